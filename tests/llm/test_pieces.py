"""Sampled segmentations: distribution, distinctness, inclusion, exact round trips."""

from __future__ import annotations

import math
import os
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from evalspark.llm import pieces, queries

from . import tables

MODEL = os.environ.get("PIECE_MODEL", pieces.MODEL)
pytestmark = pytest.mark.skipif(not os.path.exists(MODEL), reason="no model file")


@pytest.fixture(scope="module")
def model():
    return pieces.load(MODEL)


def sampled(model, texts, samples, seed=17):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["id", "text"])
    return [r for out in pieces._encoder(model, samples, seed)(iter([batch])) for r in out.to_pylist()]


def segmentations(model, text):
    known = {model.texts[i]: (int(i), w) for i, w in zip(model.ids, model.weights)}
    raw, out = (" " + text).encode(), {}

    def walk(at, ids, weight):
        if at == len(raw):
            out[ids] = weight
        for end in range(at + 1, len(raw) + 1):
            if raw[at:end] in known:
                walk(end, (*ids, known[raw[at:end]][0]), weight + known[raw[at:end]][1])

    walk(0, (), 0.0)
    total = np.logaddexp.reduce(list(out.values()))
    return {ids: math.exp(w - total) for ids, w in out.items()}


def test_first_and_second_sample_follow_the_distribution(model):
    chance = segmentations(model, "hello ab")
    n = 8000
    rows = sampled(model, ["hello ab"] * n, 3)
    first = Counter(tuple(r["ids"]) for r in rows if r["sample"] == 0)
    second = Counter(tuple(r["ids"]) for r in rows if r["sample"] == 1)
    for ids in sorted(chance, key=chance.get, reverse=True)[:4]:
        then = sum(chance[o] * chance[ids] / (1 - chance[o]) for o in chance if o != ids)
        assert abs(first[ids] / n - chance[ids]) < 0.02 and abs(second[ids] / n - then) < 0.02
    assert max(abs(r["log_prob"] - math.log(chance[tuple(r["ids"])])) for r in rows) < 1e-9
    weight = defaultdict(float)  # weighted by inverse inclusion the samples estimate a total of 1
    for r in rows:
        weight[r["id"]] += chance[tuple(r["ids"])] / math.exp(r["log_inclusion"])
    assert abs(np.mean(list(weight.values())) - 1) < 0.01


def test_few_segmentations_give_few_samples(model):
    count = len(segmentations(model, "ab"))
    rows = sampled(model, ["ab"], count + 5)
    assert len(rows) == count and len({tuple(r["ids"]) for r in rows}) == count
    assert all(abs(r["log_inclusion"]) < 1e-9 for r in rows)


def test_rows_do_not_depend_on_their_neighbours(model):
    texts = ["some words here", "x" * 300, "", "some words here"]
    alone = sampled(model, texts[:1], 2)
    assert [r for r in sampled(model, texts, 2) if r["id"] == 0] == alone


def test_round_trip_and_awkward_texts(spark, model):
    docs = tables.documents()
    docs |= {80: "tabs\tand  spaces ", 81: " leading", 82: "▁ mark ▁▁", 83: "emoji 🙂 漢字 \x00", 84: "x" * 5000}
    rows = pieces.decode(pieces.encode(tables.frame(spark, docs), model), model).collect()
    assert all(r.decoded == (docs[r.doc_id] or "") for r in rows)
    seen = defaultdict(list)
    for r in rows:
        seen[r.doc_id].append(tuple(r.ids))
    assert seen.keys() == docs.keys()
    assert all(len(set(s)) == len(s) for s in seen.values())
    assert all(len(s) == 1 and not s[0] for i, s in seen.items() if not docs[i])
    assert pieces.encode(tables.empty(spark), model).collect() == []


def test_best_left_options_equal_a_plain_search(model):
    """After each walk the best option not taken of each choice, and the next one once it is taken."""
    buf = np.frombuffer(b" some wordy words", np.uint8)
    net = pieces.lattice(model, buf, np.array([0, 5, 11, 17]))
    ends = np.flatnonzero(net.border)[1:]
    none = np.zeros(len(ends), np.int64)
    walked = pieces.walk(net, np.array([7], np.uint64), none, np.arange(len(ends)), ends, none, 0, none)
    for k in range(len(walked.text)):
        own = slice(walked.head[k], walked.head[k] + walked.count[k])
        times = walked.time[own][walked.options[own] != walked.edge[k]]
        assert walked.second[k] == min(times, default=np.inf) >= walked.least[k]
        assert np.isinf(walked.time[own][walked.options[own] == walked.edge[k]]).all()
    top = np.full(len(walked.text), 0.5)  # the same as by perturbed scores
    with np.errstate(divide="ignore"):
        gap = np.log1p(-walked.least / walked.second)
        want = 0.5 - np.logaddexp(0, gap + 0.5 + np.log(walked.second))
    got = pieces._truncated(walked.second, walked.least, np.zeros(len(top)), top)
    some = np.isfinite(walked.second)
    assert some.any() and np.allclose(got[some], want[some]) and np.isneginf(got[~some]).all()


def test_decoded_in_the_same_task(spark, model):
    """What the encoder decodes itself is what `decode` gives, with one Python step in the plan; so in the query."""
    docs = tables.documents() | {83: "emoji 🙂 漢字 \x00", 84: "x" * 5000, 85: "\ufffd  two"}
    frame = tables.frame(spark, docs)
    found = pieces.encode(frame, model, decoded=True)
    key = lambda r: (r.doc_id is None, r.doc_id, r.sample)
    assert sorted(found.collect(), key=key) == sorted(pieces.decode(pieces.encode(frame, model), model).collect(), key=key)
    plan = queries.op4_sentencepiece(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert pieces.encode(tables.empty(spark), model, decoded=True).collect() == []
