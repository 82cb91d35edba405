"""Near duplicates, repeated passages and repeated strings against their definitions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.llm import arrays as A
from evalspark.llm import anchors, minhash, store, substring, suffix

from . import brute, tables

LEAST = -(10**9)


def named(docs):
    """A null id as the least one, as the operators take it."""
    return {LEAST if i is None else i: t for i, t in docs.items()}


def of(row_id):
    return LEAST if row_id is None else row_id


@pytest.fixture(scope="module")
def docs():
    return tables.documents()


def test_words_and_blocks_agree_with_plain_python():
    rng = random.Random(3)
    for _ in range(60):
        texts = ["".join(rng.choice("ab \tcé") for _ in range(rng.randint(0, 50))).encode() for _ in range(4)]
        buf = np.frombuffer(b"".join(texts), np.uint8)
        offs = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        _, start, end, at = A.words(buf, offs)
        found = [buf[i:j].tobytes().decode() for i, j in zip(start, end)]
        if all(t.decode(errors="ignore").encode() == t for t in texts):
            assert found == [w for t in texts for w in brute.words(t.decode())]
        blocks = A.blocks(buf, offs, 12, 4)
        anchor = {}
        for t, key, _, s, n, left in zip(*blocks):
            for w in range(s, s + n):
                anchor.setdefault(texts[t][w : w + 12], set()).add((key, s + left - w))
        assert all(len(a) == 1 for a in anchor.values())
        assert sum(blocks.n) == sum(max(0, len(t) - 11) for t in texts)


def test_near_duplicates(spark, docs):
    want = brute.near_duplicates(named(docs))
    rows = minhash.near_duplicates(tables.frame(spark, docs)).collect()
    assert {of(r.doc_id): (r.n_shingles, of(r.component_id)) for r in rows} == want
    assert all(r.kept == (r.component_id == r.doc_id) for r in rows)


def test_near_duplicate_chain_and_rounds(spark, monkeypatch):
    """A chain of documents, each close to the next only, and a bucket compared in several blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 3)
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    docs = {}
    for i in range(30):
        words = words[:]
        words[(i * 7) % 200] = f"new{i}"
        docs[100 - i] = " ".join(words)
    rows = minhash.near_duplicates(tables.frame(spark, docs)).collect()
    want = brute.near_duplicates(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert len({c for _, c in want.values()}) == 1


def test_near_duplicates_of_repeated_rows(spark):
    text = tables.prose(random.Random(1), 60)
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (2, "something else")], "doc_id long, text string")
    rows = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect())
    assert rows == [(1, 1, True), (1, 1, True), (2, 1, False), (2, 1, False)]


def test_near_duplicates_broadcast_no_tables(spark, docs, monkeypatch):
    """The driver gets no table of the step, however small; but for the buckets that are still apart, once a round."""
    plans, write = [], store.landed

    def landed(df, purpose):
        df.collect()
        plans.append((purpose, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, purpose)

    monkeypatch.setattr(minhash, "landed", landed)
    monkeypatch.setattr(store, "landed", landed)
    landed(minhash.near_duplicates(tables.frame(spark, docs)), "test")
    assert len(plans) > 8 and not any("Broadcast" in plan for purpose, plan in plans if purpose != "apart")


def test_components_stop_at_stars(spark, monkeypatch):
    """One step for what is no star, none for stars; the same components as a plain search finds."""
    steps, write = [], store.landed
    monkeypatch.setattr(store, "landed", lambda df, purpose: steps.append(purpose) or write(df, purpose))
    stars = [(i, i % 3) for i in range(3, 30)] + [(5, 5), (3, 0)]
    found = {r.node: r.label for r in store.components(spark.createDataFrame(stars, "a long, b long")).collect()}
    assert found == {i: i % 3 for i in range(3, 30)} and len(steps) == 1
    rng = random.Random(9)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(180)] + [(500 + i, 501 + i) for i in range(40)]
    label = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(len(label)):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    found = {r.node: r.label for r in store.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: least for x, least in label.items() if x != least}
    assert store.components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize(("partners", "part_size"), [(64, 16384), (1, 16384), (1, 3)])
def test_repeated_passages(spark, docs, partners, part_size):
    want = brute.substring(named(docs))
    rows = substring.remove_repeats(tables.frame(spark, docs), partners=partners, part_size=part_size).collect()
    assert {of(r.doc_id): (r.n_words, r.n_removed, r.kept_text) for r in rows} == want


def test_cut_documents_keeps_rows_and_columns(spark, docs):
    df = tables.frame(spark, docs)
    want = brute.substring(named(docs))
    out = substring.cut_documents(df)
    assert out.columns == df.columns
    rows = {of(r.doc_id): r for r in out.collect()}
    assert rows.keys() == want.keys()
    for i, text in named(docs).items():
        assert rows[i].text == (want[i][2] if want[i][1] else text)
        assert (rows[i].id, rows[i].spans) == ("x", 7)


@pytest.mark.parametrize("limits", [{}, {"contexts": 2}, {"contexts": 2, "part_size": 2}, {"shard_bytes": 2000}])
def test_repeated_strings(spark, docs, limits):
    want = brute.byte_repeats(named(docs))
    rows = suffix.remove_repeated_strings(tables.frame(spark, docs), **limits).collect()
    assert {of(r.doc_id): (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows} == want


def test_suffix_arrays_and_common_prefixes():
    rng = random.Random(2)
    for trial in range(400):
        text = bytes(rng.randint(0, rng.randint(1, 5)) for _ in range(rng.randint(0, 60)))
        text = text[:9] * 7 if trial % 3 == 0 else text
        units = np.frombuffer(text, np.uint8)
        order = suffix.suffix_array(units)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        if len(text) > 1:
            before, after = suffix.common_prefixes(units, order)
            for r, i in enumerate(order):
                for got, k in ((before[i], r - 1), (after[i], r + 1)):
                    j = order[k] if 0 <= k < len(order) else None
                    n = 0
                    while j is not None and max(i, j) + n < len(text) and text[i + n] == text[j + n]:
                        n += 1
                    assert got == n


@pytest.mark.parametrize("operator", [minhash.near_duplicates, substring.remove_repeats, suffix.remove_repeated_strings, substring.cut_documents])
def test_empty_table(spark, operator):
    assert operator(tables.empty(spark)).collect() == []


def test_repeated_rows_of_one_id_count_once(spark):
    text = tables.prose(random.Random(4), 90)
    df = spark.createDataFrame([(1, text), (1, text), (2, "short"), (2, text + " more")], "doc_id long, text string")
    rows = {r.doc_id: r for r in substring.remove_repeats(df).collect()}
    assert len(rows) == 2 and rows[1].n_removed == 0
    strings = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in suffix.remove_repeated_strings(df).collect())
    each = [(1, text), (2, "short"), (2, text + " more")]  # no text is lost, and no copy of a row counts as a repeat
    best = brute.byte_repeats(dict(enumerate(t for _, t in each)))
    assert strings == sorted((i, *best[k][:2]) for k, (i, _) in enumerate(each))


def test_hot_keys_meet_bare_shuffles(spark):
    """Between a hot join's shuffle and its sort stands nothing that would keep adaptive execution from splitting it."""
    df = tables.empty(spark).select(F.col("doc_id").alias("id"), "text")
    plan = anchors.shared_blocks(df, 50, 16, True)._jdf.queryExecution().sparkPlan().toString()
    assert "Join" in plan and "Aggregate" not in plan and "MapInArrow" not in plan


def test_rows_without_an_id_are_documents_each(spark):
    rng = random.Random(5)
    shared, own = tables.prose(rng, 60), [tables.prose(rng, 90) for _ in range(4)]
    rows = [(None, own[0] + " " + shared), (None, own[1]), (None, own[2]), (None, own[2]), (3, own[3]), (4, shared)]
    df = spark.createDataFrame(rows + [(3, own[3])], "doc_id long, text string")
    found = sorted(((r.doc_id, r.kept_text) for r in substring.remove_repeats(df).collect()), key=str)
    want = [(None, own[0] + " " + shared), (None, own[1]), (None, own[2]), (None, ""), (3, own[3]), (4, "")]
    assert found == sorted(want, key=str)
    best = brute.byte_repeats(dict(enumerate(t for _, t in rows)))
    strings = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in suffix.remove_repeated_strings(df).collect())
    assert strings == sorted((str(i), *best[k][:2]) for k, (i, _) in enumerate(rows))
    other = spark.createDataFrame([(3, own[0]), (3, own[1])], "doc_id long, text string")
    assert {r.kept_text for r in substring.remove_repeats(other).collect()} == set(own[:2])


@pytest.mark.parametrize("part_size", [1, 2, 3])
def test_passage_repeated_in_other_surroundings_across_parts(spark, part_size):
    rng = random.Random(7)
    passage = tables.prose(rng, 60)
    around = lambda: tables.prose(rng, 30) + " " + passage + " " + tables.prose(rng, 30)
    docs = {i: around() + " " + around() if i % 2 else around() for i in range(12)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    rows = substring.remove_repeats(df, partners=1, part_size=part_size).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in rows} == brute.substring(docs)
