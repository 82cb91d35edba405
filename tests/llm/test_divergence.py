"""Source divergence: the pointer sort and the whole audit against plain versions."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.llm import divergence
from evalspark.llm.arrays import LOWER

from . import tables

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(text or "")]


def audit(rows, least=10, top=10):
    """{(lang, source, part, item, value, rank)} of rows (lang, source, text), straight from the definition."""
    rows = [tuple(x or "" for x in r) for r in rows]
    docs, count = Counter(), defaultdict(Counter)
    sources = defaultdict(set)
    for lang, source, text in rows:
        sources[lang].add(source)
        found = terms(text)
        docs.update((lang, t) for t in set(found))
        count[lang, source].update(found)
        count[lang].update(found)
    out = set()
    for lang in sources:
        kept = [t for (x, t), n in docs.items() if x == lang and n >= least]

        def shares(key):
            total = sum(count[key][t] for t in kept)
            return {t: 1 + 10**9 * (count[key][t] + 2) // (total + 2 * len(kept)) for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        whole, each = shares(lang), {s: shares((lang, s)) for s in sources[lang]}
        for s in sources[lang]:
            pair = [(x, sum(f(each[s][t], each[x][t]) for t in kept)) for x in sources[lang] if x != s]
            own = [(t, f(each[s][t], whole[t])) for t in kept if count[lang, s][t] and each[s][t] > whole[t]]
            for part, items in (("pair", pair), ("term", own)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(items) if part == "pair" or k < top}
    return out


@pytest.mark.parametrize("few", [2, 64, 4096])
def test_pointer_sort(monkeypatch, few):
    monkeypatch.setattr(divergence, "FEW", few)
    rng = random.Random(few)
    for _ in range(60):
        texts = [
            "".join(
                rng.choice("abcABCé漢 .1 ") if rng.random() < 0.8 else rng.choice(["aaaaaaaabbbbbbbb" * rng.randint(1, 12), " ", "the "])
                for _ in range(rng.randint(0, rng.choice([3, 30, 600])))
            ).encode()
            for _ in range(rng.randint(1, 4))
        ]
        buf = LOWER[np.frombuffer(b"".join(texts), np.uint8)]
        start, end, _ = divergence.pointers(buf, np.concatenate(([0], np.cumsum([len(t) for t in texts]))))
        words = [buf.tobytes()[a:b] for a, b in zip(start, end)]
        assert sorted(words) == sorted(w.encode() for t in texts for w in terms(t.decode()))
        order, new = divergence.multikey_sort(buf, start, end)
        want = sorted(range(len(words)), key=words.__getitem__)
        assert order.tolist() == want
        assert new.tolist() == [i == 0 or words[want[i]] != words[want[i - 1]] for i in range(len(want))]


@pytest.mark.parametrize("block,shard", [(128, 1 << 20), (2, 100)])
def test_audit(spark, monkeypatch, block, shard):
    monkeypatch.setattr(divergence, "SHARD_BYTES", shard)
    rng = random.Random(4)
    rows = [
        (rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "b", "b", "ü", "z", None]), tables.prose(rng, rng.randint(0, 40)).upper() + rng.choice([" Straße漢", ""]))
        for _ in range(300)
    ]
    rows += [("fr", "a", None), ("fr", "c", ""), ("fr", "d", "rare 1 2"), ("it", "only", "x"), ("en", "silent", "123 !"), ("en", "b", "same " * 50)] * 2
    df = spark.createDataFrame([(i, *r, "x", 7) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, term string, n int")
    got = divergence.audit(df.repartition(5), block=block)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert {tuple(r) for r in got.collect()} == audit(rows)
    assert divergence.audit(df.limit(0)).collect() == []


def test_long_texts_and_names_of_columns(spark):
    docs = tables.documents()
    rows = [("x", str(i), t) for i, t in docs.items()]
    rows.append(("x", "blob", "z" * 300_000 + " " + "z" * 300_000))
    df = spark.createDataFrame(rows, "tongue string, place string, words string")
    got = divergence.audit(df, "tongue", "place", "words", least=2, top=3)
    assert {tuple(r) for r in got.collect()} == audit(rows, 2, 3)


def test_shares_are_exact_at_any_count(spark):
    big = 4 * 10**17
    df = spark.createDataFrame([(big, 3 * big, 12345)], "n long, total long, kinds long")
    assert df.select(divergence.share("n", "total")).first()[0] == 1 + 10**9 * (big + 2) // (3 * big + 2 * 12345)
    df = spark.createDataFrame([(10**9 + 1, 1), (7, 5)], "p long, q long")
    assert [r[0] for r in df.select(divergence.divergence("p", "q")).collect()] == [10**18 // (10**9 + 2), 0]


def test_counts_combine_before_the_shuffle(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text")
    plan = divergence.term_counts(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.index("partial_sum")
    n = divergence.term_counts(docs).agg(F.sum("n")).first()[0]
    assert n == sum(len(terms(r.text)) for r in docs.collect())
