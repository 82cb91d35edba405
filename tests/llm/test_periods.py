"""Periodic runs against a direct search for every period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from evalspark.llm import periods
from evalspark.llm.queries import op13_periods

from . import brute, tables

HASHES = np.random.default_rng(1).integers(0, 2**63, 1000, dtype=np.uint64)


def runs(words):
    """[(start, length, period)]: maximal stretches for each period, least period first."""
    n, out, seen = len(words), [], set()
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(24, 3 * p) and (i, j + p) not in seen:
                seen.add((i, j + p))
                out.append((i, j + p - i, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words):
    gone = {k for s, n, p in runs(words) for k in range(s + p, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def planted(i, words):
    h = zlib.crc32(str(i).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]


def sequence(rng, n):
    kind, k = rng.randrange(6), rng.choice([1, 2, 3, 5, 50])
    words = [rng.randrange(k) for _ in range(rng.randint(0, n))]
    if kind == 1 and words:  # a tail that repeats
        a = rng.randrange(len(words))
        p = rng.randint(1, max(1, (len(words) - a) // 3))
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    elif kind == 2:  # a Fibonacci word, full of squares and nested runs, with a few faults
        x, y = [0], [0, 1]
        while len(y) < n:
            x, y = y, y + x
        words = [w if rng.random() > 0.003 else 7 for w in y[: len(words)]]
    elif kind == 3:  # highly periodic stretches inside the period of a longer run
        block = [0, 1, 1][: rng.randint(1, 3)] * rng.randint(1, 20) + [rng.randrange(3) for _ in range(rng.randint(1, 9))]
        words = (block * rng.randint(2, 5) + words[:5]) * rng.randint(1, 4)
    elif kind == 4:
        words = [1] * len(words)
    return words


@pytest.mark.parametrize("n,rounds", [(150, 250), (900, 25)])
def test_runs_of_groups_of_texts(n, rounds):
    rng = random.Random(n)
    found = 0
    for _ in range(rounds):
        docs = [sequence(rng, n) for _ in range(rng.randint(1, 5))]
        docs += docs[:1]  # equal neighbours: nothing may run over a text's end
        flat = HASHES[np.array([w for d in docs for w in d], dtype=int)]
        offs = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
        got = [[] for _ in docs]
        for s, e, p in zip(*periods.find(flat, offs)):
            at = int(np.searchsorted(offs, s, "right")) - 1
            got[at].append((int(s - offs[at]), int(e - s), int(p)))
        assert got == [runs(d) for d in docs]
        found += sum(map(len, got))
    assert found > rounds


def test_operator_on_awkward_tables(spark):
    docs = {i: t for i, t in tables.documents().items() if i != 74}
    docs |= {200: "a " * 5000, 201: "one two three four five six seven eight " * 3, 202: "w" * 100_000}
    rows = periods.find_runs(tables.frame(spark, docs).repartition(3))
    assert rows.columns == ["doc_id", "n_words", "runs", "collapsed_text"]
    got = {r.doc_id: (r.n_words, [tuple(x) for x in r.runs], r.collapsed_text) for r in rows.collect()}
    want = {}
    for i, t in docs.items():
        w = brute.words(t)
        want[i] = (len(w), runs(w), collapsed(w)) if i != 75 else got[75]
    assert got == want
    assert got[75][2] == " ".join(brute.words(docs[75]))
    assert got[201][1] == [(0, 24, 8)] and got[71][1] == [(0, 400, 1)]
    assert periods.find_runs(tables.empty(spark)).collect() == []
    twice = tables.frame(spark, {1: "a " * 30}).union(tables.frame(spark, {1: "b"}))
    assert sorted(len(r.runs) for r in periods.find_runs(twice).collect()) == [0, 1]


def test_planting(spark):
    docs = {i: " ".join(f"w{k}" for k in range(i % 37)) for i in range(300)} | {None: "a b", 9000: None}
    got = {r.doc_id: r.text for r in periods.plant(tables.frame(spark, docs)).collect()}
    assert got == {i: t if t is None or i is None else " ".join(planted(i, brute.words(t))) for i, t in docs.items()}
    assert sum(got[i] != docs[i] for i in range(300)) > 10


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    rows, some = op13_periods(spark, sf_dir).collect(), 0
    assert len(rows) == len(docs)
    for r in rows:
        words = planted(r.doc_id, re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id]))
        if len(words) > 3000:
            continue
        want = runs(words)
        best = min(want, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
        milli = 1000 * best[1] // best[2] if want else None
        lines = sha("".join(f"{s},{n},{p}\n" for s, n, p in want))
        assert tuple(r)[1:] == (len(want), *best, milli, lines, sha(collapsed(words)))
        some += bool(want)
    assert some > 5
