"""Plain versions of the operators, straight from their definitions, for small tables."""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, k=5):
    w = words(lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def near_duplicates(docs, similarity=85):
    """{id: (set size, component)} for {id: text}."""
    sets = {i: shingles(t) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(docs), 2):
        x, y = sets[a], sets[b]
        if x and y and min(len(x), len(y)) * 100 >= similarity * max(len(x), len(y)):
            both = len(x & y)
            if 100 * both >= similarity * (len(x) + len(y) - both):
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in docs}


def substring(docs, window=50):
    """{id: (words, removed, kept text)}."""
    first = {}
    for i in sorted(docs):
        w = words(docs[i])
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), i)
    out = {}
    for i, text in docs.items():
        w = words(text)
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < i:
                gone.update(range(s, s + window))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def byte_repeats(docs, length=200):
    """{id: (bytes, removed, runs, kept bytes)}."""
    seen = defaultdict(int)
    raw = {i: (t or "").encode() for i, t in docs.items()}
    for b in raw.values():
        for s in range(len(b) - length + 1):
            seen[b[s : s + length]] += 1
    out = {}
    for i, b in raw.items():
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = b"\x01" * length
        runs = len(re.findall(b"\x01+", bytes(gone)))
        out[i] = (len(b), sum(gone), runs, bytes(c for c, g in zip(b, gone) if not g))
    return out
