"""Small document tables with the awkward cases every operator must take."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, id string, spans int, score string"  # the last three clash with internal names
WORDS = "the of and to in is that it on be as are was from this with for an at by they have not you or".split()


def prose(rng: random.Random, n: int) -> str:
    pick = lambda: rng.choice(WORDS) if rng.random() < 0.4 else "".join(rng.choice("abcdefgh") for _ in range(5))
    return " ".join(pick() for _ in range(n))


def documents(seed: int = 1) -> dict[int | None, str | None]:
    rng = random.Random(seed)
    base, other, passage = prose(rng, 160), prose(rng, 300), prose(rng, 70)
    out: dict[int | None, str | None] = {10: base, 11: base, 12: None, 13: "", 14: " \t\n", 15: "one", 16: "ONE", 17: "two words"}
    for i in range(20, 32):  # near copies, some with upper case and other white space
        w = base.split(" ")
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "changed"
        out[i] = (" \n" if i % 2 else " ").join(w).upper() if i % 3 == 0 else (" \n" if i % 2 else " ").join(w)
    for i in range(40, 60):  # a passage that many share, at different places
        out[i] = prose(rng, rng.randint(0, 80)) + " " + passage + " " + prose(rng, rng.randint(0, 80))
    out[70] = " ".join([other[:400]] * 4)  # repeats itself
    out[71] = "ab " * 400
    out[72] = "ab " * 300 + "é漢 " * 90
    out[73] = other + "\n" + passage
    out[74] = prose(rng, 20000)  # very long
    out[75] = out[74][3000:90000]
    out[-5] = other
    out[None] = base + " tail"
    return out


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "x", 7, None) for i, t in docs.items()], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
