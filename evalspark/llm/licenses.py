"""Licence scans: passages compared to licence templates by Dice coefficient over word bigrams."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .store import given_id, row_id
from .templates import TEMPLATES

THRESHOLD = 0.85
SEPARATORS = A.PUNCTUATION  # punctuation and white space are normalised away, A-Z lower-cased
MATCH = "id long, license string, first_word long, n_words long, dice double"


class Template(NamedTuple):
    name: str
    size: int  # distinct bigrams
    grams: np.ndarray


def bigrams(words: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring words; a text of one word has that word alone."""
    if len(words) < 2:
        return A.mix(words + A.U(3))
    return A.mix(words[:-1] * A.U(0x9E3779B97F4A7C15) + words[1:])


def prepare(templates: dict[str, str] = TEMPLATES) -> list[Template]:
    """Templates by size. Texts without words are left out."""
    out = []
    for name, text in templates.items():
        raw = np.frombuffer((text or "").encode(), np.uint8)
        words = A.words(A.LOWER[raw], np.array([0, len(raw)]), SEPARATORS)[0]
        grams = np.unique(bigrams(words))
        if len(grams):
            out.append(Template(name, len(grams), grams))
    return sorted(out, key=lambda t: (t.size, t.name))


def size_bounds(size: int, threshold: float) -> tuple[int, int]:
    """Sizes a bigram set may have to reach the Dice coefficient with one of `size`: 2 min / (a + b) >= t."""
    return int(np.ceil(threshold * size / (2 - threshold) - 1e-9)), int(np.floor((2 - threshold) * size / threshold + 1e-9))


def _passages(templates: list[Template], threshold: float):
    known = np.unique(np.concatenate([t.grams for t in templates])) if templates else A.EMPTY
    sizes = [size_bounds(t.size, threshold) for t in templates]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << 20, bool)
        seen[(known & A.U(len(seen) - 1)).astype(np.int64)] = True
        member = [np.isin(known, t.grams) for t in templates]
        names = [c.split()[0] for c in MATCH.split(", ")]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64())
        for batch in batches:
            ids = A.ids(batch.column("id"))
            for lo, hi, buf, offs in A.byte_groups(batch.column("text")):
                words, _, _, at = A.words(A.LOWER[buf], offs, SEPARATORS)
                pair = A.mix(words[:-1] * A.U(0x9E3779B97F4A7C15) + words[1:])
                # one-word texts and templates are rare and go the plain way
                place = np.flatnonzero(seen[(pair & A.U(len(seen) - 1)).astype(np.int64)])
                which = np.minimum(np.searchsorted(known, pair[place]), max(len(known) - 1, 0)) if len(known) else place
                hit = (known[which] == pair[place]) if len(known) else np.zeros(len(place), bool)
                place, which = place[hit], which[hit]
                row = np.searchsorted(at, place, "right") - 1
                inside = place + 1 < at[row + 1]  # both words in one text
                place, which, row = place[inside], which[inside], row[inside]
                found = []
                for t, own, (least, most) in zip(templates, member, sizes):
                    mine = own[which]
                    if mine.any():
                        found += _best(t, place[mine], which[mine], row[mine], pair, at, least, most, threshold)
                singles = np.flatnonzero(np.diff(at) == 1)
                for t in templates:
                    if t.size == 1 and len(singles):
                        match = singles[A.mix(words[at[singles]] + A.U(3)) == t.grams[0]]
                        found += [(r, t.name, 0, 1, 1.0) for r in match.tolist()]
                if found:
                    rows = [(ids[lo + r], *rest) for r, *rest in _apart(found, at)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


def _best(t, place, which, row, pair, at, least, most, threshold):
    """Windows of the template's length in bigrams, one ending at each of its bigrams in the text, that share
    enough with it. Windows with too few of its bigrams by count are pruned before any set is built."""
    first = np.maximum(place - (most - 1), at[row])
    before = np.searchsorted(place, first)
    count = np.arange(len(place)) - before + 1  # template bigrams in the longest window that ends here
    need = int(np.ceil(threshold * (least + t.size) / 2 - 1e-9))
    out = []
    for k in np.flatnonzero(count >= need).tolist():
        own = place[before[k] : k + 1]
        # a passage begins and ends with a bigram of the template
        sizes = place[k] - own + 1
        ok = np.flatnonzero(sizes >= least)
        if not len(ok):
            continue
        best = None
        distinct_common = _distinct_suffix(which[before[k] : k + 1])
        for j in ok[np.argsort(-distinct_common[ok], kind="stable")].tolist():
            if best is not None and 2 * distinct_common[j] / (t.size + distinct_common[j]) <= best[0]:
                break
            total = len(np.unique(pair[own[j] : place[k] + 1]))
            dice = 2 * distinct_common[j] / (total + t.size)
            if dice >= threshold - 1e-12 and (best is None or dice > best[0]):
                best = (dice, int(own[j]))
        if best:
            r = int(row[k])
            out.append((r, t.name, best[1] - int(at[r]), int(place[k]) - best[1] + 2, float(best[0])))
    return out


def _distinct_suffix(which: np.ndarray) -> np.ndarray:
    """For each place the number of different values from it to the end."""
    _, last = np.unique(which[::-1], return_index=True)
    new = np.zeros(len(which), np.int64)
    new[len(which) - 1 - last] = 1
    return np.cumsum(new[::-1])[::-1]


def _apart(found, at):
    """Of overlapping matches in a text the one of greatest coefficient, then most words, then earliest."""
    out, used = [], {}
    for r, name, first, n, dice in sorted(found, key=lambda f: (f[0], -f[4], -f[3], f[2], f[1])):
        spans = used.setdefault(r, [])
        if all(first + n <= a or first >= b for a, b in spans):
            spans.append((first, first + n))
            out.append((r, name, first, n, dice))
    return sorted(out)


def scan(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per passage that matches a template: id, license, first_word, n_words, dice.

    Text and templates are lower-cased and split at white space and ASCII punctuation. A passage is a run of
    words that begins and ends with a bigram of the template and whose set of bigrams has a Dice coefficient
    of at least `threshold` with the template's. Size bounds prune twice: only passages of
    t * n / (2 - t) to (2 - t) * n / t bigrams can match a template of n, and only where so many bigrams of
    the template stand that close together is a set built at all. Of passages that overlap the best stays.
    Passages are found anywhere in a text, also several in one.

    Null and empty texts match nothing; rows that share an id are scanned each; null ids come back as null.
    The templates are a small fixed table and travel with the function.
    """
    ready = prepare(templates)
    docs = documents.select(row_id(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(_passages(ready, threshold), MATCH).withColumn("id", given_id("id")).withColumnRenamed("id", id_col)
