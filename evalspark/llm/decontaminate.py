"""Benchmark decontamination: every passage of every document queries a BM25 index of the test items."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .store import given_id, row_id

PIECE = 64  # words of an item that are one entry of the index; longer items have several
PASSAGE = 128  # words of a query passage; passages overlap by half, so each run of PIECE words lies within one
THRESHOLD = 0.5  # share of its own BM25 score that an entry must reach
BLOCK = 16  # entries of the index in a block
K1, B = 1.2, 0.75
GRAM = 3  # words of a gram in the check of question and answer
QUESTION, ANSWER = 0.7, 0.5  # shares of their grams that the document must hold
LEAST_WORDS = 8  # items of fewer words say too little for shares of grams: all their words must stand in a row
SHARD_WORDS = 1 << 20  # words of test items in one index shard, about; bounds what travels to the executors

ENTRY = "item long, entry int, length int, term long, tf int, words array<long>, answer_at int, name long"
MATCH = "id long, item long, passage long, score double, question_overlap double, answer_overlap double, contaminated boolean"


class Index(NamedTuple):
    """Terms sorted by hash. Postings of a term go by block; `cell` is the (term, block) pair."""

    terms: np.ndarray
    bound: np.ndarray  # greatest impact of a term anywhere
    rare: np.ndarray  # terms whose blocks are looked at one by one; of the others only `bound` is used
    cells: np.ndarray  # offsets by term into cell_block, cell_bound
    cell_block: np.ndarray
    cell_bound: np.ndarray
    postings: np.ndarray  # offsets by cell into entry, impact
    entry: np.ndarray
    impact: np.ndarray
    blocks: int
    item: np.ndarray  # of each entry
    words: dict  # item -> (hashes of its words, first word of the answer)


def _entries(piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = A.ids(batch.column("id")), []
            answers, names = batch.column("answer_from").to_pylist(), batch.column("name").to_pylist()
            for lo, hi, buf, offs in A.byte_groups(batch.column("text")):
                hashes, start, _, at = A.words(A.LOWER[buf], offs, A.PUNCTUATION)
                for i in range(hi - lo):
                    own = hashes[at[i] : at[i + 1]]
                    if not len(own):
                        continue
                    cut = answers[lo + i]
                    first = len(own) - max(1, len(own) // 4)
                    if cut is not None:
                        first = min(int(np.searchsorted(start[at[i] : at[i + 1]], offs[i] + cut)), len(own) - 1)
                    # pieces of even length, so that no short rest is an entry of its own
                    parts = np.array_split(own, -(-len(own) // piece))
                    for e, part in enumerate(parts):
                        for k, (term, tf) in enumerate(zip(*np.unique(part, return_counts=True))):
                            words = own.view(np.int64).tolist() if not e and not k else None
                            rows.append((ids[lo + i], e, len(part), term.view(np.int64), tf, words, first, names[lo + i]))
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.int64())
                fields = [c.split()[0] for c in ENTRY.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=fields)

    return run


def build(entries: pa.Table, count: int, mean: float) -> Index:
    """An index of the collected (entry, term) rows with impacts scaled to the score of an entry on itself."""
    item, number, length, tf, df = (entries.column(c).to_numpy() for c in ("item", "entry", "length", "tf", "df"))
    term = entries.column("term").to_numpy().view(np.uint64)
    pair, entry = np.unique(np.stack([item, number], 1), axis=0, return_inverse=True)
    entry = entry.ravel()
    idf = np.log1p((count - df + 0.5) / (df + 0.5))
    weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
    impact = weight / np.bincount(entry, weight)[entry]
    terms, which = np.unique(term, return_inverse=True)
    order = np.lexsort((entry, which))
    which, entry, impact = which[order], entry[order], impact[order]
    blocks = int(entry.max()) // BLOCK + 1
    cell = which * blocks + entry // BLOCK
    heads = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    cell_term, cell_block = cell[heads] // blocks, cell[heads] % blocks
    cell_bound = np.maximum.reduceat(impact, heads)
    cells = np.searchsorted(cell_term, np.arange(len(terms) + 1))
    words = {}
    for i, w, a in zip(item.tolist(), entries.column("words").to_pylist(), entries.column("answer_at").to_pylist()):
        if w is not None:
            words[i] = (np.array(w, np.int64).view(np.uint64), a)
    return Index(
        terms, np.maximum.reduceat(cell_bound, cells[:-1]), np.diff(cells) <= max(2, blocks // 8), cells, cell_block,
        cell_bound, np.append(heads, len(entry)), entry, impact, blocks, pair[:, 0], words,
    )


def _expand(rows: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the places offsets[row] .. offsets[row + 1]: (position in rows, place)."""
    n = offsets[rows + 1] - offsets[rows]
    of = np.repeat(np.arange(len(rows)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offsets[rows], n)


def retrieve(index: Index, term: np.ndarray, place: np.ndarray, passages: np.ndarray, threshold: float):
    """(passage, entry, score) for every pair that reaches the threshold. `term` and `place` are the index's
    terms in the texts and their word places, `passages` the first word of each passage.

    Block-max WAND over all passages at once: a passage whose terms' bounds do not reach the threshold is
    dropped; then a block of entries whose own bounds, with the bounds of the frequent terms, do not; only
    what is left is scored in full. Nothing that reaches the threshold can be dropped."""
    order = np.lexsort((place, term))
    t, p = term[order], place[order]
    before = np.full(len(t), -1)
    again = np.flatnonzero(t[1:] == t[:-1]) + 1
    before[again] = p[again - 1]
    # a word lies in the passages that start at most PASSAGE before it; a term counts where it stands first
    low = np.searchsorted(passages[:, 0], p - PASSAGE + 1)
    high = np.searchsorted(passages[:, 0], p, "right")
    n = high - low
    of = np.repeat(np.arange(len(t)), n)
    passage = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    inside = (p[of] < passages[passage, 1]) & (before[of] < passages[passage, 0])
    passage, t = passage[inside], t[of[inside]]
    bound = np.bincount(passage, index.bound[t], len(passages))
    alive = bound[passage] >= threshold - 1e-9
    passage, t = passage[alive], t[alive]
    rare = index.rare[t]
    common = np.bincount(passage[~rare], index.bound[t[~rare]], len(passages))
    of, cell = _expand(t[rare], index.cells)
    pair = passage[rare][of] * index.blocks + index.cell_block[cell]
    pairs, back = np.unique(pair, return_inverse=True)
    reach = np.bincount(back, index.cell_bound[cell], len(pairs)) + common[pairs // index.blocks]
    pairs = pairs[reach >= threshold - 1e-9]
    # passages whose frequent terms alone reach the threshold meet all blocks
    heavy = np.flatnonzero(common >= threshold - 1e-9)
    if len(heavy):
        every = (heavy[:, None] * index.blocks + np.arange(index.blocks)).ravel()
        pairs = np.union1d(pairs, every)
    if not len(pairs):
        return pairs, pairs, np.empty(0)
    wanted = np.isin(passage, np.unique(pairs // index.blocks))
    passage, t = passage[wanted], t[wanted]
    of, cell = _expand(t, index.cells)
    pair = passage[of] * index.blocks + index.cell_block[cell]
    at = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
    ok = pairs[at] == pair
    of2, post = _expand(cell[ok], index.postings)
    key = pair[ok][of2] // index.blocks * (index.blocks * BLOCK) + index.entry[post]
    keys, back = np.unique(key, return_inverse=True)
    score = np.bincount(back, index.impact[post], len(keys))
    good = score >= threshold - 1e-9
    return keys[good] // (index.blocks * BLOCK), keys[good] % (index.blocks * BLOCK), score[good]


def _grams(words: np.ndarray, k: int) -> np.ndarray:
    k = min(k, len(words))
    prefix = A.SHINGLES.prefix(words)
    n = len(words) - k + 1
    return np.unique(A.SHINGLES.of(prefix, np.arange(n), np.arange(k, k + n))) if k else A.EMPTY


def _overlap(part: np.ndarray, near: np.ndarray) -> float:
    grams = _grams(part, GRAM)
    return float(np.isin(grams, _grams_of(near, min(GRAM, len(part)))).mean()) if len(grams) else 0.0


def _grams_of(words: np.ndarray, k: int) -> np.ndarray:
    return _grams(words, k) if len(words) >= k else A.EMPTY


def _holds(near: np.ndarray, words: np.ndarray) -> bool:
    """Whether all the words stand in `near`, one after the other."""
    if len(near) < len(words):
        return False
    return bool((np.lib.stride_tricks.sliding_window_view(near, len(words)) == words).all(axis=1).any())


def _found(words: np.ndarray, answer: int, near: np.ndarray) -> tuple[float, float, bool]:
    """Overlaps of question and answer with the words near a passage, and the verdict."""
    question, reply = _overlap(words[:answer], near), _overlap(words[answer:], near)
    if len(words) >= LEAST_WORDS:
        return question, reply, question >= QUESTION and reply >= ANSWER
    return (1.0, 1.0, True) if _holds(near, words) else (question, reply, False)


def _matcher(index: Index, names: dict[int, int], threshold: float):
    """`names` are the given ids of the index's items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << 20, bool)
        seen[(index.terms & A.U(len(seen) - 1)).astype(np.int64)] = True
        for batch in batches:
            ids = A.ids(batch.column("id"))
            for lo, hi, buf, offs in A.byte_groups(batch.column("text")):
                hashes, _, _, at = A.words(A.LOWER[buf], offs, A.PUNCTUATION)
                place = np.flatnonzero(seen[(hashes & A.U(len(seen) - 1)).astype(np.int64)])
                term = np.minimum(np.searchsorted(index.terms, hashes[place]), len(index.terms) - 1)
                known = index.terms[term] == hashes[place]
                place, term = place[known], term[known]
                if not len(place):
                    continue
                half = PASSAGE // 2
                n = np.maximum(1, -(-(np.diff(at) - half) // half))
                doc = np.repeat(np.arange(hi - lo), n)
                first = at[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * half
                passages = np.stack([first, np.minimum(first + PASSAGE, at[doc + 1])], 1)
                passage, entry, score = retrieve(index, term, place, passages, threshold)
                best: dict[tuple[int, int], tuple] = {}
                for k in np.lexsort((entry, passage, -score)):
                    row, item = int(doc[passage[k]]), int(index.item[entry[k]])
                    words, answer = index.words[item]
                    begin, end = passages[passage[k]]
                    near = hashes[max(at[row], begin - len(words)) : min(at[row + 1], end + len(words))]
                    found = (int(begin - at[row]), float(score[k]), *_found(words, answer, near))
                    old = best.get((row, item))
                    if old is None or (found[4], min(found[2:4])) > (old[4], min(old[2:4])):
                        best[row, item] = found
                if best:
                    rows = [(ids[lo + r], names[i], *found) for (r, i), found in sorted(best.items())]
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_())
                    fields = [c.split()[0] for c in MATCH.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=fields)

    return run


def matches(
    documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", answer_from: str | None = None, threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per document and test item of which a passage reaches the threshold: id, item, passage (its
    first word), score (share of the item's own BM25 score), question_overlap, answer_overlap (shares of
    their word grams found near the passage), contaminated (both overlaps are high enough).

    Words are lower-cased (A-Z) and split at white space and ASCII punctuation. `answer_from` names a column
    of byte offsets where an item's answer begins; without it the last quarter of the words is the answer.
    The index is built in shards of about SHARD_WORDS words of items, and every passage queries each shard;
    counts of documents and terms are those of all items. Texts without words match nothing. Items of fewer than
    LEAST_WORDS words contaminate a document that holds all their words in a row (both overlaps are 1 then). Null ids count as one id below the others and come back as null; rows
    that share a document id are searched each, and so are the texts that share an item id; they give rows each.
    Of several passages the one reported is contaminated if any is, then that of the greatest lesser overlap.
    """
    docs = documents.select(row_id(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    cut = F.col(answer_from).cast("int") if answer_from else F.lit(None).cast("int")
    asked = items.select(row_id(item_col).alias("id"), F.col(item_text_col).cast("string").alias("text"), cut.alias("answer_from"))
    # one item for each id and text; the answer's place tells apart what else is equal
    asked = asked.distinct().select(F.xxhash64("id", "text", "answer_from").alias("id"), F.col("id").alias("name"), "text", "answer_from")
    entries = asked.mapInArrow(_entries(PIECE), ENTRY)
    pieces = entries.groupBy("item", "entry").agg(F.max("length").alias("length"))
    size = pieces.agg(F.count("*").alias("n"), F.sum("length").alias("words")).first()
    frequency = entries.groupBy("term").agg(F.count("*").alias("df"))
    found = None
    shards = max(1, -(-(size["words"] or 0) // SHARD_WORDS))
    for shard in range(shards if size["n"] else 0):
        part = entries.filter(F.pmod(F.xxhash64("item"), F.lit(shards)) == shard).join(frequency, "term").toArrow()
        if part.num_rows:
            index = build(part.combine_chunks(), size["n"], size["words"] / size["n"])
            named = part.select(["item", "name"]).group_by(["item", "name"]).aggregate([])  # a row an item, not a term
            names = dict(zip(named.column("item").to_pylist(), named.column("name").to_pylist()))
            own = docs.mapInArrow(_matcher(index, names, threshold), MATCH)
            found = own if found is None else found.union(own)
    if found is None:
        found = documents.sparkSession.createDataFrame([], MATCH)
    return found.select(
        given_id("id").alias(id_col), given_id("item").alias(item_col), "passage", "score", "question_overlap",
        "answer_overlap", "contaminated",
    )
