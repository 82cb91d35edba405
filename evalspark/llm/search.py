"""Exact top-k search by BM25: tokens written once, all scores of a shard at once by matrix product and postings in single
precision, exact scores for what may be among the best, one exact merge."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import arrays as A
from .store import given_id, landed, row_id

TOP = 10
K1, B = 1.2, 0.75
QUERY_TERMS = 1 << 21  # terms of all queries of one pass, about; bounds what travels to the executors
POSTINGS = 1 << 22  # of a shard, at most (a longer document is a shard of its own)
COMMON, NUMBERS = 512, 1 << 24  # terms of a pass, at most, that are multiplied as a matrix, and numbers in it
OFTEN = 1 / 256  # and the least share of (query, document) pairs that have such a term on both sides
SCORES, STEP = 1 << 20, 1 << 16  # scores of documents by queries, and products, that are worked on at once
SLACK = 1e-4  # more than twice what a sum of COMMON terms in single precision is off by, as a share of it
WAITING = 1 << 21  # documents that may be among the best of a query, held until they are scored exactly
FIRST = 8  # one in so many files is searched first, to learn how good a document must be

VECTOR = "id long, size long, terms binary, times binary"
HIT = "query long, doc long, score double"


class Queries(NamedTuple):
    ids: np.ndarray
    at: np.ndarray  # offsets by query into `term`
    term: np.ndarray  # places in `terms`
    terms: np.ndarray  # sorted hashes


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text the number of words, the sorted hashes of its distinct words, and how often each stands there."""
    for batch in batches:
        ids = A.ids(batch.column("id"))
        for lo, hi, buf, offs in A.byte_groups(batch.column("text")):
            words, _, _, at = A.words(A.LOWER[buf], offs, A.PUNCTUATION)
            for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
                words[i:j].sort()
            new = np.ones(len(words), bool)
            new[1:] = words[1:] != words[:-1]
            new[at[:-1][np.diff(at) > 0]] = True
            head = np.flatnonzero(new)
            ends = np.searchsorted(head, at)
            times = np.diff(np.append(head, len(words))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[lo:hi]), pa.array(np.diff(at)), _blobs(words[head], ends), _blobs(times, ends)],
                names=["id", "size", "terms", "times"],
            )


def _blobs(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = (ends * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _values(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of blobs, and the offset of each row."""
    buf, offs = A.text_buffer(column)
    return buf[offs[0] : offs[-1]].view(kind), (offs - offs[0]) // np.dtype(kind).itemsize


class _Terms:
    """Sorted hashes of terms with the first of each leading bits, for look-ups without a binary search."""

    def __init__(self, terms: np.ndarray):
        self.terms = terms
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(terms & A.U(len(self.seen) - 1)).astype(np.int64)] = True
        bits = min(max(len(terms).bit_length() + 1, 4), 20)
        self.shift = A.U(64 - bits)
        lead = (terms >> self.shift).astype(np.int64)
        count = np.bincount(lead, minlength=1 << bits)
        self.first = (np.cumsum(count) - count).astype(np.int32)
        self.probes = int(count.max())

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that are terms, and which they are."""
        place = np.flatnonzero(self.seen[(words & A.U(len(self.seen) - 1)).astype(np.int64)])
        word = words[place]
        term = self.first[(word >> self.shift).astype(np.int64)].astype(np.int64)
        last = len(self.terms) - 1
        left = np.arange(len(place))
        for _ in range(self.probes):
            left = left[self.terms[np.minimum(term[left], last)] != word[left]]
            if not len(left):
                break
            term[left] += 1
        hit = np.ones(len(place), bool)
        hit[left] = False
        return place[hit], term[hit]


def _found(batch: pa.RecordBatch, known: _Terms) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where in a batch of vectors query terms stand: places among all terms, rows, and the terms."""
    words, at = _values(batch.column("terms"), A.U)
    place, term = known.find(words)
    return place, np.repeat(np.arange(batch.num_rows), np.diff(at))[place], term


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(_values(batch.column("terms"), A.U)[0]).view(np.int64))], names=["term"])


def _frequencies(terms: np.ndarray):
    """Per task: in how many documents each query term stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = _Terms(terms), np.zeros(len(terms), np.int64)
        for batch in batches:
            total += np.bincount(_found(batch, known)[2], minlength=len(terms))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(terms[some].view(np.int64)), pa.array(total[some])], names=["term", "df"])

    return run


def _among(terms: np.ndarray):
    """Frequencies of these terms only, by their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Terms(terms)
        for batch in batches:
            row, term = known.find(batch.column("term").to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(term), batch.column("df").take(pa.array(row))], names=["term", "df"])

    return run


def _document_frequencies(docs: DataFrame, asked: DataFrame, at_once: int) -> DataFrame:
    """(term, df) of every term of the queries that stands in a document, counted for about `at_once` terms a pass."""
    words = landed(asked.mapInArrow(_terms, "term long").distinct(), "terms")
    passes = -(-words.count() // at_once)
    parts = []
    for number in range(passes):
        some = words.filter(F.pmod(F.xxhash64("term"), F.lit(passes)) == number).toArrow().column("term")
        if len(some):
            counts = docs.select("terms").mapInArrow(_frequencies(np.sort(some.to_numpy().view(np.uint64))), "term long, df long")
            parts.append(landed(counts.groupBy("term").agg(F.sum("df").alias("df")), "frequencies"))
    return reduce(DataFrame.union, parts) if parts else docs.sparkSession.createDataFrame([], "term long, df long")


class Asked:
    """An index of the queries: for each term those that have it, the common terms as a matrix, a row for each."""

    def __init__(self, queries: Queries, common: np.ndarray):
        self.n = len(queries.at) - 1
        query = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(queries.at))
        self.column = np.full(len(queries.terms), -1, np.int32)
        self.column[common] = np.arange(len(common))
        self.matrix = np.zeros((len(common), self.n), np.float32)
        column = self.column[queries.term]
        self.matrix[column[column >= 0], query[column >= 0]] = 1
        term, query = queries.term[column < 0], query[column < 0]
        self.query = query[np.argsort(term, kind="stable")]
        self.count = np.bincount(term, minlength=len(queries.terms))
        self.start = np.cumsum(self.count) - self.count


class Shard:
    """Some documents with the impacts of the query terms in them. `rows` ascend, and the terms of a row."""

    def __init__(self, rows, term, times, sizes, idf, mean):
        norm = K1 * (1 - B + B * sizes / mean) if mean else np.full(len(sizes), K1)
        self.n = len(sizes)
        self.row, self.terms, self.impacts = rows, term, idf[term] * times * (K1 + 1) / (times + norm[rows])
        self.rows = np.searchsorted(rows, np.arange(self.n + 1))
        self.asked = np.zeros(len(idf), bool)

    @cached_property
    def _by_term(self) -> np.ndarray:
        return np.argsort(self.terms, kind="stable")

    @cached_property
    def doc(self) -> np.ndarray:
        return self.row[self._by_term]

    @cached_property
    def impact(self) -> np.ndarray:
        return self.impacts[self._by_term]

    @cached_property
    def at(self) -> np.ndarray:
        """The first posting of each term."""
        return np.concatenate(([0], np.cumsum(np.bincount(self.terms, minlength=len(self.asked)))))

    def scores(self, asked: Asked) -> Iterator[tuple[int, np.ndarray]]:
        """Scores of some rows after others (the first of them, rows by queries) in single precision, each at most half
        of SLACK off."""
        column, n = asked.column[self.terms], asked.count[self.terms]
        common, rare = np.flatnonzero(column >= 0), np.flatnonzero(n)  # a common term counts none there
        common_at, rare_at = np.searchsorted(common, self.rows), np.searchsorted(rare, self.rows)
        step = max(1, SCORES // max(asked.n, 1))
        for lo in range(0, self.n, step):
            hi = min(lo + step, self.n)
            own = common[common_at[lo] : common_at[hi]]
            impacts = np.zeros((hi - lo, len(asked.matrix)), np.float32)
            impacts[self.row[own] - lo, column[own]] = self.impacts[own]
            out = impacts @ asked.matrix
            own = rare[rare_at[lo] : rare_at[hi]]
            self._add(out, asked, self.row[own] - lo, asked.start[self.terms[own]], n[own], self.impacts[own])
            yield lo, out

    def _add(self, out: np.ndarray, asked: Asked, row: np.ndarray, start: np.ndarray, n: np.ndarray, impact: np.ndarray) -> None:
        ends = np.cumsum(n)
        i = 0
        while i < len(n):
            done = int(ends[i - 1]) if i else 0
            j = max(int(np.searchsorted(ends, done + STEP, "right")), i + 1)
            first, last, own = row[i], row[j - 1] + 1, n[i:j]
            post = np.arange(done, ends[j - 1]) + np.repeat(start[i:j] - (ends[i:j] - own), own)
            cell = asked.query[post] + np.repeat((row[i:j] - first) * asked.n, own)
            out[first:last] += np.bincount(cell, np.repeat(impact[i:j], own), (last - first) * asked.n).reshape(-1, asked.n)
            i = j

    def exact(self, terms: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Scores of some rows. The terms of a document are added up in one order, so equal texts have equal scores."""
        if 8 * len(rows) > self.n:  # whole lists of postings cost less, and give the same scores
            lists = [slice(a, b) for a, b in zip(self.at[terms].tolist(), self.at[terms + 1].tolist())]
            docs, impacts = np.concatenate([self.doc[x] for x in lists]), np.concatenate([self.impact[x] for x in lists])
            return np.bincount(docs, impacts, self.n)[rows]
        n = self.rows[rows + 1] - self.rows[rows]
        post = np.arange(n.sum()) + np.repeat(self.rows[rows] - (np.cumsum(n) - n), n)
        self.asked[terms] = True
        hit = self.asked[self.terms[post]]
        self.asked[terms] = False
        return np.bincount(np.repeat(np.arange(len(rows)), n)[hit], self.impacts[post[hit]], len(rows))

    def top(self, terms: np.ndarray, k: int, floor: float, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of at least `floor`, the best k and all that tie with the last."""
        rows = np.setdiff1d(self.row[np.isin(self.terms, terms)], skip)
        scores = self.exact(terms, rows)
        if len(scores) >= k:
            floor = max(floor, np.partition(scores, len(scores) - k)[len(scores) - k])
        return rows[scores >= floor - 1e-9], scores[scores >= floor - 1e-9]


class Best:
    """The best k documents of each query so far. What single precision cannot rule out waits to be scored exactly."""

    def __init__(self, queries: Queries, common: np.ndarray, k: int, floors: np.ndarray):
        self.queries, self.asked, self.k = queries, Asked(queries, common), k
        self.best: list[tuple] = [(np.empty(0, np.int64), np.empty(0))] * len(queries.ids)
        self.floors = floors.copy()  # exact scores that k documents reach
        self.about = np.zeros((len(floors), k), np.float32)  # the best in single precision, of documents of their own each
        self.waiting: list[tuple] = []  # shard and ids, then query, row and score of each document
        self.n = 0

    def _least(self, some=slice(None)) -> np.ndarray:
        """What a document must reach in single precision to be among the best, perhaps."""
        least = np.maximum(self.floors[some], self.about[some].min(axis=1)) * (1 - SLACK)
        return np.maximum(least, np.finfo(np.float32).tiny).astype(np.float32)

    def add(self, shard: Shard, ids: np.ndarray) -> None:
        own = np.minimum(np.searchsorted(self.queries.ids, ids), len(self.best) - 1)  # a query does not find its own id
        same = np.flatnonzero(self.queries.ids[own] == ids)
        least = self._least()
        for lo, score in shard.scores(self.asked):
            mine = same[np.searchsorted(same, lo) : np.searchsorted(same, lo + len(score))]
            score[mine - lo, own[mine]] = 0
            some = np.flatnonzero((score >= least).any(axis=0))
            if not len(some):
                continue
            score = score[:, some]
            about = np.concatenate((self.about[some], score.T), axis=1)
            self.about[some] = np.partition(about, -self.k, axis=1)[:, -self.k :]
            least[some] = self._least(some)
            row, query = np.nonzero(score >= least[some])
            self.waiting.append((shard, ids, some[query], row + lo, score[row, query]))
            self.n += len(row)
            if self.n > WAITING:
                self.settle()
                least = self._least()

    def settle(self) -> None:
        """Score exactly what still may be among the best."""
        terms, at = self.queries.term, self.queries.at
        by_shard: dict[int, list[tuple]] = {}
        for one in self.waiting:
            by_shard.setdefault(id(one[0]), []).append(one)
        for some in by_shard.values():
            shard, ids = some[0][:2]
            query, row, score = (np.concatenate([x[i] for x in some]) for i in (2, 3, 4))
            keep = np.flatnonzero(score >= self._least()[query])
            keep = keep[np.argsort(query[keep], kind="stable")]
            query, row = query[keep], row[keep]
            head = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else query
            for i, j in zip(head.tolist(), [*head[1:].tolist(), len(query)]):
                q, rows = query[i], row[i:j]
                docs, scores = self.best[q]
                scores = np.concatenate((scores, shard.exact(terms[at[q] : at[q + 1]], rows)))
                docs = np.concatenate((docs, ids[rows]))
                keep = np.lexsort((docs, -scores))[: self.k]
                keep = keep[scores[keep] >= self.floors[q] - 1e-9]
                self.best[q] = docs[keep], scores[keep]
                if len(keep) == self.k:
                    self.floors[q] = max(self.floors[q], scores[keep[-1]])
        self.waiting, self.n = [], 0


def _shards(batch: pa.RecordBatch, known: _Terms, idf: np.ndarray, mean: float) -> Iterator[tuple[Shard, np.ndarray]]:
    """A batch of vectors in shards, and the ids of their documents."""
    ids = A.ids(batch.column("id"))
    place, rows, term = _found(batch, known)
    times, sizes = _values(batch.column("times"), np.int32)[0][place], batch.column("size").to_numpy()
    at = np.searchsorted(rows, np.arange(len(sizes) + 1))
    lo = 0
    while lo < len(sizes):
        hi = min(max(int(np.searchsorted(at, at[lo] + POSTINGS, "right")) - 1, lo + 1), len(sizes))
        own = slice(at[lo], at[hi])
        yield Shard(rows[own] - lo, term[own], times[own], sizes[lo:hi], idf, mean), ids[lo:hi]
        lo = hi


def _searcher(queries: Queries, idf: np.ndarray, mean: float, common: np.ndarray, k: int, floors: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, found = _Terms(queries.terms), Best(queries, common, k, floors)
        for batch in batches:
            for shard, ids in _shards(batch, known, idf, mean):
                found.add(shard, ids)
            found.settle()
        size = [len(d) for d, _ in found.best]
        if sum(size):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(queries.ids, size)), pa.array(np.concatenate([d for d, _ in found.best])),
                    pa.array(np.concatenate([s for _, s in found.best])),
                ],
                names=["query", "doc", "score"],
            )

    return run


def search(
    documents: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = TOP,
    query_terms: int = QUERY_TERMS,
) -> DataFrame:
    """The k best documents of each query row: query_id, rank (from 1), id, score.

    BM25 over the distinct lower-cased words of a query; number of documents, mean length and document
    frequencies are those of all documents. A query does not find rows with its own id. Ties go to the lesser
    id; documents that share no word with the query are not results. Queries without words have no rows.

    Texts are cut into words once; the vectors are written to the shared folder, as are the frequencies. Queries pass over them in blocks of
    about `query_terms` terms, the only thing that travels to the tasks. A task takes each batch of its documents as a
    shard and keeps its k best by query; each pass writes what it found. The tasks' lists merge exactly, as
    all were scored with the same statistics. Null and empty texts are documents without words. Query rows
    that share an id are one query with the greatest of their texts; documents that share one are found each.
    """
    spark = documents.sparkSession
    docs = documents.select(row_id(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    asked = queries.select(row_id(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    asked = landed(asked.groupBy("id").agg(F.max("text").alias("text")).mapInArrow(_vectors, VECTOR), "queries")
    size = asked.agg(F.expr("sum(octet_length(terms)) div 8")).first()[0] or 0
    docs = landed(docs.mapInArrow(_vectors, VECTOR), "vectors")
    count = docs.agg(F.count("*").alias("n"), F.sum("size").alias("words")).first()
    frequencies = _document_frequencies(docs, asked, query_terms)
    found = None
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc"))
    # by the number of the file, part-NNNNN
    first = F.coalesce(F.substring("_metadata.file_name", 6, 5).try_cast("int") % FIRST == 0, F.lit(False))
    passes = -(-size // query_terms)
    for number in range(passes):
        block = asked.filter(F.pmod(F.xxhash64("id"), F.lit(passes)) == number).orderBy("id").toArrow()
        words, at = _values(block.column("terms"), A.U)
        if not len(words):
            continue
        known, place = np.unique(words, return_inverse=True)
        df = frequencies.mapInArrow(_among(known), "term long, df long").toArrow()
        seen = np.zeros(len(known))
        seen[df.column("term").to_numpy()] = df.column("df").to_numpy()
        idf = np.log1p((count["n"] - seen + 0.5) / (seen + 0.5))
        vectors = Queries(block.column("id").to_numpy(), at, place, known)
        mean = (count["words"] or 0) / max(count["n"], 1)
        both = seen / max(count["n"], 1) * (np.bincount(place) / block.num_rows)  # the share of pairs that have a term
        common = np.argsort(-both, kind="stable")[: min(COMMON, NUMBERS // block.num_rows)]
        common = np.sort(common[both[common] >= OFTEN])
        floors = np.zeros(block.num_rows)
        for part in (first, ~first):
            hits = landed(docs.filter(part).mapInArrow(_searcher(vectors, idf, mean, common, k, floors), HIT), "hits")
            found = hits if found is None else found.union(hits)
            if part is first:
                last = hits.withColumn("rank", best).filter(F.col("rank") == k).toArrow()
                floors[np.searchsorted(vectors.ids, last.column("query").to_numpy())] = last.column("score").to_numpy()
    if found is None:
        found = spark.createDataFrame([], HIT)
    return found.withColumn("rank", best).filter(F.col("rank") <= k).select(
        given_id("query").alias("query_id"), "rank", given_id("doc").alias(id_col), "score"
    )
