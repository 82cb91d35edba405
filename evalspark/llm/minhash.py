"""Near-duplicate documents by min-max hashing, with every link confirmed on the full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .store import components, given_id, landed, row_id

SHINGLE = 5
PERMUTATIONS = 64  # each gives two signature values, its least and its greatest hash
ROWS = 4  # signature values in a band
SIMILARITY = 85  # per cent
SKETCH = 2048  # bits of a set's parity sketch
BLOCK = 256  # members of a bucket that meet one another in one task

SIGNED = "id long, n long, h1 long, h2 long, bands array<long>, sketch binary"


def shingle_sets(column: pa.Array, shingle: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted distinct shingle hashes of the texts one after the other, offsets by text)."""
    for lo, _, buf, offs in A.byte_groups(column):
        hashes, _, _, at = A.words(A.LOWER[buf], offs)
        grams, at = A.ngrams(hashes, at, shingle)
        sets = [np.unique(grams[i:j]) for i, j in zip(at[:-1], at[1:])]
        yield lo, np.concatenate([A.EMPTY, *sets]), np.concatenate(([0], np.cumsum([len(s) for s in sets])))


def _signer(shingle: int, permutations: int, rows: int):
    rng = np.random.default_rng(5)
    scale = rng.integers(1, 2**63, permutations, dtype=np.uint64) * A.U(2) + A.U(1)
    shift = rng.integers(0, 2**63, permutations, dtype=np.uint64)
    mixer = A.Roller(7)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = A.ids(batch.column("id"))
            for lo, sets, at in shingle_sets(batch.column("text"), shingle):
                n = np.diff(at)
                full = np.flatnonzero(n)
                sig = np.zeros((len(n), 2 * permutations), np.uint64)
                if len(full):
                    heads = at[:-1][full]
                    for p in range(permutations):
                        value = sets * scale[p] + shift[p]
                        sig[full, 2 * p] = np.minimum.reduceat(value, heads)
                        sig[full, 2 * p + 1] = np.maximum.reduceat(value, heads)
                total = np.concatenate((np.zeros(1, A.U), np.cumsum(A.mix(sets))))
                other = np.concatenate((np.zeros(1, A.U), np.cumsum(A.mix(sets ^ A.U(0x5851F42D4C957F2D)))))
                width = sig.shape[1] // rows
                parts = sig.reshape(len(n) * width, rows)
                band = np.tile(np.arange(width, dtype=np.uint64), len(n))
                for r in range(rows):
                    band = A.mix(band * mixer.base + parts[:, r])
                band = band.reshape(len(n), width)
                sizes = np.where(n > 0, width, 0)
                bit = np.repeat(np.arange(len(n)) * SKETCH, n) + (A.mix(sets) % A.U(SKETCH)).astype(np.int64)
                odd = np.packbits(np.bincount(bit, minlength=len(n) * SKETCH).astype(np.uint8) & 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[lo : lo + len(n)]), pa.array(n.astype(np.int64)),
                        pa.array((total[at[1:]] - total[at[:-1]]).view(np.int64)),
                        pa.array((other[at[1:]] - other[at[:-1]]).view(np.int64)),
                        pa.ListArray.from_arrays(
                            pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)),
                            pa.array(band[full].ravel().view(np.int64)),
                        ),
                        pa.array([x.tobytes() for x in odd.reshape(len(n), -1)], pa.binary()),
                    ],
                    names=["id", "n", "h1", "h2", "bands", "sketch"],
                )

    return sign


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = A.ids(batch.column("id"))
            for lo, sets, at in shingle_sets(batch.column("text"), shingle):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[lo : lo + len(at) - 1]),
                        pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(sets.view(np.int64))),
                    ],
                    names=["id", "grams"],
                )

    return run


def _pairs_in_block(similarity: int, top: int):
    """Of the members of two blocks of one bucket: pairs of different labels whose sketches allow a link. For
    each member the `top` likeliest; `more` tells whether others were left for later."""

    def first(of: np.ndarray, alike: np.ndarray) -> np.ndarray:
        order = np.lexsort((-alike, of))
        heads = np.flatnonzero(np.append(True, of[order][1:] != of[order][:-1])) if len(of) else of
        keep = np.empty(len(order), bool)
        keep[order] = np.arange(len(order)) - np.repeat(heads, np.diff(np.append(heads, len(order)))) < top
        return keep

    def run(part: pa.Table) -> pa.Table:
        label, n, rep, side, lo, hi = (part.column(c).to_numpy() for c in ("label", "n", "rep", "block", "lo", "hi"))
        order = np.argsort(rep)
        sketch = _sketches(part.column("sketch"))[order]
        label, n, rep, side = label[order], n[order], rep[order], side[order]
        a, b = np.flatnonzero(side == lo[0]), np.flatnonzero(side == hi[0])
        ok = label[a][:, None] != label[b][None, :]
        if lo[0] == hi[0]:
            ok &= a[:, None] < b[None, :]
        i, j = np.nonzero(ok)
        i, j = a[i], b[j]
        differ, possible = _differ(sketch, n, i, j, similarity)
        i, j, differ = i[possible], j[possible], differ[possible] / (n[i] + n[j])[possible]
        keep = first(i, differ) | first(j, differ)
        more = pa.array(np.full(keep.sum(), not keep.all()), pa.bool_())
        return pa.table({"a": rep[i][keep], "b": rep[j][keep], "more": more})

    return run


def _sketches(column) -> np.ndarray:
    buf, offs = A.text_buffer(column)
    return buf[offs[0] : offs[-1]].reshape(len(offs) - 1, -1).view(np.uint64)


def _differ(sketch: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: int):
    """Bits in which two sketches differ, never more than the elements in one set only, and whether the pair
    can reach the similarity s with that many: |A| + |B| = 2 both + apart and 100 both >= s (both + apart)
    give (100 + s) * apart <= (100 - s) * (|A| + |B|). So no pair that is linked is turned away."""
    differ = np.empty(len(i), np.int64)
    for at in range(0, len(i), 8192):
        differ[at : at + 8192] = np.bitwise_count(sketch[i[at : at + 8192]] ^ sketch[j[at : at + 8192]]).sum(axis=1)
    total = n[i] + n[j]
    return differ, (100 + similarity) * differ <= (100 - similarity) * total


def _likely(similarity: int):
    """Pairs whose sketches allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            both = np.concatenate([_sketches(batch.column("sa")), _sketches(batch.column("sb"))])
            n = np.concatenate([batch.column(c).to_numpy() for c in ("na", "nb")])
            rows = np.arange(batch.num_rows)
            _, possible = _differ(both, n, rows, rows + batch.num_rows, similarity)
            yield batch.select(["a", "b"]).filter(pa.array(possible))

    return run


def confirm(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= similarity * union of their full sets."""
    left = sets.select(F.col("id").alias("a"), F.col("grams").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("grams").alias("y"))
    met = pairs.join(_merged(left), "a").join(_merged(right), "b").withColumn("both", F.size(F.array_intersect("x", "y")))
    union = F.size("x") + F.size("y") - F.col("both")
    return met.filter(100 * F.col("both") >= similarity * union).select("a", "b")


def _merged(rows: DataFrame) -> DataFrame:
    """Joined by sorting at every size. These tables are joined over and over; small ones would else be broadcast each
    time, and the driver would hold all of them until it collects its garbage."""
    return rows.hint("merge")


def near_duplicates(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
    similarity: int = SIMILARITY, permutations: int = PERMUTATIONS, rows: int = ROWS,
) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the least id reachable over links), kept.

    Two documents are linked if their shingle sets have 100 * intersection >= similarity * union.

    1. Min-max hashing: of each permutation both the least and the greatest hash are kept, so 64 hash
       evaluations per shingle give 128 signature values, cut into 32 bands of 4. A pair of Jaccard
       similarity 0.85 shares no band with probability (1 - 0.85^4)^32, about 5e-11.
    2. Documents with equal sets become one class, represented by the least id, before anything is paired.
    3. Buckets with the same members count once. In each bucket every member is compared with the least one;
       confirmed links give components. A parity sketch of each set tells beforehand that two sets differ
       in too many elements; it never turns a linked pair away.
    4. Buckets that still hold several components are compared in blocks, never as a list of all pairs:
       each member meets its likeliest partner of another component first, and the next round, with four
       times as many, only sees what is still apart. It ends when no likely pair between components is left.

    Null or blank texts have no shingles and no links. A null id counts as an id below all others and
    comes back as null. Rows that share an id are one node: each comes back, with the links of all.
    """
    docs = documents.select(row_id(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = landed(docs.mapInArrow(_signer(shingle, permutations, rows), SIGNED), "signatures")
    # written, so that the join with it at the end can be split on a class of very many copies
    classes = landed(signed.filter("n > 0").groupBy("n", "h1", "h2").agg(F.min("id").alias("rep")), "classes")
    reps = signed.filter("n > 0").join(_merged(classes.select(F.col("rep").alias("id")).distinct()), "id", "left_semi")
    members = reps.select(F.col("id").alias("rep"), F.explode("bands").alias("bucket"))
    buckets = members.groupBy("bucket").agg(
        F.min("rep").alias("center"), F.max("rep").alias("last"), F.count("*").alias("size"),
        F.bit_xor(F.xxhash64("rep")).alias("print"),
    ).filter("center <> last")
    buckets = buckets.groupBy("center", "last", "size", "print").agg(F.min("bucket").alias("bucket"))
    members = landed(members.join(_merged(buckets.select("bucket", "center", "size")), "bucket"), "buckets")
    involved = members.select(F.col("rep").alias("id")).distinct()
    facts = landed(reps.join(_merged(involved), "id", "left_semi").select(F.col("id").alias("rep"), "n", "sketch"), "facts")
    stars = members.filter("rep <> center").select(F.col("rep").alias("a"), F.col("center").alias("b")).distinct()
    tested = landed(_possible(stars, facts, similarity), "pairs")
    sets = docs.join(_merged(involved), "id", "left_semi").mapInArrow(_sets(shingle), "id long, grams array<long>")
    sets = landed(sets, "sets")
    links = landed(confirm(tested, sets, similarity), "links")
    labels = components(links)
    top = 1
    while True:
        pairs = landed(_apart(members, labels, facts, similarity, top), "apart")
        fresh = landed(pairs.select("a", "b").distinct().join(_merged(tested), ["a", "b"], "left_anti"), "pairs")
        if not fresh.isEmpty():
            confirmed = landed(confirm(fresh, sets, similarity), "links")
            tested = tested.union(fresh)
            if not confirmed.isEmpty():
                links = links.union(confirmed)
                labels = components(links)
        elif pairs.filter("more").isEmpty():
            break
        top *= 4
    rows_out = signed.join(_merged(classes), ["n", "h1", "h2"], "left")
    rows_out = rows_out.join(_merged(labels.select(F.col("node").alias("rep"), "label")), "rep", "left")
    component = F.coalesce("label", "rep", "id")
    return rows_out.select(
        given_id("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(component != F.lit(A.NO_ID), component).alias("component_id"), (component == F.col("id")).alias("kept"),
    )


def _possible(pairs: DataFrame, facts: DataFrame, similarity: int) -> DataFrame:
    left = facts.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = facts.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    return pairs.join(_merged(left), "a").join(_merged(right), "b").mapInArrow(_likely(similarity), "a long, b long")


def _apart(members: DataFrame, labels: DataFrame, facts: DataFrame, similarity: int, top: int) -> DataFrame:
    """Likely pairs (a, b) of different components that share a bucket. (In one of two, the pair was tested.)"""
    named = members.filter("size > 2").join(_merged(labels.select(F.col("node").alias("rep"), "label")), "rep", "left")
    named = named.withColumn("label", F.coalesce("label", "rep"))
    mixed = named.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y")
    # not merged: beside the sum over buckets a join by sorting can't be split, and a crowded bucket would be one task
    named = named.join(mixed.select("bucket"), "bucket", "left_semi").join(_merged(facts), "rep")
    count = F.ceil(F.col("size") / BLOCK).cast("int")
    spread = named.withColumn("blocks", count).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    spread = spread.select("bucket", "lo", "hi", "block", "rep", "label", "n", "sketch")
    return spread.groupBy("bucket", "lo", "hi").applyInArrow(_pairs_in_block(similarity, top), "a long, b long, more boolean")
