"""Term statistics by language and source, and how far sources diverge, by sorting word-start pointers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import arrays as A
from .store import landed

LEAST_DOCUMENTS = 10  # documents of a language that a term is kept for
TOP = 10
SHARD_BYTES = 1 << 20  # text that is sorted at once
DEEP = 8  # characters of 8 bytes after which terms still equal are compared as byte strings
FEW = 1 << 12  # pointers left in a shard when one comparison sort ends it
BLOCK = 128  # sources that one matrix of pairs takes on a side
CELLS = 1 << 21

COUNTS = "lang string, source string, term string, n long, docs long"
#: Bytes of terms: `[^\x00-\x40\x5B-\x60\x7B-\x7F]`, that is letters of ASCII and all beyond it.
OTHER = np.array([c < 0x80 and not (0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A) for c in range(256)])


def pointers(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all terms in the byte buffer, and the row of each."""
    inside = np.zeros(len(buf) + 2, bool)
    np.logical_not(OTHER[buf], out=inside[1:-1])
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return start, end, np.searchsorted(offs, start, "right") - 1


def characters(wide: np.ndarray, start: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """The next 8 bytes of each term, big-endian, zeros after its end. `wide` has the 8 bytes at every place. No byte
    of a term is zero, so a shorter term comes first, and a last byte of zero tells that the term has ended."""
    left = np.clip(end - start - 8 * depth, 0, 8)
    raw = wide[np.minimum(start + 8 * depth, len(wide) - 1)].byteswap()
    shift = ((8 - left) * 8).astype(A.U)
    return np.where(left == 0, A.U(0), (raw >> shift) << shift)


def multikey_sort(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the terms and, in that order, where a run of equal terms begins. Equal terms keep their order.

    Multikey quicksort on characters of 8 bytes, all open slices in step: each takes a pivot and is dealt into what is
    less, equal and greater by the current character. The equal part goes on with the next character, or is a run
    where its terms have ended. Slices of one pointer are done. What is left when FEW pointers are open, or beyond
    DEEP characters, is ended by a comparison sort of byte strings.
    """
    n = len(start)
    order, new = np.arange(n), np.zeros(n, bool)
    new[:1] = True
    if not n:
        return order, new
    wide = np.ndarray(len(buf), "<u8", np.concatenate((buf, np.zeros(8, np.uint8))).tobytes(), strides=(1,))
    # open slices, one after the other: `at` the place in `order` of each pointer, `head` the slices' beginnings in `at`
    at, head = np.arange(n), np.zeros(1, np.int64)
    depth, key = np.zeros(1, np.int64), characters(wide, start, end, 0)
    rest: list[tuple[int, int]] = []
    while len(at):
        size = np.diff(np.append(head, len(at)))
        if len(at) <= FEW or depth.max() >= DEEP:
            late = np.flatnonzero((depth >= DEEP) | (len(at) <= FEW))
            rest += [(int(at[h]), int(s)) for h, s in zip(head[late], size[late])]
            keep = np.ones(len(head), bool)
            keep[late] = False
            stay = np.repeat(keep, size)
            at, key, depth = at[stay], key[stay], depth[keep]
            head = np.concatenate(([0], np.cumsum(size[keep])[:-1])).astype(np.int64) if keep.any() else np.empty(0, np.int64)
            continue
        pivot = np.repeat(_middle(key, head, size), size)
        less, equal = key < pivot, key == pivot
        # stable places of the three parts in their slices
        slice_of = np.repeat(np.arange(len(head)), size)
        n_less, n_equal = np.add.reduceat(less, head, dtype=np.int64), np.add.reduceat(equal, head, dtype=np.int64)
        base = np.where(less, 0, np.where(equal, n_less[slice_of], (n_less + n_equal)[slice_of])) + head[slice_of]
        rank = np.empty(len(at), np.int64)
        for part in (less, equal, ~(less | equal)):
            seen = np.cumsum(part) - part
            rank[part] = (seen - seen[head][slice_of])[part]
        to = base + rank
        moved, key2 = np.empty_like(order[at]), np.empty_like(key)
        moved[to], key2[to] = order[at], key
        order[at], key = moved, key2
        heads = np.stack((head, head + n_less, head + n_less + n_equal), 1).ravel()
        sizes = np.stack((n_less, n_equal, size - n_less - n_equal), 1).ravel()
        kind = np.tile([0, 1, 0], len(head))
        some = sizes > 0
        heads, sizes, kind, deep = heads[some], sizes[some], kind[some], np.repeat(depth, 3)[some]
        new[at[heads]] = True
        ended = (kind == 1) & ((key[heads] & A.U(0xFF)) == 0)
        go = (sizes > 1) & ~ended
        stay = np.repeat(go, sizes)
        at, key, sizes, kind = at[stay], key[stay], sizes[go], kind[go]
        depth = deep[go] + kind
        head = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64) if len(sizes) else np.empty(0, np.int64)
        further = np.repeat(kind == 1, sizes)
        if further.any():
            which = order[at[further]]
            key[further] = characters(wide, start[which], end[which], np.repeat(depth, sizes)[further])
    raw = buf.tobytes()
    for lo, size in rest:
        some = order[lo : lo + size].tolist()
        terms = [raw[a:b] for a, b in zip(start[some].tolist(), end[some].tolist())]
        by = sorted(range(size), key=terms.__getitem__)
        order[lo : lo + size] = [some[i] for i in by]
        new[lo + 1 : lo + size] = [terms[a] != terms[b] for a, b in zip(by, by[1:])]
    return order, new


def _middle(key: np.ndarray, head: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The middle of the first, the central and the last key of each slice."""
    a, b, c = key[head], key[head + size // 2], key[head + size - 1]
    return np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per shard: occurrences and documents of each term by language and source."""
    for batch in batches:
        # rows of a group lie together, so a run of equal terms has each group's pointers together
        batch = batch.take(pc.sort_indices(batch, [("lang", "ascending"), ("source", "ascending")]))
        lang, source = batch.column("lang"), batch.column("source")
        group = np.cumsum(_differs(lang) | _differs(source)) - 1
        first = np.flatnonzero(np.diff(group, prepend=-1))
        for lo, _, buf, offs in A.byte_groups(batch.column("text"), SHARD_BYTES):
            buf = A.LOWER[buf]
            start, end, row = pointers(buf, offs)
            if not len(start):
                continue
            order, new = multikey_sort(buf, start, end)
            row = row[order] + lo
            of = group[row]
            # equal runs by group; in each the rows ascend, so a document begins where the row changes
            cell = new | (np.diff(of, prepend=-1) != 0)
            head = np.flatnonzero(cell)
            n = np.diff(np.append(head, len(order)))
            docs = np.add.reduceat(cell | (np.diff(row, prepend=-1) != 0), head, dtype=np.int64)
            a, size = start[order[head]], (end - start)[order[head]]
            at = np.concatenate(([0], np.cumsum(size)))
            text = buf[np.repeat(a - at[:-1], size) + np.arange(at[-1])]
            terms = pa.StringArray.from_buffers(len(head), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(text))
            rows = pa.array(first[of[head]])
            yield pa.RecordBatch.from_arrays(
                [lang.take(rows), source.take(rows), terms, pa.array(n), pa.array(docs)], names=["lang", "source", "term", "n", "docs"]
            )


def _differs(column: pa.Array) -> np.ndarray:
    codes = column.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return np.diff(codes, prepend=-1) != 0


def term_counts(documents: DataFrame) -> DataFrame:
    """Rows (lang, source, term, n, docs): occurrences of a term in the group's documents, and how many of these have
    it. Counts of shards combine before and after the shuffle, which deals by term, so a large group is no hot spot."""
    return documents.mapInArrow(_counts, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 kinds)), exact at any count: the product is a decimal of up to 31 digits."""
    return F.expr(f"1 + cast(1000000000 as decimal(10, 0)) * cast({n} + 2 as decimal(20, 0)) div cast({total} + 2 * kinds as decimal(20, 0))")


def divergence(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)); squares stay below 2^63 as shares are at most 10^9 + 1."""
    return F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")


def kept_terms(documents: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """Rows (lang, source, term, n, n_lang, leads) of the terms that at least `least` documents of the language have, for
    each source that has them; n_lang is the language's count, `leads` marks one row of each term of a language."""
    term = Window.partitionBy("lang", "term")
    counts = term_counts(documents).withColumn("docs", F.sum("docs").over(term)).withColumn("n_lang", F.sum("n").over(term))
    counts = counts.withColumn("leads", F.col("source") == F.min("source").over(term))
    return counts.filter(F.col("docs") >= least).drop("docs")


def group_totals(documents: DataFrame, kept: DataFrame) -> DataFrame:
    """One row per group (lang, source) that occurs, with or without terms: total (its occurrences of kept terms), kinds
    and total_lang (kept terms of the language and their occurrences), place (0, 1, ... by source), places (how many)."""
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.col("leads").cast("long")).alias("leads"))
    groups = documents.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").na.fill(0, ["total", "leads"])
    lang = Window.partitionBy("lang")
    return groups.select(
        "lang", "source", "total", F.sum("leads").over(lang).alias("kinds"), F.sum("total").over(lang).alias("total_lang"),
        (F.row_number().over(lang.orderBy("source")) - 1).alias("place"), F.count("*").over(lang).alias("places"),
    )


def _pair_sums(block: int):
    """By block pair: for each pair of sources the sum over terms of f(p, q) - f(p0, q0), p0 and q0 the shares of terms
    that stand nowhere in them. A task adds up matrices of block by block; no pair of a term leaves it."""

    def flush(sums):
        for (lang, x, y), total in sums.items():
            i, j = np.nonzero(np.triu(total, 1) if x == y else total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(i), pa.string()), pa.array(i + x * block), pa.array(j + y * block), pa.array(total[i, j])],
                names=["lang", "i", "j", "gap"],
            )
        sums.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            names = list(zip(*(batch.column(c).to_pylist() for c in ("lang", "x", "y"))))
            kinds = {k: n for n, k in enumerate(dict.fromkeys(names))}
            which = np.array([kinds[k] for k in names])
            for key, number in kinds.items():
                lang, x, y = key
                part = batch.take(pa.array(np.flatnonzero(which == number)))
                px, py = (np.array(part.column(c)[0].as_py()) for c in ("px", "py"))
                cells = part.column("cells")
                sizes = cells.value_lengths().to_numpy(zero_copy_only=False)
                place, p = (c.to_numpy(zero_copy_only=False) for c in cells.flatten().flatten())
                row, at = np.repeat(np.arange(len(part)), sizes), np.concatenate(([0], np.cumsum(sizes)))
                if key not in sums:
                    if len(sums) >= 64:
                        yield from flush(sums)
                    sums[key] = np.zeros((len(px), len(py)), np.int64)
                none = _f(px[:, None], py[None, :])
                step = max(1, CELLS // none.size)
                for lo in range(0, len(part), step):
                    hi = min(lo + step, len(part))
                    some = slice(at[lo], at[hi])
                    left, right = np.tile(px, (hi - lo, 1)), np.tile(py, (hi - lo, 1))
                    for side, side_block in ((left, x), (right, y)):
                        own = place[some] // block == side_block
                        side[row[some][own] - lo, place[some][own] - side_block * block] = p[some][own]
                    sums[key] += (_f(left[:, :, None], right[:, None, :]) - none).sum(0)
        yield from flush(sums)

    return run


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def pair_values(kept: DataFrame, totals: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (lang, source, item, value) for each ordered pair of sources of a language: f summed over all kept terms.

    f(p, q) is not zero for terms that one or both lack, so sums are split: kinds * f(p0, q0), and the differences
    from f(p0, q0) of terms that stand in one at least. The latter are added up in blocks of sources."""
    rows = kept.join(totals, ["lang", "source"]).withColumn("p", share("n", "total"))
    rows = rows.withColumn("own", F.expr(f"place div {block}"))
    rows = rows.withColumn("other", F.explode(F.expr(f"sequence(0, (places - 1) div {block})")))
    cells = rows.groupBy("lang", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "term")
    cells = cells.agg(F.collect_list(F.struct(F.col("place").cast("long").alias("place"), "p")).alias("cells"))  # 2 blocks at most
    some = totals.filter("kinds > 0").withColumn("p0", share("0", "total"))
    sides = some.groupBy("lang", F.expr(f"place div {block}").alias("x"))
    sides = sides.agg(F.expr("transform(sort_array(collect_list(struct(place, p0))), s -> s.p0)").alias("px"))
    cells = cells.join(sides, ["lang", "x"]).join(sides.select("lang", F.col("x").alias("y"), F.col("px").alias("py")), ["lang", "y"])
    cells = cells.select("lang", "x", "y", "cells", "px", "py")
    gaps = cells.mapInArrow(_pair_sums(block), "lang string, i long, j long, gap long").groupBy("lang", "i", "j").agg(F.sum("gap").alias("gap"))
    totals = totals.withColumn("p0", F.when(F.col("kinds") > 0, share("0", "total")))
    one = totals.select("lang", "source", "kinds", F.col("place").cast("long").alias("a"), F.col("p0").alias("p"))
    two = totals.select("lang", F.col("source").alias("item"), F.col("place").cast("long").alias("b"), F.col("p0").alias("q"))
    pairs = one.join(two, "lang").filter("a <> b").withColumn("i", F.least("a", "b")).withColumn("j", F.greatest("a", "b"))
    value = F.coalesce(F.col("kinds") * divergence("p", "q"), F.lit(0)) + F.coalesce("gap", F.lit(0))
    return pairs.join(gaps, ["lang", "i", "j"], "left").select("lang", "source", "item", value.alias("value"))


def audit(
    documents: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
    least: int = LEAST_DOCUMENTS, top: int = TOP, block: int = BLOCK,
) -> DataFrame:
    """Rows (lang, source, part, item, value, rank). Part `pair`: how far each other source of the language is from this
    one, over all terms that at least `least` documents of the language have. Part `term`: the `top` terms that set the
    source off from its language most. Values are those of `divergence` on `share`s, exact; rank 1 has the greatest,
    equal values go by item in bytewise order.

    Null texts, languages and sources count as ''. A source without terms is compared with the others all the same; in
    a language without kept terms all pairs have value 0. Repeated rows count as documents each; other columns are not
    read. What the terms' counts need grows with the distinct terms of a source, not with its rows.
    """
    given = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    docs = documents.select(*given)
    kept = landed(kept_terms(docs, least), "terms")
    totals = landed(group_totals(docs, kept), "totals")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = kept.join(totals, ["lang", "source"]).withColumn("p", share("n", "total")).withColumn("q", share("n_lang", "total_lang"))
    terms = terms.filter("p > q").select("lang", "source", F.col("term").alias("item"), divergence("p", "q").alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)
    pairs = pair_values(kept, totals, block).withColumn("rank", F.row_number().over(ranked))
    both = pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
    return both.select("lang", "source", "part", "item", "value", "rank")
