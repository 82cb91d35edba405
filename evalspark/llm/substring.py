"""Exact removal of repeated word passages by seed and extend."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .anchors import covered, list_column, listed, shared_blocks
from .store import given_id, keyed, landed, one_per_id, row_id, with_given_ids

WINDOW = 50  # words of a repeat, at least
SEED = 10  # words of a seed
PARTNERS = 64  # contexts of one seed that are extended against one another; more are grown by hash first
LOT = 4096  # contexts that one task call extends
PART = 16384  # contexts of one seed that meet in one task call where they are too many to extend

CONTEXT = "key long, first long, starts array<int>, n int, left int, context binary"
SPAN = "id long, start int, n int"


def _contexts(window: int):
    """The words that the windows of each listed block cover, as bytes of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = A.ids(batch.column("id"))
            at, field = list_column(batch.column("blocks"))
            starts = field["starts"]
            start, n, left = (field[c].to_numpy(zero_copy_only=False) for c in ("start", "n", "left"))
            for lo, hi, buf, offs in A.byte_groups(batch.column("text")):
                _, head, tail, words = A.words(buf, offs)
                rows = np.arange(at[lo], at[hi])
                of = np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1]))
                first = words[of] + start[rows]
                begin, end = head[first], tail[first + n[rows] + window - 2]
                context = pa.array([buf[i:j].tobytes() for i, j in zip(begin, end)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        field["key"].slice(at[lo], len(rows)), pa.array(ids[lo + of]), starts.slice(at[lo], len(rows)),
                        pa.array(n[rows]), pa.array(left[rows]), context,
                    ],
                    names=["key", "first", "starts", "n", "left", "context"],
                )

    return run


def _extend(window: int):
    """Extend every seed match both ways, word by word, and keep what spans a window or more.

    Contexts of one seed are compared pairwise; a match counts against the later document only."""

    def run(lot: pa.Table) -> pa.Table:
        key, first, n, left = (lot.column(c).to_numpy() for c in ("key", "first", "n", "left"))
        order = np.lexsort((first, key))
        key, first, n, left = key[order], first[order], n[order], left[order]
        buf, offs = A.text_buffer(lot.column("context").combine_chunks().take(pa.array(order)))
        words, _, _, at = A.words(buf[offs[0] : offs[-1]], offs - offs[0])
        width = n + window - 1
        # words before the seed, nearest first, and from the seed on; padding never matches
        reach = max(int(left.max()), 1), int((width - left).max())
        before, after = np.zeros((len(n), reach[0]), A.U), np.zeros((len(n), reach[1]), A.U)
        before[:], after[:] = (np.arange(len(n), dtype=np.uint64) * A.U(2) + A.U(1))[:, None], A.U(0)
        after[:] = before[:, :1]
        row = np.repeat(np.arange(len(n)), width)
        place = np.arange(at[-1]) - np.repeat(at[:-1], width) - left[row]
        back = place < 0
        before[row[back], -1 - place[back]] = words[back]
        after[row[~back], place[~back]] = words[~back]
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        count = np.diff(np.append(heads, len(key)))
        rank = np.arange(len(key)) - np.repeat(heads, count)
        later = np.repeat(np.arange(len(key)), rank)
        earlier = np.repeat(np.arange(len(key)) - rank, rank) + np.arange(len(later)) - np.repeat(np.cumsum(rank) - rank, rank)
        ok = first[earlier] < first[later]
        later, earlier = later[ok], earlier[ok]
        hit, begin, size = [], [], []
        for s in range(0, len(later), 8192):
            i, j = later[s : s + 8192], earlier[s : s + 8192]
            back = _run(before[i] == before[j])
            ahead = _run(after[i] == after[j])
            good = back + ahead >= window
            hit.append(i[good])
            begin.append((left[i] - back)[good])
            size.append((back + ahead - window + 1)[good])
        hit, begin, size = (np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in (hit, begin, size))
        spans = np.unique(np.stack([hit, begin, size], 1), axis=0)
        starts = lot.column("starts").combine_chunks().take(pa.array(order[spans[:, 0]]))
        times = starts.value_lengths().to_numpy()
        ids = np.repeat(first[spans[:, 0]], times)
        start = starts.flatten().to_numpy() + np.repeat(spans[:, 1], times)
        return pa.table({"id": ids, "start": start.astype(np.int32), "n": np.repeat(spans[:, 2], times).astype(np.int32)})

    return run


def _run(same: np.ndarray) -> np.ndarray:
    """How many of each row's first values are true."""
    return np.where(same.all(axis=1), same.shape[1], np.argmin(same, axis=1))


def _grown(window: int):
    """Contexts of one seed, of many: the seed grown to all words of each window, by hash. What an earlier
    document of this call has too is settled (a run of windows, `grown` null). The rest, all places of each
    window's least document, is to be compared with the other calls' of this seed, if there are any."""

    def run(part: pa.Table) -> pa.Table:
        key, first, n = (part.column(c).to_numpy() for c in ("key", "first", "n"))
        order = np.argsort(first, kind="stable")
        first, n = first[order], n[order]
        buf, offs = A.text_buffer(part.column("context").combine_chunks().take(pa.array(order)))
        starts = part.column("starts").combine_chunks().take(pa.array(order))
        words, _, _, at = A.words(buf[offs[0] : offs[-1]], offs - offs[0])
        row = np.repeat(np.arange(len(n)), n)
        shift = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        grown = A.SHINGLES.of(A.SHINGLES.prefix(words), at[row] + shift, at[row] + shift + window)
        _, least, back = np.unique(grown, return_index=True, return_inverse=True)  # the first place: the least id
        settled = first[row[least[back]]] < first[row]
        edge = np.diff(np.concatenate(([False], settled, [False])).astype(np.int8))
        begin = np.flatnonzero((edge[:-1] == 1) | (settled & (shift == 0)))
        end = np.searchsorted(np.flatnonzero(~settled | (shift == 0)), begin, "right")
        stops = np.append(np.flatnonzero(~settled | (shift == 0)), len(settled))
        rest = np.flatnonzero(~settled) if part.column("parts")[0].as_py() > 1 else least[:0]
        take = np.concatenate((begin, rest))
        size = np.concatenate((stops[end] - begin, np.ones(len(rest), np.int64)))
        known = np.arange(len(take)) < len(begin)
        lists = starts.take(pa.array(row[take]))
        moved = lists.flatten().to_numpy() + np.repeat(shift[take], lists.value_lengths().to_numpy())
        return pa.table({
            "key": np.full(len(take), key[0]), "grown": pa.array(grown[take].view(np.int64), mask=known), "first": first[row[take]],
            "starts": pa.ListArray.from_arrays(lists.offsets, pa.array(moved.astype(np.int32))), "n": size.astype(np.int32),
        })

    return run


def _cut(window: int):
    """Remove the listed windows' words and join the rest by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, field = list_column(batch.column("spans"))
            start, n = (field[c].to_numpy(zero_copy_only=False) for c in ("start", "n"))
            for lo, hi, buf, offs in A.byte_groups(batch.column("text")):
                _, head, tail, words = A.words(buf, offs)
                rows = slice(at[lo], at[hi])
                first = words[np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1]))] + start[rows]
                gone = covered(len(head), first, first + n[rows] + window - 1)
                kept, counts = joined(buf, offs, head, tail, words, ~gone)
                total = np.diff(words)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(lo, hi - lo), pa.array(total),
                        pa.array(total - counts), kept,
                    ],
                    names=["id", "n_words", "n_removed", "kept_text"],
                )

    return run


def _replace(window: int, text_col: str):
    """The rows without their last column, the spans, and with these spans cut out of the texts."""
    cut = _cut(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = np.flatnonzero(batch.column("__spans").is_valid().to_numpy(zero_copy_only=False))
            columns, names = batch.columns[:-1], batch.schema.names[:-1]
            if len(some):
                part = batch.take(pa.array(some))
                plain = pa.RecordBatch.from_arrays(
                    [pa.array(some), part.column(text_col), part.column("__spans")], names=["id", "text", "spans"]
                )
                texts = batch.column(text_col).to_pylist()
                for done in cut(iter([plain])):
                    for at, text in zip(done.column("id").to_pylist(), done.column("kept_text").to_pylist()):
                        texts[at] = text
                columns[names.index(text_col)] = pa.array(texts, batch.column(text_col).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def joined(buf, offs, head, tail, words, keep) -> tuple[pa.Array, np.ndarray]:
    """The kept words of each text joined by one space, and their number."""
    counts = np.add.reduceat(np.append(keep, False).astype(np.int64), words[:-1]) * (np.diff(words) > 0)
    last = np.full(len(offs) - 1, -1)
    of = np.searchsorted(words, np.flatnonzero(keep), "right") - 1
    last[of] = np.flatnonzero(keep)
    spaced = keep.copy()
    spaced[last[last >= 0]] = False
    mask = covered(len(buf), head[keep], tail[keep])
    out = buf.copy()
    gaps = tail[spaced]
    out[gaps], mask[gaps] = 0x20, True
    ends = np.concatenate(([0], np.cumsum(mask)))[offs].astype(np.int32)
    return pa.StringArray.from_buffers(len(offs) - 1, pa.py_buffer(ends), pa.py_buffer(out[mask])), counts


def find_repeats(
    docs: DataFrame, window: int = WINDOW, seed: int = SEED, partners: int = PARTNERS, part_size: int = PART
) -> DataFrame:
    """Of documents (id, text), each id once: the repeated windows as rows (id, spans), spans a list of
    (start, n): n windows from word `start` on, each also in a document with a smaller id."""
    shared = landed(shared_blocks(docs, window, seed, True), "seeds")
    groups = landed(shared.groupBy("key", "full").agg(F.min("id").alias("first"), F.count("*").alias("times")), "groups")
    mixed = groups.groupBy("key").agg(F.count("*").alias("contexts")).filter("contexts > 1")
    placed = shared.join(groups.filter("times > 1"), ["key", "full"])
    whole = placed.filter("first < id").select("id", "start", "n")
    # the first document of each context that has rivals, with every place where the context stands in it
    rivals = groups.join(mixed, "key")
    own = shared.join(rivals, ["key", "full"]).filter("id = first")
    own = own.groupBy("id", "key", "full", "n", "left").agg(F.collect_list("start").alias("starts"))
    own = own.withColumn("start", F.col("starts")[0])
    asked = docs.join(listed(own, ["key", "starts", "start", "n", "left"], "blocks"), "id")
    contexts = landed(asked.mapInArrow(_contexts(window), CONTEXT), "contexts").join(mixed, "key")
    lots = max(1, -(-contexts.count() // LOT))
    few = contexts.filter(F.col("contexts") <= partners)
    lot = few.withColumn("lot", F.pmod(F.xxhash64("key"), F.lit(lots))).groupBy("lot")
    extended = lot.applyInArrow(_extend(window), SPAN)
    parts = F.ceil(F.col("contexts") / part_size).cast("int")
    many = contexts.filter(F.col("contexts") > partners).select(
        "key", "first", "starts", "n", "context", parts.alias("parts"), F.pmod(F.xxhash64("first"), parts).alias("part")
    )
    grown = many.groupBy("key", "part").applyInArrow(
        _grown(window), "key long, grown long, first long, starts array<int>, n int"
    )
    least = grown.filter("grown is not null").groupBy("key", "grown").agg(F.min("first").alias("least"))
    again = grown.join(least, ["key", "grown"], "left").filter("grown is null or least < first")
    regrown = again.select(F.col("first").alias("id"), F.explode("starts").alias("start"), "n")
    return listed(whole.union(extended).union(regrown), ["start", "n"], "spans")


def remove_repeats(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED,
    partners: int = PARTNERS, part_size: int = PART,
) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_text (the words that stay, joined by one space).

    A word goes if it lies in a window of `window` words whose word sequence also starts in a document with
    a smaller id. Windows are judged on the input.

    1. Seeds: each window is assigned to the `seed`-word gram of least hash in it; runs of windows with one
       seed are blocks. Only blocks whose seed occurs elsewhere go on.
    2. Documents are joined on equal seeds. Blocks of equal content are merged first: all but the copy in
       the first document go whole, so copies are never paired.
    3. The distinct contexts of a seed are extended against one another to the left and right, word by
       word; matches of `window` words or more count against the later document. Where a seed has more
       than `partners` contexts, it is grown to the whole window by hash and joined again on that: linear
       in the windows, no pairs.
    4. Overlapping matches of a document merge to maximal repeats, which are cut out.

    Null texts have no words and give an empty kept_text. A null id counts as smaller than all others and
    comes back as null. Rows without an id are documents each, rows that share one are a document for each of
    their texts, in the order of the texts' hashes.
    """
    docs = documents.select(row_id(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    docs, names = one_per_id(docs)
    spans = find_repeats(docs, window, seed, partners, part_size)
    cut = docs.join(spans, "id", "left").mapInArrow(
        _cut(window), "id long, n_words long, n_removed long, kept_text string"
    )
    return with_given_ids(cut, names).select(given_id("id").alias(id_col), "n_words", "n_removed", "kept_text")


def cut_documents(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED,
    partners: int = PARTNERS,
) -> DataFrame:
    """All rows and columns of `documents`, repeats cut out of the texts as by `remove_repeats`. Texts that lose
    nothing stay as they are, white space and all; a null text stays null. Rows that share an id, or have none, are
    documents each, in the order of their texts' hashes; copies among them count as later documents too."""
    rows = keyed(documents, id_col, text_col)
    docs = rows.select(F.col("__key").alias("id"), F.col(text_col).cast("string").alias("text"))
    spans = find_repeats(docs, window, seed, partners).select(F.col("id").alias("__key"), F.col("spans").alias("__spans"))
    rows = rows.join(spans, "__key", "left").select(*documents.columns, "__spans")
    return rows.mapInArrow(_replace(window, text_col), documents.schema)
