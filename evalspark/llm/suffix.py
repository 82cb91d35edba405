"""Exact removal of byte strings that occur more than once, by suffix arrays built by induced sorting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .anchors import covered, list_column, listed, shared_blocks
from .store import given_id, landed, one_per_id, row_id, with_given_ids

LENGTH = 200  # bytes of a repeat, at least
GRAM = 32  # bytes of an anchor
SHARD = 1 << 21  # bytes that one suffix array holds, about
STRETCH = 2048  # places of a label document whose anchors share a shard
CONTEXTS = 1024  # different contexts of one anchor that may meet in a shard; more meet by hash
PART = 16384  # of these, contexts that meet in one task
BREAK = 0xFF  # between the texts of a shard; no UTF-8 text contains it

REGION = "shard long, id long, start int, n int, region binary"


# ---- induced sorting ---------------------------------------------------------------------------------


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffix array of an array of small non-negative integers, by induced sorting.

    A suffix is S-type if it is less than the next one, else L-type; an S-type after an L-type is leftmost
    (LMS). The substrings between LMS places are sorted by one induction and named; where names repeat, the
    string of names is sorted recursively; a second induction from the sorted LMS suffixes gives all others.
    Each induction handles a whole bucket (first letter) at a time."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    kinds, text = np.unique(text, return_inverse=True)
    if len(kinds) == n:
        return np.argsort(text)
    text = text.astype(np.uint8 if len(kinds) <= 256 else np.uint16 if len(kinds) <= 65536 else np.int64)
    small = _is_small(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if not len(lms):
        return _induce(text, lms)
    order = _induce(text, lms[np.argsort(text[lms], kind="stable")])
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = order[is_lms[order]]
    number = np.empty(n, np.int64)
    number[lms] = np.arange(len(lms))
    name = np.empty(len(lms), np.int64)
    name[number[order]] = np.cumsum(_new_names(text, lms, number[order]))
    if len(lms) > 32 and name.max() + 1 > len(lms) // 8:
        rank = np.argsort(_doubled(name))  # names nearly tell all apart: ranks double once or a few times
    else:
        rank = suffix_array(name)
    return _induce(text, lms[rank])


def _is_small(text: np.ndarray) -> np.ndarray:
    """S-type or not; the last suffix is L-type, as the end counts as the least letter."""
    out = np.zeros(len(text), bool)
    change = np.flatnonzero(text[1:] != text[:-1])  # the next letter differs
    rises = text[change] < text[change + 1]
    out[: change[-1] + 1 if len(change) else 0] = np.repeat(rises, np.diff(np.concatenate(([-1], change))))
    return out


def _new_names(text: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For LMS substrings in sorted order: 1 where one differs from the one before, else 0."""
    size = np.diff(np.append(lms, len(text) - 1)) + 1
    new = np.ones(len(order), np.int64)
    new[0] = 0
    a, b = order[:-1], order[1:]
    at = np.flatnonzero(size[a] == size[b])
    # the substring up to the end of the text is like no other
    at = at[(a[at] != len(lms) - 1) & (b[at] != len(lms) - 1)]
    k = 0
    while len(at):
        at = at[text[lms[a[at]] + k] == text[lms[b[at]] + k]]
        k += 1
        done = k >= size[a[at]]
        new[at[done] + 1] = 0
        at = at[~done]
    return new


def _doubled(name: np.ndarray) -> np.ndarray:
    """Ranks of all suffixes: ranks of the first k letters give those of 2k, until all differ."""
    rank, k, n = name.copy(), 1, len(name)
    while True:
        second = np.full(n, -1)
        second[: n - k if k < n else 0] = rank[k:]
        order = np.lexsort((second, rank))
        new = (rank[order][1:] != rank[order][:-1]) | (second[order][1:] != second[order][:-1])
        rank[order] = np.concatenate(([0], np.cumsum(new)))
        if rank[order[-1]] == n - 1:
            return rank
        k *= 2


def _place(out, pointer, letters, places, step):
    """Put `places` into the buckets of their letters in the order given, from each bucket's pointer on."""
    order = np.argsort(letters, kind="stable")
    letters, places = letters[order], places[order]
    heads = np.flatnonzero(np.append(True, letters[1:] != letters[:-1]))
    count = np.diff(np.append(heads, len(letters)))
    rank = np.arange(len(letters)) - np.repeat(heads, count)
    own = letters[heads].astype(np.int64)
    out[np.repeat(pointer[own], count) + step * rank] = places
    pointer[own] += step * count


def _induce(text: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in the order that the given order of the LMS suffixes (grouped by letter) induces."""
    n, size = len(text), int(text.max()) + 1
    count = np.bincount(text, minlength=size)
    end = np.cumsum(count)
    begin = end - count
    out = np.empty(n, np.int64)
    used = np.flatnonzero(count)
    seed = np.searchsorted(text[lms], np.arange(size + 1))
    head = begin.copy()
    out[head[text[n - 1]]] = n - 1
    head[text[n - 1]] += 1
    for c in used:
        e = head[c]
        now = out[begin[c] : e]
        while len(now):
            now = now[now > 0] - 1
            now = now[text[now] == c]
            out[e : e + len(now)] = now
            e += len(now)
        head[c] = e
        now = np.concatenate((out[begin[c] : e], lms[seed[c] : seed[c + 1]]))
        now = now[now > 0] - 1
        letters = text[now]
        up = letters > c
        if up.any():
            _place(out, head, letters[up], now[up], 1)
    tail = end - 1
    for c in used[::-1]:
        e = tail[c]
        now = out[e + 1 : end[c]][::-1]
        while len(now):
            now = now[now > 0] - 1
            now = now[text[now] == c]
            out[e - len(now) + 1 : e + 1] = now[::-1]
            e -= len(now)
        tail[c] = e
        now = out[begin[c] : end[c]][::-1] if e + 1 == head[c] else np.concatenate((out[e + 1 : end[c]][::-1], out[begin[c] : head[c]][::-1]))
        now = now[now > 0] - 1
        letters = text[now]
        down = letters < c
        if down.any():
            _place(out, tail, letters[down], now[down], -1)
    return out


def common_prefixes(text: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Permuted common prefixes: for each place, how many bytes its suffix shares with the suffix before it
    in the array, and with the one after it. Only irreducible values (the letters before differ) are
    compared; each other one is its left neighbour's less one."""
    n = len(text)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    left = np.full(n, -1)
    ok = before > 0
    left[ok] = text[before[ok] - 1]
    own = np.concatenate(([-2], text[:-1].astype(np.int64)))
    at = np.flatnonzero((before < 0) | (left != own))
    other = before[at]
    wide = np.zeros(n + 16, np.uint64)
    for k in range(min(8, n)):
        wide[: n - k] |= text[k:].astype(np.uint64) << A.U(56 - 8 * k)
    shared = np.zeros(len(at), np.int64)
    alive = np.flatnonzero(other >= 0)
    while len(alive):
        i, j = at[alive] + shared[alive], other[alive] + shared[alive]
        inside = np.maximum(i, j) < n
        alive, i, j = alive[inside], i[inside], j[inside]
        apart = wide[i] ^ wide[j]
        same = apart == 0
        bits = apart[~same]
        shared[alive[~same]] += sum((bits < A.U(1 << (56 - 8 * k))).astype(np.int64) for k in range(7))
        shared[alive[same]] += 8
        alive = alive[same]
    shared = np.where(other >= 0, np.minimum(shared, n - np.maximum(at, other)), 0)
    last = np.zeros(n, np.int64)
    last[at] = np.arange(len(at))
    last = np.maximum.accumulate(last)
    ahead = np.maximum(shared[last] - (np.arange(n) - at[last]), 0)
    after = np.zeros(n, np.int64)
    after[order[:-1]] = ahead[order[1:]]
    return ahead, after


# ---- shards ------------------------------------------------------------------------------------------


def _regions(length: int):
    """Runs of listed blocks that follow one another and share a shard, with the bytes of their strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = A.ids(batch.column("id"))
            at, field = list_column(batch.column("blocks"))
            start, n, shard = (field[c].to_numpy(zero_copy_only=False) for c in ("start", "n", "shard"))
            doc = np.repeat(np.arange(len(ids)), np.diff(at))
            order = np.lexsort((start, doc))
            start, n, shard, doc = start[order], n[order], shard[order], doc[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (shard[1:] != shard[:-1]) | (start[1:] != start[:-1] + n[:-1])
            heads = np.flatnonzero(new)
            if not len(heads):
                continue
            total = np.add.reduceat(n, heads)
            buf, offs = A.text_buffer(batch.column("text"))
            begin = offs[doc[heads]] + start[heads]
            text = pa.array([buf[i : i + m + length - 1].tobytes() for i, m in zip(begin, total)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(shard[heads]), pa.array(ids[doc[heads]]), pa.array(start[heads].astype(np.int32)),
                    pa.array(total.astype(np.int32)), text,
                ],
                names=["shard", "id", "start", "n", "region"],
            )

    return run


def _search(length: int):
    """Runs of strings of the shard that stand in it more than once."""

    def run(shard: pa.Table) -> pa.Table:
        buf, offs = A.text_buffer(shard.column("region"))
        n = shard.column("n").to_numpy()
        size = np.diff(offs)
        text = np.full(size.sum() + len(size), BREAK, np.uint8)
        begin = offs[:-1] - offs[0] + np.arange(len(size))
        within = np.ones(len(text), bool)
        within[begin + size] = False
        text[within] = buf[offs[0] : offs[-1]]
        before, after = common_prefixes(text, suffix_array(text))
        twice = np.maximum(before, after) >= length
        steps = np.zeros(len(text) + 1, np.int8)
        steps[begin] = 1
        steps[begin + n] -= 1
        twice &= np.cumsum(steps[:-1]) > 0
        edge = np.diff(np.concatenate(([0], twice.astype(np.int8), [0])))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        row = np.searchsorted(begin, first, "right") - 1
        ids = shard.column("id").to_numpy()[row]
        start = shard.column("start").to_numpy()[row] + first - begin[row]
        return pa.table({"id": ids, "start": start.astype(np.int32), "n": (last - first).astype(np.int32)})

    return run


def _contexts(length: int):
    """The bytes of each listed block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = A.ids(batch.column("id"))
            at, field = list_column(batch.column("blocks"))
            start, n = (field[c].to_numpy(zero_copy_only=False) for c in ("start", "n"))
            if not len(start):
                continue
            doc = np.repeat(np.arange(len(ids)), np.diff(at))
            buf, offs = A.text_buffer(batch.column("text"))
            begin = offs[doc] + start
            text = pa.array([buf[i : i + m + length - 1].tobytes() for i, m in zip(begin, n)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [field["key"], field["part"], field["parts"], pa.array(ids[doc]), pa.array(start), pa.array(n), text],
                names=["key", "part", "parts", "id", "start", "n", "context"],
            )

    return run


def _by_hash(length: int):
    """Contexts of one anchor, of many: their strings by two hashes. Those that stand here twice are settled
    (a run of them, hashes null); the others are given one by one if the anchor has more parts than this."""

    def run(part: pa.Table) -> pa.Table:
        ids, start, n = (part.column(c).to_numpy() for c in ("id", "start", "n"))
        buf, offs = A.text_buffer(part.column("context"))
        buf, offs = buf[offs[0] : offs[-1]], offs - offs[0]
        row = np.repeat(np.arange(len(n)), n)
        shift = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        first = offs[row] + shift
        h1, h2 = (r.of(r.prefix(buf), first, first + length) for r in (A.SHINGLES, A.KEYS))
        order = np.lexsort((h2, h1))
        same = np.zeros(len(order) + 1, bool)
        same[1:-1] = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
        twice = np.empty(len(order), bool)
        twice[order] = same[1:] | same[:-1]
        cut = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (twice[1:] != twice[:-1])))
        size = np.diff(np.append(cut, len(row)))
        runs, size = cut[twice[cut]], size[twice[cut]]
        alone = np.flatnonzero(~twice) if part.column("parts")[0].as_py() > 1 else cut[:0]
        # of those that stand here twice one goes on as well, for the other parts' sake
        if part.column("parts")[0].as_py() > 1:
            alone = np.concatenate((alone, order[np.flatnonzero(~same[:-1] & same[1:])]))
        take = np.concatenate((runs, alone))
        known = np.arange(len(take)) < len(runs)
        return pa.table({
            "id": ids[row[take]], "start": (start[row[take]] + shift[take]).astype(np.int32),
            "n": np.concatenate((size, np.ones(len(alone), np.int64))).astype(np.int32),
            "h1": pa.array(h1[take].view(np.int64), mask=known), "h2": pa.array(h2[take].view(np.int64), mask=known),
        })

    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, field = list_column(batch.column("spans"))
            start, n = (field[c].to_numpy(zero_copy_only=False) for c in ("start", "n"))
            for lo, hi, buf, offs in A.byte_groups(batch.column("text")):
                rows = slice(at[lo], at[hi])
                first = offs[np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1]))] + start[rows]
                gone = covered(len(buf), first, first + n[rows] + length - 1)
                total = np.concatenate(([0], np.cumsum(gone)))
                heads = gone.copy()
                heads[1:] &= ~gone[:-1]
                edge = offs[:-1][offs[:-1] < len(buf)]
                heads[edge] = gone[edge]
                runs = np.concatenate(([0], np.cumsum(heads)))
                kept = np.concatenate(([0], np.cumsum(~gone)))[offs].astype(np.int32)
                text = pa.BinaryArray.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(kept), pa.py_buffer(buf[~gone])])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(lo, hi - lo), pa.array(np.diff(offs)), pa.array(np.diff(total[offs])),
                        pa.array(np.diff(runs[offs]).astype(np.int64)), text,
                    ],
                    names=["id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    return run


def remove_repeated_strings(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
    shard_bytes: int = SHARD, contexts: int = CONTEXTS, part_size: int = PART,
) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the remaining bytes).

    A byte goes if a string of `length` bytes that also starts anywhere else, in the same document or
    another, covers it. Strings are judged on the input and never cross documents.

    1. Dealing. Equal strings have equal anchors, so only blocks whose anchor occurs twice or more can hold
       repeats. Blocks of equal content are merged and counted first; one that occurs twice is repeated
       whole. An anchor all of whose blocks are repeated has nothing left to compare.
    2. Every other block goes, with one copy of the repeated ones, to the shard of its anchor. Anchors that
       follow one another in the first document that holds them share a shard, so that neighbouring blocks
       of a near copy stay one stretch of text there.
    3. Each shard is a suffix array: suffixes are classified, leftmost-smaller substrings are sorted
       recursively, the rest is induced; permuted common prefixes tell which strings occur twice.
    4. An anchor with more than `contexts` different blocks does not meet in one shard: its strings are
       compared by a 128-bit hash, in parts, and what a part leaves open in an aggregate over all.

    Null texts are empty. Rows with a null id are documents each and come back with a null id. Rows that share
    an id are a document for each of their texts; copies of a row are one.
    """
    docs = documents.select(row_id(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    docs, names = one_per_id(docs)
    shared = landed(shared_blocks(docs, length, gram, False), "anchors")
    groups = landed(shared.groupBy("key", "full").agg(F.min("id").alias("first"), F.count("*").alias("times")), "groups")
    label = shared.groupBy("key").agg(F.min("id").alias("at"), F.min("start").alias("place"))
    mixed = groups.groupBy("key").agg(F.count("*").alias("contexts"), F.min("times").alias("least"))
    mixed = mixed.filter("contexts > 1 and least = 1").drop("least").join(label, "key")
    repeated = shared.join(groups.filter("times > 1").select("key", "full"), ["key", "full"]).select("id", "start", "n")
    own = shared.join(groups.join(mixed, "key"), ["key", "full"]).filter("id = first")
    own = own.groupBy("id", "key", "full", "n", "contexts", "at", "place").agg(F.min("start").alias("start"))
    own = landed(own, "blocks")
    size = own.filter(F.col("contexts") <= contexts).agg(F.sum(F.col("n") + 8)).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    dealt = F.pmod(F.xxhash64("at", F.floor(F.col("place") / STRETCH)), F.lit(shards)).alias("shard")
    few = listed(own.filter(F.col("contexts") <= contexts).select("id", "start", "n", dealt), ["start", "n", "shard"], "blocks")
    parts = F.ceil(F.col("contexts") / part_size).cast("int")
    many = own.filter(F.col("contexts") > contexts).select(
        "id", "key", "start", "n", parts.alias("parts"), F.pmod(F.xxhash64("id", "start"), parts).cast("int").alias("part")
    )
    many = listed(many, ["key", "part", "parts", "start", "n"], "blocks")
    regions = docs.join(few, "id").mapInArrow(_regions(length), REGION)
    found = regions.groupBy("shard").applyInArrow(_search(length), "id long, start int, n int")
    hashed = docs.join(many, "id").mapInArrow(
        _contexts(length), "key long, part int, parts int, id long, start int, n int, context binary"
    )
    hashed = hashed.groupBy("key", "part").applyInArrow(_by_hash(length), "id long, start int, n int, h1 long, h2 long")
    open_ = hashed.filter("h1 is not null")
    often = open_.groupBy("h1", "h2").agg(F.count("*").alias("times")).filter("times > 1").drop("times")
    again = open_.join(often, ["h1", "h2"]).select("id", "start", "n").union(hashed.filter("h1 is null").select("id", "start", "n"))
    spans = listed(repeated.union(found).union(again), ["start", "n"], "spans")
    cut = docs.join(spans, "id", "left").mapInArrow(
        _cut(length), "id long, n_bytes long, n_removed long, n_spans long, kept binary"
    )
    return with_given_ids(cut, names).select(given_id("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept")
