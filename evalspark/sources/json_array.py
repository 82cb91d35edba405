"""JSON arrays of any size, read by many tasks.

`multiLine` reading parses a whole array in one task. Here the file is cut at closing braces, which Spark's text source
does by byte ranges, and the cut pieces are put together again in two passes:

1. Each block of bytes is scanned for quotes, brackets and commas, once as if it began outside a string and once as if it
   began inside. Each block's real state, in a string or not, how deep and after how many elements, follows from the
   blocks before it: one small row per block is composed in order.
2. With that state each block is cut at the commas of depth 1. Elements that lie in one block stay where they are; only
   those that reach over a block's end, at most two pieces a block, are shuffled and joined.

An array may also be spread over several files, in the order of their names, as :func:`write` leaves it; each ends after
a comma, a bracket or a blank.
"""

from __future__ import annotations

import json
import sys
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.json_text import JSON_OPTIONS

cloudpickle.register_pickle_by_value(sys.modules[__name__])

QUOTE, ESCAPE, COMMA, OPEN = ord('"'), ord("\\"), ord(","), ord("[")
STEP = np.zeros(256, np.int8)
STEP[[ord("["), ord("{")]] = 1
STEP[[ord("]"), ord("}")]] = -1
GROUP = 1 << 22  # bytes that are scanned at once
SUMMARY = ["file", "block", "size", "n_bytes", "odd", "outside", "inside", "commas_outside", "commas_inside"]


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The text between closing braces, in order within its block: (file, block, size, piece)."""
    rows = spark.read.option("lineSep", "}").text(path)
    meta = [F.col(f"_metadata.{m}").alias(n) for m, n in (("file_path", "file"), ("file_block_start", "block"), ("file_size", "size"))]
    return rows.select(*meta, F.col("value").alias("piece"))


class Group(NamedTuple):
    """Bytes of one block, up to GROUP of them; `first` and `last` of the block. A brace follows every piece, also the last
    of a file, which has none."""

    key: tuple[str, int]
    size: int
    first: bool
    last: bool
    buf: np.ndarray


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[Group]:
    held: Group | None = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = list(zip(batch.column("file").to_pylist(), batch.column("block").to_pylist()))
        sizes, pieces = batch.column("size").to_pylist(), batch.column("piece").cast(pa.binary()).to_pylist()
        at = 0
        while at < n:
            end, total = at, 0
            while end < n and keys[end] == keys[at] and (end == at or total < GROUP):
                total += len(pieces[end]) + 1
                end += 1
            buf = np.frombuffer(b"}".join(pieces[at:end]) + b"}", np.uint8)
            new = held is None or held.key != keys[at]
            if held is not None:
                yield held._replace(last=new)
            held = Group(keys[at], sizes[at], new, False, buf)
            at = end
    if held is not None:
        yield held._replace(last=True)


def _quotes(buf: np.ndarray) -> np.ndarray:
    """Which bytes are quotes that open or close a string: those after an even number of backslashes."""
    quote, escape = buf == QUOTE, buf == ESCAPE
    if escape.any():
        place = np.arange(len(buf))
        other = np.maximum.accumulate(np.where(escape, -1, place))  # the last byte that is no backslash
        quote[1:] &= (place[:-1] - other[:-1]) % 2 == 0
    return quote


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block: its bytes, whether its quotes are odd in number, and for both ways to begin (outside a string, inside
    one) by how much the depth changes and how many commas stand at each depth, counted from the depth at its start."""
    rows: list[tuple] = []
    for g in _groups(batches):
        if g.first:
            n_bytes, odd, depth, commas = 0, False, [0, 0], [Counter(), Counter()]
        quote = _quotes(g.buf)
        inside = (np.cumsum(quote) + odd) % 2 == 1
        for way in (0, 1):
            here = ~inside if way == 0 else inside
            level = depth[way] + np.cumsum(np.where(here, STEP[g.buf], 0))
            kinds, times = np.unique(level[here & (g.buf == COMMA)], return_counts=True)
            commas[way].update(dict(zip(kinds.tolist(), times.tolist())))
            depth[way] = int(level[-1])
        n_bytes += len(g.buf)
        odd ^= bool(quote.sum() % 2)
        if g.last:
            rows.append((*g.key, g.size, n_bytes, odd, *depth, *(json.dumps(list(c.items())) for c in commas)))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=SUMMARY)


class State(NamedTuple):
    """Of a block at its start: in a string or not, depth, elements before; `bare`: no brace follows its last piece."""

    in_string: bool
    depth: int
    before: int
    bare: bool


def _states(summaries: list[Row]) -> dict[tuple[str, int], State]:
    """States of the blocks, from their summaries in order."""
    read, final = Counter(), {}
    for s in summaries:
        read[s.file] += s.n_bytes
        final[s.file] = s.block
    states, in_string, depth, before = {}, False, 0, 0
    for s in summaries:
        bare = final[s.file] == s.block and read[s.file] > s.size
        states[s.file, s.block] = State(in_string, depth, before, bare)
        change, commas = (s.inside, s.commas_inside) if in_string else (s.outside, s.commas_outside)
        before += dict(json.loads(commas)).get(1 - depth, 0)
        in_string ^= s.odd
        depth += change + (bare and not in_string)  # a brace that is not there took one level back
    if in_string or depth:
        raise ValueError("the file is not a JSON array that is closed at its end")
    return states


def _cutter(states: dict[tuple[str, int], State]):
    """Rows (pos, file, block, text, whole): an element, or, where not `whole`, a piece of it that reaches over its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["pos", "file", "block", "text", "whole"])

        for g in _groups(batches):
            state = states[g.key]
            if g.first:
                in_string, depth, pos, rest = state.in_string, state.depth, state.before, b""
                open_ = depth > 0  # the element began in an earlier block
            buf = g.buf[:-1] if g.last and state.bare else g.buf
            quote = _quotes(buf)
            inside = (np.cumsum(quote) + in_string) % 2 == 1
            step = np.where(inside, 0, STEP[buf])
            level = depth + np.cumsum(step)
            raw, at = buf.tobytes(), 0
            cuts = ((level == 1) & (step == 1)) | ((level == 0) & (step == -1)) | ((buf == COMMA) & ~inside & (level == 1))
            for place in np.flatnonzero(cuts).tolist():
                if step[place] == 1:  # the bracket of the array: what stands before it is no part of an element
                    if raw[place] != OPEN:
                        raise ValueError("the file holds something else than one JSON array")
                    rest, open_ = b"", False
                else:
                    rows.append((pos, *g.key, (rest + raw[at:place]).decode(), not open_))
                    rest, open_, pos = b"", False, pos + 1
                    if len(rows) >= 4096:
                        yield out()
                        rows.clear()
                at = place + 1
            rest += raw[at:]
            in_string ^= bool(quote.sum() % 2)
            depth = int(level[-1]) if len(level) else depth
            if g.last and depth > 0:
                rows.append((pos, *g.key, rest.decode(), False))
        if rows:
            yield out()

    return run


def elements(spark: SparkSession, path: str) -> DataFrame:
    """Elements of a JSON array as rows (pos, text), pos from 0 along the array. Blanks around the array are skipped; an
    empty array has no rows. What is not an array, or not closed at its end, is an error.

    The driver takes one row per block (of `spark.sql.files.maxPartitionBytes`), not of the elements.
    """
    pieces = _pieces(spark, path)
    kinds = "string long long long boolean long long string string".split()
    summaries = pieces.mapInArrow(_summaries, ", ".join(f"{n} {k}" for n, k in zip(SUMMARY, kinds)))
    states = _states(summaries.orderBy("file", "block").collect())
    cut = pieces.mapInArrow(_cutter(states), "pos long, file string, block long, text string, whole boolean")
    parts = cut.filter("not whole").groupBy("pos").agg(F.sort_array(F.collect_list(F.struct("file", "block", "text"))).alias("p"))
    joined = parts.select("pos", F.array_join("p.text", "").alias("text"))
    found = cut.filter("whole").select("pos", "text").unionByName(joined)
    return found.filter(~F.col("text").rlike(r"\A[ \t\r\n]*\z"))


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of an array of objects by the schema, with `pos`."""
    rows = elements(spark, path).select("pos", F.from_json("text", schema, JSON_OPTIONS).alias("r"))
    return rows.select("r.*", "pos")


def write(rows: DataFrame, path: str, order: str) -> None:
    """Write rows as one JSON array in the order of a column of unique, non-null values, spread over files by their names."""
    ends = rows.agg(F.min(order).alias("lo"), F.max(order).alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    text = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    line = F.concat(F.when(F.col(order) == lo, "[").otherwise(""), text, F.when(F.col(order) == hi, "]").otherwise(","))
    rows.repartitionByRange(F.col(order)).sortWithinPartitions(order).select(line.alias("value")).write.text(path)
