"""Periodic runs of words, found by string synchronising sets at dyadic scales."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .anchors import covered
from .substring import joined

LEAST_WORDS = 24  # a run is at least so long, and at least REPEATS periods
REPEATS = 3
SMALL = 8  # periods below are read off directly; scales take the others
NEXT = 12  # two copies of a context at scale t are over t / 3 apart, so at most 11 lie between places under 4 t apart
CELLS = 1 << 20

RUN = "array<struct<start:long,length:long,period:long>>"
INFINITE = A.U(2**64 - 1)


class Runs(NamedTuple):
    """Stretches [start, end) of one group of texts with their smallest periods; places count words of the group."""

    start: np.ndarray
    end: np.ndarray
    period: np.ndarray

    def of(self, which: np.ndarray) -> Runs:
        return Runs(self.start[which], self.end[which], self.period[which])


NO_RUNS = Runs(*(np.empty(0, np.int64),) * 3)


def _together(*parts: Runs) -> Runs:
    """All runs; of those with the same ends only the one with the least period, as the others are its multiples."""
    start, end, period = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.ones(len(order), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return Runs(start[first], end[first], period[first])


def small_periods(words: np.ndarray, last: np.ndarray) -> Runs:
    """The highly periodic regions: all stretches of period below SMALL and at least REPEATS periods, whatever their
    length. `last` is for each word the end of its text."""
    parts = [NO_RUNS]
    places = np.arange(len(words))
    for p in range(1, min(SMALL, len(words))):
        same = np.zeros(len(words) - p + 2, np.int8)
        same[1:-1] = (words[p:] == words[:-p]) & (places[p:] < last[:-p])
        edges = np.flatnonzero(np.diff(same))
        start, end = edges[::2], edges[1::2] + p
        long = end - start >= REPEATS * p
        parts.append(Runs(start[long], end[long], np.full(int(long.sum()), p)))
    return _together(*parts)


def synchronising(blocks: np.ndarray, scale: int, room: np.ndarray) -> np.ndarray:
    """Places i where the least fingerprint among the blocks of `scale` words that begin in [i, i + scale] is that of
    the block at i or at i + scale. Blocks in highly periodic regions have the fingerprint INFINITE and are never
    that least one. Which places these are depends on the 2 * scale words after them alone. `room` has the words left
    in the text from each place on."""
    n = len(blocks) - scale
    if n <= 0:
        return np.empty(0, np.int64)
    least, size = blocks, 1
    while 2 * size <= scale + 1:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[:n], least[scale + 1 - size : scale + 1 - size + n])
    ends = np.minimum(blocks[:n], blocks[scale : scale + n])
    return np.flatnonzero((least == ends) & (least != INFINITE) & (room[:n] >= 2 * scale))


def _proposals(context: np.ndarray, text: np.ndarray, ends: np.ndarray, at: np.ndarray, scale: int):
    """(place, period) of synchronising places `at` whose context, a block of 2 * scale words, comes again in their
    text, after 2 to 4 scales, and which begin a square of that period."""
    key = A.mix(context[at] ^ (text[at].astype(A.U) * A.U(0x9E3779B97F4A7C15)))
    order = np.argsort(key, kind="stable")
    key, at = key[order], at[order]
    places, periods = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for k in range(1, NEXT):
        pair = np.flatnonzero(key[k:] == key[:-k])
        if not len(pair):
            break
        i, d = at[pair], at[pair + k] - at[pair]
        good = (d >= 2 * scale) & (d < 4 * scale)
        i, d = i[good], d[good]
        good = i + 2 * d <= ends[i]
        i, d = i[good], d[good]
        # the first 2 * scale words of two periods are equal; with the last ones that is all of them
        good = context[i + d - 2 * scale] == context[i + 2 * d - 2 * scale]
        places.append(i[good])
        periods.append(d[good])
    return np.concatenate(places), np.concatenate(periods)


def _reach(words: np.ndarray, at: np.ndarray, period: np.ndarray, stop: np.ndarray, step: int) -> np.ndarray:
    """How far words equal those `period` later, from each place on, in direction `step`, up to the place `stop`."""
    far = np.zeros(len(at), np.int64)
    open_ = np.arange(len(at))
    width = 16
    while len(open_):
        still = [np.empty(0, np.int64)]
        for lo in range(0, len(open_), max(1, CELLS // width)):
            some = open_[lo : lo + max(1, CELLS // width)]
            left = np.maximum((stop[some] - at[some]) * step - far[some], 0)
            reach = np.arange(width)
            place = at[some, None] + step * (far[some, None] + np.minimum(reach, np.maximum(left - 1, 0)[:, None]))
            place = np.clip(place, 0, len(words) - 1)
            other = np.minimum(place + period[some, None], len(words) - 1)
            differ = (words[place] != words[other]) | (reach >= left[:, None])
            ends = differ.any(1)
            far[some] += np.where(ends, differ.argmax(1), width)
            still.append(some[~ends])
        open_ = np.concatenate(still)
        width = min(2 * width, CELLS)
    return far


def _extended(words: np.ndarray, place: np.ndarray, period: np.ndarray, first: np.ndarray, last: np.ndarray) -> Runs:
    """Maximal stretches around squares. Squares of one period that touch lie in one stretch and are extended once."""
    order = np.lexsort((place, period))
    place, period = place[order], period[order]
    new = np.ones(len(place), bool)
    new[1:] = (period[1:] != period[:-1]) | (place[1:] > place[:-1] + period[1:]) | (first[place[1:]] != first[place[:-1]])
    head = np.flatnonzero(new)
    begin, period = place[head], period[head]
    end = place[np.append(head[1:], len(place)) - 1] + period  # words from begin to here equal those a period later
    begin = begin - _reach(words, begin - 1, period, first[begin] - 1, -1)
    end = end + _reach(words, end, period, last[begin] - period, 1)
    end = end + period
    long = end - begin >= REPEATS * period
    return _together(Runs(begin[long], end[long], period[long]), NO_RUNS)


def find(words: np.ndarray, offs: np.ndarray) -> Runs:
    """All runs in texts of words (64-bit hashes), `offs` the offsets by text: maximal stretches of at least
    LEAST_WORDS words and REPEATS smallest periods, by start, then period.

    Periods from 2 t up to 4 t are found at scale t = 4, 8, 16 and so on. A run of such a period p has a synchronising
    place among its first p words: else each of its windows of 3 t - 1 words had a period of at most t / 3, and so had
    the run. What stands there, 2 t words, comes again p words on, still in the run, with fewer than NEXT copies
    between. So each synchronising place and the next copies of its context propose a period; squares are kept and
    extended to both sides. Blocks whose period is at most a third of the scale are in stretches that smaller scales,
    or the direct reading of periods below SMALL, have supplied.
    """
    sizes = np.diff(offs)
    first, last = np.repeat(offs[:-1], sizes), np.repeat(offs[1:], sizes)
    text = np.repeat(np.arange(len(sizes)), sizes)
    found = small_periods(words, last)
    # from here on only texts that are long enough for the scale; `back` are their words' places in the group
    scale, back = 1, np.arange(len(words))
    blocks = words
    while True:
        if scale >= SMALL // 2:
            keep = (last - first)[back] >= 2 * REPEATS * scale
            if not keep.all():
                back, blocks = back[keep], blocks[keep]
            if not len(back):
                break
            here, ends, own = words[back], np.searchsorted(back, last[back]), text[back]
            begins = np.searchsorted(back, first[back])
            room = ends - np.arange(len(back))
            ids = np.where(room >= scale, blocks, INFINITE)
            dense = found.of((found.period * 3 <= scale) & (found.end - found.start >= scale))
            inside = np.searchsorted(back, dense.start)
            known = (inside < len(back)) & (back[np.minimum(inside, len(back) - 1)] == dense.start)
            dense, inside = dense.of(known), inside[known]
            ids[covered(len(ids), inside, inside + (dense.end - dense.start) - scale + 1)] = INFINITE
            at = synchronising(ids, scale, room)
            double = _doubled(blocks, scale)
            place, period = _proposals(double, own, ends, at, scale)
            if len(place):
                runs = _extended(here, place, period, begins, ends)
                found = _together(found, Runs(back[runs.start], back[runs.start] + runs.end - runs.start, runs.period))
            blocks = double
        else:
            blocks = _doubled(blocks, scale)
        scale *= 2
    return found.of((found.end - found.start >= LEAST_WORDS) & (found.end - found.start >= REPEATS * found.period))


def _doubled(blocks: np.ndarray, scale: int) -> np.ndarray:
    """Fingerprints of blocks of twice the scale; those that run over the end of all words are without meaning."""
    later = np.zeros_like(blocks)
    later[: max(0, len(blocks) - scale)] = blocks[scale:]
    return A.mix(blocks * A.U(0x9E3779B97F4A7C15) + A.mix(later + A.U(scale)))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, offs in A.byte_groups(batch.column("text"), 1 << 20):
            hashes, head, tail, at = A.words(buf, offs)
            found = find(hashes, at)
            of = np.searchsorted(at, found.start, "right") - 1
            counts = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=hi - lo)))).astype(np.int32)
            gone = covered(len(hashes), found.start + found.period, found.end)
            kept, _ = joined(buf, offs, head, tail, at, ~gone)
            fields = [pa.array(x.astype(np.int64)) for x in (found.start - at[of], found.end - found.start, found.period)]
            runs = pa.ListArray.from_arrays(pa.array(counts), pa.StructArray.from_arrays(fields, names=["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(lo, hi - lo), pa.array(np.diff(at)), runs, kept],
                names=["id", "n_words", "runs", "collapsed_text"],
            )


def find_runs(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `documents`: id, n_words, runs (start, length, period in words, by start and period), and
    collapsed_text: the words `[^\\x20\\x09-\\x0D]+`, joined by one space, without those that a run contains after its
    first period.

    A run is a maximal stretch with smallest period q and at least max(24, 3 q) words. Every text is worked on by
    itself and whole; memory is in proportion to the longest text. Words are compared by 64-bit hashes. Null, empty and
    blank texts have no runs and collapse to the empty text. Null, repeated and shared ids pass through; other columns
    are not read.
    """
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(_runs, f"id long, n_words long, runs {RUN}, collapsed_text string")
    return out.withColumnRenamed("id", id_col)


def plant(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and text. With h the crc32 of the id in decimal and g = floor(h / 10): where h % 10 = 0 and the text has n > 0
    words, word i from a = g % n on becomes word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)), and words are
    joined by one space. Other texts, and rows without an id, stay as they are."""
    h = F.crc32(F.col("id").cast("string").cast("binary"))
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    chosen = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    rows = rows.withColumn("words", chosen)
    rows = rows.withColumn("n", F.expr("nullif(size(words), 0)")).withColumn("g", F.expr("crc32(cast(cast(id as string) as binary)) div 10"))
    rows = rows.withColumn("a", F.expr("g % n")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    word = F.expr("transform(words, (w, i) -> if(i < a, w, words[cast(a + (i - a) % p as int)]))")
    return rows.select(F.col("id").alias(id_col), F.when(F.col("n") > 0, F.array_join(word, " ")).otherwise(F.col("text")).alias("text"))


def strongest(runs: str) -> Column:
    """Of a list of runs the one of greatest length / period, then least start, then least period; null if none.
    Quotients are compared by cross-multiplication."""
    better = "r.length * m.period > m.length * r.period or r.length * m.period = m.length * r.period and (r.start, r.period) < (m.start, m.period)"
    return F.expr(f"aggregate({runs}, get({runs}, 0), (m, r) -> if({better}, r, m))")
