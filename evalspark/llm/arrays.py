"""Text as numpy arrays: Arrow batches to byte groups, words, rolling hashes, anchors.

Work on one Arrow batch goes through groups of at most `GROUP_BYTES` bytes of text (a longer text is a
group of its own), so temporary arrays stay small whatever the batch holds. A group is a byte array and
the offsets of its texts; nothing computed from it crosses a text boundary.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

GROUP_BYTES = 1 << 18
NO_ID = -(1 << 63)  # stands for a null id inside the operators

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
PUNCTUATION = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
EMPTY = np.empty(0, U)


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash: every output bit depends on every input bit."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


class Roller:
    """Polynomial hashes of any slice of an array of units, modulo 2^64, from one prefix sum."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.bytes = rng.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
        self.base = U(int(rng.integers(2**40, 2**62)) * 8 + 5)
        self.inverse = U(pow(int(self.base), -1, 1 << 64))
        self.powers = np.ones(1, U)
        self.inverses = np.ones(1, U)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            for name, base in (("powers", self.base), ("inverses", self.inverse)):
                steps = np.full(2 * n, base, U)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def prefix(self, units: np.ndarray) -> np.ndarray:
        """Prefix sums for `of`. Bytes go through a table; 64-bit units are taken as they are."""
        self._grow(len(units) + 1)
        values = self.bytes[units] if units.dtype == np.uint8 else units
        out = np.empty(len(units) + 1, U)
        out[0] = 0
        np.cumsum(values * self.powers[: len(units)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.inverses[start] + (end - start).astype(U))


WORDS, KEYS, SHINGLES = Roller(11), Roller(23), Roller(37)


def ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def id_array(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=values == NO_ID)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, nulls as empty, and the offset of each row (one more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), offs


def byte_groups(column: pa.Array, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of rows of at most `limit` bytes, one row at least."""
    buf, offs = text_buffer(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(buf: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of each text: 64-bit hashes, byte starts, byte ends, and word offsets by text.
    `space` tells for each byte whether it separates words."""
    inside = np.zeros(len(buf) + 2, bool)
    np.logical_not(space[buf], out=inside[1:-1])
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    hashes = WORDS.of(WORDS.prefix(buf), start, end)
    return hashes, start, end, np.searchsorted(start, offs)


def ngrams(hashes: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text; a text of fewer words, but one at least, has its whole
    sequence as its only shingle. Returns the hashes and the offsets by text."""
    counts = np.diff(offs)
    short = (counts < k) & (counts > 0)
    sizes = np.where(short, 1, np.maximum(counts - k + 1, 0))
    at = np.concatenate(([0], np.cumsum(sizes)))
    first = np.repeat(offs[:-1] - at[:-1], sizes) + np.arange(at[-1])
    length = np.repeat(np.where(short, counts, k), sizes)
    prefix = SHINGLES.prefix(hashes)
    return SHINGLES.of(prefix, first, first + length), at


class Blocks(NamedTuple):
    """Content-defined blocks of windows, one entry per block. Windows are counted by their first unit."""

    text: np.ndarray  # row in the group
    key: np.ndarray  # hash of the anchor
    full: np.ndarray  # hash of all units that the block's windows cover, and of the anchor's place among them
    start: np.ndarray  # first window, from the text's start
    n: np.ndarray  # number of windows
    left: np.ndarray  # units from `start` to the anchor


def blocks(units: np.ndarray, offs: np.ndarray, window: int, k: int) -> Blocks:
    """Winnowing. Of the k-unit grams in a window the one with the least hash (the leftmost of equals) is its
    anchor, so equal windows have equal anchors at equal places, and every window has one. Consecutive
    windows with the same anchor form a block; equal windows lie in blocks with equal keys."""
    none = np.empty(0, np.int64)
    sizes = np.diff(offs)
    has = np.flatnonzero(sizes >= window)
    if not len(has):
        return Blocks(none, EMPTY, EMPTY, none, none, none)
    prefix = KEYS.prefix(units)
    raw = (prefix[k:] - prefix[:-k]) * KEYS.inverses[: len(units) - k + 1]
    where = least_of(raw * U(0x9E3779B97F4A7C15), window - k + 1)
    # the first window of each block: the anchor changes or a text begins; windows over a text's end go
    new = np.empty(len(where), bool)
    new[0] = True
    np.not_equal(where[1:], where[:-1], out=new[1:])
    first, end = offs[:-1][has], offs[1:][has] - window + 1
    new[first] = True
    stop = np.zeros(len(where) + 1, bool)
    stop[end] = True
    new |= stop[:-1]
    head = np.flatnonzero(new)
    n = np.diff(np.append(head, len(where)))
    owner = np.searchsorted(first, head, "right") - 1
    good = (owner >= 0) & (head < end[owner])
    head, n, owner = head[good], n[good], owner[good]
    left = where[head] - head
    full = mix(KEYS.of(prefix, head, head + n - 1 + window) + (left + 1).astype(U) * U(0x9E3779B97F4A7C15))
    return Blocks(has[owner], mix(raw[where[head]] + U(k)), full, head - first[owner], n, left)


def least_of(values: np.ndarray, w: int) -> np.ndarray:
    """Where the least of every w neighbours is (compared by the upper 33 bits, the leftmost of equals)."""
    n = len(values)
    out = n - w + 1
    low = U((1 << 31) - 1)
    least = (values & ~low) | np.arange(n, dtype=np.uint64)
    size = 1
    while 2 * size <= w:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    return (np.minimum(least[:out], least[w - size : w - size + out]) & low).astype(np.int64)
