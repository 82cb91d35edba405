"""Blocks of windows that share an anchor, over all documents: the common ground of the two exact
searches for repeated passages (`substring` on words, `suffix` on bytes)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .store import landed

BLOCK_ROW = "id long, key long, full long, start int, n int, left int"


def units_of(buf: np.ndarray, offs: np.ndarray, by_word: bool) -> tuple[np.ndarray, np.ndarray]:
    if not by_word:
        return buf, offs
    hashes, _, _, at = A.words(buf, offs)
    return hashes, at


def _blocks(window: int, gram: int, by_word: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = A.ids(batch.column("id"))
            for lo, _, buf, offs in A.byte_groups(batch.column("text")):
                found = A.blocks(*units_of(buf, offs, by_word), window, gram)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[lo + found.text]), pa.array(found.key.view(np.int64)),
                        pa.array(found.full.view(np.int64)), pa.array(found.start.astype(np.int32)),
                        pa.array(found.n.astype(np.int32)), pa.array(found.left.astype(np.int32)),
                    ],
                    names=["id", "key", "full", "start", "n", "left"],
                )

    return run


def shared_blocks(docs: DataFrame, window: int, gram: int, by_word: bool) -> DataFrame:
    """The blocks whose anchor occurs at least twice; a window with an equal lies in one of them. Texts are cut once, and
    counting combines before the shuffle. The join back reads two written tables, so only shuffles and sorts stand
    below it, and adaptive execution may split an anchor that is very common."""
    rows = landed(docs.mapInArrow(_blocks(window, gram, by_word), BLOCK_ROW), "cut")
    often = rows.groupBy("key").agg(F.count("*").alias("times")).filter("times > 1").select("key")
    return rows.join(landed(often, "often"), "key", "left_semi")


def listed(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    """One row per id with the list of its rows; bounded by the length of the document."""
    return rows.groupBy("id").agg(F.collect_list(F.struct(*columns)).alias(name))


def list_column(column: pa.Array) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Offsets by row and the flat fields of a list-of-struct column; a null list is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    fields = {f.name: c for f, c in zip(flat.type, flat.flatten())}
    return np.concatenate(([0], np.cumsum(sizes))), fields


def covered(size: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of `size` places lie in one of the spans [start, end)."""
    steps = np.bincount(start, minlength=size + 1) - np.bincount(end, minlength=size + 1)
    return np.cumsum(steps[:-1]) > 0
