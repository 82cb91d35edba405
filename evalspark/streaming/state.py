"""First successes on Spark's state store: no folder of earlier batches is read, whatever the stream's age."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..schemas import SUCCESS
from .grading import KEYS

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


COMPACT = 1 << 16  # rows that wait before a task drops those that are not their key's first


def _least(rows: pa.Table, keys: Sequence[str]) -> pa.Table:
    """One row per key, of least (ts, attempt_id); nulls count as least."""
    order = [(c, "ascending") for c in (*keys, "ts", "attempt_id")]
    rows = rows.take(pc.sort_indices(rows, sort_keys=order, null_placement="at_start")).combine_chunks()
    new = np.ones(len(rows), bool)
    if len(rows) > 1:
        new[1:] = False
        for key in keys:
            before, now = rows[key].slice(0, len(rows) - 1), rows[key].slice(1)
            differs = pc.fill_null(pc.not_equal(before, now), False)
            differs = pc.or_(differs, pc.xor(before.is_null(), now.is_null()))
            new[1:] |= differs.to_numpy()
    return rows.filter(pa.array(new))


def _firsts(keys: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, waiting, n = None, [], 0
        for batch in batches:
            waiting.append(batch)
            n += len(batch)
            if n >= max(COMPACT, 0 if kept is None else len(kept)):  # twice the keys at most are held
                kept, waiting, n = _least(pa.concat_tables([*([] if kept is None else [kept]), pa.Table.from_batches(waiting)]), keys), [], 0
        if waiting:
            kept = _least(pa.concat_tables([*([] if kept is None else [kept]), pa.Table.from_batches(waiting)]), keys)
        if kept is not None:
            yield from kept.to_batches(max_chunksize=10_000)

    return run


def first_successes(attempts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Of a stream of attempts one successful attempt per key: of the first micro-batch that has any the least
    (ts, attempt_id), emitted in that batch and never again.

    The rows of a key meet in one task, which keeps the least of the micro-batch; the state store then holds the keys
    that were emitted, with its checkpoint: a restart goes on with it. It grows with the keys and has no time to live.
    A key that is retried very often needs no memory for it. Start the query with :func:`start`.
    """
    done = attempts.filter(F.col("status") == SUCCESS)
    met = done.repartition(*keys).mapInArrow(_firsts(tuple(keys)), done.schema)
    return met.dropDuplicates(list(keys))


def start(writer: DataStreamWriter, checkpoint: str) -> StreamingQuery:
    """Run to the end of what has arrived, with state kept in RocksDB on the executors and checkpointed."""
    conf = writer._spark.conf
    before = conf.get(PROVIDER)
    conf.set(PROVIDER, ROCKSDB)  # the query takes its own copy of the settings when it starts
    try:
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(PROVIDER, before)
