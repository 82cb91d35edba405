"""Incremental grading of arriving attempts. Batch and stream share the same operators.

Every query runs with a checkpoint and ``availableNow``: it takes what has arrived, stops, and a
later start resumes after it, also when executors or the driver were lost in between.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.grading import grade
from ..operators.replies import STRICT
from ..operators.runs import coverage, model_state
from ..schemas import PASS_COLUMNS, SUCCESS

KEYS = ("run_id", "model_id", "task_id")


def grade_stream(attempts: DataFrame, truth: DataFrame, mode: str = STRICT) -> DataFrame:
    """Grades of the successful attempts: a stream-static join, no state."""
    done = attempts.filter(F.col("status") == SUCCESS).drop("status")
    return grade(done, truth, mode)


def keep_first_successes(
    attempts: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = KEYS
) -> StreamingQuery:
    """Land one successful attempt per key: of the first micro-batch that has any the least (ts, attempt_id).

    A batch is reduced map-side, rid of keys that earlier batches landed, and written to a folder of its
    own, so a repeated batch writes the same rows again and no state is kept in memory. Read the folders
    with :func:`read_batches`.
    """
    def write(batch: DataFrame, number: int) -> None:
        done = batch.filter(F.col("status") == SUCCESS)
        rest = [c for c in done.columns if c not in keys]
        first = F.min_by(F.struct(*rest), F.struct("ts", "attempt_id")).alias("a")
        firsts = done.groupBy(*keys).agg(first).select(*keys, "a.*")
        for earlier in _written(batch.sparkSession, path, number):
            firsts = firsts.join(batch.sparkSession.read.parquet(*earlier).select(*keys), list(keys), "left_anti")
        firsts.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = attempts.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
    return writer.foreachBatch(write).start()


def _batch_folders(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches below the path that were written to the end."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/_SUCCESS")
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(root) or []
    return sorted(int(f.getPath().getParent().getName().removeprefix("batch=")) for f in found)


def _written(spark: SparkSession, path: str, before: int) -> list[list[str]]:
    """The folders of earlier batches, as one list or none at all."""
    folders = [f"{path}/batch={n}" for n in _batch_folders(spark, path) if n < before]
    return [folders] if folders else []


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All batches that were written to the end."""
    return spark.read.parquet(*[f"{path}/batch={n}" for n in _batch_folders(spark, path)])


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The last complete version of a table kept by :func:`replace_table` or :func:`publish_states`."""
    return spark.read.parquet(f"{path}/batch={_batch_folders(spark, path)[-1]}")


def progress_stream(grades: DataFrame, by: Sequence[str] = ("model_id",)) -> DataFrame:
    """Running number of graded responses and correct ones per group (update or complete mode)."""
    passes = [F.sum(F.col(p).cast("bigint")).alias(p.removesuffix("_pass")) for p in PASS_COLUMNS]
    return grades.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(F.col("exact").cast("bigint")).alias("exact"), *passes)


def append_files(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run to the end of what has arrived, appending to a Parquet folder exactly once."""
    writer = stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
    return writer.option("path", path).option("checkpointLocation", checkpoint).start()


def replace_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run to the end of what has arrived, keeping the complete aggregate, each version in its own folder.

    A repeated micro-batch rewrites its own version, so a restart cannot count anything twice; readers take
    the last complete one with :func:`read_latest`, so a crash while writing leaves them the one before.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.outputMode("complete").trigger(availableNow=True)
    return writer.option("checkpointLocation", checkpoint).foreachBatch(write).start()


def publish_states(
    attempts: DataFrame, finals_path: str, tasks: DataFrame, stored: DataFrame, roster: DataFrame, path: str,
    checkpoint: str, invocation: str | None = None,
) -> StreamingQuery:
    """Live form of :func:`evalspark.operators.runs.model_state`: a new state table as attempts arrive.

    Models with attempts in any micro-batch of this invocation count as dispatched. A model whose latest
    attempt in the invocation failed takes that attempt's status as its state. What each batch saw is
    written under the invocation's name and read with those before it, so nothing a batch reported is
    forgotten by the next; pass the same ``invocation`` to go on after a crash. Progress is read from the
    first successes that :func:`keep_first_successes` lands; before there are any, nothing is finished.
    """
    invocation = invocation or uuid.uuid4().hex

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        latest = F.max_by(F.struct("ts", "attempt_id", "status"), F.struct("ts", "attempt_id")).alias("a")
        seen = batch.groupBy("model_id").agg(latest).select("model_id", "a.*")
        events = f"{path}/seen/{invocation}"
        seen.write.mode("overwrite").parquet(f"{events}/batch={number}")
        latest = read_batches(spark, events).groupBy("model_id").agg(latest).select("model_id", "a.*")
        errors = latest.filter(F.col("status") != SUCCESS).select(
            "model_id", F.col("status").alias("state"), F.lit("latest attempt failed").alias("reason"))
        if _batch_folders(spark, finals_path):
            finals = read_batches(spark, finals_path)
        else:
            finals = spark.createDataFrame([], "model_id string, task_id string")
        states = model_state(coverage(finals, tasks, roster), stored, roster, latest, errors)
        states.write.mode("overwrite").parquet(f"{path}/states/batch={number}")

    writer = attempts.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
    return writer.foreachBatch(write).start()


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """The last state table that :func:`publish_states` wrote."""
    return read_latest(spark, f"{path}/states")
