"""Task bitmaps per model: one index table that answers cohort, pending and coverage questions for any roster without the log.

An index is a folder of versions. Each version holds the tasks it added with their numbers (`tasks`), these tasks as bitmaps
(`universe`), and bitmaps of the tasks that models finished since (`done`). A bitmap row covers 32,768 numbers of one model in
4 KB. Versions are merged by OR, so a version written twice, or a response recorded twice, changes nothing. Only responses to
numbered tasks count; a task listed twice is one task, null tasks are none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runs import roster_ids

TASK = "task_id string, task_no bigint"
BITS = "model_id string, bucket bigint, bits binary"
UNIVERSE = "bucket bigint, bits binary"
BITS_A_ROW = 1 << 15
_VERSION_SHIFT = 48  # above the partition number of monotonically_increasing_id, for fewer than 2**15 partitions


def _bitmaps(numbered: DataFrame, by: list[str]) -> DataFrame:
    rows = numbered.withColumn("bucket", F.bitmap_bucket_number("task_no")).withColumn("bit", F.bitmap_bit_position("task_no"))
    return rows.groupBy(*by, "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def write(tasks: DataFrame, finals: DataFrame, path: str, version: int = 0) -> None:
    """Add a version: tasks not numbered before, then the responses `finals` (model_id, task_id) to any numbered task.

    Numbers follow the order of task ids within a version. They are taken by range partitions, each with numbers of its own,
    so no task sees them all, and are read back from the written table: a recomputed partition cannot number tasks anew.
    """
    spark = tasks.sparkSession
    new = tasks.select("task_id").filter(F.col("task_id").isNotNull()).distinct()
    if version:
        new = new.join(_tasks(spark, path, version - 1), "task_id", "left_anti")
    number = F.monotonically_increasing_id() + F.lit((version << _VERSION_SHIFT) + 1)
    numbered = new.sort("task_id").select("task_id", number.alias("task_no"))
    numbered.write.mode("overwrite").parquet(f"{path}/tasks/version={version}")
    added = spark.read.schema(TASK).parquet(f"{path}/tasks/version={version}")
    _bitmaps(added, []).write.mode("overwrite").parquet(f"{path}/universe/version={version}")
    done = finals.select("model_id", "task_id").join(_tasks(spark, path, version), "task_id")
    _bitmaps(done, ["model_id"]).write.mode("overwrite").parquet(f"{path}/done/version={version}")


def _read(spark: SparkSession, path: str, part: str, schema: str, version: int) -> DataFrame:
    folders = [spark.read.schema(schema).parquet(f"{path}/{part}/version={v}") for v in range(version + 1)]
    return reduce(DataFrame.unionByName, folders)


def _tasks(spark: SparkSession, path: str, version: int) -> DataFrame:
    return _read(spark, path, "tasks", TASK, version)


def _universe(spark: SparkSession, path: str, version: int) -> DataFrame:
    return _read(spark, path, "universe", UNIVERSE, version)  # versions number apart: no bucket stands in two of them


def _done(spark: SparkSession, path: str, version: int, roster: DataFrame) -> DataFrame:
    rows = _read(spark, path, "done", BITS, version).join(roster.select("model_id").distinct(), "model_id", "left_semi")
    return rows.groupBy("model_id", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def _byte(bits: str) -> Column:
    return F.conv(F.hex(F.substring(F.col(bits), F.col("at") + 1, F.lit(1))), 16, 10).cast("int")


def _members(rows: DataFrame, keep: list[str], value: Column) -> DataFrame:
    """(keep, task_no) of the bits set in `value`, the byte at place `at` of a row; empty bytes are left out first."""
    places = rows.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(BITS_A_ROW // 8 - 1))))
    found = places.select(*keep, "bucket", "at", value.alias("byte")).filter("byte <> 0")
    bits = found.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(7)))).filter("(shiftright(byte, bit) & 1) = 1")
    return bits.select(*keep, F.expr(f"(bucket - 1) * {BITS_A_ROW} + at * 8 + bit + 1").alias("task_no"))


def cohort(spark: SparkSession, path: str, version: int, roster: DataFrame) -> DataFrame:
    """Numbered tasks that every model of the roster finished; none for an empty roster."""
    both = _done(spark, path, version, roster).groupBy("bucket").agg(
        F.count("*").alias("models"), F.bitmap_and_agg("bits").alias("bits"))
    full = both.filter(F.col("models") == F.size(roster_ids(roster)))
    return _members(full, [], _byte("bits")).join(_tasks(spark, path, version), "task_no").select("task_id")


def pending(spark: SparkSession, path: str, version: int, roster: DataFrame) -> DataFrame:
    """(task_id, model_id) of numbered tasks that models of the roster have not finished.

    The roster is spread over the rows of the universe, 32,768 tasks each: as many rows as a full index has.
    """
    spread = _universe(spark, path, version).withColumn("ids", roster_ids(roster))
    spread = spread.select("bucket", F.col("bits").alias("every"), F.explode("ids").alias("model_id"))
    left = spread.join(_done(spark, path, version, roster), ["model_id", "bucket"], "left").filter(
        F.col("bits").isNull() | (F.bitmap_count("bits") < F.bitmap_count("every")))
    # what is done is part of the universe, so the difference is an exclusive or
    open_ = _byte("every").bitwiseXOR(F.coalesce(_byte("bits"), F.lit(0)))
    return _members(left, ["model_id"], open_).join(_tasks(spark, path, version), "task_no").select("task_id", "model_id")


def coverage(spark: SparkSession, path: str, version: int, roster: DataFrame) -> DataFrame:
    """Finished, missing and total numbered tasks per model of the roster. Bits are counted, never spread."""
    total = F.coalesce(_universe(spark, path, version).agg(F.sum(F.bitmap_count("bits"))).scalar(), F.lit(0))
    finished = _done(spark, path, version, roster).groupBy("model_id").agg(F.sum(F.bitmap_count("bits")).alias("f"))
    out = roster.select("model_id").distinct().join(finished, "model_id", "left").select(
        "model_id", F.coalesce("f", F.lit(0)).alias("finished"), total.alias("total"))
    missing = F.col("total") - F.col("finished")
    return out.withColumn("missing", missing).withColumn("complete", missing == 0)
