"""The queue of :func:`evalspark.operators.runs.queue` as an order-statistic index: positions and entries are looked up, and
answered tasks taken out, without ranking the queue.

Within a model, entries follow the SHA-256 of their task. An index is a folder of versions with entries, cut by the leading
digits of that hash, and a tree of counts: for each model the entries below every prefix of 0 to `LEAF` digits. A version
holds what it changed: entries that went, and the same changes of count along their prefixes. A position is the number of
entries of earlier models, plus the counts of smaller siblings on the path (at most 15 a level), plus the rank in the leaf.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runs import _model_order

LEAF = 3
ENTRY = "model_id string, h string, task_id string, n bigint"
COUNT = "model_id string, level int, prefix string, n bigint"


def _write(entries: DataFrame, path: str, version: int) -> None:
    """Entries sorted by leaf within files, so that a look-up of a few leaves skips row groups, and their counts."""
    spark = entries.sparkSession
    rows = entries.select("model_id", "h", "task_id", "n")
    rows.repartitionByRange("h").sortWithinPartitions("h").write.mode("overwrite").parquet(f"{path}/entries/version={version}")
    leaves = spark.read.schema(ENTRY).parquet(f"{path}/entries/version={version}").groupBy(
        "model_id", F.substring("h", 1, LEAF).alias("leaf")).agg(F.sum("n").alias("n"))
    spread = leaves.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEAF))))
    counts = spread.groupBy("model_id", "level", F.expr("left(leaf, level)").alias("prefix")).agg(F.sum("n").alias("n"))
    counts.write.mode("overwrite").parquet(f"{path}/counts/version={version}")


def _hashed(entries: DataFrame) -> DataFrame:
    """Entries with their hashes, each once; null ids are none."""
    named = entries.select("model_id", F.sha2("task_id", 256).alias("h"), "task_id")
    return named.filter(F.col("model_id").isNotNull() & F.col("task_id").isNotNull()).distinct()


def build(pending: DataFrame, path: str) -> None:
    """Version 0 from (model_id, task_id); an entry given twice is one."""
    _write(_hashed(pending).withColumn("n", F.lit(1).cast("bigint")), path, 0)


def answer(spark: SparkSession, answered: DataFrame, path: str, version: int) -> int:
    """Take entries (model_id, task_id) out; the new version. What is not in the queue changes nothing. Reads the leaves of
    these entries and writes them and their paths of counts, no others."""
    gone = _hashed(answered)
    live = _live(spark, path, version, gone.select("model_id", F.substring("h", 1, LEAF).alias("leaf")).distinct())
    out = live.join(gone, ["model_id", "h", "task_id"], "left_semi").withColumn("n", F.lit(-1).cast("bigint"))
    _write(out, path, version + 1)
    return version + 1


def _read(spark: SparkSession, path: str, part: str, schema: str, version: int) -> DataFrame:
    folders = [spark.read.schema(schema).parquet(f"{path}/{part}/version={v}") for v in range(version + 1)]
    return reduce(DataFrame.unionByName, folders)


def _live(spark: SparkSession, path: str, version: int, leaves: DataFrame) -> DataFrame:
    """(model_id, h, task_id, leaf) of the entries that stand in these leaves."""
    rows = _read(spark, path, "entries", ENTRY, version).withColumn("leaf", F.substring("h", 1, LEAF))
    rows = rows.join(leaves, ["model_id", "leaf"], "left_semi")
    return rows.groupBy("model_id", "h", "task_id", "leaf").agg(F.sum("n").alias("n")).filter("n > 0").drop("n")


def _counts(spark: SparkSession, path: str, version: int) -> DataFrame:
    """(model_id, level, prefix, n, before): entries below each prefix, and those below its smaller siblings."""
    now = _read(spark, path, "counts", COUNT, version).groupBy("model_id", "level", "prefix").agg(F.sum("n").alias("n"))
    now = now.filter("n > 0").withColumn("parent", F.expr("left(prefix, level - 1)"))
    smaller = Window.partitionBy("model_id", "level", "parent").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    return now.withColumn("before", F.coalesce(F.sum("n").over(smaller), F.lit(0)))


def _models(spark: SparkSession, path: str, version: int, roster: DataFrame) -> DataFrame:
    roots = _read(spark, path, "counts", COUNT, version).filter("level = 0").groupBy("model_id").agg(F.sum("n").alias("n_pending"))
    return _model_order(roots.filter("n_pending > 0"), roster)


def _ranked(entries: DataFrame) -> Column:
    return F.row_number().over(Window.partitionBy("model_id", "leaf").orderBy("h", "task_id"))


def positions(spark: SparkSession, path: str, version: int, keys: DataFrame, roster: DataFrame) -> DataFrame:
    """(queue_pos, provider, model_id, task_id) of those entries among `keys` (model_id, task_id) that wait in the queue."""
    asked = _hashed(keys).withColumn("leaf", F.substring("h", 1, LEAF))
    leaves = asked.select("model_id", "leaf").distinct()
    live = _live(spark, path, version, leaves)
    ranked = live.withColumn("rank", _ranked(live)).join(asked.select("model_id", "h", "task_id"), ["model_id", "h", "task_id"], "left_semi")
    steps = leaves.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(LEAF)))).withColumn("prefix", F.expr("left(leaf, level)"))
    path_sums = steps.join(_counts(spark, path, version), ["model_id", "level", "prefix"]).groupBy("model_id", "leaf").agg(
        F.sum("before").alias("before"))
    offsets = path_sums.join(_models(spark, path, version, roster).select("model_id", "provider", "ahead"), "model_id")
    return ranked.join(offsets, ["model_id", "leaf"]).select(
        (F.col("ahead") + F.col("before") + F.col("rank")).alias("queue_pos"), "provider", "model_id", "task_id")


def at(spark: SparkSession, path: str, version: int, places: DataFrame, roster: DataFrame) -> DataFrame:
    """(queue_pos, provider, model_id, task_id) of the entries at `places` (queue_pos, from 1); places past the end have none.

    The model is read off the roster's offsets, then each level off at most 16 siblings, then the leaf off its ranks.
    """
    model = F.struct("ahead", "n_pending", "provider", "model_id")
    order = _models(spark, path, version, roster).agg(F.collect_list(model)).scalar()  # a row per roster model
    here = places.select(F.col("queue_pos").cast("bigint")).distinct().withColumn("order", order)
    mine = F.filter("order", lambda m: (m.ahead < F.col("queue_pos")) & (F.col("queue_pos") <= m.ahead + m.n_pending))
    step = here.select("queue_pos", F.explode(mine).alias("m")).select(
        "queue_pos", "m.provider", "m.model_id", (F.col("queue_pos") - F.col("m.ahead")).alias("rest"), F.lit("").alias("node"))
    counts = _counts(spark, path, version)
    for level in range(1, LEAF + 1):
        children = counts.filter(F.col("level") == level).select("model_id", F.col("parent").alias("node"), "prefix", "before", "n")
        step = step.join(children, ["model_id", "node"]).filter("before < rest AND rest <= before + n").select(
            "queue_pos", "provider", "model_id", (F.col("rest") - F.col("before")).alias("rest"), F.col("prefix").alias("node"))
    found = step.withColumnRenamed("node", "leaf")
    live = _live(spark, path, version, found.select("model_id", "leaf").distinct())
    ranked = live.withColumn("rest", _ranked(live).cast("bigint"))
    return found.join(ranked, ["model_id", "leaf", "rest"]).select("queue_pos", "provider", "model_id", "task_id")
