"""Accuracy tables. All sums are integer counts, so results do not depend on row order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import PASS_COLUMNS, REPLY_FIELDS
from .runs import of_roster, roster_ids

METRICS = ("exact", *REPLY_FIELDS)


def _count(col: str) -> Column:
    return F.sum(F.col(col).cast("bigint"))


def _metric_sums() -> list[Column]:
    sums = [_count("exact").alias("exact")]
    return sums + [_count(p).alias(f) for p, f in zip(PASS_COLUMNS, REPLY_FIELDS)]


def _composite() -> Column:
    return F.col("points") / (F.lit(float(len(REPLY_FIELDS))) * F.col("n"))


def accuracy(grades: DataFrame, by: list[str]) -> DataFrame:
    """Denominator, correct count per metric and mean composite score for each group."""
    out = grades.groupBy(*by).agg(
        F.count("*").alias("n"), *_metric_sums(), _count("n_pass").alias("points")
    )
    return out.withColumn("composite", _composite())


def metric_long(table: DataFrame, ids: list[str], metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """One row per group and selectable metric: (ids, metric, n, correct, accuracy)."""
    long = table.select(*ids, "n", *metrics).unpivot([*ids, "n"], list(metrics), "metric", "correct")
    return long.withColumn("accuracy", F.col("correct") / F.col("n"))


def subgroup_accuracy(grades: DataFrame, by: Sequence[str] = ("model_id",)) -> DataFrame:
    """Accuracy within every level of each of the six attributes, for each group.

    Grades are first reduced to one row per (group, label tuple); only that small table is spread
    over the six headings. Spreading the grades themselves would multiply every row by six.
    """
    cells = grades.groupBy(*by, *REPLY_FIELDS).agg(F.count("*").alias("n"), *[
        s.alias(f"m_{m}") for m, s in zip(METRICS, _metric_sums())
    ])
    headings = F.explode(F.array(*[
        F.struct(F.lit(f).alias("heading"), F.col(f).alias("level")) for f in REPLY_FIELDS
    ]))
    spread = cells.select(*by, headings.alias("h"), "n", *[f"m_{m}" for m in METRICS])
    return spread.groupBy(*by, "h.heading", "h.level").agg(
        F.sum("n").alias("n"), *[F.sum(f"m_{m}").alias(m) for m in METRICS]
    )


def shared_cohort(finals: DataFrame, roster: DataFrame) -> DataFrame:
    """Tasks that every model of the roster has answered.

    One shuffle: the answering models are collected per task, a set no larger than the roster.
    """
    per_task = of_roster(finals, roster).groupBy("task_id").agg(F.size(F.collect_set("model_id")).alias("k"))
    return per_task.filter(F.col("k") == F.size(roster_ids(roster))).select("task_id")


def shared_accuracy(grades: DataFrame, roster: DataFrame) -> DataFrame:
    """Accuracy per roster model over the tasks all of them answered.

    Grades are first summed per (model, task): whatever the number of repeated trials, a task then
    has at most a roster's worth of rows under the window that counts its models, so grading runs once. Where grades come out of
    a join or aggregate on these keys, that needs no further shuffle. (For repeated trials with a hot
    task, ``spark.sql.adaptive.forceOptimizeSkewedJoin`` lets Spark trade that saving for a split of
    the grading join; final responses hold one row per model and task and cannot be hot.)
    """
    cells = of_roster(grades, roster).groupBy("model_id", "task_id").agg(
        F.count("*").alias("n"), *_metric_sums(), _count("n_pass").alias("points"))
    answered = F.count("*").over(Window.partitionBy("task_id"))  # one cell per roster model
    common = cells.withColumn("answered", answered).filter(F.col("answered") == F.size(roster_ids(roster)))
    out = common.groupBy("model_id").agg(*[F.sum(c).alias(c) for c in ("n", *METRICS, "points")])
    return out.withColumn("composite", _composite())
