"""Views kept up to date by deltas: a batch costs what the batch brings, however long the stream has run.

A view is an aggregate whose partial results can be merged. Each micro-batch writes its partials, one row per group that
it touches, to a folder that carries the batch's number. Every FAN folders of a level are merged into one of the next
level, so a version is read from at most FAN - 1 folders a level, and a group's row is rewritten once a level. A folder's
content follows from its batches alone: a batch that is repeated after a crash writes the same folders again, and
nothing is counted twice. Any version stays readable.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.runs import model_state
from ..schemas import PASS_COLUMNS, SUCCESS

FAN = 8


class View(NamedTuple):
    """`first` makes the columns of a partial result from rows, `merge` those of a result from partial results."""

    by: Sequence[str]
    first: Sequence[Column]
    merge: Sequence[Column]

    def partial(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.by).agg(*self.first)

    def merged(self, partials: DataFrame) -> DataFrame:
        return partials.groupBy(*self.by).agg(*self.merge)


def progress_view(by: Sequence[str] = ("model_id",)) -> View:
    """Numbers of graded responses, of correct ones, and of passes by field."""
    counts = ["n", "exact", *(p.removesuffix("_pass") for p in PASS_COLUMNS)]
    ones = [F.lit(1), F.col("exact"), *map(F.col, PASS_COLUMNS)]
    first = [F.sum(c.cast("bigint")).alias(name) for name, c in zip(counts, ones)]
    return View(by, first, [F.sum(name).alias(name) for name in counts])


def latest_view(by: Sequence[str] = ("model_id",)) -> View:
    """Time, id and status of the latest attempt."""
    parts = F.struct("ts", "attempt_id", "status")
    latest = F.max_by(parts, F.struct("ts", "attempt_id")).alias("a")
    again = F.max_by(F.col("a"), F.struct("a.ts", "a.attempt_id")).alias("a")
    return View(by, [latest], [again])


def _folder(path: str, level: int, number: int) -> str:
    """Of batches from number * FAN ** level on, FAN ** level of them."""
    return f"{path}/level={level}/part={number}"


def _cover(batches: int) -> list[tuple[int, int]]:
    """(level, number) of the folders that make up the first `batches` batches, largest first."""
    out, at, level = [], 0, 0
    while FAN ** (level + 1) <= batches:
        level += 1
    for step in range(level, -1, -1):
        while at + FAN**step <= batches:
            out.append((step, at // FAN**step))
            at += FAN**step
    return out


def update(view: View, rows: DataFrame, path: str, batch: int) -> None:
    """Add the rows of micro-batch `batch` (0, 1, 2, ... without gaps, each as often as it likes to run)."""
    spark = rows.sparkSession
    view.partial(rows).write.mode("overwrite").parquet(_folder(path, 0, batch))
    level, number = 0, batch
    while number % FAN == FAN - 1:
        parts = [_folder(path, level, n) for n in range(number - FAN + 1, number + 1)]
        level, number = level + 1, number // FAN
        view.merged(spark.read.parquet(*parts)).write.mode("overwrite").parquet(_folder(path, level, number))


def read(spark: SparkSession, view: View, path: str, batches: int) -> DataFrame:
    """The view after the first `batches` batches."""
    if batches < 1:
        raise ValueError("there is no version before the first batch")
    return view.merged(spark.read.parquet(*[_folder(path, *f) for f in _cover(batches)]))


def batches_written(spark: SparkSession, path: str) -> int:
    """How many batches are complete, from the first on."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/level=0/part=*/_SUCCESS")
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(root) or []
    numbers = {int(f.getPath().getParent().getName().removeprefix("part=")) for f in found}
    return next(n for n in range(len(numbers) + 1) if n not in numbers)


def finished_view() -> View:
    """Finished tasks per model, from rows that are each the first success of a (model, task)."""
    return View(["model_id"], [F.count("*").alias("finished")], [F.sum("finished").alias("finished")])


class LiveStates:
    """Live form of :func:`evalspark.operators.runs.model_state` on two views of a row per model.

    `finished` takes micro-batches of first successes per (model, task), `seen` those of all attempts of the invocation;
    either may run ahead of the other. What `read` reports follows from the batches that are complete at that time: a
    selected model whose tasks are all finished is completed; else the status of its latest attempt if that failed;
    else running if it has attempts; else pending. `n_tasks` is the number of tasks of the release.
    """

    def __init__(self, stored: DataFrame, roster: DataFrame, n_tasks: int, path: str):
        self.stored, self.roster, self.n_tasks = stored, roster, n_tasks
        self.spark, self.paths = stored.sparkSession, {"finished": f"{path}/finished", "seen": f"{path}/seen"}

    def finished(self, batch: DataFrame, number: int) -> None:
        update(finished_view(), batch, self.paths["finished"], number)

    def seen(self, batch: DataFrame, number: int) -> None:
        update(latest_view(), batch, self.paths["seen"], number)

    def _view(self, name: str, view: View, empty: str) -> DataFrame:
        n = batches_written(self.spark, self.paths[name])
        return read(self.spark, view, self.paths[name], n) if n else self.spark.createDataFrame([], empty)

    def read(self) -> DataFrame:
        done = self._view("finished", finished_view(), "model_id string, finished bigint")
        progress = done.select("model_id", (F.col("finished") >= self.n_tasks).alias("complete"))
        latest = self._view("seen", latest_view(), "model_id string, a struct<status: string>").select("model_id", "a.status")
        errors = latest.filter(F.col("status") != SUCCESS).select(
            "model_id", F.col("status").alias("state"), F.lit("latest attempt failed").alias("reason"))
        return model_state(progress, self.stored, self.roster, latest, errors)
