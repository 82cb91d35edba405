"""Writers. By default they refuse to replace what is already there: measurements stay frozen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_FILE = 5_000_000


def land(df: DataFrame, path: str, partitions: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Columnar copy of parsed small files, in files of bounded size."""
    writer = df.write.mode(mode).option("maxRecordsPerFile", ROWS_PER_FILE)
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def write_rewards(grades: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Reward per graded task, partitioned by release and run where the grades carry them.

    ``reward`` is the score as the shortest text that reads back to the same double.
    """
    keys = [c for c in ("release", "run_id") if c in grades.columns]
    ids = [c for c in ("model_id", "task_id") if c in grades.columns]
    land(grades.select(*keys, *ids, "score", F.col("score").cast("string").alias("reward")), path, keys, mode)


def write_scorecards(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Summaries as JSON lines."""
    df.write.mode(mode).json(path)
