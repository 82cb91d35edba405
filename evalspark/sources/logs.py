"""Attempt logs of many run directories, as a table or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ATTEMPT_JSON

LOG_GLOB = "attempts*.jsonl"


def _placed(df: DataFrame) -> DataFrame:
    """Release and run id from ``<release>/<run-id>/<log file>``."""
    parts = F.split(F.col("_metadata.file_path"), "/")
    return df.withColumns({"release": F.try_element_at(parts, F.lit(-3)), "run_id": F.try_element_at(parts, F.lit(-2))})


def read_attempts(spark: SparkSession, runs_root: str, name: str = LOG_GLOB) -> DataFrame:
    """All attempts below ``<runs_root>/<release>/<run-id>/`` in files of the name (a glob); the schema is fixed, nothing
    is inferred."""
    return _placed(spark.read.schema(ATTEMPT_JSON).json(f"{runs_root.rstrip('/')}/*/*/{name}"))


def stream_attempts(spark: SparkSession, runs_root: str, max_files: int | None = None) -> DataFrame:
    """The same logs as they arrive, new files only."""
    reader = spark.readStream.schema(ATTEMPT_JSON)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _placed(reader.json(f"{runs_root.rstrip('/')}/*/*/{LOG_GLOB}"))
