"""A training-data pipeline: five stages, each a Spark job on all that the stage before it kept.

Every stage takes (spark, docs, sf_dir) and all but the last return the columns of `documents`. `run` writes
each stage to the shared folder and goes on from there, so lost executors cost one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm import decontaminate, minhash, pieces, substring, toxicity
from evalspark.llm.store import keyed, landed, row_id


def _without(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows, without their keys, whose `__key` is not among `keys`."""
    return rows.join(keys.select(row_id("__key").alias("__key")).distinct(), "__key", "left_anti").drop("__key")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit on all labels, keep what scores below the threshold."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model, score_col="__score")
    return scored.filter(F.col("__score") < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows the one of least id stays; rows that share an id, or have none, are rows each."""
    rows = keyed(docs, "doc_id", "text")
    return _without(rows, minhash.near_duplicates(rows, id_col="__key").filter(~F.col("kept")))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has too are cut out; every document stays, its
    n_chars that of the text it keeps (0 for a null text)."""
    cut = substring.cut_documents(docs)
    return cut.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item's question and answer go; others of the same id, or without one, stay."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = keyed(docs, "doc_id", "text")
    found = decontaminate.matches(rows, items, id_col="__key").filter("contaminated")
    return _without(rows, landed(found.select("__key"), "leaks"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of each text: doc_id, sample, ids, log_prob, log_inclusion."""
    return pieces.encode(docs, pieces.load())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: No stage but the last is a plain query; `tests/llm/test_pipeline.py` compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = landed(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
