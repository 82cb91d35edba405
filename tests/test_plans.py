"""Shape of the physical plans, and results under a hot key with joins forced to shuffle."""

import json

import pytest
from pyspark.sql import functions as F

from evalspark.operators import grading, release, runs, scores
from evalspark.plans.registry import QUERIES

from .test_grading import reply, truth

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroups")
WRITING = ("reward_files", "scorecard_files", "stream_grades", "stream_first_success", "stream_progress")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(WRITING)))
def test_no_cross_join_and_no_python(spark, sf_dir, name):
    text = plan(QUERIES[name][0](spark, sf_dir))
    assert [f for f in FORBIDDEN if f in text] == []


def test_scans_read_only_what_they_need(spark, sf_dir):
    text = plan(QUERIES["accuracy_by_model_lines"][0](spark, sf_dir))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint,l_linenumber:int>" in text
    assert "ReadSchema: struct<o_orderkey:bigint>" in text
    text = plan(runs.final_responses(spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "event_type AS status", "user_id AS task_id", "event_id AS attempt_id", "ts"), ["task_id"]).filter("task_id = 3"))
    assert "EqualTo(user_id,3)" in text and "props" not in text


@pytest.fixture()
def shuffled_joins(spark):
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB",
    }
    for key, value in conf.items():
        spark.conf.set(key, value)
    yield
    for key in conf:
        spark.conf.unset(key)


def hot_replies(spark, n=60_000):
    """A third of all replies belong to task ``t``; the others to 2,000 tasks without truth or to ``n``."""
    good, bad = reply("t"), reply("n", weight="thin")
    task = F.when(F.col("id") % 3 == 0, "t").when(F.col("id") % 3 == 1, "n").otherwise(F.concat(F.lit("z"), F.col("id") % 2000))
    said = F.when(F.col("id") % 3 == 0, good).otherwise(bad)
    return spark.range(0, n, 1, 12).select(
        F.concat(F.lit("m"), F.col("id") % 5).alias("model_id"), task.alias("task_id"), said.alias("reply"), F.col("id").alias("attempt_id"),
        F.timestamp_micros(F.col("id") % 977).alias("ts"), F.lit("success").alias("status"))


def test_hot_task_is_graded_whole_and_split(spark, shuffled_joins, tmp_path):
    hot_replies(spark).write.parquet(str(tmp_path / "r"))
    said = spark.read.parquet(str(tmp_path / "r")).select("model_id", "task_id", "reply")
    extra = spark.range(3000).select(F.concat(F.lit("q"), "id").alias("task_id"), *[
        F.lit(v).alias(c) for c, v in (("canonical", "Arial"), ("category", "serif"), ("weight", "bold"), ("modifier", "regular"),
                                       ("kerning", "normal"), ("line_height", "normal"))], F.array().cast("array<string>").alias("aliases"))
    known = truth(spark).unionByName(extra.select(*truth(spark).columns))
    graded = scores.accuracy(grading.grade(said, known), ["task_id"])
    assert {r.task_id: (r.n, r.exact, r.points) for r in graded.collect()} == {"t": (20_000, 20_000, 120_000), "n": (20_000, 0, 100_000)}
    by_model = scores.accuracy(grading.grade(said, known), ["model_id"])
    assert sum(r.points for r in by_model.collect()) == 220_000
    assert "skew=true" in plan(by_model)
    everything = grading.grade_all(said, known).groupBy("n_pass").count()
    assert {r.n_pass: r["count"] for r in everything.collect()} == {6: 20_000, 5: 20_000, 0: 3_001}


def test_hot_key_in_aggregates(spark, shuffled_joins):
    df = hot_replies(spark)
    finals = runs.final_responses(df, ["model_id", "task_id"])
    last = {r.model_id: (r.attempt_id, r.ts.microsecond) for r in finals.filter("task_id = 't'").collect()}
    want = {}
    for i in range(0, 60_000, 3):
        m = f"m{i % 5}"
        want[m] = max(want.get(m, (-1, -1)), (i % 977, i))
    assert last == {m: (i, ts) for m, (ts, i) in want.items()}
    roster = spark.createDataFrame([(f"m{i}",) for i in range(5)], "model_id string")
    shared = scores.shared_accuracy(grading.grade(df.select("model_id", "task_id", "reply"), truth(spark)), roster)
    assert sum(r.n for r in shared.collect()) == 40_000


def test_hot_directory(spark, shuffled_joins):
    proposed = spark.range(30_000).select(
        F.concat(F.when(F.col("id") % 3 == 0, "hot/").otherwise(F.concat(F.col("id").cast("string"), F.lit("/"))), F.col("id")).alias("path"))
    registry = spark.range(500).select(
        F.concat("id", F.lit(".json")).alias("file_name"), F.lit("hot/manifest.json").alias("dataset_manifest"),
        F.concat(F.lit("hot/"), F.col("id") * 3).alias("harbor_dataset"))
    out = release.frozen_overlaps(proposed, release.protected_dirs(registry))
    got = {r.n_protected: r["count"] for r in out.groupBy("n_protected").count().collect()}
    assert got == {1: 9_500, 2: 500}


def test_results_serialize(spark):
    """Scorecards of a small run survive JSON, whatever the types."""
    card = scores.accuracy(grading.grade(hot_replies(spark, 30).select("model_id", "task_id", "reply"), truth(spark)), ["model_id"])
    rows = [json.loads(r) for r in card.toJSON().collect()]
    assert all(set(r) == set(card.columns) for r in rows)
