"""Streaming runs over the event log. Outputs and checkpoints go to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import PASS_COLUMNS, SUCCESS
from ..session import shared_dir
from ..streaming import grading as stream
from ..streaming import state, views
from .carriers import CARRIERS, carrier, project, table
from .oracle import SUMS, judged, sql


def attempts(spark: SparkSession, d: str) -> DataFrame:
    """The attempts carrier as a stream over the event files."""
    source, _ = CARRIERS["attempts"]
    schema = table(spark, d, source).schema
    # As a glob, the path may be one file or a folder of files.
    return project(spark.readStream.schema(schema).parquet(f"{d}/{source}.parque[t]"), "attempts")


def _finish(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def graded(spark, d):
    out = shared_dir(spark, "graded")
    said = attempts(spark, d).select("attempt_id", "task_id", "status", "reply")
    _finish(stream.append_files(
        stream.grade_stream(said, carrier(spark, d, "customer_truth")), f"{out}/data", f"{out}/checkpoint"))
    return spark.read.parquet(f"{out}/data").select("attempt_id", "task_id", *PASS_COLUMNS, "n_pass", "exact")


def _first(spark, d, out: str) -> None:
    said = attempts(spark, d).select("attempt_id", "ts", "run_id", "model_id", "task_id", "status", "reply")
    _finish(stream.keep_first_successes(said, f"{out}/first", f"{out}/first-checkpoint"))


def firsts(spark, d):
    out = shared_dir(spark, "first")
    _first(spark, d, out)
    return stream.read_batches(spark, f"{out}/first").select("run_id", "model_id", "task_id", "attempt_id")


def progress(spark, d):
    """Two chained streams: first successes land as files, a second query grades and counts them."""
    out = shared_dir(spark, "progress")
    _first(spark, d, out)
    schema = stream.read_batches(spark, f"{out}/first").schema
    landed = spark.readStream.schema(schema).parquet(f"{out}/first/batch=*")
    grades = stream.grade_stream(landed.withColumn("status", F.lit(SUCCESS)), carrier(spark, d, "customer_truth"))
    counts = stream.progress_stream(grades, ["run_id", "model_id"])
    _finish(stream.replace_table(counts, f"{out}/table", f"{out}/checkpoint"))
    return stream.read_latest(spark, f"{out}/table").withColumnRenamed("n", "finished")


def states(spark, d):
    """Live states over several micro-batches of one invocation, against what the whole log says."""
    out = shared_dir(spark, "states")
    log = carrier(spark, d, "attempts").select("attempt_id", "ts", "run_id", "model_id", "task_id", "status")
    log.repartitionByRange(4, "ts").write.parquet(f"{out}/log")

    def arriving():
        return spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/log")

    _finish(stream.keep_first_successes(arriving(), f"{out}/first", f"{out}/first-checkpoint"))
    models = carrier(spark, d, "run_catalog")
    stored = models.select("model_id", F.lit("paused").alias("state"), F.lit("stopped before the end").alias("reason"))
    attempted = log.select("task_id").distinct()
    _finish(stream.publish_states(
        arriving(), f"{out}/first", attempted, stored, models.filter("enabled AND pos <> 20"), f"{out}/states", f"{out}/checkpoint"))
    return stream.read_states(spark, f"{out}/states")


def _in_spans(spark, d, out: str, columns, run) -> None:
    """The log arrives in three spans of time; after each the query is started anew and takes what has come."""
    log = carrier(spark, d, "attempts").withColumn("ts", F.col("ts").cast("timestamp")).select(*columns)
    lo, hi = log.agg(F.min("ts"), F.max("ts")).first()
    cuts = [lo + (hi - lo) * k / 3 for k in range(3)]
    for start, end in zip(cuts, [*cuts[1:], None]):
        span = F.col("ts") >= F.lit(start)
        log.filter(span if end is None else span & (F.col("ts") < F.lit(end))).write.mode("append").parquet(f"{out}/log")
        _finish(run(spark.readStream.schema(log.schema).parquet(f"{out}/log")))


def firsts_on_state(spark, d):
    """First successes by the state store, with restarts in between."""
    out = shared_dir(spark, "state")
    kept = ["run_id", "model_id", "task_id", "attempt_id"]

    def run(said):
        rows = state.first_successes(said).select(*kept).writeStream.format("parquet").option("path", f"{out}/first")
        return state.start(rows, f"{out}/checkpoint")

    _in_spans(spark, d, out, ["attempt_id", "ts", "run_id", "model_id", "task_id", "status"], run)
    return spark.read.parquet(f"{out}/first")


def progress_by_deltas(spark, d):
    """First successes by state, graded as they come, added to a view batch by batch."""
    out = shared_dir(spark, "view")
    truth, view = carrier(spark, d, "customer_truth"), views.progress_view(["run_id", "model_id"])

    def add(batch: DataFrame, number: int) -> None:
        views.update(view, stream.grade_stream(batch, truth), f"{out}/view", number)

    def run(said):
        return state.start(state.first_successes(said).writeStream.foreachBatch(add), f"{out}/checkpoint")

    _in_spans(spark, d, out, ["attempt_id", "ts", "run_id", "model_id", "task_id", "status", "reply"], run)
    return views.read(spark, view, f"{out}/view", views.batches_written(spark, f"{out}/view")).withColumnRenamed("n", "finished")


def states_by_deltas(spark, d):
    """Live states from two small views, finished tasks and latest attempts per model."""
    out = shared_dir(spark, "live")
    models = carrier(spark, d, "run_catalog")
    stored = models.select("model_id", F.lit("paused").alias("state"), F.lit("stopped before the end").alias("reason"))
    attempted = carrier(spark, d, "attempts").agg(F.count_distinct("task_id")).first()[0]
    live = views.LiveStates(stored, models.filter("enabled AND pos <> 20"), attempted, out)

    def run(said):
        firsts = state.first_successes(said, ("model_id", "task_id")).writeStream.foreachBatch(live.finished)
        _finish(state.start(firsts, f"{out}/first-checkpoint"))
        seen = said.writeStream.option("checkpointLocation", f"{out}/seen-checkpoint").trigger(availableNow=True)
        return seen.foreachBatch(live.seen).start()

    _in_spans(spark, d, out, ["attempt_id", "ts", "run_id", "model_id", "task_id", "status"], run)
    return live.read()


_STATES = """
    , chosen AS (SELECT * FROM run_catalog WHERE enabled AND pos <> 20),
    done AS (SELECT model_id, count(DISTINCT task_id) = (SELECT count(DISTINCT task_id) FROM attempts) AS complete FROM finals GROUP BY model_id),
    l AS (SELECT model_id, arg_max(status, (ts, attempt_id)) AS status FROM attempts GROUP BY model_id)
    SELECT m.model_id,
      CASE WHEN c.model_id IS NULL THEN 'paused' WHEN coalesce(d.complete, false) THEN 'completed'
        WHEN l.status <> 'success' THEN l.status WHEN l.status IS NOT NULL THEN 'running' ELSE 'pending' END AS state,
      CASE WHEN c.model_id IS NULL THEN 'stopped before the end' WHEN coalesce(d.complete, false) THEN NULL
        WHEN l.status <> 'success' THEN 'latest attempt failed' END AS reason
    FROM run_catalog m LEFT JOIN chosen c USING (model_id) LEFT JOIN done d USING (model_id) LEFT JOIN l USING (model_id)"""


QUERIES = {
    "stream_grades": (
        graded,
        sql(f"SELECT attempt_id, task_id, {', '.join(PASS_COLUMNS)}, n_pass, exact FROM ("
            + judged("strict_successes", "customer_truth", "r.attempt_id") + ")", "strict_successes", "customer_truth")),
    "stream_first_success": (
        firsts, sql("SELECT run_id, model_id, task_id, attempt_id FROM firsts", "firsts")),
    "stream_progress": (
        progress,
        sql(f"SELECT run_id, model_id, count(*) AS finished, {SUMS} FROM ("
            + judged("strict_firsts", "customer_truth", "r.run_id, r.model_id") + ") GROUP BY ALL", "strict_firsts", "customer_truth")),
    "stream_states": (states, sql("", "attempts", "run_catalog", "finals").rstrip() + _STATES),
    "stream_first_success_state": (
        firsts_on_state, sql("SELECT run_id, model_id, task_id, attempt_id FROM firsts", "firsts")),
    "stream_progress_view": (
        progress_by_deltas,
        sql(f"SELECT run_id, model_id, count(*) AS finished, {SUMS} FROM ("
            + judged("strict_firsts", "customer_truth", "r.run_id, r.model_id") + ") GROUP BY ALL", "strict_firsts", "customer_truth")),
    "stream_states_view": (states_by_deltas, sql("", "attempts", "run_catalog", "finals").rstrip() + _STATES),
}
