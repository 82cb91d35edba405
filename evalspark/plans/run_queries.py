"""Catalog and run-log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog, grading, runs
from ..schemas import PROVIDERS
from .carriers import carrier, table
from .oracle import in_list, sql
from .score_queries import finals, roster


def run_finals(spark, d):
    return runs.final_responses(carrier(spark, d, "attempts"))


def merged_runs(spark, d):
    """Two runs read separately, one of them written before token counts were recorded."""
    log = carrier(spark, d, "attempts")
    first = log.filter("run_id = '2024-01-01-first'").drop("input_tokens")
    second = log.filter("run_id = '2024-01-16-second'")
    return runs.union_runs([first, second]).groupBy("run_id", "model_id").agg(
        F.count("*").alias("n"), F.count("input_tokens").alias("n_tokens"))


def compatible(spark, d):
    log = carrier(spark, d, "attempts")
    registered = table(spark, d, "region").filter("r_regionkey > 0").selectExpr(
        "'1.0.0' AS release", "'fp-' || CAST(r_regionkey AS STRING) AS fingerprint")
    return runs.compatible_runs(log, registered).groupBy("run_id", "fingerprint").agg(F.count("*").alias("n"))


def tasks(spark, d):
    return carrier(spark, d, "customer_truth")


def pending(spark, d):
    return runs.pending_work(tasks(spark, d), finals(spark, d), roster(spark, d))


def progress(spark, d):
    return runs.coverage(finals(spark, d), tasks(spark, d), roster(spark, d))


_PENDING = """
    SELECT m.model_id, t.task_id FROM roster m, customer_truth t
    WHERE (m.model_id, t.task_id) NOT IN (SELECT model_id, task_id FROM finals)"""
_COVERAGE = """
    SELECT m.model_id, count(f.task_id) AS finished, (SELECT count(*) FROM customer_truth) AS total,
      (SELECT count(*) FROM customer_truth) - count(f.task_id) AS missing,
      (SELECT count(*) FROM customer_truth) = count(f.task_id) AS complete
    FROM roster m LEFT JOIN (SELECT DISTINCT model_id, task_id FROM finals SEMI JOIN customer_truth USING (task_id)) f USING (model_id)
    GROUP BY m.model_id"""
_QUEUE = f"""
    SELECT row_number() OVER (ORDER BY c.finished, m.pos, sha256(p.task_id), p.task_id) AS queue_pos,
      m.provider, p.model_id, p.task_id
    FROM ({_PENDING}) p JOIN ({_COVERAGE}) c USING (model_id) JOIN roster m USING (model_id)"""


def _listed(spark, d):
    """A catalog that lacks one of the models that were run."""
    return carrier(spark, d, "run_catalog").filter("pos <> 22").drop("model_id")


def cost(spark, d):
    out = runs.cost(carrier(spark, d, "attempts"), _listed(spark, d))
    return out.withColumn("cost", F.round("cost", 6))


_COST = """
    SELECT a.model_id, c.provider, count(*) AS n_attempts, CAST(sum(a.input_tokens) AS BIGINT) AS input_tokens,
      CAST(sum(a.output_tokens) AS BIGINT) AS output_tokens,
      round((sum(a.input_tokens)::DOUBLE * any_value(c.input_per_m) + sum(a.output_tokens)::DOUBLE * any_value(c.output_per_m)) / 1e6, 6) AS cost
    FROM attempts a LEFT JOIN (SELECT * FROM run_catalog WHERE pos <> 22) c USING (model_id) GROUP BY a.model_id, c.provider"""


def attempt_costs(spark, d):
    out = runs.with_prices(carrier(spark, d, "attempts"), _listed(spark, d))
    return out.select("attempt_id", "model_id", "provider", F.round(F.col("cost") * 1e6, 3).alias("microcost"))


_ATTEMPT_COSTS = """
    SELECT attempt_id, model_id, provider,
      round((input_tokens * input_per_m + output_tokens * output_per_m) / 1e6 * 1e6, 3) AS microcost
    FROM attempts LEFT JOIN (SELECT * FROM run_catalog WHERE pos <> 22) USING (model_id)"""


def states(spark, d):
    """Progress is counted over the tasks attempted at all, so that some models are complete."""
    log = carrier(spark, d, "attempts")
    models = carrier(spark, d, "run_catalog")
    done = finals(spark, d)
    attempted = log.select("task_id").distinct()
    chosen = models.filter("enabled AND pos <> 20")
    stored = models.select(
        "model_id", F.when(F.col("pos") > 16, "paused").otherwise("completed").alias("state"),
        F.when(F.col("pos") > 16, "stopped before the end").alias("reason"))
    late = log.filter("ts >= TIMESTAMP_NTZ '2024-01-29 00:00:00'")
    dispatched = late.filter("model_id < 'model-05'").select("model_id").distinct()
    errors = late.filter("status = 'provider_error' AND model_id > 'model-08'").groupBy("model_id").agg(
        F.lit("blocked").alias("state"), F.concat(F.lit("errors: "), F.count("*").cast("string")).alias("reason"))
    return runs.model_state(runs.coverage(done, attempted, chosen), stored, chosen, dispatched, errors)


_STATES = """
    , chosen AS (SELECT * FROM run_catalog WHERE enabled AND pos <> 20),
    late AS (SELECT * FROM attempts WHERE ts >= TIMESTAMP '2024-01-29 00:00:00'),
    done AS (SELECT model_id, count(DISTINCT task_id) = (SELECT count(DISTINCT task_id) FROM attempts) AS complete FROM finals GROUP BY model_id),
    e AS (SELECT model_id, 'errors: ' || CAST(count(*) AS VARCHAR) AS reason FROM late WHERE status = 'provider_error' AND model_id > 'model-08' GROUP BY model_id),
    s AS (SELECT model_id, CASE WHEN pos > 16 THEN 'paused' ELSE 'completed' END AS state,
      CASE WHEN pos > 16 THEN 'stopped before the end' END AS reason FROM run_catalog)
    SELECT s.model_id,
      CASE WHEN c.model_id IS NULL THEN s.state WHEN coalesce(d.complete, false) THEN 'completed' WHEN e.model_id IS NOT NULL THEN 'blocked'
        WHEN s.model_id IN (SELECT model_id FROM late WHERE model_id < 'model-05') THEN 'running' ELSE 'pending' END AS state,
      CASE WHEN c.model_id IS NULL THEN s.reason WHEN coalesce(d.complete, false) THEN NULL ELSE e.reason END AS reason
    FROM s LEFT JOIN chosen c USING (model_id) LEFT JOIN done d USING (model_id) LEFT JOIN e USING (model_id)"""

# --- catalog --------------------------------------------------------------------------------

_RULES = {
    "version": "version = 1",
    "verified_at": "verified_at IS NOT NULL",
    "base_url": r"(base_url IS NULL OR regexp_full_match(base_url, '(?i:https?)://[^\s/?#]+(?:[/?#]\S*)?'))",
    "id": "regexp_full_match(id, '[a-z0-9][a-z0-9._-]*')",
    "provider": f"provider IN {in_list(PROVIDERS)}",
    "model": r"regexp_full_match(model, '\S+')",
    "display_name": "length(display_name) > 0",
    "api_key_env": "regexp_full_match(api_key_env, '[A-Z_][A-Z0-9_]*')",
    "source_url": r"regexp_full_match(source_url, '(?i:https?)://[^\s/?#]+(?:[/?#]\S*)?')",
    "pricing_source_url": r"(pricing_source_url IS NULL OR regexp_full_match(pricing_source_url, '(?i:https?)://[^\s/?#]+(?:[/?#]\S*)?'))",
    "input_per_m": "(input_per_m IS NULL OR (input_per_m >= 0 AND isfinite(input_per_m)))",
    "output_per_m": "(output_per_m IS NULL OR (output_per_m >= 0 AND isfinite(output_per_m)))",
    "max_output_tokens": "max_output_tokens > 0",
}
_VIOLATIONS = " UNION ALL ".join([
    *[f"SELECT pos, id, '{rule}' AS rule FROM catalog WHERE parsed AND NOT {ok}" for rule, ok in _RULES.items()],
    "SELECT pos, id, 'document' FROM catalog WHERE NOT parsed",
    "SELECT pos, id, 'unknown key: ' || unnest(unknown_keys) FROM catalog",
    "SELECT pos, id, 'type: ' || unnest(bad_types) FROM catalog",
])


QUERIES = {
    "attempt_log": (
        lambda s, d: carrier(s, d, "attempts").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")),
        sql("SELECT * REPLACE (strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts) FROM attempts", "attempts")),
    "final_responses": (
        lambda s, d: run_finals(s, d).select("run_id", "model_id", "task_id", "attempt_id", "reply"),
        sql("SELECT run_id, model_id, task_id, attempt_id, reply FROM run_finals", "run_finals")),
    "union_runs": (
        merged_runs,
        sql("SELECT run_id, model_id, count(*) AS n, count(CASE WHEN run_id = '2024-01-16-second' THEN input_tokens END) AS n_tokens"
            " FROM attempts GROUP BY run_id, model_id", "attempts")),
    "compatible_runs": (
        compatible,
        sql("SELECT run_id, fingerprint, count(*) AS n FROM attempts WHERE fingerprint IN"
            " (SELECT 'fp-' || CAST(r_regionkey AS VARCHAR) FROM region WHERE r_regionkey > 0) GROUP BY ALL", "attempts")),
    "orphan_replies": (
        lambda s, d: grading.orphan_replies(
            carrier(s, d, "attempts").filter("status = 'success'"), tasks(s, d).filter("task_no % 7 <> 0")),
        sql("SELECT model_id, count(*) AS n_replies, count(DISTINCT task_id) AS n_tasks FROM successes"
            " WHERE task_id NOT IN (SELECT task_id FROM customer_truth WHERE task_no % 7 <> 0) GROUP BY model_id",
            "successes", "customer_truth")),
    "pending_work": (pending, sql(_PENDING, "roster", "customer_truth", "finals")),
    "coverage": (progress, sql(_COVERAGE, "roster", "customer_truth", "finals")),
    "queue": (
        lambda s, d: runs.queue(pending(s, d), roster(s, d)),
        sql(_QUEUE, "roster", "customer_truth", "finals")),
    "entries_ahead": (
        lambda s, d: runs.entries_ahead(pending(s, d), roster(s, d)),
        sql(f"SELECT provider, min(queue_pos) - 1 AS ahead FROM ({_QUEUE}) GROUP BY provider", "roster", "customer_truth", "finals")),
    "attempt_costs": (attempt_costs, sql(_ATTEMPT_COSTS, "attempts", "run_catalog")),
    "cost_by_model": (cost, sql(_COST, "attempts", "run_catalog")),
    "model_states": (states, sql("", "attempts", "run_catalog", "finals").rstrip() + _STATES),
    "catalog_violations": (
        lambda s, d: catalog.catalog_violations(carrier(s, d, "catalog")), sql(_VIOLATIONS, "catalog")),
    "catalog_duplicate_ids": (
        lambda s, d: catalog.duplicate_ids(carrier(s, d, "catalog")),
        sql("SELECT id, count(*) AS n FROM catalog GROUP BY id HAVING count(*) > 1", "catalog")),
    "provider_cap": (
        lambda s, d: catalog.provider_cap(carrier(s, d, "catalog")),
        sql("SELECT provider, count(*) AS n, count(*) <= 5 AS ok FROM catalog WHERE enabled GROUP BY provider", "catalog")),
    "enabled_models": (
        lambda s, d: catalog.enabled_models(carrier(s, d, "catalog")).select("pos", "id", "provider"),
        sql("SELECT pos, id, provider FROM catalog WHERE enabled", "catalog")),
}
