"""Resumable run logs: final responses, pending work, queue, coverage, cost, model states.

A roster (the selected models) is bounded by the provider cap of the catalog, so it may travel as
an array; tasks and attempts are unbounded and never do.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import SUCCESS

QUEUE_BUCKET_DIGITS = 3


def roster_ids(roster: DataFrame) -> Column:
    """The selected model ids as one array (a scalar subquery)."""
    return roster.agg(F.array_sort(F.collect_set("model_id"))).scalar()


def of_roster(df: DataFrame, roster: DataFrame) -> DataFrame:
    """Rows of selected models. A filter: joining on the few model ids would shuffle on hot keys."""
    return df.filter(F.array_contains(roster_ids(roster), F.col("model_id")))


def final_responses(attempts: DataFrame, keys: Sequence[str] = ("run_id", "model_id", "task_id")) -> DataFrame:
    """The latest successful attempt per key, ties broken by attempt id.

    ``max_by`` combines map-side: a task retried very often never gathers in one place, as it would
    under a ranking window.
    """
    rest = [c for c in attempts.columns if c not in keys]
    latest = F.max_by(F.struct(*rest), F.struct("ts", "attempt_id"))
    done = attempts.filter(F.col("status") == SUCCESS)
    return done.groupBy(*keys).agg(latest.alias("a")).select(*keys, "a.*")


def union_runs(runs: Sequence[DataFrame]) -> DataFrame:
    """Logs of several runs as one table; columns a run lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), runs)


def compatible_runs(attempts: DataFrame, releases: DataFrame) -> DataFrame:
    """Only attempts recorded against a registered release with its very fingerprint.

    A semi join, so a release registered twice multiplies nothing. Read the registry from its table
    or files: Spark then knows how small it is and broadcasts it, and attempts stay where they are.
    """
    return attempts.join(releases, ["release", "fingerprint"], "left_semi")


def pending_work(tasks: DataFrame, finals: DataFrame, roster: DataFrame) -> DataFrame:
    """Selected models x tasks that have no final response.

    Instead of building the product and anti-joining it: finished models are collected per task (at
    most a roster's worth), joined once on the task, and the roster minus that set is exploded.
    """
    selected = roster_ids(roster)
    done = of_roster(finals, roster).groupBy("task_id").agg(F.collect_set("model_id").alias("done"))
    none = F.array().cast("array<string>")
    # Two steps: a scalar subquery may not sit inside a generator.
    left = tasks.select("task_id").distinct().join(done, "task_id", "left").withColumn(
        "todo", F.array_except(selected, F.coalesce("done", none))
    )
    return left.select("task_id", F.explode("todo").alias("model_id"))


def coverage(finals: DataFrame, tasks: DataFrame, roster: DataFrame) -> DataFrame:
    """Finished, missing and total tasks per roster model; a task listed twice is one task."""
    total = tasks.agg(F.count_distinct("task_id")).scalar()
    known = finals.join(tasks.select("task_id").distinct(), "task_id", "left_semi")
    finished = known.groupBy("model_id").agg(F.count_distinct("task_id").alias("f"))
    out = roster.select("model_id").distinct().join(finished, "model_id", "left").select(
        "model_id", F.coalesce("f", F.lit(0)).alias("finished"), total.alias("total")
    )
    missing = F.col("total") - F.col("finished")
    return out.withColumn("missing", missing).withColumn("complete", missing == 0)


def _model_order(counts: DataFrame, roster: DataFrame) -> DataFrame:
    """Number of queue entries ahead of each model's first, from (model_id, n_pending).

    Models with the fewest finished tasks go first, then in roster order. All models have the same tasks,
    so the fewest finished are the most pending. The window runs over one row per roster model.
    """
    models = roster.select("model_id", "provider", "pos").join(counts, "model_id")
    ahead = Window.orderBy(F.desc("n_pending"), "pos").rowsBetween(Window.unboundedPreceding, -1)
    return models.withColumn("ahead", F.coalesce(F.sum("n_pending").over(ahead), F.lit(0)))


def queue(pending: DataFrame, roster: DataFrame) -> DataFrame:
    """Every pending entry with its position in the deterministic queue, from 1.

    Within a model, tasks follow their SHA-256: a fixed order unrelated to the labels, whose leading
    digits cut each model into even buckets. Ranks are taken within buckets and shifted by the sizes
    of earlier buckets, so no task ever sorts a whole model, let alone the whole queue. The bucket
    table has at most roster x 16**digits rows.
    """
    entries = pending.select("model_id", "task_id", F.sha2("task_id", 256).alias("h")).withColumn(
        "bucket", F.substring("h", 1, QUEUE_BUCKET_DIGITS)
    )
    sizes = entries.groupBy("model_id", "bucket").agg(F.count("*").alias("n"))
    counts = sizes.groupBy("model_id").agg(F.sum("n").alias("n_pending"))
    earlier = Window.partitionBy("model_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(
        _model_order(counts, roster).select("model_id", "provider", "ahead"), "model_id"
    ).select("model_id", "bucket", "provider", (F.col("ahead") + F.col("before")).alias("offset"))
    within = Window.partitionBy("model_id", "bucket").orderBy("h", "task_id")
    ranked = entries.withColumn("rank", F.row_number().over(within))
    return ranked.join(offsets, ["model_id", "bucket"]).select(
        (F.col("offset") + F.col("rank")).alias("queue_pos"), "provider", "model_id", "task_id"
    )


def entries_ahead(pending: DataFrame, roster: DataFrame) -> DataFrame:
    """Queue entries before each provider's first one; needs only the per-model counts."""
    counts = pending.groupBy("model_id").agg(F.count("*").alias("n_pending"))
    return _model_order(counts, roster).groupBy("provider").agg(F.min("ahead").alias("ahead"))


def with_prices(attempts: DataFrame, catalog: DataFrame) -> DataFrame:
    """Attempts with the cost of each; a model without a price, or missing from the catalog, has none but
    keeps its tokens. The catalog's ids are unique and few; Spark broadcasts it below its threshold."""
    prices = catalog.select(F.col("id").alias("model_id"), "provider", "input_per_m", "output_per_m")
    return attempts.join(prices, "model_id", "left").withColumn("cost", _cost("input_tokens", "output_tokens"))


def _cost(tokens_in: str, tokens_out: str) -> Column:
    return (F.col(tokens_in) * F.col("input_per_m") + F.col(tokens_out) * F.col("output_per_m")) / 1e6


def cost(attempts: DataFrame, catalog: DataFrame) -> DataFrame:
    """Tokens and cost per model. Tokens are summed as integers before prices are joined."""
    tokens = attempts.groupBy("model_id").agg(
        F.count("*").alias("n_attempts"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
    )
    return with_prices(tokens, catalog).drop("input_per_m", "output_per_m")


def model_state(
    progress: DataFrame, stored: DataFrame, roster: DataFrame, dispatched: DataFrame, errors: DataFrame
) -> DataFrame:
    """Reported state and reason of every model with a stored state or on the roster.

    Unselected: as stored. Selected and complete: ``completed``. Selected with an error of this
    invocation: the state and reason of that error. Dispatched: ``running``. Otherwise ``pending``
    with any stale reason cleared. All inputs hold one row per model.
    """
    chosen = roster.select("model_id", F.lit(True).alias("selected"))
    sent = dispatched.select("model_id", F.lit(True).alias("dispatched")).distinct()
    failed = errors.select("model_id", F.col("state").alias("e_state"), F.col("reason").alias("e_reason"))
    df = (
        stored.select("model_id", F.col("state").alias("s_state"), F.col("reason").alias("s_reason"))
        .join(chosen, "model_id", "full_outer")
        .join(progress.select("model_id", "complete"), "model_id", "left")
        .join(sent, "model_id", "left")
        .join(failed, "model_id", "left")
    )
    outside = F.col("selected").isNull()
    complete = F.coalesce("complete", F.lit(False))
    state = (
        F.when(outside, F.col("s_state"))
        .when(complete, "completed")
        .when(F.col("e_state").isNotNull(), F.col("e_state"))
        .when(F.col("dispatched"), "running")
        .otherwise("pending")
    )
    reason = F.when(outside, F.col("s_reason")).when(~complete, F.col("e_reason"))
    return df.select("model_id", state.alias("state"), reason.alias("reason"))
