"""Run-log operators against brute force."""

import hashlib
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from evalspark.operators import runs

SCHEMA = "run_id string, model_id string, task_id string, ts timestamp, attempt_id bigint, status string, reply string"


def log(spark, n=400, hot=0):
    rng = random.Random(3)
    t0 = datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        task = "t0" if i < hot else f"t{rng.randrange(12)}"
        status = "success" if rng.random() < 0.6 else "provider_error"
        rows.append(("r", f"m{rng.randrange(3)}", task, t0 + timedelta(hours=rng.randrange(40)), i, status, f"reply {i}" if i % 9 else None))
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_final_is_latest_success(spark):
    rows, df = log(spark, hot=200)
    want = {}
    for r in rows:
        if r[5] == "success":
            key = r[1:3]
            if key not in want or (r[3], r[4]) > (want[key][3], want[key][4]):
                want[key] = r
    got = {(r.model_id, r.task_id): (r.attempt_id, r.reply) for r in runs.final_responses(df).collect()}
    assert got == {k: (v[4], v[6]) for k, v in want.items()}


def roster(spark):
    return spark.createDataFrame([("m2", "p", 0), ("m0", "q", 1), ("m1", "p", 2)], "model_id string, provider string, pos int")


def test_pending_queue_and_coverage(spark):
    rows, df = log(spark, 40)
    finals = runs.final_responses(df, ("model_id", "task_id"))
    tasks = spark.createDataFrame([(f"t{i}",) for i in range(20)], "task_id string")
    done = {(r[1], r[2]) for r in rows if r[5] == "success"}
    models = ["m2", "m0", "m1"]
    want = {(m, f"t{i}") for m in models for i in range(20)} - done
    pending = runs.pending_work(tasks, finals, roster(spark))
    assert {(r.model_id, r.task_id) for r in pending.collect()} == want

    progress = runs.coverage(finals, tasks, roster(spark))
    cov = {r.model_id: (r.finished, r.missing, r.total, r.complete) for r in progress.collect()}
    finished = {m: sum(k[0] == m for k in done) for m in models}
    assert cov == {m: (finished[m], 20 - finished[m], 20, False) for m in models}

    order = sorted(want, key=lambda k: (finished[k[0]], models.index(k[0]), hashlib.sha256(k[1].encode()).hexdigest()))
    got = runs.queue(pending, roster(spark)).orderBy("queue_pos").collect()
    assert [(r.model_id, r.task_id) for r in got] == order
    assert [r.queue_pos for r in got] == list(range(1, len(order) + 1))
    provider = {"m2": "p", "m0": "q", "m1": "p"}
    ahead = {}
    for i, (m, _) in enumerate(order):
        ahead.setdefault(provider[m], i)
    assert {r.provider: r.ahead for r in runs.entries_ahead(pending, roster(spark)).collect()} == ahead


def test_nothing_pending_for_unselected_or_complete_models(spark):
    tasks = spark.createDataFrame([("a",), ("b",)], "task_id string")
    finals = spark.createDataFrame([("m", "a"), ("m", "b"), ("z", "a"), ("n", "gone")], "model_id string, task_id string")
    chosen = spark.createDataFrame([("m",), ("n",)], "model_id string")
    got = sorted((r.model_id, r.task_id) for r in runs.pending_work(tasks, finals, chosen).collect())
    assert got == [("n", "a"), ("n", "b")]
    cov = {r.model_id: (r.finished, r.complete) for r in runs.coverage(finals, tasks, chosen).collect()}
    assert cov == {"m": (2, True), "n": (0, False)}


def test_union_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, "x")], "i int, extra string")
    b = spark.createDataFrame([(2,)], "i int")
    assert sorted(tuple(r) for r in runs.union_runs([a, b]).collect()) == [(1, "x"), (2, None)]


def test_compatible_runs_never_multiply_rows(spark):
    attempts = spark.createDataFrame([("1", "f", 1), ("1", "g", 2)], "release string, fingerprint string, i int")
    releases = spark.createDataFrame([("1", "f"), ("1", "f")], "release string, fingerprint string")
    assert [r.i for r in runs.compatible_runs(attempts, releases).collect()] == [1]


def test_cost_needs_both_prices(spark):
    attempts = spark.createDataFrame([("a", 1000, 10), ("a", 500, 5), ("b", 1, 1)], "model_id string, input_tokens bigint, output_tokens bigint")
    prices = spark.createDataFrame([("a", "p", 2.0, 10.0), ("b", "p", None, 1.0)], "id string, provider string, input_per_m double, output_per_m double")
    got = {r.model_id: (r.input_tokens, r.output_tokens, r.cost) for r in runs.cost(attempts, prices).collect()}
    assert got == {"a": (1500, 15, 0.00315), "b": (1, 1, None)}


def test_model_states(spark):
    progress = spark.createDataFrame(
        [("idle", False), ("sent", False), ("done", True), ("err", False), ("doneerr", True), ("new", False)], "model_id string, complete boolean")
    stale = ("paused", "stopped before the end")
    stored = spark.createDataFrame(
        [(m, *stale) for m in ("idle", "sent", "done", "err", "out", "doneerr")], "model_id string, state string, reason string")
    chosen = spark.createDataFrame([(m,) for m in ("idle", "sent", "done", "err", "doneerr", "new")], "model_id string")
    sent = spark.createDataFrame([("sent",), ("err",), ("sent",)], "model_id string")
    errors = spark.createDataFrame([("err", "blocked", "quota"), ("doneerr", "blocked", "quota")], "model_id string, state string, reason string")
    got = {r.model_id: (r.state, r.reason) for r in runs.model_state(progress, stored, chosen, sent, errors).collect()}
    assert got == {
        "idle": ("pending", None), "sent": ("running", None), "done": ("completed", None), "err": ("blocked", "quota"),
        "out": stale, "doneerr": ("completed", None), "new": ("pending", None),
    }


def test_queue_is_stable_under_repartitioning(spark):
    _, df = log(spark, 60)
    tasks = spark.createDataFrame([(f"t{i}",) for i in range(30)], "task_id string")

    def positions(attempts, t):
        finals = runs.final_responses(attempts, ("model_id", "task_id"))
        out = runs.queue(runs.pending_work(t, finals, roster(spark)), roster(spark))
        return sorted(tuple(r) for r in out.collect())

    assert positions(df, tasks) == positions(df.repartition(9).orderBy(F.desc("attempt_id")), tasks.repartition(4))
