"""Streams over files: equal to batch, and resumable."""

import json

from evalspark.operators import grading
from evalspark.sources import logs
from evalspark.streaming import grading as stream

from .test_grading import reply, truth
from .test_sources import attempt, write_log


def finish(query):
    query.awaitTermination()
    assert query.exception() is None


def test_stream_equals_batch_across_a_restart(spark, tmp_path):
    runs, out, ck = tmp_path / "runs", str(tmp_path / "out"), str(tmp_path / "ck")
    write_log(runs, "r1", "attempts-1.jsonl", [attempt(1, "m", "t", reply=reply("t")), attempt(2, "m", "n", "provider_error", None)])

    def step():
        arriving = logs.stream_attempts(spark, str(runs), max_files=1)
        finish(stream.append_files(stream.grade_stream(arriving, truth(spark)), out, ck))
        return spark.read.parquet(out)

    assert step().count() == 1
    assert step().count() == 1
    write_log(runs, "r2", "attempts-1.jsonl", [attempt(3, "m", "n", reply=reply("n", weight="thin"))])
    write_log(runs, "r2", "attempts-2.jsonl", [attempt(4, "k", "t", reply="junk")])
    got = step().select("run_id", "attempt_id", "task_id", "n_pass")
    batch = logs.read_attempts(spark, str(runs)).filter("status = 'success'")
    want = grading.grade(batch, truth(spark)).select("run_id", "attempt_id", "task_id", "n_pass")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 3


def test_first_success_once_across_restarts(spark, tmp_path):
    runs, out, ck = tmp_path / "runs", str(tmp_path / "out"), str(tmp_path / "ck")

    def step():
        finish(stream.keep_first_successes(logs.stream_attempts(spark, str(runs)), out, ck))
        return sorted((r.run_id, r.model_id, r.task_id, r.attempt_id) for r in stream.read_batches(spark, out).collect())

    write_log(runs, "r", "attempts-1.jsonl", [attempt(1, "m", "t", "provider_error", None), attempt(2, "m", "t")])
    assert step() == [("r", "m", "t", 2)]
    write_log(runs, "r", "attempts-2.jsonl", [attempt(i, "m", "t") for i in range(3, 40)] + [attempt(i, "m", "u") for i in range(59, 49, -1)])
    assert step() == [("r", "m", "t", 2), ("r", "m", "u", 50)]


def test_progress(spark, tmp_path):
    runs, out, ck = tmp_path / "runs", str(tmp_path / "out"), str(tmp_path / "ck")

    def step():
        grades = stream.grade_stream(logs.stream_attempts(spark, str(runs)), truth(spark))
        finish(stream.replace_table(stream.progress_stream(grades), out, ck))
        return {r.model_id: (r.n, r.exact, r.weight) for r in stream.read_latest(spark, out).collect()}

    write_log(runs, "r", "attempts-1.jsonl", [attempt(1, "m", "t", reply=reply("t"))])
    assert step() == {"m": (1, 1, 1)}
    write_log(runs, "r", "attempts-2.jsonl", [attempt(2, "m", "n", reply=reply("n", weight="thin")), attempt(3, "k", "t", reply=json.dumps({}))])
    assert step() == {"m": (2, 1, 1), "k": (1, 0, 0)}


def test_live_states(spark, tmp_path):
    runs, base = tmp_path / "runs", str(tmp_path)
    tasks = spark.createDataFrame([("t",), ("n",)], "task_id string")
    roster = spark.createDataFrame([("done",), ("going",), ("broken",), ("idle",)], "model_id string")
    stored = spark.createDataFrame([(m, "paused", "old") for m in ("done", "going", "broken", "idle", "out")], "model_id string, state string, reason string")

    def step():
        arriving = lambda: logs.stream_attempts(spark, str(runs), max_files=1)
        finish(stream.keep_first_successes(arriving(), f"{base}/first", f"{base}/first-ck"))
        finish(stream.publish_states(arriving(), f"{base}/first", tasks, stored, roster, f"{base}/states", f"{base}/states-ck"))
        return {r.model_id: (r.state, r.reason) for r in stream.read_states(spark, f"{base}/states").collect()}

    write_log(runs, "r", "attempts-1.jsonl", [
        attempt(1, "done", "t"), attempt(2, "going", "t"), attempt(3, "broken", "t"), attempt(4, "broken", "n", "provider_error", None)])
    assert step() == {
        "done": ("running", None), "going": ("running", None), "broken": ("provider_error", "latest attempt failed"),
        "idle": ("pending", None), "out": ("paused", "old")}
    write_log(runs, "r", "attempts-2.jsonl", [attempt(5, "done", "n")])
    assert step() == {
        "done": ("completed", None), "going": ("pending", None), "broken": ("pending", None), "idle": ("pending", None), "out": ("paused", "old")}


def test_states_of_one_invocation_over_several_batches(spark, tmp_path):
    """What an early micro-batch reported is still there after a later one without that model."""
    runs, base = tmp_path / "runs", str(tmp_path)
    tasks = spark.createDataFrame([("t",), ("n",)], "task_id string")
    roster = spark.createDataFrame([("failed",), ("sent",), ("late",)], "model_id string")
    stored = spark.createDataFrame([], "model_id string, state string, reason string")
    write_log(runs, "r", "attempts-1.jsonl", [attempt(1, "failed", "t", "provider_error", None), attempt(2, "sent", "t")])
    write_log(runs, "r", "attempts-2.jsonl", [attempt(3, "late", "t")])
    arriving = logs.stream_attempts(spark, str(runs), max_files=1)
    finish(stream.publish_states(arriving, f"{base}/none", tasks, stored, roster, f"{base}/states", f"{base}/ck"))
    got = {r.model_id: r.state for r in stream.read_states(spark, f"{base}/states").collect()}
    assert got == {"failed": "provider_error", "sent": "running", "late": "running"}
