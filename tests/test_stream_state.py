"""First successes on the state store, and views by deltas, against batch results."""

import shutil

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evalspark.operators import runs
from evalspark.streaming import state, views

SCHEMA = "attempt_id long, ts timestamp, run_id string, model_id string, task_id string, status string, reply string"


def attempts(spark, rows):
    text = F.col("t").cast("timestamp")
    df = spark.createDataFrame(rows, SCHEMA.replace("ts timestamp", "t string"))
    return df.withColumn("ts", text).select(*[c.split()[0] for c in SCHEMA.split(", ")])


def row(i, minute, task, status="success", model="m"):
    return i, f"2024-01-01 00:{minute:02}:00", "r", model, task, status, f"reply {i}"


BATCHES = [
    [row(1, 5, "a", "provider_error"), row(2, 6, "a"), row(3, 5, "b"), row(4, 5, "b"), row(5, 9, "c", "provider_error")],
    [row(6, 1, "a"), row(7, 20, "c"), row(8, 20, "c"), row(9, 7, "d", model="n")],
    [row(10, 2, "c"), row(11, 30, "b"), row(12, 31, "e", "provider_error")],
]
FIRST = {("m", "a"): 2, ("m", "b"): 3, ("m", "c"): 7, ("n", "d"): 9}


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).parquet(str(path))


def finish(query):
    query.awaitTermination()
    assert query.exception() is None


def test_each_key_succeeds_once_over_restarts(spark, tmp_path):
    seen = []

    def keep(batch, number):
        seen.append({(r.model_id, r.task_id): (r.attempt_id, r.reply) for r in batch.collect()})

    for rows in BATCHES:
        attempts(spark, rows).write.mode("append").parquet(str(tmp_path / "log"))
        finish(state.start(state.first_successes(stream(spark, tmp_path / "log")).writeStream.foreachBatch(keep), str(tmp_path / "checkpoint")))
    assert [set(s) for s in seen if s] == [{("m", "a"), ("m", "b")}, {("m", "c"), ("n", "d")}]
    assert {k: v for s in seen for k, v in s.items()} == {k: (i, f"reply {i}") for k, i in FIRST.items()}


def test_no_earlier_output_is_read(spark, tmp_path):
    """Earlier results may be gone: what is done is known from the state alone."""
    for k, rows in enumerate(BATCHES[:2]):
        attempts(spark, rows).write.mode("append").parquet(str(tmp_path / "log"))
        out = str(tmp_path / f"out{k}")
        firsts = state.first_successes(stream(spark, tmp_path / "log")).writeStream.foreachBatch(lambda b, n, out=out: b.write.parquet(out))
        finish(state.start(firsts, str(tmp_path / "checkpoint")))
        if k == 0:
            shutil.rmtree(tmp_path / "out0")
    assert {r.attempt_id for r in spark.read.parquet(str(tmp_path / "out1")).collect()} == {7, 9}


def test_a_key_that_is_tried_very_often(spark, tmp_path):
    rows = [row(i, i % 60, "hot") for i in range(5000)] + [row(i, i % 60, f"t{i}", model="n") for i in range(5000, 5020)]
    attempts(spark, rows).repartition(6).write.parquet(str(tmp_path / "log"))
    got = []
    finish(state.start(state.first_successes(stream(spark, tmp_path / "log")).writeStream.foreachBatch(lambda b, n: got.extend(b.collect())), str(tmp_path / "c")))
    assert len(got) == 21 and [r.attempt_id for r in got if r.task_id == "hot"] == [0]


def test_the_session_keeps_its_own_state_store(spark, tmp_path):
    before = spark.conf.get(state.PROVIDER)
    attempts(spark, BATCHES[0]).write.parquet(str(tmp_path / "log"))
    finish(state.start(state.first_successes(stream(spark, tmp_path / "log")).writeStream.foreachBatch(lambda b, n: b.count()), str(tmp_path / "c")))
    assert spark.conf.get(state.PROVIDER) == before
    assert list((tmp_path / "c" / "state").rglob("*.zip"))  # snapshots of the state store, in the checkpoint


@pytest.mark.parametrize("fan", [2, 3, 8])
def test_versions_are_covered_by_few_folders(monkeypatch, fan):
    monkeypatch.setattr(views, "FAN", fan)
    for n in range(1, 300):
        at, levels = 0, []
        for level, number in views._cover(n):
            assert number * fan**level == at
            at += fan**level
            levels.append(level)
        assert at == n and levels == sorted(levels, reverse=True)
        assert all(levels.count(x) <= fan - 1 for x in set(levels))


def test_views_equal_the_batch_result_at_every_version(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(views, "FAN", 2)
    rows = [row(i, (i * 7) % 60, f"t{i}", "success" if i % 3 else "provider_error", model="abc"[i % 3 if i < 40 else 0]) for i in range(70)]
    all_rows = attempts(spark, rows)
    view, path = views.latest_view(), str(tmp_path / "view")

    def span(lo, hi):
        return all_rows.filter((F.col("attempt_id") >= lo) & (F.col("attempt_id") < hi))

    versions = {}
    for n in range(7):
        views.update(view, span(10 * n, 10 * n + 10), path, n)
        if n in (2, 3):  # a batch that is run again after a crash
            views.update(view, span(10 * n, 10 * n + 10), path, n)
        versions[n + 1] = span(0, 10 * n + 10)
        assert views.batches_written(spark, path) == n + 1
    for n, part in versions.items():
        want = {r.model_id: (r.ts, r.attempt_id, r.status) for r in view.partial(part).select("model_id", "a.*").collect()}
        got = {r.model_id: tuple(r.a) for r in views.read(spark, view, path, n).collect()}
        assert got == want
    # a batch writes its own partials, and merges only where a level is full
    folders = sorted(str(p.relative_to(tmp_path / "view")) for p in (tmp_path / "view").glob("*/*"))
    assert folders == [f"level=0/part={n}" for n in range(7)] + [f"level=1/part={n}" for n in range(3)] + ["level=2/part=0"]
    with pytest.raises(ValueError, match="no version"):
        views.read(spark, view, path, 0)


def test_live_states_after_every_batch(spark, tmp_path):
    tasks = spark.createDataFrame([("a",), ("b",), ("c",)], "task_id string")
    roster = spark.createDataFrame([("m",), ("n",), ("idle",)], "model_id string")
    stored = spark.createDataFrame([("m", "pending", None), ("old", "paused", "by hand")], "model_id string, state string, reason string")
    live = views.LiveStates(stored, roster, 3, str(tmp_path / "live"))
    log = None
    assert {r.model_id: r.state for r in live.read().collect()} == {"m": "pending", "n": "pending", "idle": "pending", "old": "paused"}
    for k, rows in enumerate(BATCHES):
        batch = attempts(spark, rows)
        log = batch if log is None else log.union(batch)
        firsts = {key for b in BATCHES[:k] for key in [(r[3], r[4]) for r in b if r[5] == "success"]}
        new = [(r[3], r[4]) for r in rows if r[5] == "success" and (r[3], r[4]) not in firsts]
        live.finished(spark.createDataFrame(sorted(set(new)), "model_id string, task_id string"), k)
        live.seen(batch, k)
        latest = views.latest_view().partial(log).select("model_id", "a.*")
        errors = latest.filter("status <> 'success'").select("model_id", F.col("status").alias("state"), F.lit("latest attempt failed").alias("reason"))
        finals = runs.final_responses(log).filter("task_id <> 'd'")
        want = runs.model_state(runs.coverage(finals, tasks, roster), stored, roster, latest, errors)
        assert sorted(map(tuple, live.read().collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_least_rows_of_keys():
    """Null keys are keys, null times and ids count as least, and rows may come in any order and batches."""
    rows = [(None, 5, 1), ("a", 4, 9), ("a", 4, 3), (None, None, 7), ("b", None, 2), ("b", 1, None), ("a", 6, 1), ("", 2, 2)] * 3
    batches = [pa.RecordBatch.from_pylist([dict(zip(("k", "ts", "attempt_id"), r)) for r in rows[i : i + 5]],
               pa.schema([("k", pa.string()), ("ts", pa.int64()), ("attempt_id", pa.int64())])) for i in range(0, len(rows), 5)]
    got = [tuple(r.values()) for b in state._firsts(("k",))(iter(batches)) for r in b.to_pylist()]
    assert sorted(got, key=str) == sorted([(None, None, 7), ("a", 4, 3), ("b", None, 2), ("", 2, 2)], key=str)
    assert list(state._firsts(("k",))(iter([]))) == []
