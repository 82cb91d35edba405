"""Task bitmaps and the queue index against the plain operators, over several versions, and what look-ups read."""

import random

import pytest
from pyspark.sql import functions as F

from evalspark.operators import queue_index, runs, scores, task_index

MODELS = [f"m{i}" for i in range(5)]


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def pairs(spark, rows):
    return spark.createDataFrame(rows, "model_id string, task_id string")


def named(spark, tasks):
    return spark.createDataFrame([(t,) for t in tasks], "task_id string")


def roster(spark, models):
    return spark.createDataFrame([(m, f"p{m[-1]}", i) for i, m in enumerate(models)], "model_id string, provider string, pos int")


def test_bitmaps_answer_as_the_log_does(spark, tmp_path):
    rng = random.Random(3)
    first = [f"t{i}" for i in range(90)] + ["t3", None]
    more = [f"u{i}" for i in range(40)]
    path = str(tmp_path / "index")
    log = []
    for version, known in enumerate((first, first + more, first + more)):
        # every version repeats some responses; "m9" is on no roster, "x" no task; the last version has nothing new
        new = [] if version == 2 else [(m, t) for m in MODELS + ["m9"] for t in known if t and rng.random() < (0.9 if m != "m4" else 0.2)]
        new += [("m0", "x"), ("m1", None), (None, "t1")] + log[:20] if version < 2 else []
        if version == 1:
            new += [("m2", t) for t in first + more if t]  # a model that is complete
        log += new
        task_index.write(named(spark, known), pairs(spark, new), path, version)
        tasks, finals = named(spark, [t for t in known if t]), pairs(spark, [r for r in log if r[1] in known and r[1]])
        for models in (["m0", "m2"], ["m0", "unseen"], []) if version else (MODELS,):
            chosen = roster(spark, models)
            assert rows_of(task_index.coverage(spark, path, version, chosen)) == rows_of(runs.coverage(finals, tasks, chosen))
            assert rows_of(task_index.pending(spark, path, version, chosen)) == rows_of(runs.pending_work(tasks, finals, chosen))
            assert rows_of(task_index.cohort(spark, path, version, chosen)) == rows_of(scores.shared_cohort(finals, chosen))


def test_bitmaps_over_many_rows_and_of_nothing(spark, tmp_path):
    path, n = str(tmp_path / "wide"), 3 * task_index.BITS_A_ROW + 17
    tasks = spark.range(n).select(F.format_string("t%07d", "id").alias("task_id")).coalesce(1)
    done = tasks.filter("task_id <> 't0032768' AND task_id <> 't0098320'").select(F.lit("m0").alias("model_id"), "task_id")
    task_index.write(tasks, done, path)
    chosen = roster(spark, ["m0"])
    assert rows_of(task_index.pending(spark, path, 0, chosen)) == [("t0032768", "m0"), ("t0098320", "m0")]
    assert rows_of(task_index.coverage(spark, path, 0, chosen)) == [("m0", n - 2, n, 2, False)]
    assert task_index.cohort(spark, path, 0, chosen).count() == n - 2
    empty = str(tmp_path / "empty")
    task_index.write(named(spark, []), pairs(spark, [("m0", "t")]), empty)
    assert rows_of(task_index.coverage(spark, empty, 0, chosen)) == [("m0", 0, 0, 0, True)]
    assert rows_of(task_index.pending(spark, empty, 0, chosen)) == rows_of(task_index.cohort(spark, empty, 0, chosen)) == []


def test_writing_a_version_again_changes_nothing(spark, tmp_path):
    path, chosen = str(tmp_path / "again"), roster(spark, ["m0", "m1"])
    task_index.write(named(spark, ["a", "b"]), pairs(spark, [("m0", "a")]), path)
    for _ in range(2):
        task_index.write(named(spark, ["b", "c"]), pairs(spark, [("m0", "a"), ("m1", "c")]), path, 1)
        assert rows_of(task_index.pending(spark, path, 1, chosen)) == [("a", "m1"), ("b", "m0"), ("b", "m1"), ("c", "m0")]


@pytest.fixture(scope="module")
def waiting():
    rng = random.Random(5)
    return [(m, f"task {i}") for m in MODELS for i in range(400) if rng.random() < 0.2 + int(m[1]) / 6]


def test_queue_index_equals_the_queue(spark, tmp_path, waiting):
    path, chosen = str(tmp_path / "queue"), roster(spark, MODELS[::-1])
    queue_index.build(pairs(spark, waiting + waiting[:9] + [("m0", None), (None, "task 1")]), path)
    rng, left = random.Random(7), list(waiting)
    answers = [rng.sample(left, 30) + [("m0", "no such task"), ("m9", "task 1")], [r for r in left if r[0] == "m4"]]
    for version in range(len(answers) + 1):
        queue = rows_of(runs.queue(pairs(spark, left), chosen))
        assert rows_of(queue_index.positions(spark, path, version, pairs(spark, waiting), chosen)) == queue
        places = spark.createDataFrame([(i,) for i in [0, -1, 10_000, *range(1, len(queue) + 5)]], "queue_pos bigint")
        assert rows_of(queue_index.at(spark, path, version, places, chosen)) == queue
        if version < len(answers):
            gone = answers[version] + answers[0][:5]  # the first ones are answered again and again
            assert queue_index.answer(spark, pairs(spark, gone), path, version) == version + 1
            left = [r for r in left if r not in set(gone)]


def test_one_answer_writes_one_path(spark, tmp_path, waiting):
    path = str(tmp_path / "path")
    queue_index.build(pairs(spark, waiting), path)
    queue_index.answer(spark, pairs(spark, waiting[10:11]), path, 0)
    written = rows_of(spark.read.parquet(f"{path}/counts/version=1").select("model_id", "level", "n"))
    assert written == [("m0", level, -1) for level in range(queue_index.LEAF + 1)]
    assert spark.read.parquet(f"{path}/entries/version=1").count() == 1


def test_an_empty_queue_has_no_places(spark, tmp_path):
    path, chosen = str(tmp_path / "none"), roster(spark, MODELS)
    queue_index.build(pairs(spark, []), path)
    assert queue_index.positions(spark, path, 0, pairs(spark, [("m0", "t")]), chosen).isEmpty()
    assert queue_index.at(spark, path, 0, spark.range(3).withColumnRenamed("id", "queue_pos"), chosen).isEmpty()
