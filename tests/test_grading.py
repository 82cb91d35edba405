"""Grading vectors, verdict text, re-scoring, accuracy tables."""

import json

from pyspark.sql import functions as F

from evalspark.operators import grading, replies, scores
from evalspark.schemas import PASS_COLUMNS

TRUTH = {
    "t": ("Times New Roman", ["", None, "Times", "Söhne"], "mono", "black", "italic", "tight", "loose"),
    "n": ("Arial", None, "serif", "bold", "regular", "normal", "normal"),
    "x": ("Arial", ["???"], "serif", "bold", "regular", "normal", "normal"),
}
SCHEMA = "task_id string, canonical string, aliases array<string>, category string, weight string, modifier string, kerning string, line_height string"


def truth(spark):
    return spark.createDataFrame([(k, *v) for k, v in TRUTH.items()], SCHEMA)


def reply(task, **change):
    font, _, *closed = TRUTH[task]
    said = dict(zip(("font", "category", "weight", "modifier", "kerning", "line_height"), (font, *closed)))
    return json.dumps({**said, **change}, ensure_ascii=False)


CASES = [
    ("t", reply("t"), 6), ("t", reply("t", font="times-new ROMAN"), 6), ("t", reply("t", font="TIMES"), 6),
    ("t", reply("t", font="shne"), 6), ("t", reply("t", font="Söhne"), 6), ("t", reply("t", font="Sohne"), 5),
    ("t", reply("t", category=" Mono " + chr(0xA0)), 6), ("t", reply("t", weight="blac" + chr(0x212A)), 6),
    ("t", reply("t", weight="bold"), 5), ("n", reply("n"), 6), ("x", reply("x", font="!!!"), 5),
    ("t", None, 0), ("t", "junk", 0), ("t", reply("t", weight="heavy"), 0),
]


def test_grading_vectors(spark):
    said = spark.createDataFrame([(i, t, r) for i, (t, r, _) in enumerate(CASES)], "i int, task_id string, reply string")
    rows = {r.i: r for r in grading.grade(said, truth(spark)).collect()}
    assert {i: rows[i].n_pass for i in rows} == {i: c[2] for i, c in enumerate(CASES)}
    assert rows[8].score == 5 / 6.0 and not rows[8].exact and rows[0].exact
    assert not rows[10].font_pass


def test_lenient_keeps_the_good_fields(spark):
    said = spark.createDataFrame([("t", reply("t", weight="heavy")), ("n", reply("n")[:-1] + ', "x": 1}')], "task_id string, reply string")
    got = {r.task_id: r.n_pass for r in grading.grade(said, truth(spark), replies.LENIENT).collect()}
    assert got == {"t": 5, "n": 6}


def test_tasks_without_reply_grade_zero(spark):
    said = spark.createDataFrame([("t", reply("t")), ("t", reply("t", weight="bold"))], "task_id string, reply string")
    got = sorted((r.task_id, r.n_pass) for r in grading.grade_all(said, truth(spark)).collect())
    assert got == [("n", 0), ("t", 5), ("t", 6), ("x", 0)]


def test_grading_survives_partitioning_and_order(spark):
    rows = [(i, *CASES[i % len(CASES)][:2]) for i in range(200)]
    said = spark.createDataFrame(rows, "i int, task_id string, reply string")
    a = grading.grade(said, truth(spark)).orderBy("i").collect()
    b = grading.grade(said.repartition(7, "reply").orderBy(F.desc("i")), truth(spark).repartition(3)).orderBy("i").collect()
    assert a == b


def test_verdict(spark):
    said = spark.createDataFrame([("t", reply("t", weight="bold"))], "task_id string, reply string")
    text = grading.verdict_text(grading.grade(said, truth(spark))).collect()[0].verdict
    assert text == "[Verifier] Task: t - Score: 83.3%\n  Font: PASS | Cat: PASS | Weight: FAIL"


def test_rescore_lists_only_changed_rows(spark):
    good = [True] * 6
    rows = [("t", reply("t"), *good), ("n", reply("n", weight="thin"), *good), ("x", reply("x"), None, *good[1:])]
    saved = spark.createDataFrame(rows, "task_id string, reply string, " + ", ".join(f"stored_{p} boolean" for p in PASS_COLUMNS))
    assert sorted(r.task_id for r in grading.rescore_diff(saved, truth(spark)).collect()) == ["n", "x"]


def test_exact_differs_from_composite(spark):
    said = spark.createDataFrame([("m", "t", reply("t", weight="bold"))], "model_id string, task_id string, reply string")
    row = scores.accuracy(grading.grade(said, truth(spark)), ["model_id"]).collect()[0]
    assert row.exact == 0 and row.points == 5 and abs(row.composite - 5 / 6) < 1e-12


def test_shared_cohort_ignores_unselected_models(spark):
    finals = spark.createDataFrame(
        [("a", "1"), ("b", "1"), ("a", "2"), ("z", "2"), ("b", "3"), ("a", "3"), ("a", "3")], "model_id string, task_id string")
    roster = spark.createDataFrame([("a",), ("b",)], "model_id string")
    assert sorted(r.task_id for r in scores.shared_cohort(finals, roster).collect()) == ["1", "3"]
