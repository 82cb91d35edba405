"""Nothing is dropped or passed in silence: spellings of paths, broken catalogs, unknown models and tasks."""

import os
import shutil
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from evalspark.functions.paths import normalize_path
from evalspark.operators import audits, catalog, design, grading, release, runs
from evalspark.plans.registry import QUERIES
from evalspark.session import shared_dir

from .test_grading import truth


def test_normalize_path(spark):
    cases = {
        "a/b": "a/b", "./a/b": "a/b", "x/../a/b": "a/b", "a//b": "a/b", "a/b/": "a/b", ".": "", "": "", "a/..": "",
        "a/b/../../c": "c", "/a": None, "../a": None, "a/../../b": None, "..a/b": "..a/b", None: None,
    }
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    assert {r.p: r.n for r in df.select("p", normalize_path(F.col("p")).alias("n")).collect()} == cases


def test_overlap_report(spark):
    registry = spark.createDataFrame(
        [("1.json", "d/m.json", "d/pkg"), ("2.json", "/bad", "ok")], "file_name string, dataset_manifest string, harbor_dataset string")
    spelled = ["./d/pkg", "x/../d/pkg", "d//pkg", "d/pkg/", "d/pkg/a", "/d/pkg", "../d", "e"]
    rows = release.overlap_report(spark.createDataFrame([(p,) for p in spelled], "path string"), registry).collect()
    got = {(r.path, r.status) for r in rows}
    assert got == {(p, "overlap") for p in spelled[:5]} | {("/d/pkg", "outside"), ("../d", "outside"), ("/bad", "invalid registry")}


def test_catalog_gate(spark):
    model = '{"id":"a","provider":"openai","model":"m","display_name":"M","api_key_env":"KEY","source_url":"https://x.example.com"}'
    whole = '{"version":1,"verified_at":"2026-09-01","models":[%s]}'
    docs = [(1, whole % model, 7), (2, "not json", 7), (3, '{"version":1,"verified_at":"2026-09-01"}', 7), (4, whole % model + " junk", 7),
            (5, (whole % "").replace('"version":1', '"version":2'), 7), (6, None, 7), (7, whole % f"{model},{model}", 7)]
    rows = catalog.parse_catalog(spark.createDataFrame(docs, "doc int, value string, pos0 int").withColumnRenamed("doc", "part"))
    gate = {r.part: (r.n_models, r.ok) for r in catalog.catalog_gate(rows, "part").collect()}
    assert gate == {1: (1, True), 2: (0, False), 3: (0, False), 4: (0, False), 5: (0, False), 6: (0, False), 7: (2, False)}
    rules = {(r.part, r.rule) for r in catalog.catalog_violations(rows, keep=["part"]).collect()}
    assert rules == {(2, "document"), (3, "document"), (4, "document"), (5, "version"), (6, "document")}
    named = catalog.parse_catalog(spark.createDataFrame([("x", whole % model)], "doc string, value string"))
    assert [r.doc for r in named.collect()] == ["x"]


def test_unknown_models_tasks_and_labels_stay_in_sight(spark):
    log = spark.createDataFrame([("m", "t", 10, 20), ("unlisted", "gone", 1, 2)], "model_id string, task_id string, input_tokens long, output_tokens long")
    prices = spark.createDataFrame([("m", "p", 1.0, 2.0)], "id string, provider string, input_per_m double, output_per_m double")
    assert {r.model_id: (r.input_tokens, r.cost is None) for r in runs.cost(log, prices).collect()} == {"m": (10, False), "unlisted": (1, True)}
    lost = grading.orphan_replies(log, truth(spark)).collect()
    assert [(r.model_id, r.n_replies, r.n_tasks) for r in lost] == [("unlisted", 1, 1)]
    tasks = spark.createDataFrame([("regular", "regular", "tight"), ("odd", "regular", "tight")], "weight string, modifier string, kerning string")
    assert {r.weight: r.variant_index is None for r in design.with_recipe(tasks).collect()} == {"regular": False, "odd": True}
    twice = spark.createDataFrame([("t",), ("t",), ("u",)], "task_id string")
    roster = spark.createDataFrame([("m", "p", 1)], "model_id string, provider string, pos int")
    done = spark.createDataFrame([("m", "t"), ("m", "u")], "model_id string, task_id string")
    row = runs.coverage(done, twice, roster).first()
    assert (row.finished, row.total, row.complete) == (2, 2, True)
    assert runs.pending_work(twice, done.limit(0), roster).count() == 2


def test_null_is_not_empty_and_nothing_is_not_one_value(spark):
    df = spark.createDataFrame([(None,), ("",)], "t string")
    assert not audits.single_valued(df, "t").first().single
    assert not audits.single_valued(df.limit(0), "t").first().single
    assert audits.single_valued(df.filter("t IS NULL"), "t").first().single
    same = spark.createDataFrame([(1, None), (2, None), (3, "h"), (4, "h")], "k int, h string")
    assert [(r.h, r.n) for r in audits.duplicate_groups(same, "h", "k").collect()] == [("h", 2)]
    prompts = spark.createDataFrame([("a",), ("b",)], "prompt string")
    texts = spark.createDataFrame([(1, "a b")], "k int, text string")
    with pytest.raises(Exception, match="more than one prompt"):
        audits.prompt_containment(texts, prompts, "k").collect()


def test_shared_folder_is_required_on_a_cluster():
    def session(master, folder=None):
        conf = SimpleNamespace(get=lambda key: folder)
        return SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: conf, getCheckpointDir=lambda: None))

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_dir(session(master), "x")
        assert shared_dir(session(master, "hdfs:///shared/"), "x").startswith("hdfs:///shared/evalspark/x-")
    assert shared_dir(session("local[4]"), "x")


@pytest.mark.parametrize("gone", [("evalspark/llm", "tests/llm"), ("evalspark/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_without_the_training_data_folders(tmp_path, gone):
    root = Path(__file__).resolve().parent.parent
    copy = tmp_path / "copy"
    skip = {str(root / g) for g in gone}
    shutil.copytree(root, copy, ignore=lambda d, names: [n for n in names if f"{d}/{n}" in skip or n.startswith((".git", "__pycache__"))])
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') or n == 'pipeline' for n in e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert done.returncode == 0, done.stderr
    count, some = done.stdout.split()
    assert int(count) == len(QUERIES) and some == "False"
