"""Readers and writers over small file trees written here."""

import hashlib
import json

import pytest

from evalspark.operators import audits, grading, replies
from evalspark.sources import logs, packages, sinks

LABELS = {"font": "Arial", "category": "serif", "weight": "bold", "modifier": "italic", "kerning": "tight", "line_height": "loose"}
TOML = """version = "1.0"

[metadata]
name = "{name}"
author_name = "A \\"B\\" C"
difficulty = "low"
category = "perception"
tags = ["typography", "font-identification", "vlm"]

[agent]
timeout_sec = 75.5

[verifier]
timeout_sec = 20.0
"""
DESCRIPTOR = """version = "1.0"

[dataset]
name = "corpus"
version = "2.0.0"
description = "Six attributes: font, category."
license = "MIT"
task_dir = "tasks"

[metadata]
{grading}total_tasks = 2
primary_pangram = "The quick brown fox."
"""


@pytest.fixture()
def tree(tmp_path):
    tasks = tmp_path / "corpus" / "tasks"
    manifest = []
    for i, name in enumerate(("task-aa", "task-bb")):
        d = tasks / name
        for sub in ("environment", "solution", "tests"):
            (d / sub).mkdir(parents=True)
        (d / "task.toml").write_text(TOML.format(name=name))
        (d / "instruction.md").write_text("Say what you see.\n")
        (d / "environment" / "sample.png").write_bytes(bytes([i] * 100))
        (d / "solution" / "solve.sh").write_text(
            "#!/bin/bash\nif [ 1 ]; then\n  x=${y}\nfi\ncat << 'EOF' > out\n" + json.dumps(LABELS, indent=2) + "\nEOF\n")
        shared = {"aliases": ["A"], "category": "serif", "weight": "bold", "modifier": "italic", "kerning": "tight",
                  "lineHeight": "loose", "widthId": "wide", "widthPx": 640}
        (d / "tests" / "ground_truth.json").write_text(json.dumps({"taskId": f"t{i}", "harborTaskId": name, "canonical": "Arial", **shared}))
        manifest.append({"taskId": f"t{i}", "imageSha256": hashlib.sha256(bytes([i] * 100)).hexdigest(), "fontName": "Arial", **shared})
    manifest[1]["kerning"] = "normal"
    manifest.insert(0, {**manifest[0], "fontName": "Superseded"})
    (tmp_path / "manifest.json").write_text(json.dumps(manifest, indent=1))
    (tmp_path / "corpus" / "dataset.toml").write_text(DESCRIPTOR.format(grading='grading_version = "3"\n'))
    (tmp_path / "old.toml").write_text(DESCRIPTOR.format(grading=""))
    return tmp_path


def test_package_readers(spark, tree):
    root = str(tree / "corpus" / "tasks")
    rows = packages.read_tasks(spark, root).orderBy("directory").collect()
    assert [(r.directory, r.name, r.author_name, r.agent_timeout_sec, r.verifier_timeout_sec) for r in rows] == [
        (n, n, 'A "B" C', 75.5, 20.0) for n in ("task-aa", "task-bb")]
    assert rows[0].tags == ["typography", "font-identification", "vlm"] and rows[0].version == "1.0"
    expected = packages.read_expected(spark, root).orderBy("task").collect()
    assert [r.task for r in expected] == ["task-aa", "task-bb"]
    assert expected[0].asDict() == {"task": "task-aa", **LABELS}
    texts = packages.read_instructions(spark, root)
    row = audits.single_valued(texts, "text").collect()[0]
    assert row.single and row.n == 2


def test_truth_manifest_images(spark, tree):
    root = str(tree / "corpus" / "tasks")
    truth = packages.read_truth(spark, root)
    manifest = packages.read_manifest(spark, str(tree / "manifest.json"))
    assert sorted(r.directory for r in truth.collect()) == ["task-aa", "task-bb"]
    images = packages.read_images(spark, root).select("directory", "image_sha256")
    package = truth.join(images, "directory")
    fields = {"canonical": "font_name", "image_sha256": "image_sha256"}
    fields |= {f: f for f in ("aliases", "category", "weight", "modifier", "kerning", "line_height", "width", "width_px")}
    got = [tuple(r) for r in audits.field_mismatches(package, manifest, "task_id", fields, order="pos").collect()]
    assert got == [("t1", "kerning", "tight", "normal")]
    assert audits.key_diff(truth, manifest, "task_id").count() == 0


def test_descriptors(spark, tree):
    new = packages.read_descriptor(spark, str(tree / "corpus" / "dataset.toml"))
    row = new.collect()[0]
    assert (row.name, row.version, row.grading_version, row.total_tasks) == ("corpus", "2.0.0", "3", 2)
    assert packages.read_descriptor(spark, str(tree / "old.toml")).collect()[0].grading_version is None
    assert audits.declared_vs_actual(new, packages.read_tasks(spark, str(tree / "corpus" / "tasks"))).collect()[0].ok


def test_missing_package_files(spark, tree):
    (tree / "corpus" / "tasks" / "task-bb" / "solution" / "solve.sh").unlink()
    files = packages.read_files(spark, str(tree / "corpus" / "tasks"))
    expected = ["task.toml", "instruction.md", "solution/solve.sh", "tests/ground_truth.json"]
    assert [tuple(r) for r in audits.missing_files(files, "directory", expected).collect()] == [("task-bb", "solution/solve.sh")]


def test_replies_by_path_rank(spark, tmp_path):
    for root, task, data in (("first", "a", b"junk"), ("second", "a", json.dumps(LABELS).encode()), ("second", "b", json.dumps(LABELS).encode()),
                             ("first", "c", b"\xff\xfe{}"), ("first", "d", b"\xef\xbb\xbf" + json.dumps(LABELS).encode()), ("first", "e", b"")):
        (tmp_path / root / task).mkdir(parents=True)
        (tmp_path / root / task / "output.json").write_bytes(data)
    found = packages.read_replies(spark, [str(tmp_path / "first"), str(tmp_path / "second")])
    chosen = replies.first_existing(found, ["task_id"])
    status = replies.with_strict_reply(chosen).select("task_id", replies.reply_status(chosen["reply"], replies.F.col("answer")).alias("s"))
    assert {r.task_id: r.s for r in status.collect()} == {"a": "invalid", "b": "valid", "c": "invalid", "d": "invalid", "e": "invalid"}


def test_every_expected_label_scores_full_marks(spark, tree):
    root = str(tree / "corpus" / "tasks")
    labels = packages.read_expected(spark, root)
    said = labels.select(labels["task"].alias("harbor_task_id"), replies.F.to_json(replies.F.struct(*LABELS)).alias("reply"))
    truth = packages.read_truth(spark, root)
    said = said.join(truth.select("harbor_task_id", "task_id"), "harbor_task_id").select("task_id", "reply")
    assert [r.n_pass for r in grading.grade(said, truth).collect()] == [6, 6]


def test_catalog_and_releases(spark, tmp_path):
    (tmp_path / "models.json").write_text(json.dumps({"version": 1, "verified_at": "2026-09-01", "models": [
        {"id": "b", "provider": "google", "model": "b", "display_name": "B", "api_key_env": "K", "source_url": "https://x.io"},
        {"id": "a", "provider": "google", "model": "a", "display_name": "A", "api_key_env": "K", "source_url": "https://x.io"}]}, indent=2))
    rows = packages.read_catalog(spark, str(tmp_path / "models.json")).orderBy("pos").collect()
    assert [(r.pos, r.id, r.version) for r in rows] == [(0, "b", 1), (1, "a", 1)]
    registry = tmp_path / "releases"
    registry.mkdir()
    (registry / "1.0.0.json").write_text(json.dumps({"dataset_manifest": "d/r/manifest.json", "harbor_dataset": "d/p", "other": 1}, indent=1))
    (registry / "README.md").write_text("not a release")
    rows = packages.read_releases(spark, str(registry)).collect()
    assert [(r.file_name, r.dataset_manifest, r.harbor_dataset) for r in rows] == [("1.0.0.json", "d/r/manifest.json", "d/p")]


def write_log(root, run, name, rows, release="1.0.0"):
    d = root / release / run
    d.mkdir(parents=True, exist_ok=True)
    (d / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def attempt(i, model, task, status="success", reply="x"):
    return {"attempt_id": i, "model_id": model, "task_id": task, "ts": f"2024-01-01T00:00:{i:02}.000001Z", "status": status, "reply": reply,
            "input_tokens": 10, "output_tokens": 1}


def test_attempt_logs(spark, tmp_path):
    write_log(tmp_path, "run-a", "attempts.jsonl", [attempt(1, "m", "t"), attempt(2, "m", "u", "provider_error", None)])
    write_log(tmp_path, "run-b", "attempts-2.jsonl", [attempt(3, "m", "t")])
    (tmp_path / "1.0.0" / "run-a" / "run.json").write_text("{}")
    rows = logs.read_attempts(spark, str(tmp_path)).orderBy("attempt_id").collect()
    assert [(r.release, r.run_id, r.attempt_id, r.reply) for r in rows] == [
        ("1.0.0", "run-a", 1, "x"), ("1.0.0", "run-a", 2, None), ("1.0.0", "run-b", 3, "x")]
    assert rows[0].ts.microsecond == 1


def test_sinks_refuse_to_overwrite(spark, tmp_path):
    df = spark.createDataFrame([("1.0.0", "r", "t", n, n / 6.0) for n in range(7)], "release string, run_id string, task_id string, n int, score double")
    out = str(tmp_path / "rewards")
    sinks.write_rewards(df, out)
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_rewards(df, out)
    back = {r.reward for r in spark.read.parquet(out).collect()}
    assert back == {str(n / 6.0) for n in range(7)}
    assert (tmp_path / "rewards" / "release=1.0.0" / "run_id=r").is_dir()
    sinks.write_scorecards(df.select("task_id", "n"), str(tmp_path / "cards"))
    assert spark.read.json(str(tmp_path / "cards")).count() == 7
