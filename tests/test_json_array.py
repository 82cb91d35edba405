"""Arrays read by byte ranges against Python's parser and against the one-task reader."""

import json
import random

import pytest

from evalspark.schemas import MANIFEST_JSON
from evalspark.sources import json_array, packages


@pytest.fixture()
def blocks(spark):
    """Sets the size of blocks, and puts the settings back."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(n) for n in names]

    def size(n):
        spark.conf.set(names[0], str(n))
        spark.conf.set(names[1], "1")

    spark.conf.set(names[2], "false")
    yield size
    for name, value in zip(names, before):
        spark.conf.set(name, value)


def value(rng, depth=0):
    kind = rng.randrange(7)
    if kind == 0 and depth < 4:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    if kind == 1 and depth < 4:
        return {rng.choice(["a", "}", '"', "\\", "é,"]): value(rng, depth + 1) for _ in range(rng.randrange(4))}
    if kind == 2:
        return rng.choice(['"', "\\", '\\"', "}", "{", "[", "]", ",", "a\\", "漢", '}\\"}', ""]) * rng.randrange(5)
    return rng.randrange(1000) if kind == 3 else rng.choice([None, True, 1.5, "x},{", "\n"])


@pytest.mark.parametrize("seed", range(8))
def test_arrays_cut_anywhere(spark, tmp_path, blocks, monkeypatch, seed):
    monkeypatch.setattr(json_array, "GROUP", 50)
    rng = random.Random(seed)
    array = [value(rng) for _ in range([0, 1, 5, 60, 400, 400, 60, 3][seed])]
    text = ["", " \n"][seed % 2] + json.dumps(array, ensure_ascii=False, indent=[None, 1][seed // 2 % 2]) + ["", "\n "][seed // 4]
    (tmp_path / "array.json").write_text(text, encoding="utf-8")
    for size in (64, 700, 1 << 20):
        blocks(size)
        rows = sorted(json_array.elements(spark, str(tmp_path / "array.json")).collect())
        assert [(r.pos, json.loads(r.text)) for r in rows] == list(enumerate(array))


def test_a_manifest_like_the_one_task_reader(spark, tmp_path, blocks):
    rng = random.Random(3)
    manifest = [
        {"taskId": f"t{i}", "fontName": rng.choice(["Arial", 'A "B" {C}', "D\\"]), "aliases": ["x}", "y"][: i % 3], "widthPx": i / 2, "kerning": None}
        for i in range(500)
    ]
    path = str(tmp_path / "manifest.json")
    (tmp_path / "manifest.json").write_text(json.dumps(manifest, indent=2))
    whole = packages.read_manifest(spark, path).drop("pos")
    blocks(1500)
    many = packages.read_manifest_blocks(spark, path)
    assert many.columns == [*whole.columns, "pos"]
    assert [tuple(r)[:-1] for r in many.orderBy("pos").collect()] == [tuple(r) for r in whole.collect()]
    assert sorted(r.pos for r in many.collect()) == list(range(500))
    assert json_array._pieces(spark, path).rdd.getNumPartitions() > 10
    assert MANIFEST_JSON


@pytest.mark.parametrize("text", ["[1, 2", '[{"a": "x}]', '{"a": 1, "b": 2}', "]", '[{"a": [1}]'])
def test_what_is_no_array_is_refused(spark, tmp_path, text):
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(Exception, match="JSON array"):
        json_array.elements(spark, str(tmp_path / "bad.json")).collect()


def test_arrays_over_several_files(spark, tmp_path, blocks):
    rows = [(i, None if i % 7 == 0 else f'text {i} }},{{ "\\', [i, i]) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, text string, more array<int>").repartition(5)
    json_array.write(df, str(tmp_path / "out"), "id")
    assert len(list((tmp_path / "out").glob("part-*"))) > 1
    joined = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert [r["id"] for r in json.loads(joined)] == list(range(200))
    for size in (100, 1 << 20):
        blocks(size)
        back = json_array.read(spark, str(tmp_path / "out"), "id long, text string, more array<int>")
        assert sorted(tuple(r) for r in back.collect()) == [(*r, i) for i, r in enumerate(rows)]


def test_empty_arrays(spark, tmp_path):
    (tmp_path / "empty.json").write_text(" [ ] \n")
    assert json_array.elements(spark, str(tmp_path / "empty.json")).collect() == []
    df = spark.createDataFrame([(1,)], "id long")
    json_array.write(df, str(tmp_path / "one"), "id")
    assert [tuple(r) for r in json_array.read(spark, str(tmp_path / "one"), "id long").collect()] == [(1, 0)]
    json_array.write(df.limit(0), str(tmp_path / "none"), "id")
    assert json_array.read(spark, str(tmp_path / "none"), "id long").collect() == []
