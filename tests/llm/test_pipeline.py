"""Each stage of the pipeline against a plain version of it, on all that the stage before it kept."""

from __future__ import annotations

import os
import random

import pytest

import corpus_pipeline
from evalspark.llm import pieces
from evalspark.llm.store import landed

from . import brute, tables

pytestmark = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no model file")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    rng = random.Random(21)
    docs = {i: t for i, t in tables.documents().items() if i is not None}
    items = {i: tables.prose(rng, 40) for i in range(12)}
    for i in range(6):
        docs[300 + i] = tables.prose(rng, 90) + " " + items[i] + " " + tables.prose(rng, 30)
    toxic = set()
    for i in range(400, 520):
        docs[i] = tables.prose(rng, rng.choice((20, 60, 300, 2000)))
        if i % 4 == 0:
            docs[i] += " you utter dimwit " + tables.prose(rng, 10)
            toxic.add(i)
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs.items()]
    rows.append(rows[0])  # a row twice
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, int(i in toxic)) for i in docs], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = landed(stage(spark, now, str(tmp_path)), "test")
        assert now.columns == [c.split()[0] for c in COLUMNS.split(", ")], name
        kept[name] = {r.doc_id: r for r in now.collect()}
        assert all(r.n_chars == len(r.text or "") for r in kept[name].values())

    assert kept["toxicity"].keys() == docs.keys() - toxic
    left = {i: docs[i] for i in kept["toxicity"]}
    want = {i for i, (_, component) in brute.near_duplicates(left).items() if component == i}
    assert kept["near_duplicates"].keys() == want and now.count() == len(kept["decontamination"])
    left = {i: docs[i] for i in want}
    cut = brute.substring(left)
    assert {i: r.text for i, r in kept["substring_dedup"].items()} == {i: cut[i][2] if cut[i][1] else left[i] for i in want}
    assert kept["decontamination"].keys() == want - {300 + i for i in range(6)}

    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == kept["decontamination"].keys()
    ids = {(r.doc_id, tuple(r.ids)) for r in out}
    assert len(ids) == len(out)


def test_rows_without_an_id_or_with_a_shared_one_stay(spark, tmp_path):
    rng = random.Random(22)
    item, texts = tables.prose(rng, 40), [tables.prose(rng, 120) for _ in range(6)]
    leak = tables.prose(rng, 80) + " " + item
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (None, leak), (None, None), (None, None)]
    rows += [(5, texts[2]), (5, texts[3]), (5, leak + " more"), (6, texts[2]), (7, texts[4]), (7, texts[5][:500] + " x"), (7, "")]
    full = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    spark.createDataFrame(full, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, 0) for i in (5, 6, 7)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    order = lambda found: sorted(found, key=str)
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    now = landed(stages["near_duplicates"](spark, now, str(tmp_path)), "test")
    linked = [(None, texts[1]), (5, leak + " more"), (6, texts[2])]
    for row in linked:
        rows.remove(row)
    assert order((r.doc_id, r.text) for r in now.collect()) == order(rows)
    now = landed(stages["substring_dedup"](spark, now, str(tmp_path)), "test")
    assert order((r.doc_id, r.text) for r in now.collect()) == order(rows)
    rows.remove((None, leak))
    now = stages["decontamination"](spark, now, str(tmp_path))
    assert order((r.doc_id, r.text) for r in now.collect()) == order(rows)
    alone = spark.createDataFrame([(None, leak, "en", "s", 1), (3, texts[0], "en", "s", 1)], COLUMNS)
    assert [r.doc_id for r in stages["decontamination"](spark, alone, str(tmp_path)).collect()] == [3]


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11))
