"""Catalog vectors: JSON in, typed rows and violations out."""

import json

import pytest
from pyspark.sql import functions as F

from evalspark.operators import catalog
from evalspark.plans import package_queries

BASE = {
    "id": "m-1", "provider": "openai", "model": "m-1-large", "display_name": "M 1", "api_key_env": "M_KEY",
    "source_url": "https://example.com/m",
}
NL = chr(10)
CASES = {
    "fine": ({}, []),
    "full": ({"pricing_source_url": "http://x.io", "base_url": None, "input_per_m": 0, "output_per_m": 2.5, "max_output_tokens": 5,
              "enabled": False, "notes": "n", "pricing_notes": ""}, []),
    "upper id": ({"id": "Abc"}, ["id"]), "dash id": ({"id": "-a"}, ["id"]), "newline id": ({"id": "a" + NL}, ["id"]),
    "provider": ({"provider": "acme"}, ["provider"]), "blank model": ({"model": "a b"}, ["model"]), "wide blank": ({"model": "a" + chr(0xA0) + "b"}, ["model"]),
    "name": ({"display_name": ""}, ["display_name"]), "env": ({"api_key_env": "m_KEY"}, ["api_key_env"]),
    "env newline": ({"api_key_env": "M" + NL}, ["api_key_env"]), "url": ({"source_url": "ftp://x"}, ["source_url"]),
    "negative": ({"input_per_m": -1}, ["input_per_m"]), "nan": ({"input_per_m": float("nan")}, ["input_per_m"]),
    "infinite": ({"output_per_m": float("inf")}, ["output_per_m"]), "null price": ({"input_per_m": None}, []),
    "text price": ({"input_per_m": "3"}, ["type: input_per_m"]), "no tokens": ({"max_output_tokens": 0}, ["max_output_tokens"]),
    "float tokens": ({"max_output_tokens": 1024.5}, ["max_output_tokens", "type: max_output_tokens"]),
    "text flag": ({"enabled": "true"}, ["type: enabled"]), "unknown": ({"extra": 1}, ["unknown key: extra"]),
    "null notes": ({"notes": None}, ["type: notes"]), "number id": ({"id": 5}, ["id", "type: id"]),
}


def parsed(spark, models, version=1):
    doc = json.dumps({"version": version, "verified_at": "2026-09-01", "models": models})
    return catalog.parse_catalog(spark.createDataFrame([(doc,)], "value string"))


def test_field_rules(spark):
    df = parsed(spark, [{**BASE, **change} for change, _ in CASES.values()]).cache()
    assert df.count() == len(CASES)
    got = {}
    for r in catalog.catalog_violations(df).collect():
        got.setdefault(r.pos, []).append(r.rule)
    wrong = {name: (got.get(i, []), want) for i, (name, (_, want)) in enumerate(CASES.items()) if sorted(got.get(i, [])) != sorted(want)}
    assert wrong == {}


def test_defaults_and_missing(spark):
    row, bare = parsed(spark, [BASE, {"id": "x"}]).orderBy("pos").collect()
    assert (row.max_output_tokens, row.enabled, row.notes, row.input_per_m) == (1024, True, "", None)
    assert row.bad_types == [] and bare.bad_types == ["provider", "model", "display_name", "api_key_env", "source_url"]
    assert str(row.verified_at) == "2026-09-01"


def test_document_members(spark):
    doc = json.dumps({"version": 1, "verified_at": "yesterday", "models": [BASE], "owner": "x"})
    df = catalog.parse_catalog(spark.createDataFrame([(doc,)], "value string"))
    assert sorted(r.rule for r in catalog.catalog_violations(df).collect()) == ["unknown key: document.owner", "verified_at"]


def test_version(spark):
    rules = [r.rule for r in catalog.catalog_violations(parsed(spark, [BASE], version=2)).collect()]
    assert rules == ["version"]


def test_duplicates_cap_and_order(spark):
    models = [{**BASE, "id": f"a{i}", "enabled": i != 3} for i in range(6)] + [{**BASE, "id": "a0", "enabled": False}]
    df = parsed(spark, models)
    assert [tuple(r) for r in catalog.duplicate_ids(df).collect()] == [("a0", 2)]
    assert [tuple(r) for r in catalog.provider_cap(df).collect()] == [("openai", 5, True)]
    assert [r.id for r in catalog.enabled_models(df).collect()] == ["a0", "a1", "a2", "a4", "a5"]
    six = df.withColumn("enabled", F.lit(True))
    assert not catalog.provider_cap(six).collect()[0].ok


@pytest.mark.parametrize("name", ["catalog_documents", "catalog_gate"])
def test_documents_of_one_file_are_parsed_by_many_tasks(spark, sf_dir, name):
    seen = []
    parse = catalog.parse_catalog
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(catalog, "parse_catalog", lambda df: (seen.append(df.rdd.getNumPartitions()), parse(df))[1])
        package_queries.QUERIES[name][0](spark, sf_dir)
    assert seen and min(seen) >= 8
