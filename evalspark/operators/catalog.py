"""Model catalog: typed rows from JSON, field rules, uniqueness, provider cap, selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json_text import JSON_OPTIONS, json_single
from ..functions.text import finite_nonneg, full_match
from ..schemas import (
    CATALOG_VERSION, DEFAULT_MAX_OUTPUT_TOKENS, MAX_ENABLED_PER_PROVIDER, PROVIDERS,
)

# Members of a catalog document.
DOCUMENT_FIELDS = ("version", "verified_at", "models")

# Catalog fields with the kind of JSON value each takes.
REQUIRED_TEXT = ("id", "provider", "model", "display_name", "api_key_env", "source_url")
OPTIONAL_TEXT = ("pricing_source_url", "base_url")
DEFAULTED_TEXT = ("pricing_notes", "notes")
PRICES = ("input_per_m", "output_per_m")
CATALOG_FIELDS = (
    *REQUIRED_TEXT, *OPTIONAL_TEXT, *DEFAULTED_TEXT, *PRICES, "max_output_tokens", "enabled",
)

# Patterns the fields must match as a whole.
ID_PATTERN = r"[a-z0-9][a-z0-9._-]*"
MODEL_PATTERN = r"(?U:\S+)"  # Unicode whitespace counts too
ENV_PATTERN = r"[A-Z_][A-Z0-9_]*"
URL_PATTERN = r"(?i:https?)://[^\s/?#]+(?:[/?#]\S*)?"

_NUMBER = r"BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\s*\d+\)"


def parse_catalog(documents: DataFrame, text: str = "value") -> DataFrame:
    """One row per model of each catalog document, with its position, and one with a NULL position for a
    document without models. ``parsed`` tells whether the text is one JSON document with a list of models.

    ``unknown_keys`` lists members outside the schema (those of the document itself with a
    ``document.`` prefix) and ``bad_types`` fields whose JSON value is
    of the wrong kind (no coercion: ``"3"`` is not a price, ``1024.0`` not a token count) or, where
    required, absent.
    """
    doc = F.from_json(F.col(text), "version variant, verified_at variant, models array<variant>", JSON_OPTIONS)
    carried = [c for c in documents.columns if c != text]
    keys = F.map_keys(F.from_json(F.col(text), "map<string,string>", JSON_OPTIONS))
    strange = F.array_except(keys, F.array(*map(F.lit, DOCUMENT_FIELDS)))
    whole = F.coalesce(json_single(F.col(text)), F.lit(False))
    read = documents.select(*carried, doc.alias("__doc"), strange.alias("__strange"), whole.alias("__whole"))
    listed = F.coalesce(F.col("__whole") & F.col("__doc.models").isNotNull(), F.lit(False))
    models = read.select(
        *carried, F.col("__strange").alias("strange"), listed.alias("parsed"),
        F.when(F.schema_of_variant("__doc.version") == "BIGINT", F.try_variant_get("__doc.version", "$", "int")).alias("version"),
        F.try_to_date(F.try_variant_get("__doc.verified_at", "$", "string"), "yyyy-MM-dd").alias("verified_at"),
        F.posexplode_outer(F.when(listed, F.col("__doc.models"))).alias("pos", "m"),
    ).withColumn("members", F.try_variant_get("m", "$", "map<string,variant>"))

    kind = {f: F.schema_of_variant(F.col("members")[f]) for f in CATALOG_FIELDS}
    present = {f: F.array_contains(F.map_keys("members"), f) for f in CATALOG_FIELDS}

    def value(field: str, sql_type: str) -> Column:
        return F.try_variant_get(F.col("members")[field], "$", sql_type)

    bad: list[Column] = []
    out: dict[str, Column] = {}
    for f in (*REQUIRED_TEXT, *OPTIONAL_TEXT, *DEFAULTED_TEXT):
        allowed = ["STRING", "VOID"] if f in OPTIONAL_TEXT else ["STRING"]
        wrong = present[f] & ~kind[f].isin(*allowed)
        bad.append(F.when(wrong | (F.lit(f in REQUIRED_TEXT) & ~present[f]), F.lit(f)))
        text_value = F.when(kind[f] == "STRING", value(f, "string"))
        out[f] = F.when(~present[f], "").otherwise(text_value) if f in DEFAULTED_TEXT else text_value
    for f in PRICES:
        bad.append(F.when(present[f] & ~kind[f].rlike(rf"\A(?:VOID|{_NUMBER})\z"), F.lit(f)))
        out[f] = F.when(kind[f].rlike(rf"\A(?:{_NUMBER})\z"), value(f, "double"))
    tokens, enabled = "max_output_tokens", "enabled"
    bad.append(F.when(present[tokens] & (kind[tokens] != "BIGINT"), F.lit(tokens)))
    bad.append(F.when(present[enabled] & (kind[enabled] != "BOOLEAN"), F.lit(enabled)))
    out[tokens] = F.when(~present[tokens], F.lit(DEFAULT_MAX_OUTPUT_TOKENS).cast("bigint")).otherwise(
        F.when(kind[tokens] == "BIGINT", value(tokens, "bigint")))
    out[enabled] = F.when(~present[enabled], F.lit(True)).otherwise(
        F.when(kind[enabled] == "BOOLEAN", value(enabled, "boolean")))

    known = F.array(*map(F.lit, CATALOG_FIELDS))
    return models.select(
        *carried, "parsed", "version", "verified_at", "pos", *[c.alias(f) for f, c in out.items()],
        F.concat(
            F.array_sort(F.array_except(F.map_keys("members"), known)),
            F.transform("strange", lambda name: F.concat(F.lit("document."), name)),
        ).alias("unknown_keys"),
        F.array_compact(F.array(*bad)).alias("bad_types"),
    )


def catalog_violations(catalog: DataFrame, providers: Sequence[str] = PROVIDERS, keep: Sequence[str] = ()) -> DataFrame:
    """(keep, pos, id, rule) for every broken rule; one pass, one row out per violation.

    Every rule needs its column: one that is missing is an error, not a rule passed. A text that is no
    catalog document breaks the rule ``document`` and no other; the document's own rules are reported with
    each of its models, or once where it has none.
    """
    def optional(col: str, ok: Column) -> Column:
        return F.col(col).isNull() | ok

    def url(col: str) -> Column:
        return full_match(F.col(col), URL_PATTERN) & (F.length(col) <= 2083)

    document = {
        "version": F.col("version") == CATALOG_VERSION,
        "verified_at": F.col("verified_at").isNotNull(),
    }
    rules = {
        "id": full_match(F.col("id"), ID_PATTERN),
        "provider": F.col("provider").isin(*providers),
        "model": full_match(F.col("model"), MODEL_PATTERN),
        "display_name": F.length("display_name") > 0,
        "api_key_env": full_match(F.col("api_key_env"), ENV_PATTERN),
        "source_url": url("source_url"),
        "pricing_source_url": optional("pricing_source_url", url("pricing_source_url")),
        "base_url": optional("base_url", url("base_url")),
        "input_per_m": optional("input_per_m", finite_nonneg(F.col("input_per_m"))),
        "output_per_m": optional("output_per_m", finite_nonneg(F.col("output_per_m"))),
        "max_output_tokens": F.col("max_output_tokens") > 0,
    }
    parsed, model = F.coalesce("parsed", F.lit(False)), F.col("pos").isNotNull()

    def broken(applies: Column, checks: dict[str, Column]) -> list[Column]:
        return [F.when(applies & ~F.coalesce(ok, F.lit(False)), F.lit(rule)) for rule, ok in checks.items()]

    found = F.array_compact(F.array(
        F.when(~parsed, F.lit("document")), *broken(parsed, document), *broken(parsed & model, rules)))
    for column, label in (("unknown_keys", "unknown key"), ("bad_types", "type")):
        found = F.concat(found, _labelled(column, label))
    return catalog.select(*keep, "pos", "id", F.explode(found).alias("rule"))


def catalog_gate(catalog: DataFrame, by: str, providers: Sequence[str] = PROVIDERS, cap: int = MAX_ENABLED_PER_PROVIDER) -> DataFrame:
    """One verdict per document: models, broken rules, ids configured twice, providers over the cap, ok."""
    models = catalog.groupBy(by).agg(F.count("pos").alias("n_models"))
    rules = catalog_violations(catalog, providers, [by]).groupBy(by).agg(F.count("*").alias("n_violations"))
    listed = catalog.filter("pos IS NOT NULL")
    twice = listed.groupBy(by, "id").agg(F.count("*").alias("n")).filter("n > 1 AND id IS NOT NULL")
    over = listed.filter("enabled").groupBy(by, "provider").agg(F.count("*").alias("n")).filter(F.col("n") > cap)
    out = models.join(rules, by, "left")
    out = out.join(twice.groupBy(by).agg(F.count("*").alias("n_duplicates")), by, "left")
    out = out.join(over.groupBy(by).agg(F.count("*").alias("n_over_cap")), by, "left")
    counts = ("n_violations", "n_duplicates", "n_over_cap")
    out = out.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in counts})
    return out.withColumn("ok", sum((F.col(c) for c in counts), F.lit(0)) == 0)


def _labelled(column: str, label: str) -> Column:
    named = F.transform(F.col(column), lambda name: F.concat(F.lit(f"{label}: "), name))
    return F.coalesce(named, F.array().cast("array<string>"))


def enabled_models(catalog: DataFrame) -> DataFrame:
    """Enabled models in configured order."""
    return catalog.filter("enabled").orderBy("pos")


def duplicate_ids(catalog: DataFrame) -> DataFrame:
    """Model ids configured more than once, disabled ones included."""
    return catalog.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")


def provider_cap(catalog: DataFrame, cap: int = MAX_ENABLED_PER_PROVIDER) -> DataFrame:
    """Enabled models per provider and whether they are within the cap."""
    return catalog.filter("enabled").groupBy("provider").agg(F.count("*").alias("n")).withColumn(
        "ok", F.col("n") <= cap
    )
