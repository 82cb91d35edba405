"""Reconciliation, uniqueness, naming and release-protection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.paths import base_name, parent_dir, valid_release_path
from ..operators import audits, release
from ..schemas import PACKAGE_TAGS
from .carriers import carrier, table
from .oracle import sql

_TAGS = "[" + ", ".join(f"'{t}'" for t in PACKAGE_TAGS) + "]"


# --- keys, duplicates, totals ---------------------------------------------------------------

def declared(spark, d):
    orders = table(spark, d, "orders")
    descriptor = orders.agg((F.max("o_orderkey") + 1).alias("total_tasks")).withColumn("name", F.lit("orders"))
    return audits.declared_vs_actual(descriptor, orders)


def one_prompt(spark, d):
    """Every benchmark item is the reference text of a group of documents and is looked for in each of these."""
    items = table(spark, d, "benchmark").select(
        "item_id", F.concat(F.lit(chr(0xA0) + chr(10)), F.col("text"), F.lit(" ")).alias("prompt"))
    documents = table(spark, d, "documents").select("doc_id", "text", (F.col("doc_id") % 40).alias("item_id"))
    return audits.prompt_containment(documents, items, "doc_id", by="item_id")


def visible_lines(spark, d):
    lines = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))
    return audits.line_count_violations(
        table(spark, d, "documents").select("doc_id", lines.cast("bigint").alias("visible_lines")))


# --- package against manifest ---------------------------------------------------------------

_FIELDS = {
    "font": "font_name", "category": "category", "weight": "weight", "modifier": "modifier",
    "kerning": "kerning", "line_height": "line_height", "width": "width", "image_sha256": "image_sha256",
}


def mismatches(spark, d):
    return audits.field_mismatches(
        carrier(spark, d, "samples"), carrier(spark, d, "manifest"), "task_id", _FIELDS, order="doc_id")


_MISMATCHES = " UNION ALL ".join(
    f"SELECT p.task_id, '{a}' AS field, p.{a} AS packaged, m.{b} AS frozen FROM samples p JOIN manifest m USING (task_id)"
    f" WHERE p.{a} IS DISTINCT FROM m.{b}"
    for a, b in _FIELDS.items()
)

_BOTH = """
    SELECT coalesce(p.doc_id, m.doc_id) AS doc_id, coalesce(p.n, 0) AS n_left, coalesce(m.n, 0) AS n_right
    FROM (SELECT doc_id, count(*) AS n FROM documents GROUP BY doc_id) p
    FULL JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY doc_id) m ON p.doc_id = m.doc_id"""


# --- naming and metadata --------------------------------------------------------------------

def leaked_tags(spark, d):
    return audits.tag_violations(carrier(spark, d, "packages")).select(
        "task_no", F.array_join("tags", "|").alias("tags"), F.array_join("leaked", "|").alias("leaked"))


# --- release protection ---------------------------------------------------------------------

def path_checks(spark, d):
    """Both forms of every page address as a registry value: with and without its scheme."""
    p = carrier(spark, d, "url_paths")
    return p.select(
        "page_id", valid_release_path(F.col("url")).alias("url_valid"), valid_release_path(F.col("path")).alias("path_valid"),
        parent_dir(F.col("path")).alias("parent"), base_name(F.col("path")).alias("base"))


def _valid(c: str) -> str:
    parts = f"string_split({c}, '/')"
    return (
        f"({c} <> '' AND NOT starts_with({c}, '/') AND NOT contains({c}, chr(92))"
        f" AND NOT list_has_any({parts}, ['', '.', '..']))"
    )


_PATH_CHECKS = f"""
    SELECT page_id, {_valid('url')} AS url_valid, {_valid('path')} AS path_valid,
      CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '' END AS parent,
      regexp_extract(path, '([^/]*)$', 1) AS base FROM url_paths"""

_ENTRIES = """(SELECT file_name, 'dataset_manifest' AS field, dataset_manifest AS value FROM {r}
    UNION ALL SELECT file_name, 'harbor_dataset', harbor_dataset FROM {r})"""
_INVALID = f"SELECT file_name, field, value FROM {_ENTRIES.format(r='releases')} WHERE NOT coalesce({_valid('value')}, false)"
_PROTECTED = f"""
    SELECT file_name, field, CASE WHEN field = 'harbor_dataset' THEN value
      WHEN contains(value, '/') THEN regexp_extract(value, '^(.*)/[^/]*$', 1) ELSE '' END AS path
    FROM {{e}} WHERE coalesce({_valid('value')}, false)"""


def overlaps(spark, d):
    """Outputs proposed at the https addresses, in several spellings, against what the http ones protect."""
    registry = carrier(spark, d, "releases")
    clean = registry.filter(F.col("secure") & valid_release_path(F.col("harbor_dataset")))
    proposed = clean.select(F.expr(_SPELLED).alias("path"))
    return release.overlap_report(proposed, registry.filter("NOT secure"))


# Spellings of one path by the page number: four that must be found, two that leave the root.
_SPELLED = """CASE CAST(regexp_extract(file_name, '^([0-9]+)', 1) AS BIGINT) % 7
    WHEN 0 THEN './' || harbor_dataset WHEN 1 THEN 'x/../' || harbor_dataset WHEN 2 THEN replace(harbor_dataset, '/', '//')
    WHEN 3 THEN harbor_dataset || '/' WHEN 4 THEN '/' || harbor_dataset WHEN 5 THEN 'x/../../' || harbor_dataset
    ELSE harbor_dataset END"""


_OVERLAPS = f"""
    WITH views_releases AS (SELECT * FROM releases WHERE NOT secure),
    prot AS ({_PROTECTED.format(e=_ENTRIES.format(r='views_releases'))}),
    proposed AS (SELECT *, {_SPELLED} AS spelled, CAST(regexp_extract(file_name, '^([0-9]+)', 1) AS BIGINT) AS page
      FROM releases WHERE secure AND coalesce({_valid('harbor_dataset')}, false)),
    hits AS (
      SELECT DISTINCT r.spelled AS path, p.path AS held FROM proposed r, prot p
      WHERE r.page % 7 NOT IN (4, 5) AND (r.harbor_dataset = p.path OR starts_with(r.harbor_dataset, p.path || '/')
        OR starts_with(p.path, r.harbor_dataset || '/') OR p.path = '' OR r.harbor_dataset = ''))
    SELECT h.path, 'overlap' AS status, count(DISTINCT h.held) AS n_protected,
      min({{'a': p.file_name, 'b': p.field}}).a AS file_name, min({{'a': p.file_name, 'b': p.field}}).b AS field
    FROM hits h JOIN prot p ON p.path = h.held GROUP BY h.path
    UNION ALL SELECT DISTINCT spelled, 'outside', NULL, NULL, NULL FROM proposed WHERE page % 7 IN (4, 5)
    UNION ALL SELECT value, 'invalid registry', NULL, file_name, field FROM {_ENTRIES.format(r='views_releases')}
      WHERE NOT coalesce({_valid('value')}, false)"""


def _text(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-;' ELSE CAST(length({c}) AS VARCHAR) || ':' || {c} || ';' END"


_FP_COLS = ("task_id", "image_sha256", "font", "weight", "modifier", "kerning", "line_height")
_FINGERPRINT = f"""
    , rows_ AS (SELECT sha256({' || '.join(_text(c) for c in _FP_COLS)}) AS h FROM samples),
    l0 AS (SELECT h AS id, h || 'x' || CAST(count(*) AS VARCHAR) AS d, count(*) AS n FROM rows_ GROUP BY h),
    l1 AS (SELECT left(id, 6) AS id, left(id, 6) || ':' || sha256(string_agg(d, ',' ORDER BY d)) AS d, sum(n) AS n FROM l0 GROUP BY left(id, 6)),
    l2 AS (SELECT left(id, 3) AS id, left(id, 3) || ':' || sha256(string_agg(d, ',' ORDER BY d)) AS d, sum(n) AS n FROM l1 GROUP BY left(id, 3))
    SELECT sha256(string_agg(d, ',' ORDER BY d)) AS fingerprint, CAST(sum(n) AS BIGINT) AS n_rows FROM l2"""


def _fingerprint_sql() -> str:
    return sql("", "samples").rstrip() + _FINGERPRINT


QUERIES = {
    "duplicate_contents": (
        lambda s, d: audits.duplicate_groups(carrier(s, d, "samples"), "image_sha256", "doc_id"),
        sql("SELECT image_sha256, count(*) AS n, min(doc_id) AS first_key FROM samples GROUP BY image_sha256 HAVING count(*) > 1", "samples")),
    "key_violations": (
        lambda s, d: audits.key_violations(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]),
        "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1"),
    "declared_vs_actual": (
        declared,
        "SELECT 'orders' AS name, max(o_orderkey) + 1 AS declared, count(*) AS actual, max(o_orderkey) + 1 = count(*) AS ok FROM orders"),
    "single_valued": (
        lambda s, d: audits.single_valued(table(s, d, "documents"), "lang", ["source"]),
        "SELECT source, count(*) AS n, count(DISTINCT lang) = 1 AS single FROM documents GROUP BY source"),
    "single_instruction": (
        lambda s, d: audits.single_valued(table(s, d, "documents"), "text"),
        "SELECT count(*) AS n, count(DISTINCT text) = 1 AS single FROM documents"),
    "match_audit": (
        lambda s, d: audits.match_audit(table(s, d, "documents"), table(s, d, "labels"), "doc_id"),
        f"SELECT *, CASE WHEN n_right = 0 THEN 'orphan' WHEN n_left = 0 THEN 'unpackaged' WHEN n_left > 1 THEN 'repeated' ELSE 'matched' END AS state FROM ({_BOTH})"),
    "key_diff": (
        lambda s, d: audits.key_diff(table(s, d, "documents"), table(s, d, "labels"), "doc_id"),
        f"SELECT doc_id, CASE WHEN n_right = 0 THEN 'left' ELSE 'right' END AS only_in FROM ({_BOTH}) WHERE n_left = 0 OR n_right = 0"),
    "key_diff_both_ways": (
        lambda s, d: audits.key_diff(
            table(s, d, "labels"), table(s, d, "pages").select(F.col("page_id").alias("doc_id")), "doc_id"),
        "SELECT doc_id, 'left' AS only_in FROM labels WHERE doc_id NOT IN (SELECT page_id FROM pages)"
        " UNION ALL SELECT page_id, 'right' FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels)"),
    "field_mismatches": (mismatches, sql(_MISMATCHES, "samples", "manifest")),
    "prompt_containment": (
        one_prompt,
        "SELECT doc_id, coalesce(contains(d.text, b.text), false) AS contains FROM documents d LEFT JOIN benchmark b ON d.doc_id % 40 = b.item_id"),
    "missing_files": (
        lambda s, d: audits.missing_files(
            table(s, d, "conversations").select("conv_id", F.col("role").alias("name")), "conv_id", ["assistant", "system", "user"]),
        "SELECT c.conv_id, r.role AS missing FROM (SELECT DISTINCT conv_id FROM conversations) c,"
        " (VALUES ('assistant'), ('system'), ('user')) r(role)"
        " WHERE (c.conv_id, r.role) NOT IN (SELECT conv_id, role FROM conversations)"),
    "naming_violations": (
        lambda s, d: audits.naming_violations(carrier(s, d, "packages")).select("task_no", "directory", "name"),
        sql("SELECT task_no, directory, name FROM packages WHERE NOT (directory = task_id AND name = directory AND starts_with(directory, 'task-'))", "packages")),
    "tag_violations": (
        leaked_tags,
        sql(f"SELECT task_no, array_to_string(tags, '|') AS tags, array_to_string(list_filter(tags, lambda t: NOT list_contains({_TAGS}, t)), '|') AS leaked"
            f" FROM packages WHERE tags <> {_TAGS}", "packages")),
    "line_count_violations": (
        visible_lines,
        "SELECT * FROM (SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS visible_lines FROM documents)"
        " WHERE visible_lines < 2 OR visible_lines > 5"),
    "release_path_checks": (path_checks, sql(_PATH_CHECKS, "url_paths")),
    "invalid_release_entries": (
        lambda s, d: release.invalid_entries(carrier(s, d, "releases")), sql(_INVALID, "releases")),
    "protected_dirs": (
        lambda s, d: release.protected_dirs(carrier(s, d, "releases")),
        sql(_PROTECTED.format(e=_ENTRIES.format(r="releases")), "releases")),
    "frozen_overlaps": (overlaps, sql("SELECT * FROM (" + _OVERLAPS + ")", "releases")),
    "dataset_fingerprint": (
        lambda s, d: release.fingerprint(carrier(s, d, "samples"), list(_FP_COLS)), _fingerprint_sql()),
}
