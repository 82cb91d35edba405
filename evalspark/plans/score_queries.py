"""Reply validation, grading and accuracy queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import json_text
from ..functions.text import in_domain, norm_name, strip_unicode
from ..operators import grading, replies, runs, scores
from ..schemas import PASS_COLUMNS, REPLY_DOMAINS, REPLY_FIELDS
from .carriers import carrier
from .oracle import ACCURACY, SUMS, documents, fold, in_list, judged, norm, sql, strip

_PASSES = ", ".join(PASS_COLUMNS)
_GRADE_SQL = f"{_PASSES}, n_pass, round(score, 6) AS score, exact"


def _graded(df: DataFrame, *ids: str) -> DataFrame:
    return df.select(*ids, *PASS_COLUMNS, "n_pass", F.round("score", 6).alias("score"), "exact")


def successes(spark: SparkSession, d: str) -> DataFrame:
    return carrier(spark, d, "attempts").filter("status = 'success'")


def finals(spark: SparkSession, d: str) -> DataFrame:
    columns = ("model_id", "task_id", "ts", "attempt_id", "status", "reply")
    return runs.final_responses(carrier(spark, d, "attempts").select(*columns), ("model_id", "task_id"))


def roster(spark: SparkSession, d: str) -> DataFrame:
    return carrier(spark, d, "run_catalog").filter("enabled")


def grades(spark: SparkSession, d: str, mode: str = replies.STRICT) -> DataFrame:
    saved = finals(spark, d).select("model_id", "task_id", "reply")
    return grading.grade(saved, carrier(spark, d, "customer_truth"), mode)


def line_grades(spark: SparkSession, d: str, mode: str = replies.STRICT) -> DataFrame:
    return grading.grade(carrier(spark, d, "line_replies"), carrier(spark, d, "order_truth"), mode)


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("composite", F.round("composite", 6))


# --- validation -----------------------------------------------------------------------------

def json_checks(spark, d):
    t = F.col("reply")
    return successes(spark, d).select(
        "attempt_id",
        json_text.json_single(t).alias("is_single"),
        json_text.json_unique_keys(t).alias("is_unique"),
        json_text.json_signature(t, REPLY_FIELDS).alias("is_shaped"),
    )


_KEYS = "[" + ", ".join(f"'{f}'" for f in sorted(REPLY_FIELDS)) + "]"
_TYPED = " AND ".join(f"json_type(doc, '$.{f}') = 'VARCHAR'" for f in REPLY_FIELDS)
_JSON_CHECKS = f"""
    SELECT attempt_id, coalesce(json_valid(reply), false) AS is_single,
      coalesce(json_valid(reply), false) AND coalesce(len(json_keys(doc)) = len(list_distinct(json_keys(doc))), true) AS is_unique,
      coalesce(list_sort(json_keys(doc)) = {_KEYS} AND {_TYPED}, false) AS is_shaped
    FROM {documents('successes')}"""


def domain_checks(spark, d):
    """Label and font checks on leniently read fields, so that bad values are still there to test."""
    read = replies.with_lenient_reply(successes(spark, d).select("attempt_id", "reply"))
    font = F.coalesce(F.length(strip_unicode(F.col("answer.font"))) > 0, F.lit(False))
    return read.select(
        "attempt_id", font.alias("font_ok"),
        *[in_domain(F.col(f"answer.{f}"), v).alias(f"{f}_ok") for f, v in REPLY_DOMAINS.items()],
    )


_DOMAIN_CHECKS = "SELECT attempt_id, coalesce({} <> '', false) AS font_ok, {} FROM lenient_successes".format(
    strip("f_font"),
    ", ".join(f"coalesce({fold(f'f_{f}')} IN {in_list(v)}, false) AS {f}_ok" for f, v in REPLY_DOMAINS.items()),
)


def _fields(df: DataFrame) -> DataFrame:
    return df.select("attempt_id", *[F.col(f"answer.{f}").alias(f) for f in REPLY_FIELDS])


_FIELDS = "SELECT attempt_id, " + ", ".join(f"f_{f} AS {f}" for f in REPLY_FIELDS) + " FROM "


# --- grading --------------------------------------------------------------------------------

def grade_with_missing(spark, d):
    said = successes(spark, d).select(F.col("attempt_id").cast("string").alias("attempt"), "task_id", "reply")
    return _graded(grading.grade_all(said, carrier(spark, d, "customer_truth")), "task_id", "attempt")


def names(spark, d):
    truth = carrier(spark, d, "order_truth")
    accepted = grading.accepted_names(F.col("canonical"), F.col("aliases"))
    return truth.select(
        "task_no", norm_name(F.col("canonical")).alias("normal"), F.array_join(accepted, "|").alias("accepted")
    )


_NAMES = f"""
    SELECT task_no, {norm('canonical')} AS normal, array_to_string(list_transform(
      list_filter(list_concat([canonical], aliases), lambda a: a <> ''), lambda a: {norm('a')}), '|') AS accepted
    FROM order_truth"""


def rescored(spark, d):
    """Grades saved under the lenient reading against a strict re-grading of the same replies."""
    said = finals(spark, d).select("model_id", "task_id", "reply")
    truth = carrier(spark, d, "customer_truth")
    saved = grading.grade(said.withColumn("saved_reply", F.col("reply")), truth, replies.LENIENT)
    stored = [F.col(p).alias(f"stored_{p}") for p in PASS_COLUMNS]
    saved = saved.select("model_id", "task_id", F.col("saved_reply").alias("reply"), *stored)
    return grading.rescore_diff(saved, truth).select(
        "model_id", "task_id", "n_pass", *[f"stored_{p}" for p in PASS_COLUMNS]
    )


_RESCORED = "WITH {views} SELECT model_id, task_id, s.n_pass, {stored} FROM lax l JOIN grades s USING (model_id, task_id) WHERE {diff}"


def _rescored_sql() -> str:
    from .oracle import VIEWS, lenient_parse

    needed = ["attempts", "finals", "customer_truth", "strict_finals", "grades"]
    views = ", ".join(f"{v} AS ({VIEWS[v]})" for v in needed)
    views += f", lenient_finals AS ({lenient_parse('finals')})"
    views += f", lax AS ({judged('lenient_finals', 'customer_truth', 'r.model_id')})"
    return _RESCORED.format(
        views=views,
        stored=", ".join(f"l.{p} AS stored_{p}" for p in PASS_COLUMNS),
        diff=" OR ".join(f"l.{p} <> s.{p}" for p in PASS_COLUMNS),
    )


def verdicts(spark, d):
    return grading.verdict_text(grades(spark, d)).select("model_id", "task_id", "verdict")


_VERDICTS = """
    SELECT model_id, task_id, '[Verifier] Task: ' || task_id || ' - Score: ' || printf('%.1f', score * 100) || '%' || chr(10)
      || '  Font: ' || CASE WHEN font_pass THEN 'PASS' ELSE 'FAIL' END
      || ' | Cat: ' || CASE WHEN category_pass THEN 'PASS' ELSE 'FAIL' END
      || ' | Weight: ' || CASE WHEN weight_pass THEN 'PASS' ELSE 'FAIL' END AS verdict
    FROM grades"""


def first_paths(spark, d):
    """Turns of a conversation as reply files at two candidate paths: the assistant's, then the user's."""
    from .carriers import table

    turns = table(spark, d, "conversations")
    ranked = turns.withColumn("path_rank", F.struct(F.col("role") != "assistant", "turn"))
    return replies.first_existing(ranked, ["conv_id"])


_FIRST_PATHS = """
    SELECT conv_id, text AS reply FROM (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY role <> 'assistant', turn) AS rn FROM conversations) WHERE rn = 1"""


# --- accuracy -------------------------------------------------------------------------------

_METRICS = ("exact", *REPLY_FIELDS)
_LONG = " UNION ALL ".join(
    f"SELECT model_id, n, '{m}' AS metric, {m} AS correct, round({m} / n, 6) AS accuracy FROM a" for m in _METRICS
)
_SUBGROUPS = " UNION ALL ".join(
    f"SELECT model_id, '{f}' AS heading, {f} AS level, count(*) AS n, {SUMS} FROM {{g}} GROUP BY model_id, {f}"
    for f in REPLY_FIELDS
)


def subgroup_metrics(spark, d):
    table_ = scores.subgroup_accuracy(grades(spark, d))
    long = scores.metric_long(table_, ["model_id", "heading", "level"])
    return long.withColumn("accuracy", F.round("accuracy", 6))


_SUBGROUP_METRICS = " UNION ALL ".join(
    f"SELECT model_id, heading, level, n, '{m}' AS metric, {m} AS correct, round({m} / n, 6) AS accuracy FROM s" for m in _METRICS
)

_SHARED = """
    SELECT task_id FROM finals WHERE model_id IN (SELECT model_id FROM roster)
    GROUP BY task_id HAVING count(DISTINCT model_id) = (SELECT count(DISTINCT model_id) FROM roster)"""

QUERIES = {
    "json_checks": (json_checks, sql(_JSON_CHECKS, "successes")),
    "domain_checks": (domain_checks, sql(_DOMAIN_CHECKS, "lenient_successes")),
    "strict_replies": (
        lambda s, d: _fields(replies.with_strict_reply(successes(s, d).select("attempt_id", "reply"))),
        sql(_FIELDS + "strict_successes", "strict_successes"),
    ),
    "lenient_replies": (
        lambda s, d: _fields(replies.with_lenient_reply(successes(s, d).select("attempt_id", "reply"))),
        sql(_FIELDS + "lenient_successes", "lenient_successes"),
    ),
    "reply_status_census": (
        lambda s, d: replies.status_census(carrier(s, d, "line_replies"), ["model_id"]),
        sql("SELECT model_id, CASE WHEN reply IS NULL THEN 'missing' WHEN ok THEN 'valid' ELSE 'invalid' END AS status,"
            " count(*) AS n FROM strict_lines GROUP BY ALL", "strict_lines"),
    ),
    "accepted_names": (names, sql(_NAMES, "order_truth")),
    "grade_strict": (
        lambda s, d: _graded(grades(s, d), "model_id", "task_id"),
        sql(f"SELECT model_id, task_id, {_GRADE_SQL} FROM grades", "grades"),
    ),
    "grade_lenient_lines": (
        lambda s, d: _rounded(scores.accuracy(line_grades(s, d, replies.LENIENT), ["model_id"])),
        sql(f"SELECT model_id, {ACCURACY} FROM lenient_line_grades GROUP BY model_id", "lenient_line_grades"),
    ),
    "grade_with_missing": (
        grade_with_missing,
        sql(f"SELECT task_id, CAST(attempt_id AS VARCHAR) AS attempt, {_GRADE_SQL} FROM ("
            + judged("strict_successes", "customer_truth", "r.attempt_id", "LEFT JOIN") + ")",
            "strict_successes", "customer_truth"),
    ),
    "rescore_diff": (rescored, _rescored_sql()),
    "verdict_lines": (verdicts, sql(_VERDICTS, "grades")),
    "first_existing_reply": (first_paths, _FIRST_PATHS),
    "accuracy_by_model": (
        lambda s, d: _rounded(scores.accuracy(grades(s, d), ["model_id"])),
        sql(f"SELECT model_id, {ACCURACY} FROM grades GROUP BY model_id", "grades"),
    ),
    "accuracy_by_model_lines": (
        lambda s, d: _rounded(scores.accuracy(line_grades(s, d), ["model_id"])),
        sql(f"SELECT model_id, {ACCURACY} FROM line_grades GROUP BY model_id", "line_grades"),
    ),
    "metric_selection": (
        lambda s, d: scores.metric_long(scores.accuracy(grades(s, d), ["model_id"]), ["model_id"]).withColumn(
            "accuracy", F.round("accuracy", 6)),
        sql(f"SELECT * FROM ({_LONG.replace('FROM a', f'FROM (SELECT model_id, {ACCURACY} FROM grades GROUP BY model_id)')})", "grades"),
    ),
    "subgroup_accuracy": (subgroup_metrics, sql(
        f"SELECT * FROM ({_SUBGROUP_METRICS.replace('FROM s', 'FROM (' + _SUBGROUPS.format(g='grades') + ')')})", "grades")),
    "subgroup_accuracy_lines": (
        lambda s, d: scores.subgroup_accuracy(line_grades(s, d)),
        sql(_SUBGROUPS.format(g="line_grades"), "line_grades"),
    ),
    "shared_cohort": (
        lambda s, d: scores.shared_cohort(finals(s, d), roster(s, d)),
        sql(_SHARED, "finals", "roster"),
    ),
    "shared_accuracy": (
        lambda s, d: _rounded(scores.shared_accuracy(grades(s, d), roster(s, d))),
        sql(f"SELECT model_id, {ACCURACY} FROM grades WHERE task_id IN ({_SHARED}) GROUP BY model_id",
            "grades", "roster"),
    ),
}
