"""Design, distribution and association queries over labelled samples and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audits, design
from ..schemas import KERNING_EM, LEVELS, LINE_HEIGHT_RATIO, MODIFIERS, WEIGHT_CSS, WEIGHTS, WIDTHS
from .carriers import FAMILIES, carrier, table
from .oracle import sql

# --- oracle side of the recipe rule ---------------------------------------------------------

def _pick(values, index: str) -> str:
    return "([" + ", ".join(f"'{v}'" for v in values) + f"])[{index} + 1]"


RECIPES = f"""
    SELECT CAST((w * 5 + m) * 3 + k + 1 AS INTEGER) AS variant_index, {_pick(WEIGHTS, 'w')} AS weight,
      {_pick(MODIFIERS, 'm')} AS modifier, {_pick(LEVELS, 'k')} AS kerning,
      {_pick(LEVELS, '((k + m) % 3)')} AS line_height, {_pick(WIDTHS, '((k + w + m // 3) % 3)')} AS width
    FROM range(4) a(w), range(5) b(m), range(3) c(k)"""
FAMILY_ROWS = "SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{c}')" for f, c in FAMILIES) + ") f(font, category)"


def _case(col: str, mapping) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in mapping.items()) + " END"


# --- Spark side -----------------------------------------------------------------------------

def line_axes(spark, d):
    """Line items as design rows: an axis independent of the others and one that follows them."""
    return table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
        (F.col("l_linenumber") % 3).alias("lane"),
        F.when(F.col("l_quantity") < 10, F.col("l_linenumber") % 3).otherwise(
            (F.col("l_suppkey") + F.col("l_partkey")) % 3).cast("int").alias("planted"),
    )


_LINE_AXES = """(SELECT l_returnflag AS flag, l_linestatus AS status, l_linenumber % 3 AS lane,
    CAST(CASE WHEN l_quantity < 10 THEN l_linenumber % 3 ELSE (l_suppkey + l_partkey) % 3 END AS INTEGER) AS planted FROM lineitem)"""


def data_factor_grid(spark, d):
    axes = line_axes(spark, d)
    seen = axes.groupBy("flag", "status", "lane").agg(F.count("*").alias("n"))
    grid = design.factor_grid(axes, ["flag", "status", "lane"])
    return grid.join(seen, ["flag", "status", "lane"], "left").select(
        "flag", "status", "lane", F.coalesce("n", F.lit(0)).alias("n"))


_DATA_GRID = f"""
    SELECT a.flag, b.status, c.lane, count(x.flag) AS n
    FROM (SELECT DISTINCT flag FROM {_LINE_AXES}) a, (SELECT DISTINCT status FROM {_LINE_AXES}) b,
      (SELECT DISTINCT lane FROM {_LINE_AXES}) c
      LEFT JOIN {_LINE_AXES} x ON x.flag = a.flag AND x.status = b.status AND x.lane = c.lane
    GROUP BY ALL"""


def recipe_usage(spark, d):
    """Every recipe in order with the tasks that use it; recipes nobody uses count zero."""
    used = design.with_recipe(carrier(spark, d, "order_truth")).groupBy("variant_index").agg(
        F.count("*").alias("n_tasks"))
    return design.recipes(spark).join(used, "variant_index", "left").select(
        "variant_index", "weight", "modifier", "kerning", "line_height", "width",
        F.coalesce("n_tasks", F.lit(0)).alias("n_tasks")).orderBy("variant_index")


_RECIPE_USAGE = f"""
    SELECT r.*, count(t.task_no) AS n_tasks FROM ({RECIPES}) r
    LEFT JOIN order_truth t ON t.weight = r.weight AND t.modifier = r.modifier AND t.kerning = r.kerning
    GROUP BY ALL"""


def _families(spark, d):
    return carrier(spark, d, "samples").select("font", "category").distinct()


def candidate_grid(spark, d):
    """Grid over the families that occur in the corpus, with the samples accepted in each cell."""
    accepted = carrier(spark, d, "samples").groupBy("font", "weight", "modifier", "kerning").agg(
        F.count("*").alias("n_samples"))
    keys = ["font", "weight", "modifier", "kerning"]
    return design.candidate_grid(_families(spark, d)).join(accepted, keys, "left").select(
        "font", "category", "variant_index", F.coalesce("n_samples", F.lit(0)).alias("n_samples"))


_FAMILIES = "(SELECT DISTINCT font, category FROM samples)"
_CANDIDATES = f"""
    SELECT f.font, f.category, r.variant_index, count(s.doc_id) AS n_samples
    FROM {_FAMILIES} f CROSS JOIN ({RECIPES}) r
    LEFT JOIN samples s ON s.font = f.font AND s.weight = r.weight AND s.modifier = r.modifier AND s.kerning = r.kerning
    GROUP BY ALL"""


def omitted(spark, d):
    cells = ["font", "weight", "modifier", "kerning"]
    grid = design.candidate_grid(_families(spark, d))
    return design.omitted_candidates(grid, carrier(spark, d, "samples"), cells).select("font", "variant_index")


_OMITTED = f"SELECT font, variant_index FROM ({_CANDIDATES}) WHERE n_samples = 0"


def recovered(spark, d):
    """Width and variant recovered from the three shown labels, and whether line height agrees."""
    truth = carrier(spark, d, "order_truth").drop("width")
    out = design.with_recipe(truth)
    return out.groupBy("variant_index", "width").agg(
        F.count("*").alias("n"),
        F.sum((F.col("line_height") == F.col("design_line_height")).cast("bigint")).alias("n_agree"))


_RECOVERED = f"""
    SELECT r.variant_index, r.width, count(*) AS n,
      CAST(sum(CASE WHEN t.line_height = r.line_height THEN 1 ELSE 0 END) AS BIGINT) AS n_agree
    FROM order_truth t JOIN ({RECIPES}) r USING (weight, modifier, kerning) GROUP BY ALL"""


def numeric_labels(spark, d):
    return design.label_metrics(carrier(spark, d, "order_truth")).select(
        "task_no", "weight_css", "kerning_em", "line_height_px")


_NUMERIC = f"""
    SELECT task_no, {_case('weight', WEIGHT_CSS)} AS weight_css,
      CAST({_case('kerning', KERNING_EM)} AS DOUBLE) AS kerning_em,
      round(CAST({_case('line_height', LINE_HEIGHT_RATIO)} AS DOUBLE) * 22, 6) AS line_height_px FROM order_truth"""

_DIMS = ("font", "category", "weight", "modifier", "kerning", "line_height", "width")
_DISTRIBUTION = " UNION ALL ".join(f"SELECT '{c}' AS dim, {c} AS level, count(*) AS n FROM samples GROUP BY {c}" for c in _DIMS)
_LINE_DIMS = ("flag", "status", "lane", "planted")
_BALANCE = "SELECT dim, count(*) AS n_levels, min(n) AS min_n, max(n) AS max_n, min(n) = max(n) AS balanced FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS dim, count(*) AS n FROM {_LINE_AXES} GROUP BY {c}" for c in _LINE_DIMS) + ") GROUP BY dim"

_COVERAGE = """
    SELECT weight, modifier, count(*) AS n, count(DISTINCT kerning) AS kerning_levels,
      count(DISTINCT line_height) AS line_height_levels, count(DISTINCT width) AS width_levels
    FROM samples GROUP BY weight, modifier"""


def coverage(spark, d):
    axes = ["kerning", "line_height", "width"]
    return audits.level_coverage(carrier(spark, d, "samples"), ["weight", "modifier"], axes)


def coverage_gaps(spark, d):
    """Faces of the corpus that do not have exactly one sample on each of three levels."""
    axes = ["kerning", "line_height", "width"]
    return audits.coverage_violations(carrier(spark, d, "samples"), ["font", "weight", "modifier"], axes, 3)


_COVERAGE_GAPS = """
    SELECT * FROM (SELECT font, weight, modifier, count(*) AS n, count(DISTINCT kerning) AS kerning_levels,
      count(DISTINCT line_height) AS line_height_levels, count(DISTINCT width) AS width_levels
    FROM samples GROUP BY font, weight, modifier)
    WHERE NOT (n = 3 AND kerning_levels = 3 AND line_height_levels = 3 AND width_levels = 3)"""


def _shortcut(a: str, b: str):
    def run(spark, d):
        out = audits.shortcut_audit(line_axes(spark, d), a, b)
        return out.withColumn("share", F.round("share", 6))

    query = f"""
        WITH j AS (SELECT {a}, {b}, count(*) AS n FROM {_LINE_AXES} GROUP BY ALL)
        SELECT {a}, CAST(sum(n) AS BIGINT) AS n, max(n) AS top_n, count(*) AS n_levels, round(max(n) / sum(n), 6) AS share,
          count(*) = (SELECT count(DISTINCT {b}) FROM j) AND max(n) / sum(n) <= 0.5 AS ok
        FROM j GROUP BY {a}"""
    return run, query


def _association(a: str, b: str):
    def run(spark, d):
        return audits.association(line_axes(spark, d), a, b).select(
            "a_levels", "b_levels", F.round("v", 6).alias("v"))

    query = f"""
        WITH j AS (SELECT {a}, {b}, count(*) AS n FROM {_LINE_AXES} GROUP BY ALL),
        e AS (SELECT n, sum(n) OVER (PARTITION BY {a}) * sum(n) OVER (PARTITION BY {b}) / CAST(sum(n) OVER () AS DOUBLE) AS e, {a}, {b},
          sum(n) OVER () AS t FROM j)
        SELECT count(DISTINCT {a}) AS a_levels, count(DISTINCT {b}) AS b_levels,
          round(sqrt((sum((n - e) * (n - e) / e) + any_value(t) - sum(e)) / any_value(t)
            / (least(count(DISTINCT {a}), count(DISTINCT {b})) - 1)), 6) AS v FROM e"""
    return run, query


def _conditional(a: str, b: str, given: str):
    def run(spark, d):
        return audits.conditional_association(line_axes(spark, d), a, b, given).select(
            "n_strata", "n", F.round("statistic", 3).alias("statistic"), "df", F.round("v", 6).alias("v"))

    return run, f"""
        SELECT count(*) AS n_strata, CAST(sum(t) AS BIGINT) AS n, round(sum(t * (q - 1)), 3) AS statistic,
          CAST(sum((x - 1) * (y - 1)) AS BIGINT) AS df, round(sqrt(sum(t * (q - 1)) / nullif(sum(t * (least(x, y) - 1)), 0)), 6) AS v
        FROM (SELECT g, sum(n) AS t, sum(n::DOUBLE * n / (r * c)) AS q, count(DISTINCT a) AS x, count(DISTINCT b) AS y FROM (
          SELECT *, sum(n) OVER (PARTITION BY g, a) AS r, sum(n) OVER (PARTITION BY g, b) AS c FROM (
            SELECT {given} AS g, {a} AS a, {b} AS b, count(*) AS n FROM {_LINE_AXES} WHERE {given} IS NOT NULL AND {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL)) GROUP BY g)"""


QUERIES = {
    "factor_grid": (data_factor_grid, _DATA_GRID),
    "recipe_usage": (recipe_usage, sql(_RECIPE_USAGE, "order_truth")),
    "candidate_grid": (candidate_grid, sql(_CANDIDATES, "samples")),
    "omitted_candidates": (omitted, sql(_OMITTED, "samples")),
    "recovered_recipe": (recovered, sql(_RECOVERED, "order_truth")),
    "label_metrics": (numeric_labels, sql(_NUMERIC, "order_truth")),
    "axis_filter": (
        lambda s, d: design.with_levels(carrier(s, d, "order_truth"), weight="bold", modifier="italic").select(
            "task_no", "kerning", "line_height", "width"),
        sql("SELECT task_no, kerning, line_height, width FROM order_truth WHERE weight = 'bold' AND modifier = 'italic'", "order_truth"),
    ),
    "class_distribution": (
        lambda s, d: audits.class_distribution(carrier(s, d, "samples"), _DIMS), sql(_DISTRIBUTION, "samples")),
    "axis_balance": (lambda s, d: audits.balance(line_axes(s, d), _LINE_DIMS), _BALANCE),
    "level_coverage": (coverage, sql(_COVERAGE, "samples")),
    "level_coverage_gaps": (coverage_gaps, sql(_COVERAGE_GAPS, "samples")),
    "contingency": (
        lambda s, d: audits.contingency(line_axes(s, d), "lane", "planted"),
        f"SELECT lane, planted, count(*) AS n FROM {_LINE_AXES} GROUP BY ALL"),
    "shortcut_audit_planted": _shortcut("lane", "planted"),
    "shortcut_audit_flag_status": _shortcut("flag", "status"),
    "association_planted": _association("lane", "planted"),
    "association_within_flag": _conditional("lane", "planted", "flag"),
    "association_within_lane": _conditional("flag", "planted", "lane"),
    "association_flag_lane": _association("flag", "lane"),
    "supported_faces": (
        lambda s, d: design.supported_faces(carrier(s, d, "samples"), ["font", "weight", "modifier"]),
        sql("SELECT font, weight, modifier, count(*) AS n, count(DISTINCT kerning) AS n_levels FROM samples"
            " GROUP BY font, weight, modifier", "samples")),
}
