"""Design balance, label leakage, and reconciliation of packages with their manifest.

Every check returns rows (the violations or the table behind them); an empty result means clean.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_unicode
from ..schemas import PACKAGE_TAGS


# --- distributions and design balance -------------------------------------------------------

def class_distribution(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows per (dim, level). Identical label tuples are merged before they are spread over dims."""
    tuples = df.groupBy(*cols).agg(F.count("*").alias("n"))
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("dim"), F.col(c).cast("string").alias("level")) for c in cols
    ]))
    return tuples.select(pairs.alias("p"), "n").groupBy("p.dim", "p.level").agg(F.sum("n").alias("n"))


def balance(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Smallest and largest level of each dim, and whether they are equal."""
    return class_distribution(df, cols).groupBy("dim").agg(
        F.count("*").alias("n_levels"), F.min("n").alias("min_n"), F.max("n").alias("max_n")
    ).withColumn("balanced", F.col("min_n") == F.col("max_n"))


def level_coverage(df: DataFrame, by: Sequence[str], axes: Sequence[str]) -> DataFrame:
    """Rows and distinct levels per axis in each group; counts distinct on the cells, not the rows."""
    cells = df.groupBy(*by, *axes).agg(F.count("*").alias("n"))
    levels = [F.count_distinct(a).alias(f"{a}_levels") for a in axes]
    return cells.groupBy(*by).agg(F.sum("n").alias("n"), *levels)


def coverage_violations(df: DataFrame, by: Sequence[str], axes: Sequence[str], k: int) -> DataFrame:
    """Groups that lack a level on some axis or whose size is not ``k``."""
    bad = F.col("n") != k
    for axis in axes:
        bad = bad | (F.col(f"{axis}_levels") != k)
    return level_coverage(df, by, axes).filter(bad)


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Joint counts of two axes."""
    return df.groupBy(a, b).agg(F.count("*").alias("n"))


def shortcut_audit(df: DataFrame, a: str, b: str, limit: float = 0.5) -> DataFrame:
    """How far each value of ``a`` predicts ``b``.

    ``ok`` holds when every level of ``b`` occurs with the value and none has more than ``limit``
    of its rows. Works on the joint counts only.
    """
    joint = contingency(df, a, b)
    per_value = joint.groupBy(a).agg(F.sum("n").alias("n"), F.max("n").alias("top_n"), F.count(b).alias("n_levels"))
    every = joint.agg(F.count_distinct(b)).scalar()
    share = F.col("top_n") / F.col("n")
    return per_value.withColumn("share", share).withColumn("ok", (F.col("n_levels") == every) & (share <= limit))


def association(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cramer's V of two axes, one row: (a_levels, b_levels, v).

    From joint counts n, row sums r and column sums c: chi2/N = sum(n*n / (r*c)) - 1, which needs
    no expected counts for empty cells.
    """
    joint = contingency(df, a, b).filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    rows = joint.groupBy(a).agg(F.sum("n").alias("r"))
    cols = joint.groupBy(b).agg(F.sum("n").alias("c"))
    n, r, c = (F.col(x).cast("double") for x in ("n", "r", "c"))
    total = joint.join(rows, a).join(cols, b).agg(
        F.sum(n * n / (r * c)).alias("s"),
        F.count_distinct(a).alias("a_levels"),
        F.count_distinct(b).alias("b_levels"),
    )
    spare = F.least("a_levels", "b_levels") - 1
    v = F.when(spare > 0, F.sqrt(F.greatest(F.col("s") - 1, F.lit(0.0)) / spare))
    return total.select("a_levels", "b_levels", v.alias("v"))


def conditional_association(df: DataFrame, a: str, b: str, given: str) -> DataFrame:
    """Association of two axes within the levels of a third, one row: (n_strata, n, statistic, df, v).

    The generalized Cochran-Mantel-Haenszel test needs a covariance matrix per stratum. This is its simpler relative for
    nominal axes: the sum over strata of Pearson's statistic, on the sum of their degrees of freedom, so it is about `df`
    where the axes are independent within every stratum, however much both depend on the third. `v` is Cramer's V of the
    pooled strata: the root of the sum of the strata's statistics over the sum of their greatest possible values; null
    where no stratum has two levels of both. Rows with a null in any axis are left out.

    One scan: everything follows from the joint counts of the three axes, which are as many as their levels allow.
    """
    known = F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(given).isNotNull()
    joint = df.filter(known).groupBy(F.col(given).alias("s"), F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    rows = joint.groupBy("s", "a").agg(F.sum("n").alias("r"))
    cols = joint.groupBy("s", "b").agg(F.sum("n").alias("c"))
    n, r, c = (F.col(x).cast("double") for x in ("n", "r", "c"))
    strata = joint.join(rows, ["s", "a"]).join(cols, ["s", "b"]).groupBy("s").agg(
        F.sum("n").alias("total"), F.sum(n * n / (r * c)).alias("q"), F.count_distinct("a").alias("x"), F.count_distinct("b").alias("y"))
    statistic = F.greatest(F.col("total") * (F.col("q") - 1), F.lit(0.0))
    most = F.col("total") * (F.least("x", "y") - 1)
    out = strata.agg(
        F.count("*").alias("n_strata"), F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.coalesce(F.sum(statistic), F.lit(0.0)).alias("statistic"),
        F.coalesce(F.sum((F.col("x") - 1) * (F.col("y") - 1)), F.lit(0)).alias("df"), F.sum(most).alias("most"))
    v = F.when(F.col("most") > 0, F.sqrt(F.col("statistic") / F.col("most")))
    return out.withColumn("v", v).drop("most")


# --- keys, duplicates, totals ---------------------------------------------------------------

def duplicate_groups(df: DataFrame, hash_col: str, key: str) -> DataFrame:
    """Contents that occur more than once, with their count and smallest key. An unknown hash equals none."""
    return df.filter(F.col(hash_col).isNotNull()).groupBy(hash_col).agg(F.count("*").alias("n"), F.min(key).alias("first_key")).filter("n > 1")


def key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that are not unique."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def declared_vs_actual(descriptor: DataFrame, tasks: DataFrame) -> DataFrame:
    """Declared total against the counted one; the count is a scalar subquery."""
    actual = tasks.agg(F.count("*")).scalar()
    return descriptor.select("name", F.col("total_tasks").cast("bigint").alias("declared")).withColumn(
        "actual", actual
    ).withColumn("ok", F.col("declared").eqNullSafe(F.col("actual")))


def single_valued(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Whether all rows (of each group) hold one value: min = max of its digest, constant state.

    NULL is a value of its own, not the empty text; no rows at all do not hold one value.
    """
    digest = F.coalesce(F.sha2(F.col(col).cast("string"), 256), F.lit("null"))
    stats = df.select(*by, digest.alias("d")).groupBy(*by).agg(
        F.count("*").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi")
    )
    return stats.select(*by, "n", F.coalesce(F.col("lo") == F.col("hi"), F.lit(False)).alias("single"))


# --- package against manifest ---------------------------------------------------------------

def _sides(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row counts of both tables per key: one shuffle, combined map-side, safe for repeated keys."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    both = left.select(*keys, one.alias("l"), none.alias("r")).unionByName(
        right.select(*keys, none.alias("l"), one.alias("r"))
    )
    return both.groupBy(*keys).agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right"))


def match_audit(package: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Full outer view of the keys: on which sides each occurs, and what that means.

    ``orphan`` (package only) is an error, ``unpackaged`` (manifest only) a gap, ``repeated`` a key
    packaged twice, ``matched`` fine.
    """
    state = (
        F.when(F.col("n_right") == 0, "orphan")
        .when(F.col("n_left") == 0, "unpackaged")
        .when(F.col("n_left") > 1, "repeated")
        .otherwise("matched")
    )
    return _sides(package, manifest, [key]).withColumn("state", state)


def key_diff(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that occur on one side only; empty when the key sets are equal."""
    side = F.when(F.col("n_right") == 0, "left").otherwise("right")
    return _sides(left, right, [key]).filter((F.col("n_left") == 0) | (F.col("n_right") == 0)).select(
        key, side.alias("only_in")
    )


def field_mismatches(
    package: DataFrame, manifest: DataFrame, key: str, fields: dict[str, str], order: str | None = None
) -> DataFrame:
    """Fields whose values differ between a package row and the manifest row of its key.

    ``fields`` maps package columns to manifest columns. Where the manifest repeats a key, the last
    row by ``order`` stands for it (by default the largest field tuple, to stay deterministic), so
    no pairs multiply. Values are compared as JSON text, NULL-safely.
    """
    def as_text(df: DataFrame, c: str) -> Column:
        complex_type = df.schema[c].dataType.typeName() in ("array", "struct", "map")
        return F.to_json(F.col(c)) if complex_type else F.col(c).cast("string")

    right_fields = F.struct(*[as_text(manifest, m).alias(p) for p, m in fields.items()])
    last = F.max_by(right_fields, F.col(order)) if order else F.max(right_fields)
    right = manifest.groupBy(key).agg(last.alias("m"))
    pairs = F.array(*[
        F.struct(F.lit(p).alias("field"), as_text(package, p).alias("packaged"), F.col(f"m.{p}").alias("frozen"))
        for p in fields
    ])
    differing = F.filter(pairs, lambda x: ~x["packaged"].eqNullSafe(x["frozen"]))
    return package.join(right, key).select(key, F.explode(differing).alias("d")).select(key, "d.*")


def prompt_containment(texts: DataFrame, prompts: DataFrame, key: str, by: str | None = None) -> DataFrame:
    """Whether each text contains the stripped prompt: the one there is, or with ``by`` that of its group.

    Several different prompts (of a group) are an error, as the least of them would hide the others.
    """
    text = strip_unicode(F.col("prompt"))
    several = F.raise_error(F.lit("prompt_containment: more than one prompt")).cast("string")
    one = F.when(F.min(text).eqNullSafe(F.max(text)), F.min(text)).otherwise(several)
    if by is None:
        prompt = prompts.agg(one).scalar()
        return texts.select(key, F.coalesce(F.contains(F.col("text"), prompt), F.lit(False)).alias("contains"))
    own = prompts.groupBy(by).agg(one.alias("__prompt"))
    return texts.join(own, by, "left").select(
        key, F.coalesce(F.contains(F.col("text"), F.col("__prompt")), F.lit(False)).alias("contains"))


def missing_files(files: DataFrame, key: str, expected: Sequence[str]) -> DataFrame:
    """Expected files a task lacks. Only expected names are collected, so the set is bounded."""
    present = F.collect_set(F.when(F.col("name").isin(*expected), F.col("name")))
    lacking = F.array_except(F.array(*map(F.lit, expected)), present)
    return files.groupBy(key).agg(lacking.alias("m")).select(key, F.explode("m").alias("missing"))


# --- naming and metadata --------------------------------------------------------------------

def naming_violations(tasks: DataFrame) -> DataFrame:
    """Packages whose directory is not their task id and name, or is not opaque (``task-...``)."""
    ok = (
        (F.col("directory") == F.col("task_id"))
        & (F.col("name") == F.col("directory"))
        & F.col("directory").startswith("task-")
    )
    return tasks.filter(~F.coalesce(ok, F.lit(False)))


def tag_violations(tasks: DataFrame, allowed: Sequence[str] = PACKAGE_TAGS) -> DataFrame:
    """Packages whose tags are not exactly the constant ones, with the tags that leak something."""
    constant = F.array(*map(F.lit, allowed))
    return tasks.filter(~F.coalesce(F.col("tags") == constant, F.lit(False))).withColumn(
        "leaked", F.array_except(F.coalesce(F.col("tags"), F.array().cast("array<string>")), constant)
    )


def line_count_violations(samples: DataFrame, low: int = 2, high: int = 5) -> DataFrame:
    """Samples whose number of visible lines is outside the range; an unmeasured one is a violation."""
    return samples.filter(~F.coalesce(F.col("visible_lines").between(low, high), F.lit(False)))
