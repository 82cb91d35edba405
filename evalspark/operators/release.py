"""Release identity and protection of frozen outputs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import normalize_path, parent_dir, prefixes, strict_prefixes, valid_release_path

# Digest tree: hash prefixes of these lengths name its levels, leaf buckets first.
LEVELS = (6, 3, 0)


def _row_text(cols: Sequence[str]) -> Column:
    """Injective text of a row: each value with its length in front, NULL apart from empty."""
    parts = []
    for c in cols:
        text = F.col(c).cast("string")
        parts.append(F.when(text.isNull(), "-;").otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text, F.lit(";"))))
    return F.concat(*parts)


def row_hash(cols: Sequence[str]) -> Column:
    return F.sha2(_row_text(cols), 256)


def fingerprint(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One SHA-256 over the rows as a multiset: order, partitioning and file layout do not matter.

    Equal rows are first merged into (hash, count). A fixed-depth digest tree then hashes buckets
    named by hash prefixes. SHA-256 spreads distinct rows evenly, so a leaf bucket holds about
    n / 16**6 entries and an inner node at most 4,096 children: nothing unbounded is collected.
    """
    node = df.select(row_hash(cols).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    total = F.sum("n").alias("n_rows")
    node = node.select(F.col("h").alias("id"), F.concat_ws("x", "h", F.col("n").cast("string")).alias("d"), "n")
    for width in LEVELS:
        bucket = F.substring("id", 1, width) if width else F.lit("")
        digest = F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ","), 256)
        node = node.groupBy(bucket.alias("id")).agg(digest.alias("d"), total.alias("n"))
        node = node.select("id", F.concat_ws(":", "id", "d").alias("d"), "n")
    return node.select(F.substring_index("d", ":", -1).alias("fingerprint"), F.col("n").alias("n_rows"))


def _entries(releases: DataFrame) -> DataFrame:
    fields = F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("dataset_manifest", "harbor_dataset")
    ])
    return releases.select("file_name", F.explode(fields).alias("e")).select("file_name", "e.*")


def invalid_entries(releases: DataFrame) -> DataFrame:
    """Registry values that are not clean relative paths."""
    return _entries(releases).filter(~valid_release_path(F.col("value")))


def protected_dirs(releases: DataFrame) -> DataFrame:
    """(file_name, field, path): the manifest's directory and the package directory itself."""
    path = F.when(F.col("field") == "dataset_manifest", parent_dir(F.col("value"))).otherwise(F.col("value"))
    return _entries(releases).filter(valid_release_path(F.col("value"))).select(
        "file_name", "field", path.alias("path")
    )


def frozen_overlaps(proposed: DataFrame, protected: DataFrame) -> DataFrame:
    """Proposed paths that equal, lie under or contain a protected path.

    One row per distinct path with the number of protected paths met and the first registry entry
    among them. Proposals are compared in their shortest form (no ``.``, ``..``, empty components or
    trailing slash); what is absolute or leaves the root is no overlap but a finding of
    :func:`overlap_report`. A prefix test between two tables is a nested loop; on ancestor prefixes it
    becomes equi-joins. Both sides are deduplicated first, so a proposal yields at most one row per path
    level plus one, never a row per pair. The join is an inner one on raw shuffles, where adaptive
    execution may split a directory above a large share of all proposals. The root directory is settled
    by scalar subqueries.
    """
    paths = proposed.select("path").filter(F.col("path").isNotNull()).distinct()
    paths = paths.withColumn("norm", normalize_path(F.col("path"))).filter(F.col("norm").isNotNull())
    entry = F.min(F.struct("file_name", "field")).alias("entry")
    frozen = protected.groupBy("path").agg(entry)
    own = F.lit(1).cast("bigint").alias("k")
    at_or_under = paths.select("path", F.explode(prefixes(F.col("norm"))).alias("p")).join(
        frozen.select(F.col("path").alias("p"), "entry"), "p"
    ).select("path", own, "entry")
    holders = frozen.select(F.explode(strict_prefixes(F.col("path"))).alias("norm"), "entry").groupBy("norm").agg(
        F.count("*").alias("k"), F.min("entry").alias("entry")
    )
    contains = paths.join(holders, "norm").select("path", "k", "entry")

    root = frozen.filter(F.col("path") == "")
    root_entry = root.agg(F.min("entry")).scalar()
    under_root = paths.select("path", own, root_entry.alias("entry")).filter(F.col("entry").isNotNull())
    below = frozen.filter(F.col("path") != "")
    holds_all = paths.filter(F.col("norm") == "").select(
        "path", below.agg(F.count("*")).scalar().alias("k"), below.agg(F.min("entry")).scalar().alias("entry")
    ).filter(F.col("entry").isNotNull())

    hits = at_or_under.unionByName(contains).unionByName(under_root).unionByName(holds_all)
    return hits.groupBy("path").agg(F.sum("k").alias("n_protected"), F.min("entry").alias("entry")).select(
        "path", "n_protected", "entry.file_name", "entry.field"
    )


def overlap_report(proposed: DataFrame, releases: DataFrame) -> DataFrame:
    """Everything that stands against the proposed paths: (path, status, n_protected, file_name, field).

    ``overlap``: as :func:`frozen_overlaps`. ``outside``: a path that is absolute or leaves the root.
    ``invalid registry``: an entry that is no clean relative path, its value as path; while there is one, no
    answer about overlaps is complete. Proposals without a row are free.
    """
    none = F.lit(None)
    found = frozen_overlaps(proposed, protected_dirs(releases)).select(
        "path", F.lit("overlap").alias("status"), "n_protected", "file_name", "field")
    outside = proposed.select("path").filter(F.col("path").isNotNull() & normalize_path(F.col("path")).isNull()).distinct()
    outside = outside.select(
        "path", F.lit("outside").alias("status"), none.cast("bigint").alias("n_protected"),
        none.cast("string").alias("file_name"), none.cast("string").alias("field"))
    broken = invalid_entries(releases).select(
        F.col("value").alias("path"), F.lit("invalid registry").alias("status"), none.cast("bigint").alias("n_protected"),
        "file_name", "field")
    return found.unionByName(outside).unionByName(broken)


def release_report(checks: Mapping[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """One row per assertion: (assertion, n_checked, n_failed, ok), from what was checked and what failed."""
    rows = []
    for name, (checked, failed) in checks.items():
        row = checked.agg(F.count("*").alias("n_checked")).withColumn("n_failed", failed.agg(F.count("*")).scalar())
        rows.append(row.select(F.lit(name).alias("assertion"), "n_checked", "n_failed", (F.col("n_failed") == 0).alias("ok")))
    return reduce(DataFrame.unionByName, rows)


def finalization(cohort: DataFrame, coverage: DataFrame, rescored: DataFrame, prints: DataFrame) -> DataFrame:
    """One row to freeze a release by: models, tasks all of them answered, finished and expected responses
    (models times tasks), stored grades that a fresh grading contradicts, and the fingerprint of the dataset."""
    models = coverage.agg(
        F.count("*").alias("n_models"), F.sum("finished").alias("n_finished"), F.sum("total").alias("n_expected"))
    out = models.withColumns({
        "n_cohort": cohort.agg(F.count("*")).scalar(), "n_rescored": rescored.agg(F.count("*")).scalar(),
        "fingerprint": prints.select("fingerprint").scalar(),
    })
    complete = (F.col("n_finished") == F.col("n_expected")) & (F.col("n_rescored") == 0)
    return out.withColumn("complete", complete)
