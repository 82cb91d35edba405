"""The digest tree of :func:`evalspark.operators.release.fingerprint` kept as a table, updated along changed paths only.

A tree is a folder of versions. Version 0 has all entries (row hash, key, count) and all nodes (level, id, digest, rows);
each later version has what it changed: an entry whose count became 0, or a node that vanished, stands there with 0 rows.
Of an entry or node the latest version up to the one that is read counts. A node's digest covers its children's, so the
root is the dataset's fingerprint, and two trees differ below a node only if its digests do.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .release import LEVELS, row_hash

ENTRY = "h string, key string, n bigint, p string, version int"
NODE = "level int, id string, d string, n bigint, version int"
DIGITS = 2  # leading digits of the hash that entries are partitioned by on disk, the same in all calls on a tree


def _entries(df: DataFrame, cols: Sequence[str], key: str) -> DataFrame:
    rows = df.select(row_hash(cols).alias("h"), F.col(key).cast("string").alias("key"))
    return rows.groupBy("h", "key").agg(F.count("*").alias("n"))


def _parents(children: DataFrame, width: int) -> DataFrame:
    """Nodes named by `width` digits over their children (id, d, n); a child's text names it, so children may not move."""
    name = F.substring("id", 1, width) if width else F.lit("")
    digest = F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ","), 256)
    nodes = children.groupBy(name.alias("id")).agg(digest.alias("d"), F.sum("n").alias("n"))
    return nodes.select(F.lit(width).alias("level"), "id", F.concat_ws(":", "id", "d").alias("d"), "n")


def _leaf_children(entries: DataFrame) -> DataFrame:
    """Children of leaf nodes: equal rows as one, by hash and count."""
    merged = entries.groupBy("h").agg(F.sum("n").alias("n"))
    return merged.select(F.col("h").alias("id"), F.concat_ws("x", "h", F.col("n").cast("string")).alias("d"), "n")


def _write(entries: DataFrame, path: str, version: int, digits: int) -> None:
    placed = entries.select("h", "key", "n", F.substring("h", 1, digits).alias("p"))
    placed.repartition("p").sortWithinPartitions("p", "h").write.mode("overwrite").partitionBy("p").parquet(f"{path}/entries/version={version}")


def build(df: DataFrame, cols: Sequence[str], key: str, path: str, digits: int = DIGITS) -> None:
    """Version 0 of a tree over the rows' `cols`, one of which is `key`, by which :func:`diff` names rows."""
    if key not in cols:
        raise ValueError("the key must be among the columns")
    spark = df.sparkSession
    _write(_entries(df, cols, key), path, 0, digits)
    children = _leaf_children(entries(spark, path, 0))
    for width in LEVELS:
        _parents(children, width).write.mode("overwrite").parquet(f"{path}/nodes/version=0/l={width}")
        children = nodes(spark, path, 0, width)


def _latest(rows: DataFrame, names: Sequence[str], rest: Sequence[str]) -> DataFrame:
    last = F.max_by(F.struct(*rest), "version").alias("x")
    return rows.groupBy(*names).agg(last).select(*names, "x.*").filter("n > 0")


def entries(spark: SparkSession, path: str, version: int, under: DataFrame | None = None, digits: int = DIGITS) -> DataFrame:
    """(h, key, n) of a version; of the leaves whose ids are in `under` only, if given. Only their partitions are read."""
    rows = spark.read.schema(ENTRY).parquet(f"{path}/entries").filter(F.col("version") <= version)
    if under is not None:
        leaves = under.select(F.col("id").alias("leaf"), F.substring("id", 1, digits).alias("p")).distinct()
        rows = rows.withColumn("leaf", F.substring("h", 1, LEVELS[0])).join(leaves, ["p", "leaf"], "left_semi")
    return _latest(rows, ["h", "key"], ["n"])


def nodes(spark: SparkSession, path: str, version: int, level: int, under: DataFrame | None = None) -> DataFrame:
    """(id, d, n) of one level of a version; the children of the nodes in `under` only, if given."""
    folders = [f"{path}/nodes/version={v}/l={level}" for v in range(version + 1)]
    parts = [spark.read.schema("level int, id string, d string, n bigint").parquet(f).withColumn("version", F.lit(v)) for v, f in enumerate(folders)]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    if under is not None:
        above = LEVELS[LEVELS.index(level) + 1]
        parents = under.select(F.col("id").alias("parent")).distinct()
        rows = rows.withColumn("parent", F.substring("id", 1, above)).join(parents, "parent", "left_semi")
    return _latest(rows, ["id"], ["d", "n"])


def fingerprint(spark: SparkSession, path: str, version: int) -> DataFrame:
    """(fingerprint, n_rows) of a version: one node is read."""
    return nodes(spark, path, version, LEVELS[-1]).select(F.substring_index("d", ":", -1).alias("fingerprint"), F.col("n").alias("n_rows"))


def update(
    removed: DataFrame, added: DataFrame, cols: Sequence[str], key: str, path: str, version: int, digits: int = DIGITS
) -> int:
    """Write the version after `version`: rows that go and rows that come, multisets both. Returns its number.

    Entries are read in the leaves that changed rows fall into, and nodes among the children of changed ones: work and
    what is written follow the number of changed rows. A row that goes but is not there is an error.
    """
    spark, new = added.sparkSession, version + 1
    change = _entries(added, cols, key).unionByName(_entries(removed, cols, key).withColumn("n", -F.col("n")))
    change = change.groupBy("h", "key").agg(F.sum("n").alias("n")).filter("n <> 0")
    leaves = change.select(F.substring("h", 1, LEVELS[0]).alias("id")).distinct()
    before = entries(spark, path, version, leaves, digits)
    after = before.unionByName(change).groupBy("h", "key").agg(F.sum("n").alias("n"))
    touched = after.join(change.select("h", "key"), ["h", "key"], "left_semi")
    lacking = F.when(F.col("n") < 0, F.raise_error(F.concat(F.lit("not in the tree as often: "), "key"))).otherwise(F.col("n"))
    _write(touched.select("h", "key", lacking.alias("n")), path, new, digits)
    children, changed = _leaf_children(entries(spark, path, new, leaves, digits)), leaves
    for k, width in enumerate(LEVELS):
        fresh = _parents(children, width)
        gone = changed.join(fresh.select("id"), "id", "left_anti")
        gone = gone.select(F.lit(width).alias("level"), "id", F.lit(None).cast("string").alias("d"), F.lit(0).cast("bigint").alias("n"))
        fresh.unionByName(gone).write.mode("overwrite").parquet(f"{path}/nodes/version={new}/l={width}")
        if width:
            above = LEVELS[k + 1]
            changed = changed.select(F.substring("id", 1, above).alias("id")).distinct()
            children = nodes(spark, path, new, width, changed)
    return new


def diff(spark: SparkSession, a: tuple[str, int], b: tuple[str, int], digits: int = DIGITS) -> DataFrame:
    """Keys of rows that differ between two (tree, version): (key, status, n_a, n_b), status `only a`, `only b` or, where
    both have rows of the key but not the same, `changed`; the counts are of the rows that differ.

    Walks both trees from the root: the children of nodes whose digests differ are compared, and entries are read in
    the leaves that differ at last. Equal trees end at the root.
    """
    under = None
    for level in reversed(LEVELS):
        left, right = (nodes(spark, path, version, level, under) for path, version in (a, b))
        both = left.select("id", F.col("d").alias("x")).join(right.select("id", F.col("d").alias("y")), "id", "full_outer")
        under = both.filter(~F.col("x").eqNullSafe(F.col("y"))).select("id")
    left, right = (entries(spark, path, version, under, digits) for path, version in (a, b))
    both = left.withColumnRenamed("n", "a").join(right.withColumnRenamed("n", "b"), ["h", "key"], "full_outer").na.fill(0, ["a", "b"])
    rows = both.filter("a <> b").groupBy("key").agg(
        F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("n_a"), F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("n_b"))
    status = F.when(F.col("n_b") == 0, "only a").when(F.col("n_a") == 0, "only b").otherwise("changed")
    return rows.select("key", status.alias("status"), "n_a", "n_b")
