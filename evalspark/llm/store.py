"""Written intermediates, ids that may be null, and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir
from .arrays import NO_ID


def landed(df: DataFrame, purpose: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = shared_dir(spark, f"llm-{purpose}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(name: str, columns: list[str]) -> str:
    """The name, with underscores added until no column is called so (in any case of letters)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_id(name: str) -> Column:
    """The id as the operators use it: null becomes a value below all ids."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def given_id(name: str) -> Column:
    """The id as it was given."""
    return F.when(F.col(name) != F.lit(NO_ID), F.col(name))


def keyed(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """All rows with a column `__key`, a long of each row's own in the order of ids (null first), then of texts'
    hashes. Where every id stands once it is the id; only where rows share an id, or have none, are they sorted for it."""
    if documents.groupBy(id_col).count().filter("count > 1").isEmpty():
        return documents.withColumn("__key", row_id(id_col))
    # the row's place in the input deals out copies, which have all else in common
    placed = documents.withColumn("__at", F.monotonically_increasing_id())
    order = placed.orderBy(row_id(id_col), F.xxhash64(text_col), "__at").drop("__at")
    return landed(order.withColumn("__key", F.monotonically_increasing_id()), "keyed")


def one_per_id(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows (id, text) with every id once, and the names (id, given) of these ids where they are not those given.
    Rows without an id (NO_ID) are documents of their own. Rows that share an id are one document for each of their
    texts; only where such rows exist are the texts shuffled."""
    if docs.groupBy("id").count().filter("count > 1").isEmpty():
        return docs, None
    named = docs.filter(F.col("id") != F.lit(NO_ID)).distinct()
    rows = keyed(named.union(docs.filter(F.col("id") == F.lit(NO_ID))), "id", "text")
    # where only copies shared ids, none does now, and the keys are the ids
    return rows.select(F.col("__key").alias("id"), "text"), rows.select(F.col("__key").alias("id"), F.col("id").alias("given"))


def with_given_ids(rows: DataFrame, names: DataFrame | None) -> DataFrame:
    """The rows with the ids of `one_per_id` replaced by those given (NO_ID for null)."""
    if names is None:
        return rows
    return rows.join(names, "id").withColumn("id", F.col("given")).select(*rows.columns)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (node, label), label the least node of the component.

    Alternates large-star and small-star steps on tables, until every component is a star around its least node. A
    step keeps one row per edge and takes minima with map-side combination, so a node with very many links is no hot
    spot; adaptive execution splits the join on it. Nothing is broadcast, so the driver holds no table, however small.
    """
    now = landed(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    while not _stars(now):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.hint("merge"), "a")
        small = small.select("a", F.col("m").alias("b")).union(
            small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        now = landed(small.distinct(), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label"))


def _stars(edges: DataFrame) -> bool:
    """Whether of distinct edges (a, b) with a > b every node is the `a` of one, or the `b` of some, and not both."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg((F.sum("up") + F.max("down")).alias("n")).filter("n > 1").isEmpty()
