"""The balanced factorial design: recipes, candidate grid, and labels recovered from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import level_at, lookup
from ..schemas import (
    FONT_SIZE_PX, KERNING_EM, LEVELS, LINE_HEIGHT_RATIO, MODIFIERS, WEIGHT_CSS, WEIGHTS, WIDTHS,
)

N_RECIPES = len(WEIGHTS) * len(MODIFIERS) * len(LEVELS)
RECIPE_KEYS = ("weight", "modifier", "kerning")


def recipe_columns(index: Column) -> list[Column]:
    """The design cell at a zero-based index.

    Index digits are (weight, modifier, repeat). Line height is the repeat shifted by the modifier,
    width the repeat shifted by the weight and by half-way through the modifiers, so that neither
    kerning nor width predicts line height.
    """
    w = F.floor(index / (len(MODIFIERS) * len(LEVELS)))
    m = F.floor(index / len(LEVELS)) % len(MODIFIERS)
    k = index % len(LEVELS)
    return [
        (index + 1).cast("int").alias("variant_index"),
        level_at(WEIGHTS, w).alias("weight"),
        level_at(MODIFIERS, m).alias("modifier"),
        level_at(LEVELS, k).alias("kerning"),
        level_at(LEVELS, (k + m) % len(LEVELS)).alias("line_height"),
        level_at(WIDTHS, (k + w + F.floor(m / 3)) % len(WIDTHS)).alias("width"),
    ]


def recipes(spark: SparkSession) -> DataFrame:
    """All cells in variant order. Sixty rows, whatever the corpus size."""
    return spark.range(N_RECIPES).select(*recipe_columns(F.col("id"))).orderBy("variant_index")


def factor_grid(df: DataFrame, axes: list[str], most: int = 1000) -> DataFrame:
    """Every combination of the levels that occur on each axis.

    Levels are collected per axis in one aggregate and the product is unfolded by successive explodes
    rather than by cross joins. Axes are closed domains: more than `most` levels on one is an error, found
    before anything is collected.
    """
    counts = df.agg(*[F.count_distinct(a).alias(a) for a in axes]).first()
    for a in axes:
        if counts[a] > most:
            raise ValueError(f"axis {a} has {counts[a]} levels; a grid takes {most} at most")
    grid = df.agg(*[F.array_sort(F.collect_set(a)).alias(a) for a in axes])
    for axis in axes:
        grid = grid.withColumn(axis, F.explode(axis))
    return grid


def candidate_grid(families: DataFrame) -> DataFrame:
    """Each family with each recipe. Generates from the family rows, so it stays partitioned."""
    index = F.explode(F.sequence(F.lit(0), F.lit(N_RECIPES - 1))).alias("__i")
    return families.select("*", index).select(*families.columns, *recipe_columns(F.col("__i")))


def omitted_candidates(grid: DataFrame, accepted: DataFrame, keys: list[str]) -> DataFrame:
    """Grid cells without an accepted sample. Accepted keys are combined before the anti join."""
    return grid.join(accepted.select(*keys).distinct(), keys, "left_anti")


def with_recipe(tasks: DataFrame) -> DataFrame:
    """Variant index, and the width and line height the design implies, from the three shown labels.

    A task whose labels are outside the design stays, with NULL. The other side is the fixed sixty-row
    recipe table, so broadcasting it is always safe.
    """
    side = recipes(tasks.sparkSession).select(
        *RECIPE_KEYS, "variant_index", "width", F.col("line_height").alias("design_line_height")
    )
    return tasks.join(F.broadcast(side), list(RECIPE_KEYS), "left")


def with_levels(df: DataFrame, **levels: str) -> DataFrame:
    """Rows on the given axis values; plain equality filters that reach the scan."""
    for axis, value in levels.items():
        df = df.filter(F.col(axis) == value)
    return df


def supported_faces(samples: DataFrame, face: list[str], axis: str = "kerning") -> DataFrame:
    """Each distinct face with its row count and how many levels of the axis it carries."""
    per_level = samples.groupBy(*face, axis).agg(F.count("*").alias("n"))
    return per_level.groupBy(*face).agg(
        F.sum("n").alias("n"), F.count(axis).alias("n_levels")
    )


def label_metrics(df: DataFrame) -> DataFrame:
    """Adds the numeric meaning of the weight, kerning and line-height labels."""
    return df.withColumns({
        "weight_css": lookup(WEIGHT_CSS, F.col("weight")),
        "kerning_em": lookup(KERNING_EM, F.col("kerning")),
        "line_height_px": F.round(lookup(LINE_HEIGHT_RATIO, F.col("line_height")) * FONT_SIZE_PX, 6),
    })
