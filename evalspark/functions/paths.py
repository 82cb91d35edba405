"""Lexical path expressions: ``/``-separated, relative to the repository root (written ``''``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parent_dir(path: Column) -> Column:
    """Everything before the last slash; the root for a bare file name."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(
        F.when(path.isNotNull(), F.lit(""))
    )


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def prefixes(path: Column) -> Column:
    """The path and each of its ancestors below the root, shortest first; empty for the root."""
    parts = F.split(path, "/")
    ladder = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")
    )
    return F.when(path == "", F.array().cast("array<string>")).otherwise(ladder)


def strict_prefixes(path: Column) -> Column:
    """Ancestors below the root, without the path itself."""
    return F.filter(prefixes(path), lambda p: p != path)


def normalize_path(path: Column) -> Column:
    """The path without empty and ``.`` components and with ``..`` folded, by the text alone. NULL if it is
    absolute or leaves the root."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("out"))

    def step(state: Column, part: Column) -> Column:
        kept, up = state["kept"], part == ".."
        shorter = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.struct(
            F.when(up, shorter).otherwise(F.concat(kept, F.array(part))).alias("kept"),
            (state["out"] | (up & (F.size(kept) == 0))).alias("out"),
        )

    folded = F.aggregate(parts, start, step)
    return F.when(~path.startswith("/") & ~folded["out"], F.array_join(folded["kept"], "/"))


def valid_release_path(path: Column) -> Column:
    """Non-empty and relative, no backslash, no empty, ``.`` or ``..`` component."""
    bad_part = F.exists(F.split(path, "/"), lambda part: part.isin("", ".", ".."))
    ok = (path != "") & ~path.startswith("/") & ~path.contains("\\") & ~bad_part
    return F.coalesce(ok, F.lit(False))
