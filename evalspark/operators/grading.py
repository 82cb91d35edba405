"""Six attribute checks per reply, the composite score and re-scoring of saved grades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_closed, norm_name, percent
from ..schemas import PASS_COLUMNS, REPLY_DOMAINS, REPLY_FIELDS
from .replies import STRICT, with_answer


def accepted_names(canonical: Column, aliases: Column) -> Column:
    """Normalized canonical name and aliases; empty and missing ones are ignored."""
    none = F.array().cast("array<string>")
    names = F.concat(F.array(canonical), F.coalesce(aliases, none))
    return F.transform(F.filter(names, lambda n: n.isNotNull() & (n != "")), norm_name)


def font_pass(predicted: Column, accepted: Column) -> Column:
    """``predicted`` is a normalized name; one that normalized to nothing never passes."""
    return F.coalesce((predicted != "") & F.array_contains(accepted, predicted), F.lit(False))


def label_pass(predicted: Column, expected: Column) -> Column:
    """``predicted`` is a folded label, ``expected`` the raw truth."""
    return F.coalesce(predicted == expected, F.lit(False))


def _answers(replies: DataFrame, mode: str) -> DataFrame:
    """Replies with the comparable form of each field: what the join shuffles instead of the text."""
    read = with_answer(replies, mode)
    folded = [norm_name(F.col("answer.font")).alias("p_font")]
    folded += [fold_closed(F.col(f"answer.{f}"), v).alias(f"p_{f}") for f, v in REPLY_DOMAINS.items()]
    carried = [c for c in replies.columns if c != "reply"]
    return read.select(*carried, *folded)


def _judged(df: DataFrame, carried: list[str]) -> DataFrame:
    passes = [font_pass(F.col("p_font"), F.col("accepted")).alias("font_pass")]
    passes += [label_pass(F.col(f"p_{f}"), F.col(f)).alias(f"{f}_pass") for f in REPLY_DOMAINS]
    labels = [F.col("canonical").alias("font"), *REPLY_DOMAINS]
    n_pass = sum((F.col(p).cast("int") for p in PASS_COLUMNS), F.lit(0))
    return (
        df.select("task_id", *carried, *labels, *passes)
        .withColumn("n_pass", n_pass)
        .withColumn("score", F.col("n_pass") / F.lit(6.0))
        .withColumn("exact", F.col("n_pass") == len(REPLY_FIELDS))
    )


def _expected(truth: DataFrame) -> DataFrame:
    """Truth as it is compared: names are normalized once per task, not once per reply."""
    accepted = accepted_names(F.col("canonical"), F.col("aliases"))
    return truth.select("task_id", "canonical", accepted.alias("accepted"), *REPLY_DOMAINS)


def grade(replies: DataFrame, truth: DataFrame, mode: str = STRICT) -> DataFrame:
    """Grade each reply against its task's truth. Replies to unknown tasks are dropped.

    Parsing runs before the join, so raw text is never shuffled. The join is an inner one on
    ``task_id``, where adaptive execution may split a task that holds a large share of the replies;
    the truth side is broadcast only if Spark finds it below its threshold.
    """
    carried = [c for c in replies.columns if c not in ("reply", "task_id")]
    joined = _answers(replies, mode).join(_expected(truth), "task_id")
    return _judged(joined, carried)


def orphan_replies(replies: DataFrame, truth: DataFrame, by: Sequence[str] = ("model_id",)) -> DataFrame:
    """How many replies per group name a task that has no truth, and how many such tasks. Grades leave these
    replies out, so this report tells whether denominators can be trusted."""
    lost = replies.select(*by, "task_id").join(truth.select("task_id").distinct(), "task_id", "left_anti")
    return lost.groupBy(*by).agg(F.count("*").alias("n_replies"), F.count_distinct("task_id").alias("n_tasks"))


def grade_all(replies: DataFrame, truth: DataFrame, mode: str = STRICT) -> DataFrame:
    """:func:`grade`, and a zero grade for every task without any reply.

    Left join semantics, done as an inner join plus an anti join: a left join could not split the
    replies of a hot task, and the anti join needs only the distinct task ids, combined map-side.
    """
    carried = [f for f in replies.schema.fields if f.name not in ("reply", "task_id")]
    answered = replies.select("task_id").distinct()
    silent = _expected(truth).join(answered, "task_id", "left_anti")
    blanks = [F.lit(None).cast(f.dataType).alias(f.name) for f in carried]
    blanks += [F.lit(None).cast("string").alias(f"p_{f}") for f in REPLY_FIELDS]
    names = [f.name for f in carried]
    return grade(replies, truth, mode).unionByName(_judged(silent.select("*", *blanks), names))


def rescore_diff(saved: DataFrame, truth: DataFrame, mode: str = STRICT) -> DataFrame:
    """Saved replies whose stored passes differ from a fresh grading.

    ``saved`` carries the reply and one ``stored_<attribute>_pass`` per attribute. NULL counts as a
    value, so a stored grade that is missing is a difference.
    """
    differs = F.lit(False)
    for name in PASS_COLUMNS:
        differs = differs | ~F.col(f"stored_{name}").eqNullSafe(F.col(name))
    return grade(saved, truth, mode).filter(differs)


def verdict_text(grades: DataFrame, label: str = "Verifier") -> DataFrame:
    """The two verdict lines per graded task."""
    word = {a: F.when(F.col(f"{a}_pass"), "PASS").otherwise("FAIL") for a in ("font", "category", "weight")}
    first = F.concat(F.lit(f"[{label}] Task: "), F.col("task_id"), F.lit(" - Score: "), percent(F.col("score")))
    second = F.concat(
        F.lit("  Font: "), word["font"], F.lit(" | Cat: "), word["category"], F.lit(" | Weight: "), word["weight"]
    )
    return grades.withColumn("verdict", F.concat(first, F.lit("\n"), second))
