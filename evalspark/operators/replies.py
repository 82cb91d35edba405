"""Reply text to six answer fields, strictly or leniently, and which reply file counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json_text import (
    consumed, flat_string_object, string_fields, variant_fields, variant_string, wrapped,
)
from ..functions.text import in_domain, not_blank
from ..schemas import REPLY_DOMAINS, REPLY_FIELDS

STRICT, LENIENT = "strict", "lenient"


def _fields_valid(fields: Column) -> Column:
    """Every field present, the font not blank, each closed label in its domain."""
    present = F.lit(True)
    for name in REPLY_FIELDS:
        present = present & fields[name].isNotNull()
    ok = present & not_blank(fields["font"])
    for name, allowed in REPLY_DOMAINS.items():
        ok = ok & in_domain(fields[name], allowed)
    return ok


def with_strict_reply(df: DataFrame, text: str = "reply", into: str = "answer") -> DataFrame:
    """All-or-nothing reading: NULL unless the text is one object of six distinct string members
    with valid values.

    Six members by the grammar and six non-NULL fields together mean the key set is exact and
    nothing repeats. The parse is projected once, so later checks share it.
    """
    flat = flat_string_object(F.col(text), len(REPLY_FIELDS))
    parsed = df.withColumn(into, F.when(flat, string_fields(F.col(text), REPLY_FIELDS)))
    return parsed.withColumn(into, F.when(_fields_valid(F.col(into)), F.col(into)))


def with_lenient_reply(df: DataFrame, text: str = "reply", into: str = "answer") -> DataFrame:
    """Field-by-field reading: last duplicate wins, extra members are ignored, a non-string value
    loses only its own field; NULL when the text is not one JSON object.

    Well-behaved replies take the cheap typed parse, the rest the variant parse. The steps are
    separate projections so that neither the regex nor a parse runs twice for a row.
    """
    raw = F.col(text)
    spec = variant_fields(REPLY_FIELDS)
    steps = df.withColumn("__flat", flat_string_object(raw))
    steps = steps.withColumn("__map", F.when(~F.col("__flat"), wrapped(raw, spec)))
    steps = steps.withColumn("__obj", F.when(consumed(F.col("__map"), raw), F.element_at(F.map_values("__map"), 1)))
    slow = F.struct(*[variant_string(F.col("__obj")[f]).alias(f) for f in REPLY_FIELDS])
    fields = F.when(F.col("__flat"), string_fields(raw, REPLY_FIELDS)).when(F.col("__obj").isNotNull(), slow)
    return steps.withColumn(into, fields).drop("__flat", "__map", "__obj")


def with_answer(df: DataFrame, mode: str = STRICT, text: str = "reply", into: str = "answer") -> DataFrame:
    if mode == STRICT:
        return with_strict_reply(df, text, into)
    if mode == LENIENT:
        return with_lenient_reply(df, text, into)
    raise ValueError(f"unknown reply mode {mode!r}")


def reply_status(text: Column, answer: Column) -> Column:
    """``missing``, ``invalid`` or ``valid``; all but the last grade 0 of 6."""
    return F.when(text.isNull(), "missing").when(answer.isNull(), "invalid").otherwise("valid")


def status_census(replies: DataFrame, by: list[str], mode: str = STRICT) -> DataFrame:
    """Replies per status within each group."""
    read = with_answer(replies.select(*by, "reply"), mode)
    return read.groupBy(*by, reply_status(F.col("reply"), F.col("answer")).alias("status")).agg(
        F.count("*").alias("n")
    )


def first_existing(replies: DataFrame, keys: list[str], rank: str = "path_rank", text: str = "text") -> DataFrame:
    """The reply at the first existing candidate path, valid or not; there is no second try.

    ``min_by`` combines map-side, so a task with very many files does not meet in one place. The
    text travels in a struct, which keeps an unreadable (NULL) first file the winner.
    """
    winner = F.min_by(F.struct(F.col(text).alias("reply")), F.col(rank))
    return replies.groupBy(*keys).agg(winner.alias("w")).select(*keys, F.col("w.reply").alias("reply"))
