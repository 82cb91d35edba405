r"""JSON checks on raw text.

Spark's parsers stop at the end of the first value, so ``{...} junk`` parses. Two devices close
that gap without a Python UDF:

* **Flat grammar.** A reply that can pass is one object whose members are all string-valued, which
  is a regular language. One possessive regex (no backtracking, no recursion, any length) settles
  whole-document validity, and the typed parser then only has to fetch fields.
* **Trailing witness.** For any other JSON the text is wrapped as ``{"w":<text>,"<digest>":null}``
  where the digest is the text's own SHA-256. The wrapped keys come out as exactly ``[w, digest]``
  only if the parser consumed the text as a single value: text that closes the wrapper early or
  adds members yields other keys, and no text can contain its own digest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_WS = r"[ \t\n\r]*+"
_PLAIN = r'[^"\\\x00-\x1F]*+'
_STRING = rf'"{_PLAIN}(?:\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{{4}}){_PLAIN})*+"'
_MEMBER = rf"{_WS}{_STRING}{_WS}:{_WS}{_STRING}{_WS}"

# JSON as Python's parser accepts it: NaN and infinities are numbers, single quotes are not strings.
# The parser's limits on text length, nesting and digits are lifted: no valid document may depend on them.
_NO_LIMIT = str(2**31 - 1)
JSON_OPTIONS = {
    "allowSingleQuotes": "false", "allowNonNumericNumbers": "true",
    "maxStringLen": _NO_LIMIT, "maxNestingDepth": _NO_LIMIT, "maxNumLen": _NO_LIMIT,
}


def _flat_object(members: str) -> str:
    return rf"\A{_WS}\{{{members}\}}{_WS}\z"


def flat_string_object(text: Column, n_members: int | None = None) -> Column:
    """Exactly one object, every member a string; with ``n_members``, exactly that many (> 0)."""
    if n_members is None:
        members = rf"(?:{_MEMBER}(?:,{_MEMBER})*+|{_WS})"
    else:
        members = rf"{_MEMBER}(?:,{_MEMBER}){{{n_members - 1}}}"
    return F.coalesce(text.rlike(_flat_object(members)), F.lit(False))


def string_fields(text: Column, fields: Sequence[str]) -> Column:
    """Struct of the named members read as strings; only sound after :func:`flat_string_object`."""
    return F.from_json(text, ",".join(f"`{f}` string" for f in fields), JSON_OPTIONS)


def wrapped(text: Column, value_type: str) -> Column:
    """The text parsed behind its witness, as a map; see :func:`consumed`."""
    witness = F.concat(F.lit('{"w":'), text, F.lit(',"'), F.sha2(text, 256), F.lit('":null}'))
    return F.from_json(witness, f"map<string,{value_type}>", JSON_OPTIONS)


def consumed(parsed: Column, text: Column) -> Column:
    """The wrapped parse saw exactly one value."""
    expected = F.array(F.lit("w"), F.sha2(text, 256))
    return F.coalesce(F.map_keys(parsed) == expected, F.lit(False))


def json_single(text: Column) -> Column:
    """The text is exactly one JSON value with nothing but whitespace around it.

    Reading the value as text stops at 1,000 levels of nesting; reading it as a variant does not, but cannot
    hold repeated keys in nested objects. Either will do.
    """
    return consumed(wrapped(text, "string"), text) | consumed(wrapped(text, "variant"), text)


def variant_fields(fields: Sequence[str]) -> str:
    """Value type for :func:`wrapped` that reads the named members of an object as variants.

    The last duplicate wins and other members are skipped. A member that cannot be held as a variant
    (duplicate keys inside a nested object) is NULL and leaves the others alone.
    """
    return "struct<" + ",".join(f"`{f}`: variant" for f in fields) + ">"


def _variant(text: Column) -> Column:
    """The text as a variant, NULL where it is none; NaN and infinities are none."""
    return F.from_json(text, "variant", {**JSON_OPTIONS, "allowNonNumericNumbers": "false"})


def json_unique_keys(text: Column) -> Column:
    """No object at any depth repeats a key. False for text that is not one JSON value.

    Nested repeats make the variant parser give NULL (the session default of
    ``spark.sql.variant.allowDuplicateKeys``); top-level ones are counted whatever the setting.
    """
    top = F.json_object_keys(text)
    unique_top = F.coalesce(F.size(top) == F.size(F.array_distinct(top)), F.lit(True))
    return json_single(text) & _variant(text).isNotNull() & unique_top


def json_signature(text: Column, fields: Sequence[str]) -> Column:
    """The text is one object with exactly these members, all strings."""
    shape = "OBJECT<" + ", ".join(f"{f}: STRING" for f in sorted(fields)) + ">"
    return json_single(text) & F.coalesce(F.schema_of_variant(_variant(text)) == shape, F.lit(False))


def variant_string(value: Column) -> Column:
    """The variant's content where it is a string, else NULL (numbers are not turned into text)."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))
