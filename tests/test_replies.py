"""Reply vectors: strict, lenient and the single JSON checks."""

import json

import pytest
from pyspark.sql import functions as F

from evalspark.functions import json_text
from evalspark.operators import replies
from evalspark.schemas import REPLY_FIELDS

G = json.dumps({
    "font": "Arial", "category": "serif", "weight": "bold", "modifier": "italic",
    "kerning": "tight", "line_height": "loose",
})

BS = chr(92)


def with_font(token):
    return G.replace('"Arial"', token)


STRICT = [
    (G, True), (G + " t", False), (G + "} {", False), (G + "] [", False), (G + ", " + G, False),
    (G + " " + G, False), ("", False), ("null", False), ("[1]", False), (chr(0xFEFF) + G, False),
    ("\n" + G + "\r\n", True), (with_font("1"), False), (with_font("NaN"), False),
    (with_font('{"a":1,"a":2}'), False), (with_font('"' + "A" * 200_000 + '"'), True),
    (G[:-1] + ',"font":"B"}', False), (with_font('"A\tb"'), False), (G + "//c", False),
    (with_font("'Arial'"), False), (G[:-1] + ",}", False),
    # values
    (G.replace('"serif"', '" Serif "'), True), (G.replace('"serif"', '" SERIF "'), True),
    (G.replace('"bold"', '"heavy"'), False), (with_font('"   "'), False), (with_font('"' + chr(0x3000) + '"'), False),
    (G[:-1] + ',"x":"y"}', False), (G.replace('"font": "Arial", ', ""), False), (with_font("null"), False),
    # grammar corners; BS is a backslash
    (with_font('"A' + BS + '"' + BS + BS + BS + '/' + BS + 'b"'), True), (with_font('"' + BS + 'x41"'), False),
    (with_font('"' + BS + 'u00g1"'), False), (with_font('"' + BS + 'ud83d' + BS + 'ude00"'), True),
    (with_font('"' + BS + 'u0041"'), True), (with_font('"' + BS + 'u2028"'), False),
    (G.replace('"font"', '"' + BS + 'u0066ont"'), True), (with_font('"' + chr(0x1F600) + '"'), True),
    (G.replace("{", "{ " + chr(9) + chr(13) + chr(10)).replace(":", " : ").replace(",", " ,"), True), (G[1:], False),
    (G[:-1], False), (with_font('"}"'), True), (with_font('"' + chr(0x2028) + '"'), False), ("{}", False), (None, False),
    (G.replace('"font"', '"font "'), False), ("\x0b" + G, False), (with_font('"a" "b"'), False),
]


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "i int, reply string").repartition(4)


def test_strict_vectors(spark):
    df = replies.with_strict_reply(texts(spark, [t for t, _ in STRICT]))
    got = {r.i: r.ok for r in df.select("i", F.col("answer").isNotNull().alias("ok")).collect()}
    assert [(i, STRICT[i][0]) for i in range(len(STRICT)) if got[i] != STRICT[i][1]] == []


def duck_strict(values):
    """Validity of each text by the SQL of the oracle, which knows nothing of the Spark expressions. A comma
    before a closing bracket, which DuckDB lets pass, counts as an error."""
    import re

    import duckdb

    from evalspark.plans.oracle import strict_parse

    con = duckdb.connect()
    con.execute("CREATE TABLE cases (i INTEGER, reply VARCHAR)")
    con.executemany("INSERT INTO cases VALUES (?, ?)", [[i, t] for i, t in enumerate(values)])
    rows = con.sql(f"SELECT i, ok, reply FROM ({strict_parse('cases')})").fetchall()
    bare = re.compile(r'"(?:[^"\\\\]|\\\\.)*"')
    return {i: ok and not re.search(r",\s*[}\]]", bare.sub('""', t)) for i, ok, t in rows}


def test_strict_vectors_in_sql():
    got = duck_strict([t for t, _ in STRICT])
    assert [t for i, (t, ok) in enumerate(STRICT) if got[i] != ok] == []


def test_strict_random_edits_agree_with_sql(spark):
    """Brute force: every text one or two edits away from a valid reply, at random places."""
    import random

    rng = random.Random(7)
    pieces = ['"', "{", "}", "[", "]", ",", ":", " ", "\\", "\n", "a", "1", "null", "\t", " ", '"font":"x",', "\\u0020", "'"]
    cases = []
    for _ in range(3000):
        t = G
        for _ in range(rng.choice([1, 1, 2])):
            at = rng.randrange(len(t) + 1)
            t = t[:at] + rng.choice(pieces) + t[at + rng.choice([0, 0, 1]):]
        cases.append(t)
    df = replies.with_strict_reply(texts(spark, cases))
    got = {r.i: r.ok for r in df.select("i", F.col("answer").isNotNull().alias("ok")).collect()}
    want = duck_strict(cases)
    assert [c for i, c in enumerate(cases) if got[i] != want[i]] == []


ALL = {"font": "Arial", "category": "serif", "weight": "bold", "modifier": "italic", "kerning": "tight", "line_height": "loose"}
NONE = dict.fromkeys(REPLY_FIELDS)
LENIENT = [
    (G, ALL), ("\n" + G + "\r\n", ALL), *[(t, NONE) for t in (
        G + " t", G + "} {", G + "] [", G + ", " + G, "", "null", "[1]", "[]", '"str"', "3", chr(0xFEFF) + G,
        with_font('"A\tb"'), '{"font":"A",}', "{}", '{"FONT":"A"}', with_font("'Arial'"), with_font("01"))],
    (G + ',"w":' + G, NONE), ("[" + G + "]", NONE), (None, NONE),
    *[(with_font(t), {**ALL, "font": None}) for t in ("1", "NaN", "Infinity", "-Infinity", "null", "[1]", "true")],
    (G[:-1] + ',"font":"B"}', {**ALL, "font": "B"}), (G[:-1] + ',"font":3}', {**ALL, "font": None}),
    (with_font("3")[:-1] + ',"font":"B"}', {**ALL, "font": "B"}),
    (G[:-1] + ',"x":{"a":[1,2]}}', ALL), (G[:-1] + ',"x":{"a":1,"a":2}}', ALL), (G[:-1] + ',"x":"y"}', ALL),
    ('{"font":"A"}', {**NONE, "font": "A"}), ('{"font":"A","category":null,"weight":[1]}', {**NONE, "font": "A"}),
    (with_font('{"a":1,"a":2}'), {**ALL, "font": None}), (with_font('[{"a":1,"a":2},3]'), {**ALL, "font": None}),
    (with_font('"' + "A" * 200_000 + '"')[:-1] + ',"n":1}', {**ALL, "font": "A" * 200_000}),
]


def test_lenient_vectors(spark):
    df = replies.with_lenient_reply(texts(spark, [t for t, _ in LENIENT]))
    rows = {r.i: r for r in df.select("i", *[F.col(f"answer.{f}").alias(f) for f in REPLY_FIELDS]).collect()}
    wrong = [(i, str(LENIENT[i][0])[:80]) for i in range(len(LENIENT))
             if {f: rows[i][f] for f in REPLY_FIELDS} != LENIENT[i][1]]
    assert wrong == []


def test_single_checks(spark):
    cases = {
        "G": (G, True, True, True), "trailing": (G + " x", False, False, False), "number": (with_font("1"), True, True, False),
        "repeat": (G[:-1] + ',"font":"B"}', True, False, False), "deep": (with_font('{"a":{"b":1,"b":2}}'), True, False, False),
        "array": ("[1, 2]", True, True, False), "scalar": ("3", True, True, False), "nan": ("NaN", True, False, False),
        "two": ("1, 2", False, False, False), "closer": ("1} {", False, False, False), "empty": ("", False, False, False),
        "extra": (G[:-1] + ',"x":"y"}', True, True, False),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "k string, t string")
    t = F.col("t")
    rows = df.select("k", json_text.json_single(t), json_text.json_unique_keys(t), json_text.json_signature(t, REPLY_FIELDS)).collect()
    assert {r[0]: tuple(r)[1:] for r in rows} == {k: v[1:] for k, v in cases.items()}


def test_long_texts_do_not_exhaust_the_stack(spark):
    """Many escapes in one string, many members, deep nesting: whole texts, no recursion limits hit."""
    cases = [
        (with_font('"' + (BS + '"') * 150_000 + 'a"'), True),
        (with_font('"' + (BS + "u0041") * 100_000 + '"'), True),
        (with_font('"' + (BS + '"') * 150_000), False),
        (G[:-1] + "".join(f',"k{i}":"v"' for i in range(30_000)) + "}", False),
        (with_font("[" * 900 + "]" * 900), False),
    ]
    df = replies.with_strict_reply(texts(spark, [t for t, _ in cases]))
    assert {r.i: r.answer is not None for r in df.select("i", "answer").collect()} == {i: ok for i, (_, ok) in enumerate(cases)}
    lax = replies.with_lenient_reply(texts(spark, [t for t, _ in cases]))
    got = {r.i: r.weight for r in lax.select("i", "answer.weight").collect()}
    assert got == {0: "bold", 1: "bold", 2: None, 3: "bold", 4: "bold"}


def test_no_parser_limit_drops_a_valid_reply(spark):
    """On both sides of 20,000,000 characters in a string and of 1,000 levels of nesting."""
    def padded(n):
        return with_font('"' + "A" * n + '"')

    def nested(n):
        return G[:-1] + ',"x":' + "[" * n + "]" * n + "}"

    cases = [padded(19_999_000), padded(21_000_000), nested(900), nested(1_100)]
    df = texts(spark, cases)
    strict = {r.i: r.ok for r in replies.with_strict_reply(df).select("i", F.col("answer").isNotNull().alias("ok")).collect()}
    assert strict == {0: True, 1: True, 2: False, 3: False}
    lax = {r.i: (r.n, r.w) for r in replies.with_lenient_reply(df).select(
        "i", F.length("answer.font").alias("n"), F.col("answer.weight").alias("w")).collect()}
    assert lax == {0: (19_999_000, "bold"), 1: (21_000_000, "bold"), 2: (5, "bold"), 3: (5, "bold")}
    t = F.col("reply")
    checks = df.select("i", json_text.json_single(t), json_text.json_unique_keys(t), json_text.json_signature(t, REPLY_FIELDS))
    assert {r[0]: tuple(r)[1:] for r in checks.collect()} == {
        0: (True, True, True), 1: (True, True, True), 2: (True, True, False), 3: (True, True, False)}


def test_strict_does_not_depend_on_the_duplicate_key_setting(spark):
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    try:
        df = replies.with_strict_reply(texts(spark, [G[:-1] + ',"font":"B"}', G]))
        assert {r.i: r.answer is not None for r in df.collect()} == {0: False, 1: True}
    finally:
        spark.conf.unset("spark.sql.variant.allowDuplicateKeys")


def test_first_existing_path_wins_even_if_invalid(spark):
    df = spark.createDataFrame(
        [("a", 0, "junk"), ("a", 1, G), ("b", 1, G), ("c", 0, None), ("c", 1, G)], "task_id string, path_rank int, text string")
    got = {r.task_id: r.reply for r in replies.first_existing(df, ["task_id"]).collect()}
    assert got == {"a": "junk", "b": G, "c": None}


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        replies.with_answer(texts(spark, [G]), "fuzzy")
