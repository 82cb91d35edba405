"""Engine-shaped inputs derived row by row from the driver tables.

Each carrier is a narrow projection of one table, written once as SQL that both Spark and the
oracle read (only array indexing and JSON access differ), so inputs are equal by construction and
everything downstream is computed independently on each side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import CATEGORIES, LEVELS, MODIFIERS, PACKAGE_TAGS, PROVIDERS, WEIGHTS, WIDTHS

SPARK, DUCK = "spark", "duck"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _at(values, index: str, dialect: str) -> str:
    quoted = ", ".join(f"'{v}'" for v in values)
    if dialect == SPARK:
        return f"element_at(array({quoted}), CAST(({index}) + 1 AS INT))"
    return f"([{quoted}])[({index}) + 1]"


def _div(a: str, b: int) -> str:
    return f"CAST(floor(({a}) / {b}) AS BIGINT)"


def task_id(key: str, dialect: str) -> str:
    digest = f"sha2(CAST({key} AS STRING), 256)" if dialect == SPARK else f"sha256(CAST({key} AS VARCHAR))"
    return f"'task-' || left({digest}, 24)"


def model_id(number: str) -> str:
    return f"'model-' || lpad(CAST({number} AS VARCHAR(9)), 2, '0')"


# Invented families, ten first names by five second ones, with categories in turn.
FAMILIES = tuple(
    (f"{first} {second}", CATEGORIES[(i + k) % len(CATEGORIES)])
    for k, second in enumerate(("Sans", "Text", "Display", "Mono", "One"))
    for i, first in enumerate("Alder Birch Cedar Elm Fir Hazel Linden Maple Oak Rowan".split())
)


def digits(key: str) -> str:
    """Design digits of a task number; the labels are read off them in the next step."""
    i = f"(({key}) * 7 + {_div(key, 50)}) % 60"
    return f"({key}) % 50 AS fam, {_div(i, 15)} AS w, {_div(i, 3)} % 5 AS m, ({i}) % 3 AS k"


def labels(dialect: str, font: str = "canonical") -> str:
    """Family and label columns from the digits ``fam, w, m, k``."""
    columns = {
        font: _at([f for f, _ in FAMILIES], "fam", dialect),
        "category": _at([c for _, c in FAMILIES], "fam", dialect),
        "weight": _at(WEIGHTS, "w", dialect),
        "modifier": _at(MODIFIERS, "m", dialect),
        "kerning": _at(LEVELS, "k", dialect),
        "line_height": _at(LEVELS, "(k + m) % 3", dialect),
        "width": _at(WIDTHS, f"(k + w + {_div('m', 3)}) % 3", dialect),
    }
    return ", ".join(f"{expr} AS {name}" for name, expr in columns.items())


def answers(dialect: str) -> str:
    """Label columns as a reply of kind ``defect`` states them; some kinds get one label wrong."""
    def off(kind: int) -> str:
        return f"CASE WHEN defect = {kind} THEN 1 ELSE 0 END"

    columns = {
        "said_font": _at([f for f, _ in FAMILIES], "fam", dialect),
        "said_category": _at([c for _, c in FAMILIES], "fam", dialect),
        "said_weight": _at(WEIGHTS, f"(w + {off(1)}) % 4", dialect),
        "said_modifier": _at(MODIFIERS, f"(m + {off(22)}) % 5", dialect),
        "said_kerning": _at(LEVELS, f"(k + {off(20)}) % 3", dialect),
        "said_line_height": _at(LEVELS, f"(k + m + {off(21)}) % 3", dialect),
    }
    return ", ".join(f"{expr} AS {name}" for name, expr in columns.items())


def reply_body() -> str:
    """JSON object of kind ``defect`` in 0..31 over the answers; kinds from 24 on are clean."""
    quoted = {f: f"'\"' || said_{f} || '\"'" for f in ("weight", "modifier", "kerning", "line_height")}
    font = (
        "CASE defect WHEN 11 THEN '\"Unknown Face\"' WHEN 12 THEN '\"   \"' WHEN 14 THEN '{\"a\":1}' ELSE"
        " '\"' || CASE WHEN defect = 2 THEN ' ' || upper(replace(said_font, ' ', '-')) ELSE said_font END"
        " || CASE WHEN defect = 10 THEN ' MT\"' ELSE '\"' END END"
    )
    category = (
        "CASE defect WHEN 23 THEN '\"other\"' WHEN 2 THEN '\" ' || upper(said_category) || chr(160) || '\"'"
        " ELSE '\"' || said_category || '\"' END"
    )
    weight = f"CASE defect WHEN 5 THEN '1' WHEN 13 THEN '\"heavy\"' WHEN 18 THEN 'null' ELSE {quoted['weight']} END"
    line_height = f"CASE defect WHEN 17 THEN '' ELSE ',\"line_height\":' || {quoted['line_height']} END"
    return (
        "'{' || CASE defect WHEN 3 THEN '\"note\":\"x\",' WHEN 4 THEN '\"weight\":\"bold\",' ELSE '' END"
        f" || '\"font\":' || {font} || ',\"category\":' || {category} || ',\"weight\":' || {weight}"
        f" || ',\"modifier\":' || {quoted['modifier']} || ',\"kerning\":' || {quoted['kerning']} || {line_height} || '}}'"
    )


def reply_text() -> str:
    """The body as the reply file holds it: absent, or damaged outside the object, for some kinds."""
    return (
        "CASE defect WHEN 8 THEN NULL WHEN 9 THEN '' ELSE"
        " CASE defect WHEN 15 THEN '[' WHEN 16 THEN chr(10) || ' ' ELSE '' END"
        " || CASE WHEN defect = 7 THEN left(body, 60) ELSE body END"
        " || CASE defect WHEN 6 THEN ' done' WHEN 15 THEN ']' WHEN 16 THEN chr(13) || chr(10)"
        " WHEN 19 THEN '{}' ELSE '' END END"
    )


# --- carriers: source table, then successive projections --------------------------------------

def _truth(source: str, key: str):
    def steps(dialect: str) -> list[str]:
        array = "array('', canonical || ' MT', CAST(NULL AS STRING))" if dialect == SPARK else "['', canonical || ' MT', NULL]"
        return [
            f"{key} AS task_no, {task_id(key, dialect)} AS task_id, {digits(key)}",
            f"task_no, task_id, {labels(dialect)}",
            f"*, {array} AS aliases",
        ]
    return source, steps


def _attempts(dialect: str) -> list[str]:
    """One attempt per event: 11 models, the user is the task, errors are provider errors."""
    k = "get_json_object(props, '$.k')" if dialect == SPARK else "json_extract_string(props, '$.k')"
    log = "attempt_id, ts, release, fingerprint, run_id, model_id, task_id, status, input_tokens, output_tokens"
    return [
        "event_id AS attempt_id, ts, '1.0.0' AS release,"
        " CASE WHEN ts < TIMESTAMP '2024-01-06 00:00:00' THEN 'fp-0' ELSE 'fp-1' END AS fingerprint,"
        " CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN '2024-01-01-first' ELSE '2024-01-16-second' END AS run_id,"
        f" {model_id('event_id % 11')} AS model_id, {task_id('user_id', dialect)} AS task_id,"
        " CASE WHEN event_type = 'error' THEN 'provider_error' ELSE 'success' END AS status,"
        f" CAST({k} AS BIGINT) * 10 AS input_tokens, CAST(floor(value) AS BIGINT) AS output_tokens,"
        f" {_div('event_id', 11)} % 32 AS defect, {digits('user_id')}",
        f"{log}, defect, {answers(dialect)}",
        f"{log}, defect, {reply_body()} AS body",
        f"{log}, CASE WHEN status = 'success' THEN {reply_text()} END AS reply",
    ]


def _line_replies(dialect: str) -> list[str]:
    """One reply per line item to the task that is its order."""
    return [
        f"{model_id('l_suppkey % 11')} AS model_id, {task_id('l_orderkey', dialect)} AS task_id,"
        f" (l_partkey + l_linenumber * 5) % 32 AS defect, {digits('l_orderkey')}",
        f"model_id, task_id, defect, {answers(dialect)}",
        f"model_id, task_id, defect, {reply_body()} AS body",
        f"model_id, task_id, {reply_text()} AS reply",
    ]


def _texts(dialect: str, when: str, text: str) -> str:
    """A list of the one text where the condition holds, else an empty one."""
    one, none = (f"array('{text}')", "CAST(array() AS ARRAY<STRING>)") if dialect == SPARK else (f"['{text}']", "CAST([] AS VARCHAR[])")
    return f"CASE WHEN {when} THEN {one} ELSE {none} END"


def _catalog(dialect: str) -> list[str]:
    """One catalog entry per part; rules break on the part's own attributes."""
    names = ", ".join(f"'{p}'" for p in (*PROVIDERS, "other"))
    pick = f"element_at(array({names}), CAST(p_size % 4 + 1 AS INT))" if dialect == SPARK else f"([{names}])[p_size % 4 + 1]"
    return [
        "p_partkey AS pos, CASE WHEN p_type = 'PROMO' THEN 'P ' || p_name"
        " WHEN p_type = 'LARGE' THEN replace(p_name, ' ', '-')"
        " WHEN p_size = 50 THEN '-' || replace(p_name, ' ', '_')"
        " ELSE replace(p_name, ' ', '-') || '.' || CAST(p_partkey AS VARCHAR(20)) END AS id,"
        f" {pick} AS provider,"
        " CASE WHEN p_size % 5 = 0 THEN p_name ELSE replace(p_name, ' ', '') END AS model,"
        " CASE WHEN p_size = 1 THEN '' ELSE p_name END AS display_name,"
        " CASE WHEN p_size < 4 THEN lower(p_type) || '_KEY' WHEN p_size > 47 THEN p_type || '_KEY' || chr(10)"
        " ELSE p_type || '_KEY' END AS api_key_env,"
        " CASE WHEN p_brand = 'Brand#1' THEN 'ftp://host/x' WHEN p_brand = 'Brand#2' THEN 'https://'"
        " ELSE 'https://models.example.com/' || CAST(p_size AS VARCHAR(9)) END AS source_url,"
        " CASE WHEN p_brand = 'Brand#3' THEN 'see pricing' WHEN p_size % 2 = 0 THEN 'HTTP://p.example.com?q=1' END AS pricing_source_url,"
        " CASE WHEN p_brand = 'Brand#4' THEN -p_retailprice WHEN p_brand = 'Brand#5' THEN CAST('NaN' AS DOUBLE)"
        " WHEN p_brand = 'Brand#6' THEN CAST('Infinity' AS DOUBLE) WHEN p_brand = 'Brand#7' THEN NULL ELSE p_retailprice END AS input_per_m,"
        " p_retailprice / 2 AS output_per_m,"
        " CASE WHEN p_size = 2 THEN 0 WHEN p_size = 3 THEN -1 ELSE 1024 END AS max_output_tokens,"
        " p_size <= 25 AS enabled,"
        " CASE WHEN p_brand = 'Brand#8' THEN 2 ELSE 1 END AS version,"
        " CASE WHEN p_size = 7 THEN CAST(NULL AS DATE) ELSE DATE '2026-09-01' END AS verified_at,"
        " CASE WHEN p_size = 8 THEN 'no address' WHEN p_size % 3 = 0 THEN 'https://b.example.com' END AS base_url,"
        f" {_texts(dialect, 'p_size = 9', 'extra')} AS unknown_keys, {_texts(dialect, 'p_size = 10', 'enabled')} AS bad_types,"
        " p_size <> 11 AS parsed",
    ]


def _run_catalog(dialect: str) -> list[str]:
    """The models that appear in the attempts, from nations; 11 of 25 are enabled."""
    pick = _at(PROVIDERS, "n_nationkey % 3", dialect)
    return [
        f"CAST(25 - n_nationkey AS BIGINT) AS pos, {model_id('n_nationkey')} AS id, {model_id('n_nationkey')} AS model_id,"
        f" {pick} AS provider,"
        " CASE WHEN n_nationkey % 4 = 3 THEN NULL ELSE CAST(n_nationkey AS DOUBLE) / 4 + 0.5 END AS input_per_m,"
        " CAST(n_nationkey AS DOUBLE) + 2.0 AS output_per_m, n_nationkey < 11 AS enabled",
    ]


def _url_paths(dialect: str) -> list[str]:
    return ["page_id, url, regexp_replace(url, '^https?://', '') AS path"]


def _samples(dialect: str) -> list[str]:
    """One corpus sample per document; the face comes from language, source and length."""
    cell = "(n_chars * n_chars + doc_id) % 60"
    digest = "sha2(text, 256)" if dialect == SPARK else "sha256(text)"
    rest = "doc_id, task_id, image_sha256, lang, source, text"
    return [
        f"doc_id, {task_id('doc_id', dialect)} AS task_id, {digest} AS image_sha256, lang, source, text,"
        f" ({_div('doc_id', 3)} * 3 + n_chars) % 50 AS fam, {_div(cell, 15)} AS w, {_div(cell, 3)} % 5 AS m, {cell} % 3 AS k",
        f"{rest}, {labels(dialect, 'font')}",
    ]


def _packages(dialect: str) -> list[str]:
    """One task package per customer; the market segment decides how its naming and tags go wrong."""
    def array(*items: str) -> str:
        return f"array({', '.join(items)})" if dialect == SPARK else f"[{', '.join(items)}]"

    tags = [f"'{t}'" for t in PACKAGE_TAGS]
    return [
        f"c_custkey AS task_no, {task_id('c_custkey', dialect)} AS task_id, c_mktsegment AS segment, {digits('c_custkey')}",
        f"task_no, task_id, segment, {labels(dialect)}",
        "task_no, task_id, CASE segment WHEN 'BUILDING' THEN 'font-' || lower(replace(canonical, ' ', '-')) || '-v01'"
        " WHEN 'MACHINERY' THEN replace(task_id, 'task-', 'task_') ELSE task_id END AS directory,"
        " CASE WHEN segment = 'FURNITURE' AND weight = 'bold' THEN canonical ELSE task_id END AS name,"
        f" CASE segment WHEN 'BUILDING' THEN {array(*tags, 'category', 'weight', 'width')}"
        f" WHEN 'AUTOMOBILE' THEN {array(*reversed(tags))} ELSE {array(*tags)} END AS tags,"
        " category, weight, modifier, kerning, line_height, canonical",
    ]


def _manifest(dialect: str) -> list[str]:
    """Frozen manifest of the samples; some fields were changed after packaging."""
    return [
        *_samples(dialect),
        "task_id, doc_id, CASE WHEN source = 'src7' THEN upper(font) ELSE font END AS font_name,"
        " CASE WHEN lang = 'fr' AND weight = 'thin' THEN NULL ELSE weight END AS weight,"
        " CASE WHEN modifier = 'small-caps' AND lang = 'de' THEN 'regular' ELSE modifier END AS modifier,"
        " kerning, line_height, CASE WHEN source = 'src3' THEN 'wide' ELSE width END AS width, category,"
        " CASE WHEN source = 'src1' THEN upper(image_sha256) ELSE image_sha256 END AS image_sha256",
    ]


def _releases(dialect: str) -> list[str]:
    """Release registry entries from pages: the address without its scheme as manifest path, and
    without query and fragment as package directory."""
    return [
        "CAST(page_id AS VARCHAR(20)) || '.json' AS file_name, url LIKE 'https%' AS secure,"
        " regexp_replace(url, '^https?://', '') AS path",
        "file_name, secure, CASE WHEN path LIKE '%spam%' THEN '/' || path ELSE path END AS dataset_manifest,"
        " regexp_replace(path, '[?#].*$', '') AS harbor_dataset",
    ]


CARRIERS = {
    "customer_truth": _truth("customer", "c_custkey"),
    "order_truth": _truth("orders", "o_orderkey"),
    "attempts": ("events", _attempts),
    "line_replies": ("lineitem", _line_replies),
    "catalog": ("part", _catalog),
    "run_catalog": ("nation", _run_catalog),
    "url_paths": ("pages", _url_paths),
    "samples": ("documents", _samples),
    "packages": ("customer", _packages),
    "manifest": ("documents", _manifest),
    "releases": ("pages", _releases),
}


def _split(projection: str) -> list[str]:
    """Top-level commas only: expressions hold commas in calls, arrays and literals."""
    parts, depth, quote, start = [], 0, False, 0
    for i, ch in enumerate(projection):
        if ch == "'":
            quote = not quote
        elif not quote and ch in "([":
            depth += 1
        elif not quote and ch in ")]":
            depth -= 1
        elif ch == "," and not quote and depth == 0:
            parts.append(projection[start:i])
            start = i + 1
    return [*parts, projection[start:]]


def carrier(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, _ = CARRIERS[name]
    return project(table(spark, sf_dir, source), name)


def project(df: DataFrame, name: str) -> DataFrame:
    """The carrier's projections over any frame with the source's columns, also a stream."""
    for projection in CARRIERS[name][1](SPARK):
        df = df.selectExpr(*_split(projection))
    return df


def carrier_sql(name: str) -> str:
    source, steps = CARRIERS[name]
    sql = source
    for projection in steps(DUCK):
        sql = f"(SELECT {projection} FROM {sql})"
    return sql[1:-1]
