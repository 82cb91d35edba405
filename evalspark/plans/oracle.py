"""SQL building blocks for the oracle side, written independently of the Spark operators."""

from __future__ import annotations

from ..functions.text import STRIP_CHARS
from ..schemas import REPLY_DOMAINS, REPLY_FIELDS
from .carriers import CARRIERS, carrier_sql

_CLOSED = tuple(REPLY_DOMAINS)


def in_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def strip(expr: str) -> str:
    points = " || ".join(f"chr({ord(c)})" for c in STRIP_CHARS)
    return f"trim({expr}, {points})"


def fold(expr: str) -> str:
    return f"lower({strip(expr)})"


def norm(expr: str) -> str:
    return f"regexp_replace(lower({expr}), '[^a-z0-9]', '', 'g')"


def strict_parse(source: str) -> str:
    """Source rows with the six fields, all NULL unless the reply is strictly valid."""
    keys = "[" + ", ".join(f"'{f}'" for f in sorted(REPLY_FIELDS)) + "]"
    typed = " AND ".join(f"json_type(doc, '$.{f}') = 'VARCHAR'" for f in REPLY_FIELDS)
    text = {f: f"json_extract_string(doc, '$.{f}')" for f in REPLY_FIELDS}
    domain = " AND ".join(f"{fold(text[f])} IN {in_list(v)}" for f, v in REPLY_DOMAINS.items())
    ok = f"coalesce(list_sort(json_keys(doc)) = {keys} AND {typed} AND {strip(text['font'])} <> '' AND {domain}, false)"
    fields = ", ".join(f"CASE WHEN ok THEN {text[f]} END AS f_{f}" for f in REPLY_FIELDS)
    return f"SELECT * EXCLUDE (doc), {fields} FROM (SELECT *, {ok} AS ok FROM {documents(source)})"


def documents(source: str) -> str:
    """Source rows with ``doc``: the reply where it is valid JSON, else an empty object."""
    return f"(SELECT *, CASE WHEN json_valid(reply) THEN reply ELSE '{{}}' END AS doc FROM {source})"


def lenient_parse(source: str) -> str:
    """Source rows with the six fields; the last member of a name counts, if it is a string."""
    fields = ", ".join(
        f"max(CASE WHEN j.key = '{f}' AND j.jtype = 'VARCHAR' THEN json_extract_string(j.val, '$') END) AS f_{f}"
        for f in REPLY_FIELDS
    )
    return f"""
        SELECT s.*, p.* EXCLUDE (rid) FROM (SELECT *, row_number() OVER () AS rid FROM {source}) s
        LEFT JOIN (
          SELECT rid, {fields} FROM (
            SELECT n.rid, e.key, arg_max(e.value, e.id) AS val, arg_max(e.type, e.id) AS jtype
            FROM (SELECT rid, CASE WHEN json_valid(reply) THEN reply ELSE '{{}}' END AS t
                  FROM (SELECT *, row_number() OVER () AS rid FROM {source})) n, json_each(n.t) e
            WHERE starts_with(ltrim(n.t, chr(9) || chr(10) || chr(13) || ' '), '{{')
            GROUP BY n.rid, e.key) j
          GROUP BY rid) p USING (rid)"""


def judged(parsed: str, truth: str, carry: str, kind: str = "JOIN") -> str:
    """Six passes, count, score and exactness of parsed replies against a truth carrier."""
    accepted = f"list_transform(list_filter(list_concat([t.canonical], t.aliases), lambda a: a <> ''), lambda a: {norm('a')})"
    predicted = norm("r.f_font")
    font = f"coalesce({predicted} <> '' AND list_contains({accepted}, {predicted}), false) AS font_pass"
    closed = ", ".join(f"coalesce({fold(f'r.f_{f}')} = t.{f}, false) AS {f}_pass" for f in _CLOSED)
    passes = " + ".join(f"CAST({f}_pass AS INTEGER)" for f in REPLY_FIELDS)
    labels = ", ".join(f"t.{f}" for f in _CLOSED)
    return f"""
        SELECT *, n_pass / 6.0::DOUBLE AS score, n_pass = 6 AS exact FROM (
          SELECT *, {passes} AS n_pass FROM (
            SELECT t.task_id, {carry}, t.canonical AS font, {labels}, {font}, {closed}
            FROM {truth} t {kind} {parsed} r ON t.task_id = r.task_id))"""


_FINALS = """SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ts DESC, attempt_id DESC) AS rn
    FROM {source} WHERE status = 'success') WHERE rn = 1"""

VIEWS = {
    **{name: carrier_sql(name) for name in CARRIERS},
    "successes": "SELECT * FROM attempts WHERE status = 'success'",
    "finals": _FINALS.format(keys="model_id, task_id", source="attempts"),
    "run_finals": _FINALS.format(keys="run_id, model_id, task_id", source="attempts"),
    "firsts": """SELECT * EXCLUDE (rn) FROM (
        SELECT *, row_number() OVER (PARTITION BY run_id, model_id, task_id ORDER BY ts, attempt_id) AS rn
        FROM attempts WHERE status = 'success') WHERE rn = 1""",
    "strict_firsts": strict_parse("firsts"),
    "roster": "SELECT * FROM run_catalog WHERE enabled",
    "strict_finals": strict_parse("finals"),
    "strict_successes": strict_parse("successes"),
    "lenient_successes": lenient_parse("successes"),
    "strict_lines": strict_parse("line_replies"),
    "lenient_lines": lenient_parse("line_replies"),
    "grades": judged("strict_finals", "customer_truth", "r.model_id"),
    "line_grades": judged("strict_lines", "order_truth", "r.model_id"),
    "lenient_line_grades": judged("lenient_lines", "order_truth", "r.model_id"),
}
_USES = {
    "successes": ["attempts"], "finals": ["attempts"], "run_finals": ["attempts"], "firsts": ["attempts"], "strict_firsts": ["firsts"], "roster": ["run_catalog"],
    "strict_finals": ["finals"], "strict_successes": ["successes"], "lenient_successes": ["successes"],
    "strict_lines": ["line_replies"], "lenient_lines": ["line_replies"],
    "grades": ["strict_finals", "customer_truth"], "line_grades": ["strict_lines", "order_truth"],
    "lenient_line_grades": ["lenient_lines", "order_truth"],
}


def sql(body: str, *views: str) -> str:
    """The body behind the named views and those they build on."""
    order: list[str] = []

    def add(name: str) -> None:
        for used in _USES.get(name, []):
            add(used)
        if name not in order:
            order.append(name)

    for view in views:
        add(view)
    ctes = ", ".join(f"{name} AS ({VIEWS[name]})" for name in order)
    return f"WITH {ctes} {body}" if ctes else body


SUMS = ", ".join(
    f"CAST(sum(CAST({p} AS INTEGER)) AS BIGINT) AS {n}"
    for n, p in [("exact", "exact"), *[(f, f"{f}_pass") for f in REPLY_FIELDS]]
)
ACCURACY = f"count(*) AS n, {SUMS}, CAST(sum(n_pass) AS BIGINT) AS points, round(sum(n_pass) / (6.0 * count(*)), 6) AS composite"
