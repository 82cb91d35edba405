"""Reports that join the results of other registered queries."""

from __future__ import annotations

from ..operators import release
from . import audit_queries, run_queries, score_queries
from .carriers import table

# Query of the rows that break an assertion, with the table whose rows it checks.
ASSERTIONS = {
    "naming_violations": "customer", "tag_violations": "customer", "line_count_violations": "documents",
    "field_mismatches": "documents", "key_diff": "documents", "invalid_release_entries": "pages",
    "key_violations": "lineitem",
}
PARTS = {
    "cohort": score_queries.QUERIES["shared_cohort"], "coverage": run_queries.QUERIES["coverage"],
    "rescored": score_queries.QUERIES["rescore_diff"], "prints": audit_queries.QUERIES["dataset_fingerprint"],
}


def report(spark, d):
    return release.release_report({
        name: (table(spark, d, source), audit_queries.QUERIES[name][0](spark, d)) for name, source in ASSERTIONS.items()})


def final(spark, d):
    return release.finalization(**{part: run(spark, d) for part, (run, _) in PARTS.items()})


_REPORT = " UNION ALL ".join(
    f"SELECT '{name}' AS assertion, (SELECT count(*) FROM {source}) AS n_checked,"
    f" (SELECT count(*) FROM ({audit_queries.QUERIES[name][1]})) AS n_failed,"
    f" (SELECT count(*) FROM ({audit_queries.QUERIES[name][1]})) = 0 AS ok"
    for name, source in ASSERTIONS.items())
_FINAL = f"""
    SELECT *, n_finished = n_expected AND n_rescored = 0 AS complete FROM (
      SELECT count(*) AS n_models, CAST(sum(finished) AS BIGINT) AS n_finished, CAST(sum(total) AS BIGINT) AS n_expected,
        (SELECT count(*) FROM ({PARTS['cohort'][1]})) AS n_cohort, (SELECT count(*) FROM ({PARTS['rescored'][1]})) AS n_rescored,
        (SELECT fingerprint FROM ({PARTS['prints'][1]})) AS fingerprint
      FROM ({PARTS['coverage'][1]}))"""

QUERIES = {"release_report": (report, _REPORT), "finalization": (final, _FINAL)}
