"""All registered queries: name -> (Spark callable, oracle SQL or None)."""

from __future__ import annotations

from . import audit_queries, design_queries, index_queries, package_queries, report_queries, run_queries, scan_queries, score_queries, stream_queries, tree_queries

GROUPS = (score_queries, design_queries, audit_queries, run_queries, package_queries, stream_queries, report_queries, scan_queries, tree_queries, index_queries)

QUERIES = {name: pair for group in GROUPS for name, pair in group.QUERIES.items()}
