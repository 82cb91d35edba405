"""Order-insensitive comparison of a Spark result with its DuckDB oracle."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark"
    " labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _canon(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return f"{value:.6f}"
    return f"{type(value).__name__}:{value}"


def rows_of_spark(df):
    order = sorted(df.columns)
    return order, sorted(tuple(_canon(r[c]) for c in order) for r in df.collect())


def rows_of_duck(con, query):
    rel = con.sql(query)
    order = sorted(rel.columns)
    at = [rel.columns.index(c) for c in order]
    return order, sorted(tuple(_canon(r[i]) for i in at) for r in rel.fetchall())


def difference(df, con, query) -> str | None:
    """None if equal, else a short description."""
    s_cols, s_rows = rows_of_spark(df)
    o_cols, o_rows = rows_of_duck(con, query)
    if s_cols != o_cols:
        return f"columns {s_cols} != {o_cols}"
    if len(s_rows) != len(o_rows):
        only_s = [r for r in s_rows if r not in set(o_rows)][:2]
        only_o = [r for r in o_rows if r not in set(s_rows)][:2]
        return f"rows {len(s_rows)} != {len(o_rows)}; spark only {only_s}; oracle only {only_o}"
    for a, b in zip(s_rows, o_rows):
        if a != b:
            return f"spark {a} != oracle {b}"
    return None
