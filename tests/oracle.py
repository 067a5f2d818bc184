"""Local stand-in for the driver's correctness check: run a Spark query and
its DuckDB SQL on the same parquet tables, compare row count, column names
and an order-insensitive multiset of values."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal

import duckdb

from renewlens.sources.tables import TABLES, table_path


def duck_connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    return con


def _norm(v, digits: int):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return round(v, digits) + 0.0
    if isinstance(v, Decimal):
        return round(float(v), digits) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, bool):
        return int(v)
    return v


def rows_of(columns, records, digits):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_norm(r[i], digits) for i in order) for r in records)


def compare(spark_df, con, sql: str, digits: int = 6):
    """Return (ok, message)."""
    s_cols = list(spark_df.columns)
    s_rows = [tuple(r) for r in spark_df.collect()]
    rel = con.sql(sql)
    d_cols = list(rel.columns)
    d_rows = rel.fetchall()
    if sorted(s_cols) != sorted(d_cols):
        return False, f"columns differ: spark={sorted(s_cols)} duck={sorted(d_cols)}"
    if len(s_rows) != len(d_rows):
        return False, f"row count differs: spark={len(s_rows)} duck={len(d_rows)}"
    a, b = rows_of(s_cols, s_rows, digits), rows_of(d_cols, d_rows, digits)
    if a != b:
        only_s = list((a - b).elements())[:3]
        only_d = list((b - a).elements())[:3]
        return False, f"values differ ({sum((a - b).values())} rows); spark-only={only_s} duck-only={only_d}"
    return True, f"{len(s_rows)} rows"
