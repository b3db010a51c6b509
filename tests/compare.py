"""Rows of a query in Spark and of its SQL in DuckDB, as comparable lists."""

from __future__ import annotations

import decimal
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (decimal.Decimal, float)):
        v = float(v)
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


def compare(spark, name, query, sql, sf_dir, con) -> str:
    """Empty when both give the same rows."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    if got[0] != want[0]:
        return f"{name}: columns {got[0]} and {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{name}: {len(got[1])} and {len(want[1])} rows"
    odd = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
    return f"{name}: {len(odd)} rows differ, such as {odd[0]}" if odd else ""
