"""Rows of a Spark query and of its SQL, as comparable lists."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool) or isinstance(value, str):
        return value
    try:
        return round(float(value), 6) + 0.0
    except (TypeError, ValueError):
        return str(value)


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in data), key=repr)


def difference(spark, sf_dir: str, query, sql: str) -> str:
    """Empty if both give the same columns and rows."""
    df = query(spark, sf_dir)
    con = connect(sf_dir)
    there = con.sql(sql)
    if sorted(df.columns) != sorted(there.columns):
        return f"columns {sorted(df.columns)} and {sorted(there.columns)}"
    a, b = rows(df.columns, [tuple(r) for r in df.collect()]), rows(there.columns, there.fetchall())
    if a == b:
        return ""
    odd = [(x, y) for x, y in zip(a, b) if x != y][:3]
    return f"{len(a)} and {len(b)} rows; {odd}"
