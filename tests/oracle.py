"""Compares registered queries with their SQL in DuckDB, whole rows, any order."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb
import pandas as pd

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01"))


def connection(folder: Path = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(folder.glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(value):
    if value is None or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return float(f"{value:.10g}")
    return list(map(plain, value)) if isinstance(value, (list, tuple)) else value


def rows(columns: list[str], values) -> list[str]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr([plain(v[k]) for k in order]) for v in values)


def difference(query, sql: str, spark, folder: Path = DATA) -> str:
    """'' if both give the same columns and rows."""
    df = query(spark, str(folder))
    found = connection(folder).execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = rows(df.columns, df.collect()), rows(names, found.fetchall())
    if a == b:
        return ""
    odd = [(x, y) for x, y in zip(a, b) if x != y][:3]
    return f"{len(a)} and {len(b)} rows; {odd}"
