"""Runs a query in Spark and its SQL in DuckDB on the same tables and compares rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connection(folder: str):
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda r: tuple((x is None, str(x)) for x in r))


def difference(spark, query, sql: str, folder: str) -> str:
    """Empty if equal."""
    df = query(spark, folder)
    con = connection(folder)
    res = con.execute(sql)
    theirs = [d[0] for d in res.description]
    if sorted(df.columns) != sorted(theirs):
        return f"columns {sorted(df.columns)} and {sorted(theirs)}"
    a, b = rows(df.columns, [tuple(r) for r in df.collect()]), rows(theirs, res.fetchall())
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if any(not (p == q or isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 2e-6 * max(1, abs(p))) for p, q in zip(x, y, strict=True))]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else ""
