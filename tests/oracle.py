"""Compares a DataFrame with the rows of a SQL text that DuckDB runs on the same tables."""

from __future__ import annotations

import math
from collections import Counter
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in Path(folder).iterdir():
        if p.name.endswith(".parquet"):
            files = f"{p}/*.parquet" if p.is_dir() else str(p)
            c.execute(f"CREATE VIEW {p.name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{files}')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, Decimal):
        return float(f"{v:.9g}")
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    return v


def rows(columns: list[str], data) -> Counter:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


def differences(df, sql: str, folder: str) -> tuple[list, list, int]:
    """Rows only in the DataFrame, rows only in SQL, and how many there are."""
    cursor = connect(folder).execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns), (sorted(names), sorted(df.columns))
    want = rows(names, cursor.fetchall())
    got = rows(df.columns, [tuple(x.asDict(True).values() if hasattr(x, "asDict") and isinstance(x, dict) else x for x in r) for r in df.collect()])
    return list((got - want).elements()), list((want - got).elements()), sum(got.values())
