"""Comparing a query with its SQL."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else v


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for f in os.listdir(folder):
        path = f"{folder}/{f}" + ("/*.parquet" if os.path.isdir(f"{folder}/{f}") else "")
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path}'")
    return c


def assert_same(df, sql: str, c: duckdb.DuckDBPyConnection) -> int:
    names = sorted(df.columns)
    mine = sorted(repr(tuple(plain(r[n]) for n in names)) for r in df.collect())
    found = c.execute(sql)
    theirs = [d[0] for d in found.description]
    assert sorted(theirs) == names
    place = [theirs.index(n) for n in names]
    assert mine == sorted(repr(tuple(plain(r[i]) for i in place)) for r in found.fetchall())
    return len(mine)
