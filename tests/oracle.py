"""Compare a query with its oracle SQL in DuckDB: names, counts, and values in any order."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _value(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, int):
        return float(f"{x:.9g}") if abs(x) < 1 << 30 else x
    return x


def _sorted(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return c


def difference(df, sql: str, con) -> str:
    """Empty where the frame's rows are the oracle's."""
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    want, have = _sorted(names, found.fetchall()), _sorted(df.columns, df.collect())
    if len(want) != len(have):
        return f"{len(have)} rows, oracle has {len(want)}: {have[:2]} {want[:2]}"
    return next((f"{a} is not {b}" for a, b in zip(have, want, strict=True) if a != b), "")
