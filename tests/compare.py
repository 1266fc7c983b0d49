"""Runs registered queries against DuckDB on the same tables."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.exists(path):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else glob.escape(path) + '/*.parquet'}'")
    return c


def value(x: object) -> object:
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, float)):
        x = float(x)
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(value(y) for y in x)
    return str(x)


def rows(columns: list[str], data: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(value(r[i]) for i in order) for r in data), key=repr)


def difference(spark, c: duckdb.DuckDBPyConnection, folder: str, run, sql: str) -> str | None:
    """What differs between a query and its SQL; None if nothing does."""
    df = run(spark, folder)
    got = rows(df.columns, df.collect())
    cursor = c.execute(sql)
    names = [x[0] for x in cursor.description]
    want = rows(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}"
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b and not _near(a, b)]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None


def _near(a: tuple, b: tuple) -> bool:
    return all(x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6) for x, y in zip(a, b, strict=True))
