"""Ordering and row limits."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut


def order(df: DataFrame, *keys: Column) -> DataFrame:
    """A global order.  CLUSTER BY, DISTRIBUTE BY and SORT BY mean the same here."""
    return df.orderBy(*keys)


def limit(df: DataFrame, n: int | None, offset: int = 0) -> DataFrame:
    out = df.offset(offset) if offset else df
    return out if n is None else out.limit(n)


def percent_rows(rows: int, percent: float) -> int:
    """Rounded up; over 100 percent is all."""
    return math.ceil(rows * min(percent, 100) / 100)


def top(df: DataFrame, n: int, keys: list[Column], ties: list[str] | None = None) -> DataFrame:
    """The first n rows.  With ``ties``, the names of the order's columns, also those that equal the last one in them.

    No global rank: the n rows are a distributed top-k, and whatever equals
    one of them in the order's columns joins in.
    """
    first = df.orderBy(*keys).limit(n)
    if ties is None:
        return first
    tied = first.select(*[F.col(c).alias(f"__t{i}") for i, c in enumerate(ties)]).distinct()
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__t{i}")) for i, c in enumerate(ties)])
    return df.join(tied, on, "left_semi").orderBy(*keys)


def top_percent(df: DataFrame, percent: float, keys: list[Column], ties: list[str] | None = None) -> DataFrame:
    """The first percent of the rows, a share of the table that no one task can hold.

    The rows are sorted by ranges and written with their place, which is their
    partition and their number in it.  The driver gets a count for each
    partition and so the place of the last row; with ``ties`` also that row's
    keys, and rows that equal them join in.
    """
    keys = keys or [F.lit(1)]
    placed = cut(df.orderBy(*keys).withColumn("__place", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("__place", 33)
    sizes = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # a row for each partition
    left = percent_rows(sum(n for _, n in sizes), percent)
    last = -1
    for p, n in sizes:
        if left <= 0:
            break
        last = (p << 33) + min(left, n) - 1
        left -= n
    hit = F.col("__place") <= last
    if ties is not None and last >= 0:
        edge = placed.where(F.col("__place") == last).select(*[F.col(c).alias(f"__t{i}") for i, c in enumerate(ties)])
        one = edge.first()  # one row
        hit = hit | reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(one[f"__t{i}"]).cast(edge.schema[i].dataType)) for i, c in enumerate(ties)])
    return placed.where(hit).orderBy("__place").drop("__place")


def fetch(df: DataFrame, n: float, keys: list[Column], percent: bool = False, ties: list[str] | None = None) -> DataFrame:
    """FETCH FIRST n [PERCENT] ROWS ONLY or WITH TIES."""
    return top_percent(df, n, keys, ties) if percent else top(df, int(n), keys, ties)


def limit_by(df: DataFrame, n: int, by: list[str], keys: list[Column], offset: int = 0) -> DataFrame:
    """At most n rows for each value of some columns, in an order; then a global offset in that order.

    Spark filters groups to n rows before the shuffle (a window group limit).
    """
    w = Window.partitionBy(*by).orderBy(*keys)
    out = df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")
    return out.orderBy(*keys).offset(offset) if offset else out
