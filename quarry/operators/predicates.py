"""Predicates, and filters by subqueries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPS = {"=": "=", "==": "=", "<>": "<>", "!=": "<>", "<": "<", "<=": "<=", ">": ">", ">=": ">="}


def compare(a: Column, op: str, b: Column) -> Column:
    """a op b, with SQL's three-valued logic."""
    kind = OPS[op]
    return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[kind]


def numeric_or_text(a: Column, op: str, b: Column) -> Column:
    """Compares as numbers if both sides can be read as such, else as texts."""
    x, y = a.cast("string"), b.cast("string")
    m, n = x.try_cast("double"), y.try_cast("double")
    return F.when(m.isNotNull() & n.isNotNull(), compare(m, op, n)).otherwise(compare(x, op, y))


def like(a: Column, pattern: str, escape: str = "\\") -> Column:
    """LIKE and ILIKE: both ignore case.  A pattern that only fixes a beginning still goes by ILIKE."""
    return a.ilike(pattern if escape == "\\" else re.sub(rf"{re.escape(escape)}(.)", r"\\\1", pattern.replace("\\", "\\\\")))


def prefix(a: Column, start: str) -> Column:
    """A case-sensitive prefix, which the Parquet reader can use."""
    return a.startswith(start)


def regexp(a: Column, pattern: str) -> Column:
    """RLIKE, case-sensitive; a broken pattern is an error now, not at the run."""
    re.compile(pattern)
    return a.rlike(pattern)


def between(a: Column, low: object, high: object) -> Column:
    return (a >= low) & (a <= high)


def two_valued(p: Column) -> Column:
    """The predicate with false for unknown, so that NOT turns it into true."""
    return F.coalesce(p, F.lit(False))


def _one(sub: DataFrame) -> str:
    if len(sub.columns) != 1:
        raise ValueError("the subquery has one column")
    return sub.columns[0]


def in_subquery(df: DataFrame, column: str, sub: DataFrame, negated: bool = False) -> DataFrame:
    """[NOT] IN (subquery): a semi join; NOT IN with a null in the subquery keeps nothing, and a null value only passes an empty subquery."""
    if not negated:
        s = sub.select(F.col(_one(sub)).alias("__s"))
        return df.join(s, F.col(column) == F.col("__s"), "left_semi")
    s = sub.select(F.col(_one(sub)).alias("__s"))
    kept = df.join(s.where("__s is not null").distinct(), F.col(column) == F.col("__s"), "left_anti")
    facts = s.agg(F.count("*").alias("__n"), F.count("__s").alias("__m"))  # one row
    return kept.join(F.broadcast(facts), on=F.expr("__n = 0") | (F.col(column).isNotNull() & F.expr("__n = __m")), how="inner").drop("__n", "__m")


def exists(df: DataFrame, sub: DataFrame, on: Column, negated: bool = False) -> DataFrame:
    """[NOT] EXISTS of a correlated subquery: a semi or an anti join."""
    return df.join(sub, on, "left_anti" if negated else "left_semi")


def scalar(df: DataFrame, column: str, op: str, sub: DataFrame) -> DataFrame:
    """column op (subquery of one row); more rows are an error, none is unknown."""
    name = _one(sub)
    one = sub.agg(F.when(F.count("*") > 1, F.raise_error(F.lit("the subquery gives more than one row"))).otherwise(F.min(name)).alias("__s"))  # one row
    return df.join(F.broadcast(one), compare(F.col(column), op, F.col("__s"))).drop("__s")


def quantified(df: DataFrame, column: str, op: str, sub: DataFrame, every: bool) -> DataFrame:
    """column op ANY or ALL (subquery).  ALL of an empty subquery holds, ANY doesn't; a null leaves open what the others don't decide."""
    name = _one(sub)
    op = OPS[op]
    facts = sub.agg(F.count("*").alias("__n"), F.count(name).alias("__m"), F.min(name).alias("__lo"), F.max(name).alias("__hi"))  # one row
    x, lo, hi = F.col(column), F.col("__lo"), F.col("__hi")
    if op == "=" and not every:
        return in_subquery(df, column, sub)
    if op == "<>" and every:
        return in_subquery(df, column, sub, negated=True)
    if op in ("=", "<>"):  # = ALL: all are the same; <> ANY: one differs
        hit = (x == lo) & (x == hi) if every else (x != lo) | (x != hi)
    else:
        bound = (hi if every else lo) if op in (">", ">=") else (lo if every else hi)
        hit = compare(x, op, bound)
    cond = (F.col("__n") == 0) | (hit & (F.col("__n") == F.col("__m"))) if every else (F.col("__m") > 0) & hit
    return df.join(F.broadcast(facts), cond).drop("__n", "__m", "__lo", "__hi")
