"""Joins: five kinds, by equality, by named columns, and by any condition."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "cross": "cross", "semi": "left_semi", "anti": "left_anti"}


def join(left: DataFrame, right: DataFrame, on: Column | list[str] | None, kind: str = "inner") -> DataFrame:
    """A join; Catalyst takes equalities out of a condition as keys and checks the rest on their matches.

    A row whose key is null has no match and stays, extended by nulls, where
    the kind keeps unmatched rows.
    """
    how = KINDS[kind]
    if how == "cross":
        return left.crossJoin(right)
    if on is None:
        raise ValueError("a join needs a condition")
    return left.join(right, on, how)


def chain(first: DataFrame, *steps: tuple[DataFrame, Column | list[str], str]) -> DataFrame:
    """A left-deep chain of joins; AQE chooses how each runs."""
    return reduce(lambda df, s: join(df, *s), steps, first)


def lookup(df: DataFrame, table: DataFrame, name: str, key: str, table_key: str, columns: list[str]) -> DataFrame:
    """Binds columns of another table by key as ``name__column``; rows without a match get nulls."""
    bound = table.select(F.col(table_key).alias(f"{name}__key"), *[F.col(c).alias(f"{name}__{c}") for c in columns])
    return df.join(bound, F.col(key) == F.col(f"{name}__key"), "left").drop(f"{name}__key")
