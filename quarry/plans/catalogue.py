"""All registered queries of the engine and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import registry


def _load() -> None:
    from . import q_aggregates, q_ctes, q_functions, q_joins, q_limits, q_predicates, q_routines, q_sets, q_sources, q_statements, q_windows  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of an OLAP view of lineitem."""
    return queries()["AGG6_show_slices"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(registry.SQL)
