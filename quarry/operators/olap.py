"""OLAP views: slices over declared dimensions, and hypercubes."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .predicates import compare

MEASURES = {"SUM": F.sum, "COUNT": F.count, "MIN": F.min, "MAX": F.max, "AVG": F.avg}


@dataclass(frozen=True)
class OlapView:
    """CREATE OLAPVIEW name USING dimensions AS source."""

    name: str
    dimensions: tuple[str, ...]
    source: DataFrame
    keys: tuple[str, ...] = ()

    def measures(self) -> list[str]:
        """The numeric columns that are neither dimensions nor keys."""
        return [f.name for f in self.source.schema if isinstance(f.dataType, T.NumericType) and f.name not in self.dimensions + self.keys]

    def slices(self, where: list[tuple[str, str, object]] = (), order: list[tuple[str, bool]] = (), limit: int | None = None) -> DataFrame:
        """SHOW SLICES: a row for each coordinate with row_count, and sum, min, max and avg of each measure.

        Nulls are no part of an aggregate.  A null or blank coordinate is
        null and comes first.  ``order`` holds (column, descending).  One
        shuffle with partial aggregation; conditions on dimensions reach the
        scan.
        """
        dims = [self._coordinate(d).alias(d) for d in self.dimensions]
        aggs = [F.count("*").alias("row_count")]
        for m in self.measures():
            x = F.col(m).cast("double")
            aggs += [F.sum(x).alias(f"sum_{m}"), F.min(x).alias(f"min_{m}"), F.max(x).alias(f"max_{m}"), F.avg(x).alias(f"avg_{m}")]
        out = self.source.groupBy(*dims).agg(*aggs)
        if where:
            out = out.where(reduce(lambda a, b: a & b, [compare(F.col(c), op, F.lit(v)) for c, op, v in where]))
        keys = [F.col(c).desc() if down else F.col(c).asc() for c, down in order] or [F.col(d).asc_nulls_first() for d in self.dimensions]
        out = out.orderBy(*keys)
        return out if limit is None else out.limit(limit)

    def _coordinate(self, name: str) -> Column:
        if isinstance(self.source.schema[name].dataType, T.StringType):
            return F.when(F.trim(F.col(name)) != "", F.col(name))
        return F.col(name)


@dataclass
class Hypercube:
    """Cells by coordinate, with measures and, on demand, the rows behind them."""

    source: DataFrame
    dimensions: tuple[str, ...]
    measures: tuple[tuple[str, str, str], ...]  # name, aggregate, column
    key: str | None = None
    state: str = field(default="Current", init=False)
    _cells: DataFrame | None = field(default=None, init=False)

    def cells(self) -> DataFrame:
        """A row for each cell; built once, kept until invalidated."""
        if self._cells is None or self.state == "Stale":
            if self._cells is not None:
                self._cells.unpersist()
            aggs = [F.count("*").alias("row_count"), *[MEASURES[a.upper()](F.col(c)).alias(n) for n, a, c in self.measures]]
            self._cells = self.source.groupBy(*self.dimensions).agg(*aggs).persist()
            self.state = "Current"
        return self._cells

    def invalidate(self) -> None:
        self.state = "Stale"

    def slice(self, value: object) -> DataFrame:
        """The cells with a value of the first dimension."""
        return self.cells().where(F.col(self.dimensions[0]).eqNullSafe(F.lit(value)))

    def cell(self, *coordinates: object) -> DataFrame:
        return self.cells().where(reduce(lambda a, b: a & b, [F.col(d).eqNullSafe(F.lit(v)) for d, v in zip(self.dimensions, coordinates, strict=True)]))

    def cell_count(self) -> int:
        return self.cells().count()

    def row_count(self) -> int:
        return self.cells().agg(F.sum("row_count")).first()[0] or 0

    def rows(self) -> DataFrame:
        """Drill-through: the coordinates of each row with its key, a row each, so no cell's list has to fit one task."""
        return self.source.select(*self.dimensions, F.col(self.key).alias("row_id"))
