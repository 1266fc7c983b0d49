"""Window specifications with ROWS, RANGE and GROUPS frames, and named windows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

FIRST, LAST = Window.unboundedPreceding, Window.unboundedFollowing


@dataclass(frozen=True)
class Spec:
    """A window; a missing end of a frame is the current row, no frame the whole partition."""

    partition: tuple[str, ...] = ()
    order: tuple[Column, ...] = ()
    frame: tuple[str, int, int] | None = None

    def over(self) -> WindowSpec:
        w = Window.partitionBy(*self.partition)
        if self.order:
            w = w.orderBy(*self.order)
        if self.frame is None:
            return w.rowsBetween(FIRST, LAST)
        kind, low, high = self.frame
        return w.rangeBetween(low, high) if kind == "range" else w.rowsBetween(low, high)

    def ranking(self) -> WindowSpec:
        """Without a frame, for ranks, LAG and LEAD."""
        w = Window.partitionBy(*self.partition)
        return w.orderBy(*self.order) if self.order else w


@dataclass
class Named:
    """Named windows, which may build on each other."""

    specs: dict[str, Spec] = field(default_factory=dict)

    def define(self, name: str, base: str | None = None, **parts: object) -> Spec:
        """A window; what it gives itself replaces what its base has."""
        found = replace(self.specs[base], **parts) if base else Spec(**parts)
        self.specs[name] = found
        return found


def rows(low: int, high: int = 0) -> tuple[str, int, int]:
    return "rows", low, high


def range_(low: int, high: int = 0) -> tuple[str, int, int]:
    return "range", low, high


def groups(df: DataFrame, name: str, value: Callable[[Column], Column], argument: Column, partition: list[str], order: list[Column], low: int, high: int = 0) -> DataFrame:
    """A value over a GROUPS frame: peers are numbered by a dense rank, over which the frame is a range."""
    ranked = df.withColumn("__peer", F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order)))
    w = Window.partitionBy(*partition).orderBy("__peer").rangeBetween(low, high)
    return ranked.withColumn(name, value(argument).over(w)).drop("__peer")


def qualify(df: DataFrame, windows: dict[str, Column], condition: Column, keep: bool = True) -> DataFrame:
    """Adds window values and filters by them; without ``keep`` they go again."""
    out = df.withColumns(windows).where(condition)
    return out if keep else out.drop(*windows)
