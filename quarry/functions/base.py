"""What all function modules share: arguments, and the registry of names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every name, with its function and the least and greatest number of arguments (None: any).
REGISTRY: dict[str, tuple[Callable[..., Column], int, int | None]] = {}


def named(*names: str, args: tuple[int, int | None]) -> Callable[[Callable[..., Column]], Callable[..., Column]]:
    """Registers a function under some names."""

    def put(f: Callable[..., Column]) -> Callable[..., Column]:
        for n in names:
            REGISTRY[n] = (f, *args)
        return f

    return put


def call(name: str, *args: object) -> Column:
    """A function by its name, in any case and quotes; a wrong number of arguments is an error with the usage."""
    key = name.strip("`\"'").lower()
    if key not in REGISTRY:
        raise ValueError(f"unknown function {name}")
    f, low, high = REGISTRY[key]
    if len(args) < low or (high is not None and len(args) > high):
        many = f"{low}" if low == high else f"{low} or more" if high is None else f"{low} to {high}"
        raise ValueError(f"{key.upper()} takes {many} arguments, not {len(args)}")
    return f(*args)


def arg(x: object) -> Column:
    """A column as it is; anything else as a literal."""
    return x if isinstance(x, Column) else F.lit(x)


def any_null(*xs: Column) -> Column:
    out = xs[0].isNull()
    for x in xs[1:]:
        out = out | x.isNull()
    return out


def strict(value: Column, *xs: Column) -> Column:
    """The value, or null if an argument is null."""
    return F.when(~any_null(*xs), value)


def finite(x: Column) -> Column:
    """A double, null if it isn't finite."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
