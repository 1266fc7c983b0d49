"""Recursive common table expressions by frontiers, with guardrails."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut


@dataclass(frozen=True)
class Guards:
    """Limits of a recursion; a timeout of 0 seconds is none."""

    max_iterations: int = 128
    max_rows: int = 50_000
    timeout: float = 0.0
    detect_repeats: bool = True


class RecursionLimit(RuntimeError):
    pass


#: Names of the variables and the ranges that they may be set to.
RANGES = {"max_iterations": (1, 100_000), "max_rows": (1, 10**12), "timeout": (0, 86_400), "detect_repeats": (0, 1)}


def set_guards(guards: Guards, **values: float) -> Guards:
    """New limits; if any value is out of range none changes."""
    for k, v in values.items():
        if k not in RANGES:
            raise ValueError(f"unknown variable cte.{k}")
        low, high = RANGES[k]
        if not low <= v <= high:
            raise ValueError(f"cte.{k} is from {low} to {high}")
    return replace(guards, **{k: bool(v) if k == "detect_repeats" else v for k, v in values.items()})


def _state(frontier: DataFrame) -> tuple[int, int, int]:
    """The number of rows of a frontier, and two sums of their hashes: equal for equal rows in any order."""
    row = F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(frontier.columns)]), {"ignoreNullFields": "false"})
    sums = [F.coalesce(F.sum(F.xxhash64(*x).cast("decimal(38,0)")), F.lit(0)).alias(n) for n, x in (("a", [row]), ("b", [F.lit(1), row]))]
    r = frontier.agg(F.count("*").alias("n"), *sums).first()
    return r["n"], int(r["a"]), int(r["b"])


def recursive(seed: DataFrame, step: Callable[[DataFrame], DataFrame], distinct: bool = False, guards: Guards | None = None) -> DataFrame:
    """WITH RECURSIVE: the seed, and what ``step`` makes of each frontier, until it makes nothing.

    UNION ALL keeps all rows; ``distinct`` (UNION) only goes on with rows that
    aren't there yet, which an anti join finds.  Each frontier is written to
    the shared folder, so plans don't grow and lost executors don't matter;
    the driver only sees counts and sums of hashes.  A UNION ALL whose frontier
    holds the same rows as an earlier one would never end, and is an error
    unless ``detect_repeats`` is off.
    """
    guards = guards or Guards()
    began, frontier = time.time(), cut(seed.distinct() if distinct else seed)
    parts, state = [frontier], _state(frontier)
    rows = found = state[0]
    seen_states, turn = set(), 0
    while found:
        turn += 1
        if turn > guards.max_iterations:
            raise RecursionLimit(f"over {guards.max_iterations} iterations")
        if guards.timeout and time.time() - began > guards.timeout:
            raise RecursionLimit(f"over {guards.timeout} seconds")
        if not distinct and guards.detect_repeats:
            if state in seen_states:
                raise RecursionLimit("a frontier of UNION ALL came twice")
            seen_states.add(state)
        new = step(frontier).toDF(*seed.columns)
        if distinct:
            seen = parts[0]
            for p in parts[1:]:
                seen = seen.unionAll(p)
            on = [F.col(f"n.{c}").eqNullSafe(F.col(f"s.{c}")) for c in seed.columns]
            cond = on[0]
            for x in on[1:]:
                cond = cond & x
            new = new.distinct().alias("n").join(seen.alias("s"), cond, "left_anti")
        frontier = cut(new)
        state = _state(frontier)
        found = state[0]
        rows += found
        if rows > guards.max_rows:
            raise RecursionLimit(f"over {guards.max_rows} rows")
        if found:
            parts.append(frontier)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out
