"""Connected components of links by large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c


def _state(edges: DataFrame) -> tuple[int, int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"), F.sum(F.col("b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["h"], row["s"]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of each node that has an edge; edges has columns a and b, long.

    component is the least node that can be reached.  Nodes without an edge
    are not in the result; an empty table gives an empty one.  Each step groups
    by node with partial aggregation, and joins that a frequent node can't
    hold up, as Spark splits them; the state is written to the shared folder.
    """
    now = c.written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _state(now)
    while before[0]:
        # large star: larger neighbours of a node join its least neighbour
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: smaller neighbours, and the node itself, join the least of them
        large = c.written(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        old, now = now, c.written(small, "edges")
        c.forget(old, large)
        after = _state(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def forest(n: int, a: list[int], b: list[int]) -> list[int]:
    """The least member of the group of each of n items, after joining a[i] and b[i]."""
    up = list(range(n))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in zip(a, b, strict=True):
        x, y = find(x), find(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]
