"""Set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import limits, setops
from .registry import Tables, query

C = F.col
A, B, D = "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'"


def _keys(t: Tables, status: str, name: str = "o_custkey") -> DataFrame:
    return t.orders.where(C("o_orderstatus") == status).select(C("o_custkey").alias(name))


@query("SET1_union_all", f"{A} UNION ALL {B}")
def union_all(t: Tables) -> DataFrame:
    return setops.union(_keys(t, "F", "k"), _keys(t, "O"), every=True)


@query("SET2_union", f"{A} UNION {B}")
def union(t: Tables) -> DataFrame:
    return setops.union(_keys(t, "F", "k"), _keys(t, "O"))


@query("SET3_except", f"{A} EXCEPT {D}")
def except_(t: Tables) -> DataFrame:
    return setops.except_(_keys(t, "F", "k"), _keys(t, "P"))


@query("SET4_intersect", f"{A} INTERSECT {D}")
def intersect(t: Tables) -> DataFrame:
    return setops.intersect(_keys(t, "F", "k"), _keys(t, "P"))


@query("SET5_mixed", f"({A} INTERSECT {B}) UNION ALL (({D}) EXCEPT ({A}))")
def mixed(t: Tables) -> DataFrame:
    sides = [_keys(t, "F", "k"), _keys(t, "O"), _keys(t, "P", "k")]
    return setops.evaluate(sides, [0, 1, "INTERSECT", 2, 0, "EXCEPT", "UNION ALL"])


@query("SET6_types", "SELECT CAST(n_nationkey AS VARCHAR) AS a, CAST(n_regionkey AS DOUBLE) AS b FROM nation UNION SELECT r_name, r_regionkey + 0.5 FROM region")
def types(t: Tables) -> DataFrame:
    return setops.union(t.nation.select(C("n_nationkey").alias("a"), C("n_regionkey").alias("b")), t.region.select("r_name", C("r_regionkey") + F.lit(0.5).cast("double")))


@query("SET7_collation", "SELECT min(s) AS s FROM (SELECT c_mktsegment AS s FROM customer UNION ALL SELECT lower(c_mktsegment) FROM customer) GROUP BY lower(s)")
def collation(t: Tables) -> DataFrame:
    setops.collation("utf8_general_ci", None)
    return setops.union_ci(t.customer.select(C("c_mktsegment").alias("s")), t.customer.select(F.lower("c_mktsegment")))


@query("SET8_ordered", f"SELECT * FROM ({A} UNION {B}) ORDER BY 1 DESC LIMIT 20 OFFSET 5")
def ordered(t: Tables) -> DataFrame:
    return limits.limit(limits.order(setops.union(_keys(t, "F", "k"), _keys(t, "O")), F.desc("k")), 20, 5)
