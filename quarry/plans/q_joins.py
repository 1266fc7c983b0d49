"""Joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import joins as j
from .registry import Tables, query

C = F.col
SMALL = "SELECT c_custkey, c_name, o_orderkey FROM (SELECT * FROM customer WHERE c_nationkey < 12) c {} JOIN (SELECT * FROM orders WHERE o_totalprice > 150000) o ON c_custkey = o_custkey"


def on():
    return C("c_custkey") == C("o_custkey")


def _sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    return t.customer.where("c_nationkey < 12"), t.orders.where("o_totalprice > 150000")


for _name, _kind in (("JOI1_inner", "inner"), ("JOI2_left", "left"), ("JOI3_right", "right"), ("JOI4_full", "full")):
    query(_name, SMALL.format(_kind.upper()))(lambda t, kind=_kind: j.join(*_sides(t), on(), kind).select("c_custkey", "c_name", "o_orderkey"))


@query("JOI5_cross", "SELECT n_name, r_name FROM nation CROSS JOIN region")
def cross(t: Tables) -> DataFrame:
    return j.join(t.nation, t.region, None, "cross").select("n_name", "r_name")


@query("JOI6_using", "SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) JOIN (SELECT r_regionkey AS k, r_name FROM region) USING (k)")
def using(t: Tables) -> DataFrame:
    return j.join(t.nation.select(C("n_regionkey").alias("k"), "n_name"), t.region.select(C("r_regionkey").alias("k"), "r_name"), ["k"])


@query("JOI7_theta", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey + b.n_regionkey > 6")
def theta(t: Tables) -> DataFrame:
    a, b = t.nation.alias("a"), t.nation.alias("b")
    return j.join(a, b, (C("a.n_nationkey") < C("b.n_nationkey")) & (C("a.n_regionkey") + C("b.n_regionkey") > 6)).select(C("a.n_name").alias("a"), C("b.n_name").alias("b"))


@query("JOI8_residual", "SELECT o_orderkey, l_linenumber, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND (l_quantity > 40 OR NOT o_orderstatus = 'F') AND l_extendedprice < o_totalprice / 2")
def residual(t: Tables) -> DataFrame:
    cond = (C("o_orderkey") == C("l_orderkey")) & ((C("l_quantity") > 40) | ~(C("o_orderstatus") == "F")) & (C("l_extendedprice") < C("o_totalprice") / 2)
    return j.join(t.orders, t.lineitem, cond).select("o_orderkey", "l_linenumber", "l_partkey")


@query("JOI9_key_driven", "SELECT o_orderkey, l_partkey, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def key_driven(t: Tables) -> DataFrame:
    return j.join(t.orders, t.lineitem, C("o_orderkey") == C("l_orderkey")).select("o_orderkey", "l_partkey", "l_quantity")


@query("JOI10_semi_anti", "SELECT s_suppkey, 'with' AS kind FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49) UNION ALL SELECT s_suppkey, 'without' FROM supplier WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49)")
def semi_anti(t: Tables) -> DataFrame:
    cond, big = C("s_suppkey") == C("l_suppkey"), t.lineitem.where("l_quantity > 49")
    a, b = (j.join(t.supplier, big, cond, k).select("s_suppkey", F.lit(v).alias("kind")) for k, v in (("semi", "with"), ("anti", "without")))
    return a.unionAll(b)


@query("JOI11_chain", "SELECT r_name, n_name, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY r_name, n_name")
def chain(t: Tables) -> DataFrame:
    out = j.chain(
        t.region,
        (t.nation, C("r_regionkey") == C("n_regionkey"), "inner"),
        (t.customer, C("n_nationkey") == C("c_nationkey"), "inner"),
        (t.orders, on(), "inner"),
        (t.lineitem, C("o_orderkey") == C("l_orderkey"), "inner"),
    )
    return out.groupBy("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("JOI12_where_after_join", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' WHERE o_orderkey IS NULL OR o_totalprice + c_acctbal > 200000")
def where_after_join(t: Tables) -> DataFrame:
    out = j.join(t.customer, t.orders, on() & (C("o_orderstatus") == "P"), "left")
    return out.where(C("o_orderkey").isNull() | (C("o_totalprice") + C("c_acctbal") > 200000)).select("c_custkey", "o_orderkey")
