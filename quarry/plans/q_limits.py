"""Ordering and row limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import limits as m
from .registry import Tables, query

C = F.col


@query("SRT1_order_by", "SELECT c_name AS name, c_acctbal FROM customer")
def order_by(t: Tables) -> DataFrame:
    return m.order(t.customer.select(C("c_name").alias("name"), "c_acctbal"), F.desc("c_acctbal"), C("name"))


@query("SRT2_order_by_function", "SELECT c_custkey FROM customer")
def order_by_function(t: Tables) -> DataFrame:
    return m.order(t.customer, F.abs("c_acctbal"), C("c_custkey")).select("c_custkey")


@query("SRT3_limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 40")
def limit_offset(t: Tables) -> DataFrame:
    return m.limit(m.order(t.orders.select("o_orderkey"), C("o_orderkey")), 25, 40)


@query("SRT4_top_ties", "SELECT p_partkey, p_size FROM (SELECT *, rank() OVER (ORDER BY p_size DESC) AS r FROM part) WHERE r <= 10")
def top_ties(t: Tables) -> DataFrame:
    return m.top(t.part.select("p_partkey", "p_size"), 10, [F.desc("p_size")], ["p_size"])


@query("SRT4b_top_percent", "SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS n, count(*) OVER () AS c FROM part) WHERE n <= ceil(c * 3 / 100.0)")
def top_percent(t: Tables) -> DataFrame:
    return m.top_percent(t.part.select("p_partkey"), 3, [C("p_partkey")])


@query("SRT5_fetch", "SELECT p_partkey, p_size FROM (SELECT *, rank() OVER (ORDER BY p_size) AS r, row_number() OVER (ORDER BY p_size) AS n, count(*) OVER () AS c FROM part) WHERE r <= ceil(c * 2 / 100.0)")
def fetch(t: Tables) -> DataFrame:
    return m.fetch(t.part.select("p_partkey", "p_size"), 2, [C("p_size")], percent=True, ties=["p_size"])


@query("SRT6_limit_by", "SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n <= 2 ORDER BY o_orderkey OFFSET 10")
def limit_by(t: Tables) -> DataFrame:
    return m.limit_by(t.orders.select("o_orderkey", "o_custkey"), 2, ["o_custkey"], [C("o_orderkey")], 10)


@query("SRT7_cluster_by", "SELECT c_custkey FROM customer")
def cluster_by(t: Tables) -> DataFrame:
    return m.order(t.customer, C("c_nationkey"), C("c_custkey")).select("c_custkey")


@query("SRT8_limit_alone", "SELECT CAST(7 AS BIGINT) AS n, CAST(0 AS BIGINT) AS zero")
def limit_alone(t: Tables) -> DataFrame:
    first = m.limit(t.orders.select("o_orderkey"), 7).agg(F.count("*").alias("n"))
    return first.join(F.broadcast(m.limit(t.orders, 0).agg(F.count("*").alias("zero"))))
