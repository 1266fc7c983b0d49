"""Filters and subquery predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import predicates as p
from ..operators.windows import qualify
from .registry import Tables, query

C = F.col


def _customers(name: str, condition, sql: str) -> None:
    query(name, f"SELECT c_custkey, c_name FROM customer WHERE {sql}")(lambda t: t.customer.where(condition()).select("c_custkey", "c_name"))


def seg():
    """The segment, null for one of its values: the tables hold no null."""
    return F.nullif(C("c_mktsegment"), F.lit("BUILDING"))


SEG = "nullif(c_mktsegment, 'BUILDING')"

_customers("FIL1_compare", lambda: p.compare(C("c_acctbal"), ">=", F.lit(0)) & p.compare(seg(), "<>", F.lit("MACHINERY")), f"c_acctbal >= 0 AND {SEG} <> 'MACHINERY'")
_customers("FIL2_expression", lambda: p.numeric_or_text(C("c_acctbal") / 2, ">", F.lit("1000")), "c_acctbal / 2 > 1000")
_customers("FIL3_column_to_column", lambda: C("c_custkey") % 25 < C("c_nationkey"), "c_custkey % 25 < c_nationkey")
_customers("FIL4_like", lambda: ~p.like(seg(), "%in%") & p.like(C("c_name"), "customer%!_1%", "!") | p.like(C("c_name"), "CUSTOMER%7"), f"({SEG} NOT ILIKE '%in%' AND c_name ILIKE 'customer%!_1%' ESCAPE '!') OR c_name ILIKE 'CUSTOMER%7'")
_customers("FIL5_regexp", lambda: p.regexp(C("c_name"), "^C.*[13579]$") & ~p.regexp(seg(), "^M"), f"regexp_matches(c_name, '^C.*[13579]$') AND NOT regexp_matches({SEG}, '^M')")
_customers("FIL6_in_list", lambda: C("c_nationkey").isin(1, 2, 3) & ~seg().isin("MACHINERY", "FURNITURE"), f"c_nationkey IN (1, 2, 3) AND {SEG} NOT IN ('MACHINERY', 'FURNITURE')")
_customers("FIL7_is_null", lambda: seg().isNull() | C("c_acctbal").isNull(), f"{SEG} IS NULL OR c_acctbal IS NULL")
_customers("FIL8_between", lambda: p.between(C("c_acctbal"), 100, 2000) & ~p.between(C("c_nationkey"), 3, 20), "c_acctbal BETWEEN 100 AND 2000 AND c_nationkey NOT BETWEEN 3 AND 20")
_customers("FIL14_prewhere", lambda: (C("c_nationkey") < 10) & (C("c_acctbal") > 0), "c_nationkey < 10 AND c_acctbal > 0")
_customers("FIL16_constant_folding", lambda: C("c_nationkey") < F.lit(2) * 3 + 1, "c_nationkey < 2 * 3 + 1")


@query("FIL9_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def in_subquery(t: Tables) -> DataFrame:
    found = p.in_subquery(t.customer, "c_custkey", t.orders.where("o_totalprice > 200000").select("o_custkey"))
    return p.in_subquery(found, "c_nationkey", t.nation.where("n_regionkey = 1").select("n_nationkey"), negated=True).select("c_custkey")


@query("FIL9b_not_in_null", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT nullif(n_nationkey, 3) FROM nation)")
def not_in_null(t: Tables) -> DataFrame:
    return p.in_subquery(t.customer, "c_nationkey", t.nation.select(F.nullif("n_nationkey", F.lit(3)).alias("k")), negated=True).select("c_custkey")


@query("FIL10_scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
def scalar_subquery(t: Tables) -> DataFrame:
    return p.scalar(t.orders, "o_totalprice", ">", t.orders.agg(F.avg("o_totalprice").alias("a"))).select("o_orderkey")


@query("FIL10b_correlated_scalar", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
def correlated_scalar(t: Tables) -> DataFrame:
    return t.views("orders").sql("SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")


@query("FIL11_any", "SELECT p_partkey FROM part WHERE p_retailprice > ANY (SELECT p_retailprice FROM part WHERE p_size > 48)")
def any_(t: Tables) -> DataFrame:
    return p.quantified(t.part, "p_retailprice", ">", t.part.where("p_size > 48").select("p_retailprice"), every=False).select("p_partkey")


@query("FIL12_all", "SELECT p_partkey FROM part WHERE p_retailprice >= ALL (SELECT p_retailprice FROM part WHERE p_size < 3)")
def all_(t: Tables) -> DataFrame:
    return p.quantified(t.part, "p_retailprice", ">=", t.part.where("p_size < 3").select("p_retailprice"), every=True).select("p_partkey")


@query("FIL12b_all_of_none", "SELECT p_partkey FROM part")
def all_of_none(t: Tables) -> DataFrame:
    return p.quantified(t.part, "p_retailprice", "<", t.part.where("p_size < 0").select("p_retailprice"), every=True).select("p_partkey")


@query("FIL13_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P') AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
def exists(t: Tables) -> DataFrame:
    on = C("o_custkey") == C("c_custkey")
    found = p.exists(t.customer, t.orders.where("o_orderstatus = 'P'"), on)
    return p.exists(found, t.orders.where("o_totalprice > 300000"), on, negated=True).select("c_custkey")


@query("FIL15_qualify", "SELECT o_orderkey, o_custkey, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 2")
def qualify_(t: Tables) -> DataFrame:
    from ..operators.windows import Spec

    w = Spec(("o_custkey",), (F.desc("o_totalprice"), C("o_orderkey"))).ranking()
    return qualify(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), {"n": F.row_number().over(w).cast("long")}, C("n") <= 2).drop("o_totalprice")
