"""Scans, probes and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import predicates as p
from ..operators.storage import shared_path
from ..sources import dump
from .registry import Tables, query

LI = "l_orderkey, l_linenumber, l_partkey, l_quantity"


@query("SRC1_full_scan", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders")
def full_scan(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")


@query("SRC2_key_lookup", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 100")
def key_lookup(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_orderkey") == 100).select("o_orderkey", "o_totalprice")


@query("SRC3_equality_probe", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def equality_probe(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_orderstatus") == "F").select("o_orderkey", "o_orderstatus")


@query("SRC4_in_list_probe", f"SELECT {LI} FROM lineitem WHERE l_partkey IN (1, 5, 9, 200)")
def in_list_probe(t: Tables) -> DataFrame:
    return t.lineitem.where(F.col("l_partkey").isin(1, 5, 9, 200)).select(*LI.split(", "))


@query("SRC5_range_probe", "SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 50 AND 500")
def range_probe(t: Tables) -> DataFrame:
    return t.orders.where(p.between(F.col("o_orderkey"), 50, 500)).select("o_orderkey")


@query("SRC6_range_intersection", f"SELECT {LI} FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20 AND l_discount BETWEEN 0.02 AND 0.04 AND l_partkey > 20")
def range_intersection(t: Tables) -> DataFrame:
    q, d = F.col("l_quantity"), F.col("l_discount")
    return t.lineitem.where((q >= 10) & (q < 20) & p.between(d, 0.02, 0.04) & (F.col("l_partkey") > 20)).select(*LI.split(", "))


@query("SRC7_prefix_probe", "SELECT p_partkey, p_type FROM part WHERE starts_with(p_type, 'S')")
def prefix_probe(t: Tables) -> DataFrame:
    return t.part.where(p.prefix(F.col("p_type"), "S")).select("p_partkey", "p_type")


@query("SRC8_string_like", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%A%1_'")
def string_like(t: Tables) -> DataFrame:
    return t.part.where(p.like(F.col("p_name"), "%a%1_")).select("p_partkey", "p_name")


@query("SRC9_one_row", "SELECT 1 + 2 AS v, upper('x') AS s")
def one_row(t: Tables) -> DataFrame:
    return t.spark.range(1).select((F.lit(1) + F.lit(2)).alias("v"), F.upper(F.lit("x")).alias("s"))


@query("SRC10_view_scan", "SELECT c_custkey, c_name FROM (SELECT * FROM customer WHERE c_acctbal > 0) v WHERE c_nationkey = 3")
def view_scan(t: Tables) -> DataFrame:
    t.customer.where("c_acctbal > 0").createOrReplaceTempView("rich_customer")
    return t.spark.table("rich_customer").where("c_nationkey = 3").select("c_custkey", "c_name")


@query("SRC11_derived_table", "SELECT a.c_custkey, a.b FROM (SELECT c_custkey, c_acctbal AS b FROM customer WHERE c_nationkey < 5) a WHERE a.b > 100")
def derived_table(t: Tables) -> DataFrame:
    return t.views("customer").sql("SELECT a.c_custkey, a.b FROM (SELECT c_custkey, c_acctbal AS b FROM customer WHERE c_nationkey < 5) a WHERE a.b > 100")


@query("SRC12_cross_database", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def cross_database(t: Tables) -> DataFrame:
    from ..engine import Engine

    e = Engine(t.spark)
    e.sql("CREATE DATABASE geo; CREATE DATABASE world")
    e.register("geo.nation", t.nation)
    e.register("world.region", t.region)
    return e.sql("SELECT n_name, r_name FROM geo.nation JOIN world.region ON n_regionkey = r_regionkey")


@query("SRC13_dump_import", "SELECT n_nationkey AS id, n_name AS name, CASE WHEN n_regionkey = 0 THEN NULL ELSE n_regionkey END AS region FROM nation")
def dump_import(t: Tables) -> DataFrame:
    rows = t.nation.withColumn("region", F.nullif("n_regionkey", F.lit(0))).select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), "region")
    path = shared_path(t.spark, "nation_dump")
    dump.export_table(rows, "nation", path)
    return dump.import_dump(t.spark, path)["nation"]


@query("SINK1_export", "SELECT r_regionkey, r_name FROM region")
def export(t: Tables) -> DataFrame:
    path = shared_path(t.spark, "region_dump")
    dump.export_table(t.region, "region", path)
    return dump.import_dump(t.spark, path)["region"]


@query("SINK2_create_table_as", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey")
def create_table_as(t: Tables) -> DataFrame:
    from ..engine import Engine

    e = Engine(t.spark)
    e.register("customer", t.customer)
    e.sql("CREATE TABLE per_nation AS SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey")
    return e.sql("SELECT * FROM per_nation")


@query("SINK3_client", "SELECT c_custkey, c_name FROM customer")
def client(t: Tables) -> DataFrame:
    from ..engine import Engine

    e = Engine(t.spark)
    e.register("customer", t.customer)
    return e.query("SELECT c_custkey, c_name FROM customer")


@query("PRJ1_columns", "SELECT c.c_custkey AS id, c.c_name AS name FROM customer c")
def columns(t: Tables) -> DataFrame:
    return t.customer.alias("c").select(F.col("c.c_custkey").alias("id"), F.col("c.c_name").alias("name"))


@query("PRJ2_star", "SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
def star(t: Tables) -> DataFrame:
    return t.nation.alias("n").join(t.region.alias("r"), F.col("n.n_regionkey") == F.col("r.r_regionkey")).select("n.*", "r.r_name")


@query("PRJ3_nested_functions", "SELECT c_custkey, upper(left(c_name, 3)) AS a, round(abs(c_acctbal * 2 - 1), 2) AS b FROM customer")
def nested_functions(t: Tables) -> DataFrame:
    from ..functions import call

    return t.customer.select("c_custkey", call("upper", call("left", F.col("c_name"), 3)).alias("a"), F.round(call("abs", F.col("c_acctbal") * 2 - 1), 2).alias("b"))


@query("PRJ4_case", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'mixed' END AS s, CASE WHEN o_totalprice > 100000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' END AS p FROM orders")
def case(t: Tables) -> DataFrame:
    s, x = F.col("o_orderstatus"), F.col("o_totalprice")
    return t.orders.select("o_orderkey", F.when(s == "F", "done").when(s == "O", "open").otherwise("mixed").alias("s"), F.when(x > 100000, "high").when(x > 50000, "mid").alias("p"))


@query("PRJ5_window_item", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders")
def window_item(t: Tables) -> DataFrame:
    from ..operators.windows import Spec

    return t.orders.select("o_orderkey", F.row_number().over(Spec(("o_custkey",), (F.col("o_orderkey"),)).ranking()).cast("long").alias("n"))


@query("PRJ6_hidden_sort_key", "SELECT c_name FROM customer")
def hidden_sort_key(t: Tables) -> DataFrame:
    return t.customer.orderBy(F.desc("c_acctbal"), "c_custkey").select("c_name")


@query("PRJ7_arithmetic", "SELECT l_orderkey, round(l_extendedprice * (1 - l_discount), 4) AS net, CAST(l_quantity AS BIGINT) AS q, 7 AS seven FROM lineitem")
def arithmetic(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"), F.col("l_quantity").cast("long").alias("q"), F.lit(7).alias("seven"))


@query("PRJ8_variable", "SELECT 50000 AS max_rows")
def variable(t: Tables) -> DataFrame:
    from ..engine import Engine

    return Engine(t.spark).sql("SELECT cte.max_rows AS max_rows")
