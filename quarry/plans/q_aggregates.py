"""Counts, grouping, OLAP slices and cubes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.olap import Hypercube, OlapView
from .registry import Tables, query

C = F.col


@query("AGG1_count", "SELECT (SELECT count(*) FROM lineitem) AS n, (SELECT count(*) FROM lineitem WHERE l_quantity > 25) AS m, (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey) AS j")
def count(t: Tables) -> DataFrame:
    n = t.lineitem.agg(F.count("*").alias("n"), F.count_if(C("l_quantity") > 25).alias("m"))
    return n.join(F.broadcast(t.orders.join(t.customer, C("o_custkey") == C("c_custkey")).agg(F.count("*").alias("j"))))


@query("AGG2_group_by", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def group_by(t: Tables) -> DataFrame:
    return t.lineitem.select("l_returnflag", "l_linestatus").distinct()


@query("AGG3_having", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey HAVING c_nationkey > 3 AND count(*) > 2")
def having(t: Tables) -> DataFrame:
    return t.customer.groupBy("c_nationkey").agg(F.count("*").alias("n")).where("c_nationkey > 3 AND n > 2")


@query("AGG4_distinct", "SELECT DISTINCT p_brand, p_size FROM part")
def distinct(t: Tables) -> DataFrame:
    return t.part.select("p_brand", "p_size").dropDuplicates()


def view(t: Tables) -> OlapView:
    source = t.lineitem.select("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return OlapView("lines", ("l_returnflag", "l_linestatus"), source)


def _measures(names: str, digits: int = 4) -> str:
    return ", ".join(f"round({f}(CAST({m} AS DOUBLE)), {digits}) AS {f}_{m}" for m in names.split() for f in ("sum", "min", "max", "avg"))


def _rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else c for c, k in df.dtypes])


SLICES = f"SELECT l_returnflag, l_linestatus, count(*) AS row_count, {_measures('l_quantity l_extendedprice l_discount l_tax')} FROM lineitem GROUP BY l_returnflag, l_linestatus"


@query("AGG5_create_olapview", "SELECT 'lines' AS name, 'l_returnflag,l_linestatus' AS dimensions, 'l_quantity,l_extendedprice,l_discount,l_tax' AS measures")
def create_olapview(t: Tables) -> DataFrame:
    from ..engine import Engine

    e = Engine(t.spark)
    e.register("lineitem", t.lineitem)
    e.sql("CREATE OLAPVIEW lines USING l_returnflag, l_linestatus AS SELECT l_returnflag, l_linestatus, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
    v = e.olap["lines"]
    return t.spark.createDataFrame([(v.name, ",".join(v.dimensions), ",".join(v.measures()))], "name string, dimensions string, measures string")


@query("AGG6_show_slices", SLICES)
def show_slices(t: Tables) -> DataFrame:
    return _rounded(view(t).slices())


@query("AGG7_slice_options", f"SELECT * FROM ({SLICES}) WHERE sum_l_quantity > 1000 AND l_returnflag <> 'N' ORDER BY row_count DESC LIMIT 3")
def slice_options(t: Tables) -> DataFrame:
    from ..engine import Engine

    e = Engine(t.spark)
    e.register("lineitem", t.lineitem)
    e.sql("CREATE OLAPVIEW lines USING l_returnflag, l_linestatus AS SELECT l_returnflag, l_linestatus, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
    return _rounded(e.sql("SHOW SLICES FROM lines WHERE sum_l_quantity > 1000 AND l_returnflag <> 'N' ORDER BY row_count DESC LIMIT 3"))


@query("AGG8_coordinate_order", "SELECT c, s, row_number() OVER (ORDER BY c NULLS FIRST, s NULLS FIRST) AS place FROM (SELECT DISTINCT nullif(o_orderstatus, 'F') AS c, nullif(o_orderpriority, '1-URGENT') AS s FROM orders)")
def coordinate_order(t: Tables) -> DataFrame:
    source = t.orders.select(F.nullif("o_orderstatus", F.lit("F")).alias("c"), F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("s"))
    cells = OlapView("o", ("c", "s"), source).slices()
    from pyspark.sql import Window

    w = Window.orderBy(F.asc_nulls_first("c"), F.asc_nulls_first("s"))  # a row for each cell
    return cells.select("c", "s", F.row_number().over(w).cast("long").alias("place"))


def cube(t: Tables) -> Hypercube:
    return Hypercube(t.orders, ("o_orderstatus", "o_orderpriority"), (("total", "SUM", "o_totalprice"), ("n", "COUNT", "o_totalprice"), ("lo", "MIN", "o_totalprice"), ("hi", "MAX", "o_totalprice"), ("mean", "AVG", "o_totalprice")), "o_orderkey")


CUBE = "SELECT o_orderstatus, o_orderpriority, count(*) AS row_count, round(sum(o_totalprice), 3) AS total, count(o_totalprice) AS n, round(min(o_totalprice), 3) AS lo, round(max(o_totalprice), 3) AS hi, round(avg(o_totalprice), 3) AS mean FROM orders GROUP BY o_orderstatus, o_orderpriority"


@query("AGG9_hypercube", CUBE)
def hypercube(t: Tables) -> DataFrame:
    return _rounded(cube(t).cells(), 3)


@query("AGG10_drill_through", "SELECT o_orderstatus, o_orderpriority, o_orderkey AS row_id FROM orders")
def drill_through(t: Tables) -> DataFrame:
    return cube(t).rows()


@query("AGG11_slice_cell", f"SELECT c.*, (SELECT count(*) FROM ({CUBE})) AS cells, (SELECT count(*) FROM orders) AS rows_ FROM ({CUBE}) c WHERE o_orderstatus = 'F'")
def slice_cell(t: Tables) -> DataFrame:
    c = cube(t)
    return _rounded(c.slice("F"), 3).withColumns({"cells": F.lit(c.cell_count()).cast("long"), "rows_": F.lit(c.row_count()).cast("long")})


@query("AGG12_cube_cache", "SELECT 'Current' AS a, 'Stale' AS b, 'Current' AS c")
def cube_cache(t: Tables) -> DataFrame:
    c = cube(t)
    c.cells()
    states = [c.state]
    c.invalidate()
    states.append(c.state)
    c.cells()
    states.append(c.state)
    return t.spark.createDataFrame([tuple(states)], "a string, b string, c string")


@query("AGG13_cube_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, GROUPING(o_orderstatus) + 2 * GROUPING(o_orderpriority) AS g FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_rollup(t: Tables) -> DataFrame:
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), (F.grouping("o_orderstatus") + 2 * F.grouping("o_orderpriority")).cast("long").alias("g"))
