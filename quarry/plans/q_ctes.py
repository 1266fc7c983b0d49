"""Common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cte
from .registry import Tables, query

C = F.col


@query("CTE1_with", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 150000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT c_name, n FROM per JOIN customer ON o_custkey = c_custkey")
def with_(t: Tables) -> DataFrame:
    return t.views("orders", "customer").sql("WITH big AS (SELECT * FROM orders WHERE o_totalprice > 150000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT c_name, n FROM per JOIN customer ON o_custkey = c_custkey")


@query("CTE2_recursive_all", "WITH RECURSIVE r AS (SELECT n_nationkey AS id, 0 AS depth FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n_nationkey, depth + 1 FROM r JOIN nation ON n_nationkey = id + 1 WHERE depth < 10) SELECT id, depth FROM r")
def recursive_all(t: Tables) -> DataFrame:
    return cte.recursive(
        t.nation.where("n_nationkey = 0").select(C("n_nationkey").alias("id"), F.lit(0).alias("depth")),
        lambda r: r.where("depth < 10").join(t.nation, C("n_nationkey") == C("id") + 1).select("n_nationkey", C("depth") + 1),
    )


@query("CTE3_recursive_distinct", "WITH RECURSIVE r AS (SELECT 1 AS node UNION SELECT (n_nationkey * 3 + 1) % 25 FROM r JOIN nation ON n_nationkey = node) SELECT node FROM r")
def recursive_distinct(t: Tables) -> DataFrame:
    return cte.recursive(
        t.spark.range(1).select(F.lit(1).alias("node")),
        lambda r: r.join(t.nation, C("n_nationkey") == C("node")).select(((C("n_nationkey") * 3 + 1) % 25).alias("node")),
        distinct=True,
    )


@query("CTE4_guardrails", "SELECT 'over 5 iterations' AS message, 'a frontier of UNION ALL came twice' AS repeated, 128 AS max_iterations, 50000 AS max_rows")
def guardrails(t: Tables) -> DataFrame:
    messages = []
    for step, guards in ((lambda r: r.selectExpr("id + 1 AS id"), cte.Guards(max_iterations=5)), (lambda r: r.selectExpr("(id + 1) % 3 AS id"), cte.Guards())):
        try:
            cte.recursive(t.spark.range(1), step, guards=guards)
        except cte.RecursionLimit as e:
            messages.append(str(e))
    g = cte.Guards()
    return t.spark.createDataFrame([(*messages, g.max_iterations, g.max_rows)], "message string, repeated string, max_iterations int, max_rows int")


@query("CTE5_variables", "SELECT * FROM (VALUES ('cte.detect_repeats', '1'), ('cte.max_iterations', '9'), ('cte.max_rows', '50000'), ('cte.timeout', '0')) v(name, value)")
def variables(t: Tables) -> DataFrame:
    from ..engine import Engine

    e = Engine(t.spark)
    e.sql("SET SESSION cte.max_iterations = 9")
    try:
        e.sql("SET cte.max_rows = 7, cte.max_iterations = -1")  # changes nothing, as one value is out of range
    except ValueError:
        pass
    return e.sql("SHOW VARIABLES LIKE 'cte.%'")
