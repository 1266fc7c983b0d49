"""Window functions and frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import windows as w
from .registry import Tables, query

C = F.col
PART = ("user_id",)
R = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
ORDER = "PARTITION BY user_id ORDER BY ts"


def whole():
    return w.Spec(PART, (C("ts"),)).over()


def ranking():
    return w.Spec(PART, (C("ts"),)).ranking()


def running():
    return w.Spec(PART, (C("ts"),), w.rows(w.FIRST)).over()


def tied():
    return w.Spec(("event_type",), (F.floor("value"),)).ranking()


def _event(name: str, build: Callable[[], Column], sql: str, digits: int | None = None) -> None:
    def run(t: Tables) -> DataFrame:
        v = build()
        return t.events.select("event_id", (F.round(v, digits) if digits else v).alias("v"))

    query(name, f"SELECT event_id, {f'round({sql}, {digits})' if digits else sql} AS v FROM events")(run)


TIES = "PARTITION BY event_type ORDER BY floor(value)"

_event("WIN1_row_number", lambda: F.row_number().over(ranking()).cast("long"), f"row_number() OVER ({ORDER})")
_event("WIN2_rank", lambda: F.rank().over(tied()).cast("long"), f"rank() OVER ({TIES})")
_event("WIN3_dense_rank", lambda: F.dense_rank().over(tied()).cast("long"), f"dense_rank() OVER ({TIES})")
_event("WIN4_percent_rank", lambda: F.percent_rank().over(tied()), f"percent_rank() OVER ({TIES})", 8)
_event("WIN5_cume_dist", lambda: F.cume_dist().over(tied()), f"cume_dist() OVER ({TIES})", 8)
_event("WIN6_ntile", lambda: F.ntile(4).over(ranking()).cast("long"), f"ntile(4) OVER ({ORDER})")
_event("WIN7_lag", lambda: F.lag("event_id", 2, -1).over(ranking()), f"lag(event_id, 2, -1) OVER ({ORDER})")
_event("WIN8_lead", lambda: F.lead("value").over(ranking()), f"lead(value) OVER ({ORDER})")
_event("WIN9_sum", lambda: F.sum("event_id").over(running()), f"CAST(sum(event_id) OVER ({ORDER} {R}) AS BIGINT)")
_event("WIN10_count", lambda: F.count(F.nullif(C("event_type"), F.lit("click"))).over(running()), f"count(nullif(event_type, 'click')) OVER ({ORDER} {R})")
_event("WIN11_avg", lambda: F.avg("event_id").over(running()), f"avg(event_id) OVER ({ORDER} {R})", 6)
_event("WIN12_min", lambda: F.min("value").over(running()), f"min(value) OVER ({ORDER} {R})")
_event("WIN13_max", lambda: F.max("value").over(running()), f"max(value) OVER ({ORDER} {R})")
_event("WIN14_first_value", lambda: F.first_value("event_id").over(running()), f"first_value(event_id) OVER ({ORDER} {R})")
_event("WIN15_last_value", lambda: F.last_value("event_id").over(whole()), f"last_value(event_id) OVER ({ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
_event("WIN16_nth_value", lambda: F.nth_value("event_id", 3).over(whole()), f"nth_value(event_id, 3) OVER ({ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
_event("WIN17_rows_frame", lambda: F.sum("event_id").over(w.Spec(PART, (C("ts"),), w.rows(-2, 1)).over()), f"CAST(sum(event_id) OVER ({ORDER} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS BIGINT)")
_event("WIN18_range_frame", lambda: F.count("*").over(w.Spec(("event_type",), (C("event_id"),), w.range_(-50, 10)).over()), "count(*) OVER (PARTITION BY event_type ORDER BY event_id RANGE BETWEEN 50 PRECEDING AND 10 FOLLOWING)")


@query("WIN19_groups_frame", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS v FROM orders")
def groups_frame(t: Tables) -> DataFrame:
    return w.groups(t.orders, "v", F.count, F.lit(1), ["o_orderstatus"], [C("o_orderpriority")], -1).select("o_orderkey", "v")


@query("WIN20_named_window", f"SELECT event_id, row_number() OVER ({ORDER}) AS a, CAST(sum(event_id) OVER ({ORDER} {R}) AS BIGINT) AS b, count(*) OVER (PARTITION BY user_id) AS c FROM events")
def named_window(t: Tables) -> DataFrame:
    n = w.Named()
    n.define("base", partition=PART)
    n.define("ordered", "base", order=(C("ts"),))
    n.define("running", "ordered", frame=w.rows(w.FIRST))
    s = n.specs
    return t.events.select("event_id", F.row_number().over(s["ordered"].ranking()).cast("long").alias("a"), F.sum("event_id").over(s["running"].over()).alias("b"), F.count("*").over(s["base"].over()).alias("c"))


@query("WIN21_ordinal_keys", "SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS n FROM events")
def ordinal_keys(t: Tables) -> DataFrame:
    out = t.events.select("event_id", "event_type")
    key, part = out.columns[0], out.columns[1]
    return out.withColumn("n", F.row_number().over(w.Spec((part,), (F.desc(key),)).ranking()).cast("long"))
