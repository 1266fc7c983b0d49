"""One query for each scalar function: its value over a column of a table."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import functions as fn
from ..engine import Engine
from ..functions.text import sql_of
from .registry import Tables, query

# name, arguments of the function over the table's columns, DuckDB's expression, its type
Case = tuple[str, Callable[[], Column], str, str]

C = F.col


def _over(table: str, key: str, cases: list[Case]) -> None:
    for name, build, sql, kind in cases:
        spark_kind = {"BIGINT": "long", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date", "TIMESTAMP": "timestamp_ntz"}[kind]
        value = f"CAST({sql} AS {kind})"
        if kind == "DOUBLE":
            value = f"round({value}, 6)"

        def run(t: Tables, build: Callable[[], Column] = build, spark_kind: str = spark_kind) -> object:
            v = build().cast(spark_kind)
            v = F.round(v, 6) if spark_kind == "double" else v
            return getattr(t, table).select(C(key).alias("k"), v.alias("v"))

        def run_text(t: Tables, build: Callable[[], Column] = build, kind: str = kind) -> object:
            v = f"CAST({_text(build)} AS {'TIMESTAMP_NTZ' if kind == 'TIMESTAMP' else 'STRING' if kind == 'VARCHAR' else kind})"
            engine = Engine(t.spark)
            engine.register(table, getattr(t, table))
            return engine.sql(f"SELECT {key} AS k, {f'round({v}, 6)' if kind == 'DOUBLE' else v} AS v FROM {table}")

        oracle = f"SELECT {key} AS k, {value} AS v FROM {table}"
        query(name, oracle)(run)
        query(f"{name}_text", oracle)(run_text)


#: While a call's text is wanted: the texts of the calls inside it.
_calls: list[str] | None = None


def call(name: str, *args: object) -> Column:
    """A function of the library; or, for the SQL form of a query, a mark for the text of its call."""
    if _calls is None:
        return fn.call(name, *args)
    shown = [" ".join(sql_of(x)) if isinstance(x, Column) else "'" + x + "'" if isinstance(x, str) else str(x) for x in args]
    _calls.append(f"{name}({', '.join(shown)})")
    return F.expr(f"call__{len(_calls) - 1}")


def _text(build: Callable[[], Column]) -> str:
    """The SQL text of a query's value."""
    global _calls
    _calls = []
    try:
        out = " ".join(sql_of(build()))
        for i in reversed(range(len(_calls))):
            out = re.sub(rf"\bcall__{i}\b", lambda m, i=i: _calls[i], out)
        return out
    finally:
        _calls = None


_name, _acct, _seg = "c_name", "c_acctbal", "c_mktsegment"
NUL = "nullif(c_mktsegment, 'BUILDING')"


def nul() -> Column:
    return F.nullif(C(_seg), F.lit("BUILDING"))


_over("customer", "c_custkey", [
    ("STR1_ascii", lambda: call("ascii", C(_name)), "ascii(c_name)", "BIGINT"),
    ("STR2_char_length", lambda: call("char_length", nul()), f"length({NUL})", "BIGINT"),
    ("STR3_concat", lambda: call("concat", C(_name), "-", nul()), f"c_name || '-' || {NUL}", "VARCHAR"),
    ("STR4_concat_ws", lambda: call("concat_ws", "|", C(_name), nul(), C(_seg)), f"concat_ws('|', c_name, {NUL}, c_mktsegment)", "VARCHAR"),
    ("STR5_field", lambda: call("field", nul(), "machinery", "AUTOMOBILE", "household"), f"coalesce(list_position(['machinery', 'automobile', 'household'], lower({NUL})), 0)", "BIGINT"),
    ("STR6_find_in_set", lambda: call("find_in_set", C(_seg), "furniture,machinery,building"), "coalesce(list_position(['furniture', 'machinery', 'building'], lower(c_mktsegment)), 0)", "BIGINT"),
    ("STR7_format", lambda: call("format", F.floor(C(_acct)), 0), "format('{:,}', CAST(floor(c_acctbal) AS BIGINT))", "VARCHAR"),
    ("STR8_insert", lambda: call("insert", C(_name), 3, 4, "XY"), "left(c_name, 2) || 'XY' || substr(c_name, 7)", "VARCHAR"),
    ("STR9_instr", lambda: call("instr", C(_seg), "in"), "instr(lower(c_mktsegment), 'in')", "BIGINT"),
    ("STR10_left", lambda: call("left", C(_name), 5), "left(c_name, 5)", "VARCHAR"),
    ("STR11_length", lambda: call("length", F.concat(C(_name), F.lit("é"))), "strlen(c_name || 'é')", "BIGINT"),
    ("STR12_locate", lambda: call("locate", "I", C(_seg), 3), "CASE WHEN instr(substr(lower(c_mktsegment), 3), 'i') > 0 THEN instr(substr(lower(c_mktsegment), 3), 'i') + 2 ELSE 0 END", "BIGINT"),
    ("STR13_lpad", lambda: call("lpad", nul(), 12, "*"), f"lpad({NUL}, 12, '*')", "VARCHAR"),
    ("STR14_rpad", lambda: call("rpad", nul(), 12, "*"), f"rpad({NUL}, 12, '*')", "VARCHAR"),
    ("STR15_ltrim", lambda: call("ltrim", F.concat(F.lit("  "), C(_name), F.lit(" "))), "ltrim('  ' || c_name || ' ', ' ')", "VARCHAR"),
    ("STR16_mid", lambda: call("mid", C(_name), -4, 2), "substr(c_name, -4, 2)", "VARCHAR"),
    ("STR17_position", lambda: call("position", "r", C(_seg)), "instr(lower(c_mktsegment), 'r')", "BIGINT"),
    ("STR18_repeat", lambda: call("repeat", C(_seg), 2), "repeat(c_mktsegment, 2)", "VARCHAR"),
    ("STR19_replace", lambda: call("replace", C(_name), "0", "o"), "replace(c_name, '0', 'o')", "VARCHAR"),
    ("STR20_reverse", lambda: call("reverse", C(_name)), "reverse(c_name)", "VARCHAR"),
    ("STR21_right", lambda: call("right", C(_name), 3), "right(c_name, 3)", "VARCHAR"),
    ("STR22_rtrim", lambda: call("rtrim", F.concat(F.lit(" "), C(_name), F.lit("  "))), "rtrim(' ' || c_name || '  ', ' ')", "VARCHAR"),
    ("STR23_space", lambda: call("concat", "[", call("space", C("c_nationkey") % 4), "]"), "'[' || repeat(' ', c_nationkey % 4) || ']'", "VARCHAR"),
    ("STR24_substr", lambda: call("substr", C(_name), C("c_nationkey") % 5, 3), "CASE WHEN c_nationkey % 5 = 0 THEN '' ELSE substr(c_name, c_nationkey % 5, 3) END", "VARCHAR"),
    ("STR25_upper", lambda: call("ucase", C(_name)), "upper(c_name)", "VARCHAR"),
    ("STR26_lower", lambda: call("lcase", C(_seg)), "lower(c_mktsegment)", "VARCHAR"),
    ("STR27_substring_index", lambda: call("substring_index", C(_name), "#", -1), "list_extract(string_split(c_name, '#'), -1)", "VARCHAR"),
    ("STR28_trim", lambda: call("trim", "ab", F.concat(F.lit("abab"), C(_seg), F.lit("ab"))), "regexp_replace(regexp_replace('abab' || c_mktsegment || 'ab', '^(?:ab)+', ''), '(?:ab)+$', '')", "VARCHAR"),
    ("MTH1_abs", lambda: call("abs", C(_acct)), "abs(c_acctbal)", "DOUBLE"),
    ("MTH2_acos", lambda: call("acos", C(_acct) / 5000), "CASE WHEN abs(c_acctbal / 5000) <= 1 THEN acos(c_acctbal / 5000) END", "DOUBLE"),
    ("MTH3_asin", lambda: call("asin", C(_acct) / 5000), "CASE WHEN abs(c_acctbal / 5000) <= 1 THEN asin(c_acctbal / 5000) END", "DOUBLE"),
    ("MTH4_atan", lambda: call("atan", C(_acct)), "atan(c_acctbal)", "DOUBLE"),
    ("MTH5_atan2", lambda: call("atan2", C(_acct), C("c_nationkey")), "atan2(c_acctbal, c_nationkey)", "DOUBLE"),
    ("MTH6_avg", lambda: call("avg", C(_acct), F.nullif(C("c_nationkey"), F.lit(3)), 1), "(c_acctbal + coalesce(nullif(c_nationkey, 3), 0) + 1) / CASE WHEN c_nationkey = 3 THEN 2 ELSE 3 END", "DOUBLE"),
    ("MTH7_ceil", lambda: call("ceiling", C(_acct)), "ceil(c_acctbal)", "DOUBLE"),
    ("MTH8_cos", lambda: call("cos", C(_acct)), "cos(c_acctbal)", "DOUBLE"),
    ("MTH9_count", lambda: call("count", C(_acct), nul(), 1), "CASE WHEN c_mktsegment = 'BUILDING' THEN 2 ELSE 3 END", "BIGINT"),
    ("MTH10_cot", lambda: call("cot", C("c_nationkey")), "CASE WHEN tan(c_nationkey) <> 0 THEN 1 / tan(c_nationkey) END", "DOUBLE"),
    ("MTH11_degrees", lambda: call("degrees", C("c_nationkey")), "degrees(c_nationkey)", "DOUBLE"),
    ("MTH12_div", lambda: call("div", C(_acct), C("c_nationkey")), "CASE WHEN c_nationkey <> 0 THEN trunc(c_acctbal / c_nationkey) END", "BIGINT"),
    ("MTH13_exp", lambda: call("exp", C("c_nationkey") / 10), "exp(c_nationkey / 10)", "DOUBLE"),
    ("MTH14_floor", lambda: call("floor", C(_acct)), "floor(c_acctbal)", "DOUBLE"),
    ("MTH15_greatest", lambda: call("greatest", C(_acct), F.nullif(C("c_nationkey"), F.lit(3)), 1000), "CASE WHEN c_nationkey <> 3 THEN greatest(c_acctbal, c_nationkey, 1000) END", "DOUBLE"),
    ("MTH16_least", lambda: call("least", C(_acct), F.nullif(C("c_nationkey"), F.lit(3)), 1000), "CASE WHEN c_nationkey <> 3 THEN least(c_acctbal, c_nationkey, 1000) END", "DOUBLE"),
    ("MTH17_ln", lambda: call("ln", C(_acct)), "CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END", "DOUBLE"),
    ("MTH18_log", lambda: call("log", C("c_nationkey"), C("c_custkey")), "CASE WHEN c_nationkey > 1 AND c_custkey > 0 THEN ln(c_custkey) / ln(c_nationkey) END", "DOUBLE"),
    ("MTH19_log10", lambda: call("log10", C(_acct)), "CASE WHEN c_acctbal > 0 THEN log10(c_acctbal) END", "DOUBLE"),
    ("MTH20_log2", lambda: call("log2", C(_acct)), "CASE WHEN c_acctbal > 0 THEN log2(c_acctbal) END", "DOUBLE"),
    ("MTH21_max", lambda: call("max", C(_acct), F.nullif(C("c_nationkey"), F.lit(3)), 1000), "greatest(c_acctbal, coalesce(nullif(c_nationkey, 3), -1e9), 1000)", "DOUBLE"),
    ("MTH22_min", lambda: call("min", C(_acct), F.nullif(C("c_nationkey"), F.lit(3)), 1000), "least(c_acctbal, coalesce(nullif(c_nationkey, 3), 1e9), 1000)", "DOUBLE"),
    ("MTH23_mod", lambda: call("mod", F.floor(C(_acct)), C("c_nationkey")), "CASE WHEN c_nationkey <> 0 THEN CAST(floor(c_acctbal) AS BIGINT) % c_nationkey END", "DOUBLE"),
    ("MTH24_pi", lambda: call("pi"), "pi()", "DOUBLE"),
    ("MTH25_pow", lambda: call("power", C("c_nationkey"), 3), "pow(c_nationkey, 3)", "DOUBLE"),
    ("MTH26_radians", lambda: call("radians", C(_acct)), "radians(c_acctbal)", "DOUBLE"),
    ("MTH28_round", lambda: call("round", C(_acct), 1), "round(c_acctbal, 1)", "DOUBLE"),
    ("MTH29_sign", lambda: call("sign", C(_acct)), "sign(c_acctbal)", "BIGINT"),
    ("MTH30_sin", lambda: call("sin", C(_acct)), "sin(c_acctbal)", "DOUBLE"),
    ("MTH31_sqrt", lambda: call("sqrt", C(_acct)), "CASE WHEN c_acctbal >= 0 THEN sqrt(c_acctbal) END", "DOUBLE"),
    ("MTH32_sum", lambda: call("sum", C(_acct), F.nullif(C("c_nationkey"), F.lit(3)), 1), "c_acctbal + coalesce(nullif(c_nationkey, 3), 0) + 1", "DOUBLE"),
    ("MTH33_tan", lambda: call("tan", C("c_nationkey")), "tan(c_nationkey)", "DOUBLE"),
    ("MTH34_truncate", lambda: call("truncate", C(_acct), -2), "trunc(c_acctbal / 100) * 100", "DOUBLE"),
    ("ADV1_bin", lambda: call("bin", C("c_custkey")), "bin(c_custkey)", "VARCHAR"),
    ("ADV2_binary", lambda: call("binary", C(_name)), "c_name", "VARCHAR"),
    ("ADV3_case", lambda: call("case", C(_acct) < 0, "debt", C(_acct) < 1000, "low", "high"), "CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' ELSE 'high' END", "VARCHAR"),
    ("ADV4_cast", lambda: call("cast", C("c_custkey"), "string"), "c_custkey", "VARCHAR"),
    ("ADV5_coalesce", lambda: call("coalesce", nul(), "none"), f"coalesce({NUL}, 'none')", "VARCHAR"),
    ("ADV6_connection_id", lambda: call("connection_id"), "1", "BIGINT"),
    ("ADV7_conv", lambda: call("conv", C("c_custkey"), 10, 16), "upper(to_base(c_custkey, 16))", "VARCHAR"),
    ("ADV8_convert", lambda: call("convert", C("c_custkey"), "string"), "c_custkey", "VARCHAR"),
    ("ADV9_current_user", lambda: call("current_user"), "'root@localhost'", "VARCHAR"),
    ("ADV10_database", lambda: call("database"), "NULL", "VARCHAR"),
    ("ADV11_if", lambda: call("if", C("c_nationkey"), "yes", "no"), "CASE WHEN c_nationkey <> 0 THEN 'yes' ELSE 'no' END", "VARCHAR"),
    ("ADV12_ifnull", lambda: call("ifnull", nul(), "none"), f"ifnull({NUL}, 'none')", "VARCHAR"),
    ("ADV13_isnull", lambda: call("isnull", nul()), "CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END", "BIGINT"),
    ("ADV14_last_insert_id", lambda: call("last_insert_id", 7), "7", "BIGINT"),
    ("ADV15_nullif", lambda: call("nullif", C(_seg), "BUILDING"), NUL, "VARCHAR"),
    ("ADV16_session_user", lambda: call("session_user"), "'root'", "VARCHAR"),
    ("ADV17_system_user", lambda: call("system_user"), "'root@localhost'", "VARCHAR"),
    ("ADV18_user", lambda: call("user"), "'root@localhost'", "VARCHAR"),
    ("ADV19_version", lambda: call("version"), "'1.0.0'", "VARCHAR"),
    ("GEO1_distance", lambda: call("distance", C("c_nationkey") * 15 - 180, C("c_nationkey") * 3 - 40, 170, 10), "2 * 6371 * asin(sqrt(least(1.0, pow(sin(radians(10 - (c_nationkey * 3 - 40)) / 2), 2) + cos(radians(c_nationkey * 3 - 40)) * cos(radians(10)) * pow(sin(radians(170 - (c_nationkey * 15 - 180)) / 2), 2))))", "DOUBLE"),
])

_date = "o_orderdate"
_over("orders", "o_orderkey", [
    ("DAT1_adddate", lambda: call("date_add", C(_date), 10), "CAST(o_orderdate AS DATE) + 10", "DATE"),
    ("DAT2_addtime", lambda: call("addtime", C(_date), "01:30:05"), "o_orderdate + INTERVAL 5405 SECOND", "TIMESTAMP"),
    ("DAT5_date", lambda: call("date", C(_date)), "CAST(o_orderdate AS DATE)", "DATE"),
    ("DAT6_datediff", lambda: call("datediff", C(_date), "1996-01-01"), "datediff('day', DATE '1996-01-01', CAST(o_orderdate AS DATE))", "BIGINT"),
    ("DAT7_date_format", lambda: call("date_format", C(_date), "%Y/%m/%d day %j"), "strftime(o_orderdate, '%Y/%m/%d day %j')", "VARCHAR"),
    ("DAT8_day", lambda: call("day", C(_date)), "day(o_orderdate)", "BIGINT"),
    ("DAT9_dayname", lambda: call("dayname", C(_date)), "left(dayname(o_orderdate), 3)", "VARCHAR"),
    ("DAT10_dayofmonth", lambda: call("dayofmonth", C(_date)), "dayofmonth(o_orderdate)", "BIGINT"),
    ("DAT11_dayofweek", lambda: call("dayofweek", C(_date)), "dayofweek(o_orderdate) + 1", "BIGINT"),
    ("DAT12_dayofyear", lambda: call("dayofyear", C(_date)), "dayofyear(o_orderdate)", "BIGINT"),
    ("DAT13_extract", lambda: call("extract", "year_month", C(_date)), "year(o_orderdate) * 100 + month(o_orderdate)", "BIGINT"),
    ("DAT14_from_days", lambda: call("from_days", C("o_orderkey") + 700000), "DATE '1970-01-01' + CAST(o_orderkey + 700000 - 719528 AS INTEGER)", "DATE"),
    ("DAT15_hour", lambda: call("hour", C(_date)), "hour(o_orderdate)", "BIGINT"),
    ("DAT16_last_day", lambda: call("last_day", C(_date)), "last_day(o_orderdate)", "DATE"),
    ("DAT19_makedate", lambda: call("makedate", 2023, C("o_orderkey") % 400), "CASE WHEN o_orderkey % 400 BETWEEN 1 AND 365 THEN DATE '2023-01-01' + CAST(o_orderkey % 400 - 1 AS INTEGER) END", "DATE"),
    ("DAT20_maketime", lambda: call("maketime", C("o_orderkey") % 30, C("o_orderkey") % 60, 7), "printf('%02d:%02d:07', o_orderkey % 30, o_orderkey % 60)", "VARCHAR"),
    ("DAT25_period_add", lambda: call("period_add", 202311, C("o_orderkey") % 20), "strftime(DATE '2023-11-01' + to_months(CAST(o_orderkey % 20 AS INTEGER)), '%Y%m')", "BIGINT"),
    ("DAT26_period_diff", lambda: call("period_diff", call("extract", "year_month", C(_date)), 199001), "(year(o_orderdate) - 1990) * 12 + month(o_orderdate) - 1", "BIGINT"),
    ("DAT27_quarter", lambda: call("quarter", C(_date)), "quarter(o_orderdate)", "BIGINT"),
    ("DAT28_sec_to_time", lambda: call("sec_to_time", -C("o_orderkey")), "CASE WHEN o_orderkey = 0 THEN '' ELSE '-' END || printf('%02d:%02d:%02d', o_orderkey // 3600, o_orderkey // 60 % 60, o_orderkey % 60)", "VARCHAR"),
    ("DAT30_str_to_date", lambda: call("str_to_date", call("date_format", C(_date), "%d.%m.%Y"), "%d.%m.%Y"), "date_trunc('day', o_orderdate)", "TIMESTAMP"),
    ("DAT31_subdate", lambda: call("date_sub", C(_date), 10), "CAST(o_orderdate AS DATE) - 10", "DATE"),
    ("DAT32_subtime", lambda: call("subtime", C(_date), 90), "o_orderdate - INTERVAL 90 SECOND", "TIMESTAMP"),
    ("DAT39_to_days", lambda: call("to_days", C(_date)), "datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 719528", "BIGINT"),
    ("DAT41_week", lambda: call("week", C(_date)), "weekofyear(o_orderdate)", "BIGINT"),
    ("DAT42_weekday", lambda: call("weekday", C(_date)), "(dayofweek(o_orderdate) + 6) % 7", "BIGINT"),
    ("DAT43_weekofyear", lambda: call("weekofyear", C(_date)), "weekofyear(o_orderdate)", "BIGINT"),
    ("DAT44_year", lambda: call("year", C(_date)), "year(o_orderdate)", "BIGINT"),
    ("DAT45_yearweek", lambda: call("yearweek", C(_date)), "isoyear(o_orderdate) * 100 + weekofyear(o_orderdate)", "BIGINT"),
    ("DAT23_month", lambda: call("month", C(_date)), "month(o_orderdate)", "BIGINT"),
])

_over("events", "event_id", [
    ("DAT21_microsecond", lambda: call("microsecond", C("ts")), "microsecond(ts) % 1000000", "BIGINT"),
    ("DAT22_minute", lambda: call("minute", C("ts")), "minute(ts)", "BIGINT"),
    ("DAT29_second", lambda: call("second", C("ts")), "second(ts)", "BIGINT"),
    ("DAT34_time_format", lambda: call("time_format", C("ts"), "%H-%i-%s"), "strftime(ts, '%H-%M-%S')", "VARCHAR"),
    ("DAT35_time_to_sec", lambda: call("time_to_sec", C("ts")), "hour(ts) * 3600 + minute(ts) * 60 + second(ts)", "BIGINT"),
    ("DAT36_time", lambda: call("time", C("ts")), "strftime(ts, '%H:%M:%S')", "VARCHAR"),
    ("DAT37_timediff", lambda: call("timediff", F.date_trunc("second", C("ts")), "2024-01-01 00:00:00"), "epoch(date_trunc('second', ts)) - epoch(TIMESTAMP '2024-01-01')", "BIGINT"),
    ("DAT38_timestamp", lambda: call("timestamp", C("ts"), "10:00:00"), "date_trunc('day', ts) + INTERVAL 10 HOUR", "TIMESTAMP"),
])


def _now(name: str, function: str, sql: str, check: Callable[[Column], Column]) -> None:
    """Functions of the present: what can be said of them whatever the time."""
    query(name, f"SELECT {sql} AS ok")(lambda t: t.spark.range(1).select(check(call(function)).alias("ok")))
    query(f"{name}_text", f"SELECT {sql} AS ok")(lambda t: Engine(t.spark).sql(f"SELECT {function}() AS v").select(check(C("v")).alias("ok")))


_now("DAT3_curdate", "curdate", "true", lambda v: v == F.current_date())
_now("DAT4_curtime", "curtime", "true", lambda v: v.rlike(r"^\d\d:\d\d:\d\d$"))
_now("DAT17_localtime", "localtime", "true", lambda v: v == F.localtimestamp())
_now("DAT18_localtimestamp", "localtimestamp", "true", lambda v: v == F.localtimestamp())
_now("DAT24_now", "now", "true", lambda v: v == F.current_timestamp())
_now("DAT33_sysdate", "sysdate", "true", lambda v: v == F.current_timestamp())
_now("DAT40_unix_timestamp", "unix_timestamp", "true", lambda v: v == F.unix_timestamp())
_now("CUS2_newuuid", "newuuid", "true", lambda v: v.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"))


@query("MTH27_rand", "SELECT c_custkey AS k, true AS ok FROM customer")
def rand(t: Tables):
    """Values differ between engines; that they are in range doesn't."""
    r = call("rand", 7)
    return t.customer.select(C("c_custkey").alias("k"), ((r >= 0) & (r < 1)).alias("ok"))


@query("CUS1_lookup", "SELECT n_nationkey AS k, coalesce(CASE WHEN r_regionkey < 3 THEN r_name END, 'other') AS v FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def lookup(t: Tables):
    from ..operators import joins

    bound = joins.lookup(t.nation, t.region.where("r_regionkey < 3"), "region", "n_regionkey", "r_regionkey", ["r_name"])
    return bound.select(C("n_nationkey").alias("k"), call("lookup", "region", C("n_regionkey"), "r_name", "other").alias("v"))
