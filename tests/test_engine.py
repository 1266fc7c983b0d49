"""The engine on small literal cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarry import routines
from quarry.engine import Engine
from quarry.functions import REGISTRY, call
from quarry.operators import cte, limits, predicates, setops
from quarry.operators.tables import ConstraintError
from quarry.plans import dialect
from quarry.sources import dump


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


@pytest.mark.parametrize(
    ("name", "args", "want"),
    [
        ("week", ("2024-01-01",), 1),
        ("weekday", ("2024-01-01",), 0),
        ("dayofweek", ("2024-01-01",), 2),
        ("period_add", (202312, 2), 202402),
        ("period_add", (202313, 2), None),
        ("yearweek", ("2024-01-01",), 202401),
        ("makedate", (2023, 366), None),
        ("maketime", (-30, 5, 7), "-30:05:07"),
        ("timediff", ("10:00:01", "09:59:59"), 2),
        ("from_days", (719528,), dt.date(1970, 1, 1)),
        ("str_to_date", ("03.02.2021", "%d.%m.%Y"), dt.datetime(2021, 2, 3)),
        ("ascii", ("é",), 195),
        ("ascii", ("",), 0),
        ("length", ("é",), 2),
        ("concat", ("a", None), None),
        ("concat_ws", (",", "a", None, "b"), "a,b"),
        ("field", ("B", "a", "b"), 2),
        ("find_in_set", ("a,b", "a,b"), 0),
        ("format", (1234567.891, 2, "de_DE"), "1.234.567,89"),
        ("format", (1234.5, 1), "1,234.5"),
        ("insert", ("Quadratic", 3, 4, "What"), "QuWhattic"),
        ("insert", ("abc", 9, 1, "x"), "abc"),
        ("lpad", ("a", 3, ""), None),
        ("lpad", ("abc", -1, "x"), None),
        ("substr", ("hello", 0, 2), ""),
        ("substr", ("hello", -9, 2), ""),
        ("substring_index", ("a.b.c", ".", -2), "b.c"),
        ("substring_index", ("a.b.c", "", 1), ""),
        ("trim", ("xy", "xyxyaxy"), "a"),
        ("repeat", ("a", -1), ""),
        ("acos", (2,), None),
        ("log", (1, 5), None),
        ("ln", (0,), None),
        ("pow", (10, 400), None),
        ("div", (7, 0), None),
        ("div", (-7, 2), -3),
        ("mod", (-7, 3), -1.0),
        ("round", (2.5,), 3.0),
        ("round", (-2.5,), -3.0),
        ("round", (1250, -2), 1300.0),
        ("truncate", (-1.999, 1), -1.9),
        ("greatest", (1, None), None),
        ("max", (1, None, 3), 3.0),
        ("sum", (None, None), None),
        ("bin", (-1,), "1" * 64),
        ("conv", ("ff", 16, 10), "255"),
        ("conv", ("-17", 10, 16), "-11"),
        ("if", ("false", 1, 2), 2),
        ("isnull", (None,), 1),
        ("distance", (179.5, 0, -179.5, 0), pytest.approx(111.19, abs=0.01)),
    ],
)
def test_functions(spark, name, args, want):
    keep = {("str_to_date", 1), ("conv", 1), ("conv", 2)}
    cols = [a if (name, i) in keep else F.lit(a) for i, a in enumerate(args)]
    assert one(spark, call(name, *cols)) == want


def test_function_names():
    assert len(REGISTRY) == 141
    with pytest.raises(ValueError, match="ROUND takes 1 to 2 arguments"):
        call("`Round`", 1, 2, 3)
    with pytest.raises(ValueError, match="unknown function"):
        call("nothing")


def test_three_valued_logic(spark):
    p = F.lit(None).cast("int") > 1
    assert one(spark, ~p) is None
    assert one(spark, ~predicates.two_valued(p)) is True


def test_scalar_subquery_of_two_rows(spark):
    with pytest.raises(Exception, match="more than one row"):
        predicates.scalar(spark.range(3), "id", ">", spark.range(2)).collect()


def test_limits(spark):
    df = spark.createDataFrame([(1, 99), (2, 90), (3, 90), (4, 80)], "id int, score int")
    ties = limits.top(df, 2, [F.desc("score")], ["score"])
    assert sorted(r.id for r in ties.collect()) == [1, 2, 3]
    assert limits.percent_rows(4, 30) == 2
    assert limits.limit(df, 0).count() == 0


def test_set_types(spark):
    a, b = spark.sql("SELECT 1 AS a"), spark.sql("SELECT 'x'")
    assert sorted(r.a for r in setops.union(a, b).collect()) == ["1", "x"]
    with pytest.raises(ValueError, match="don't go together"):
        setops.union(spark.sql("SELECT x'00' AS a"), b)
    with pytest.raises(ValueError, match="collations"):
        setops.collation("latin1_bin", "utf8_bin")


def test_guardrails(spark):
    with pytest.raises(cte.RecursionLimit, match="rows"):
        cte.recursive(spark.range(3), lambda r: r, guards=cte.Guards(max_rows=5))
    with pytest.raises(ValueError, match="from 1"):
        cte.set_guards(cte.Guards(), max_rows=-1)
    with pytest.raises(ValueError, match="SESSION"):
        Engine(spark).sql("SET GLOBAL x = 1")


def test_slices_with_nulls(spark):
    e = Engine(spark)
    e.sql("CREATE TABLE orders (id BIGINT PRIMARY KEY, region VARCHAR(8), product VARCHAR(8), qty INT)")
    e.sql("INSERT INTO orders VALUES (1, 'EU', 'A', 10), (2, 'EU', 'A', 20), (3, 'US', 'B', 7), (4, NULL, 'B', NULL), (5, ' ', 'B', 4)")
    e.sql("CREATE OLAPVIEW v USING region, product AS SELECT id, region, product, qty FROM orders")
    got = [tuple(r) for r in e.sql("SHOW SLICES FROM v").collect()]
    assert got == [(None, "B", 2, 4.0, 4.0, 4.0, 4.0), ("EU", "A", 2, 30.0, 10.0, 20.0, 15.0), ("US", "B", 1, 7.0, 7.0, 7.0, 7.0)]


def test_failed_statement_changes_nothing(spark):
    e = Engine(spark)
    e.sql("CREATE TABLE t (k INT PRIMARY KEY, v INT NOT NULL); INSERT INTO t VALUES (1, 1), (2, 2)")
    for bad in ("INSERT INTO t VALUES (3, 3), (1, 9)", "UPDATE t SET k = 1", "INSERT INTO t VALUES (4, NULL)", "ALTER TABLE t DROP COLUMN k", "INSERT INTO t VALUES (5, 5) ON DUPLICATE KEY UPDATE k = 6"):
        with pytest.raises(ConstraintError):
            e.sql(bad)
    assert [tuple(r) for r in e.sql("SELECT * FROM t ORDER BY k").collect()] == [(1, 1), (2, 2)]
    assert e.execute("UPDATE t SET v = v + 1 WHERE k > 1") == 1


def test_script_reader(spark):
    text = """
    -- a dump; with a remark
    SET NAMES utf8;
    CREATE TABLE `t` (`id` int NOT NULL, `s` varchar(20), PRIMARY KEY (`id`)) ENGINE=x;
    INSERT INTO `t` VALUES (1,'it''s; \\'q\\''),(2,NULL);
    DELIMITER //
    CREATE PROCEDURE p() BEGIN SELECT 1; END//
    DELIMITER ;
    INSERT INTO t (s, id) VALUES ('x,(y)', 3);
    """
    assert len(list(dump.statements(text))) == 5
    got = sorted(tuple(r) for r in dump.read_script(spark, text)["t"].collect())
    assert got == [(1, "it's; 'q'"), (2, None), (3, "x,(y)")]


def test_dump_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a'b\\c\nd", 1.5), (2, None, None)], "k int, s string, d double")
    dump.export_table(df, "t", f"file://{tmp_path}/d")
    assert sorted(dump.import_dump(spark, f"file://{tmp_path}/d")["t"].collect()) == sorted(df.collect())


def test_split_keeps_routines_together():
    text = "CREATE PROCEDURE p() BEGIN IF 1 THEN SET @a = 1; END IF; WHILE 0 DO SET @b = 2; END WHILE; END; SELECT 1; CREATE TABLE IF NOT EXISTS t (k INT); SELECT 2"
    assert len(routines.split(text)) == 4


def test_named_window_override():
    s = dialect.select(dialect.tokens("SELECT sum(x) OVER (w ORDER BY b ROWS 2 PRECEDING) FROM t WINDOW w AS (PARTITION BY a ORDER BY c)"))
    assert s.text == "SELECT sum(x) OVER (PARTITION BY a ORDER BY b ROWS 2 PRECEDING) FROM t"


def test_plans(spark):
    """Filters and columns reach the scan; a broadcast or a sort merge join, no cartesian product."""
    path = "/root/testdata/sf0.001/lineitem.parquet"
    df = spark.read.parquet(path).where("l_quantity > 40").select("l_orderkey")
    plan = df._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,40.0)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan
