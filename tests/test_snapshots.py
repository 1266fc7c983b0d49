"""What the SQL comparison can't show: files that stay, plans, scripts of several lines."""

import decimal
import os

import pytest
from pyspark.sql import functions as F

from quarry.engine import Engine
from quarry.operators import limits, setops, tables
from quarry.sources import dump


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def listed(files):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for x in files for d, _, names in os.walk(x.removeprefix("file://")) for f in names}


def test_insert_leaves_old_files_as_they_are(spark):
    e = Engine(spark)
    e.sql("CREATE TABLE t (k INT PRIMARY KEY, v INT); INSERT INTO t SELECT id, id FROM range(1000)")
    first = e.table("t").files
    before = listed(first)
    e.sql("INSERT INTO t VALUES (5000, 1); INSERT IGNORE INTO t VALUES (5000, 2), (5001, 3)")
    now = e.table("t").files
    assert now[: len(first)] == first and len(now) == len(first) + 2 and listed(first) == before
    assert e.sql("SELECT count(*) AS n, sum(v) AS s FROM t").first()[:] == (1002, sum(range(1000)) + 4)
    with pytest.raises(tables.ConstraintError):
        e.sql("INSERT INTO t VALUES (7, 7)")
    assert e.table("t").files == now


def test_many_inserts_become_one_folder(spark, monkeypatch):
    monkeypatch.setattr(tables, "MANY", 3)
    e = Engine(spark)
    e.sql("CREATE TABLE t (k INT)" + "".join(f"; INSERT INTO t VALUES ({i})" for i in range(8)))
    assert len(e.table("t").files) <= 3 and sorted(r[0] for r in e.sql("SELECT k FROM t").collect()) == list(range(8))


def test_rows_that_are_computed_anew_are_hit_once(spark):
    e = Engine(spark)
    e.register("t", spark.range(500).repartition(7).select(F.col("id").alias("k"), F.lit(0).alias("v")))
    e.sql("UPDATE t SET v = 1 ORDER BY k LIMIT 50; DELETE FROM t ORDER BY k DESC LIMIT 100")
    got = {r.k: r.v for r in e.sql("SELECT * FROM t").collect()}
    assert got == {k: int(k < 50) for k in range(400)}


@pytest.fixture
def written(monkeypatch):
    """The plans of what statements write."""
    plans, cut = [], tables.cut
    monkeypatch.setattr(tables, "cut", lambda df, *more: plans.append(plan(df)) or cut(df, *more))
    return plans


def matched(spark):
    e = Engine(spark)
    e.register("s", spark.createDataFrame([(1, 5), (1, 7), (2, None), (3, 1), (None, 9)], "k int, w int"))
    e.sql("CREATE TABLE t (k INT, v VARCHAR(8)); INSERT INTO t VALUES (1, 'a'), (1, 'b'), (2, 'c'), (3, 'd'), (4, 'e'), (NULL, 'f')")
    return e


@pytest.mark.parametrize("value", ["'x'", "concat(t.v, '!')", "CAST(s.w AS STRING)"])
@pytest.mark.parametrize("form", ["UPDATE t SET v = {} FROM s WHERE t.k = s.k AND s.w > 3", "UPDATE t JOIN s ON t.k = s.k SET v = {} WHERE s.w > 3"])
def test_update_from_joins_by_its_keys(spark, written, form, value):
    e = matched(spark)
    del written[:]
    assert e.execute(form.format(value)) == 2
    assert not any("NestedLoop" in p or "Cartesian" in p for p in written)
    got = sorted(map(str, (r.v for r in e.sql("SELECT v FROM t").collect())))
    hits = {"'x'": [["x", "x"]], "concat(t.v, '!')": [["a!", "b!"]]}.get(value, [[a, b] for a in "57" for b in "57"])
    assert got in [sorted([*"cdef", *h]) for h in hits]


def test_update_from_without_equal_keys(spark):
    e = matched(spark)
    assert e.execute("UPDATE t SET v = 'x' FROM s WHERE t.k < s.w") == 5
    assert e.execute("UPDATE t SET v = 'y' FROM s WHERE t.k = s.k ORDER BY t.k DESC LIMIT 2") == 2
    assert sorted((str(r.k), r.v) for r in e.sql("SELECT * FROM t").collect()) == [("1", "x"), ("1", "x"), ("2", "y"), ("3", "y"), ("4", "x"), ("None", "f")]


def test_delete_using_joins_by_its_keys(spark, written):
    e = matched(spark)
    del written[:]
    assert e.execute("DELETE FROM t USING s WHERE t.k = s.k AND s.w > 3") == 2
    assert not any("NestedLoop" in p or "Cartesian" in p for p in written)
    assert sorted(r.v for r in e.sql("SELECT v FROM t").collect()) == ["c", "d", "e", "f"]
    assert [r.v for r in e.sql("DELETE FROM t USING s WHERE t.k = s.k ORDER BY s.w LIMIT 1 RETURNING v").collect()] == ["c"]
    assert e.execute("DELETE FROM t USING s WHERE t.k < s.w") == 2
    assert [r.v for r in e.sql("SELECT v FROM t").collect()] == ["f"]


@pytest.mark.parametrize("ties", [None, ["v"]])
def test_percent_has_no_top_k(spark, ties):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("v")).repartition(5)
    out = limits.top_percent(df, 40, [F.asc("v")], ties)
    assert "TakeOrdered" not in plan(out) and "GlobalLimit" not in plan(out)
    got = [r.v for r in out.collect()]
    assert got == sorted(x % 7 for x in range(1000))[: 400 if ties is None else 429]
    assert limits.top_percent(df, 0, [F.asc("v")], ties).count() == 0 and limits.top_percent(df.limit(0), 50, [F.asc("v")], ties).count() == 0


@pytest.mark.parametrize("op", ["=", "<>", "<", ">="])
@pytest.mark.parametrize("word", ["ANY", "ALL"])
@pytest.mark.parametrize("sub", ["SELECT y FROM s", "SELECT y FROM s WHERE y IS NOT NULL", "SELECT y FROM s WHERE y > 99", "SELECT y FROM s WHERE y = 3"])
def test_quantified(spark, op, word, sub):
    e = Engine(spark)
    e.register("t", spark.createDataFrame([(1,), (3,), (5,), (None,)], "x int"))
    e.register("s", spark.createDataFrame([(3,), (4,), (None,)], "y int"))
    values = [r[0] for r in e.sql(sub).collect()]
    one = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b}[op]

    def holds(x):
        got = [None if x is None or y is None else one(x, y) for y in values]
        return all(g is True for g in got) if word == "ALL" else any(g is True for g in got)

    df = e.sql(f"SELECT x FROM t WHERE x {op} {word} ({sub})")
    assert sorted(str(r[0]) for r in df.collect()) == sorted(str(x) for x in (1, 3, 5, None) if holds(x))
    if (op, word) != ("<>", "ALL"):
        assert "NestedLoop" not in plan(df)


def test_decimals_stay_exact(spark):
    a = spark.sql("SELECT CAST('12345678901234567.89' AS DECIMAL(20,2)) AS x")
    b = spark.sql("SELECT CAST('0.1234' AS DECIMAL(10,4)) AS x")
    assert {r[0] for r in setops.union(a, b).collect()} == {decimal.Decimal("12345678901234567.8900"), decimal.Decimal("0.1234")}
    assert {r[0] for r in setops.union(a, spark.sql("SELECT 7 AS x")).collect()} == {decimal.Decimal("12345678901234567.89"), decimal.Decimal("7.00")}


SCRIPT = """-- a dump
/*!40101 SET NAMES utf8 */;
DROP TABLE IF EXISTS `pets`;
CREATE TABLE `pets` (
  `id` int NOT NULL, -- the key
  `name` varchar(20) DEFAULT NULL,
  PRIMARY KEY (`id`)
) ENGINE=InnoDB;
LOCK TABLES `pets` WRITE;
INSERT INTO `pets` (`id`, `name`) VALUES
  (1, 'Rex; the first'),
  (2, 'O''Neil'); INSERT INTO `pets` VALUES (3, NULL);
UNLOCK TABLES;
"""


def test_scripts_of_several_lines(spark, tmp_path):
    (tmp_path / "a.sql").write_text(SCRIPT)
    got = dump.import_dump(spark, f"file://{tmp_path}/a.sql")
    assert sorted(map(tuple, got["pets"].collect())) == [(1, "Rex; the first"), (2, "O'Neil"), (3, None)]
    (tmp_path / "b.sql").write_text(SCRIPT + "DELIMITER //\nCREATE PROCEDURE p() BEGIN SELECT 1;\n SELECT 2;\nEND//\nDELIMITER ;\nINSERT INTO pets VALUES (4, 'Tom');\n")
    assert dump.import_dump(spark, f"file://{tmp_path}/b.sql")["pets"].count() == 4
    (tmp_path / "c.sql").write_text(SCRIPT + "garbage that is no statement;\n")
    with pytest.raises(Exception, match="no statement of a script"):
        dump.import_dump(spark, f"file://{tmp_path}/c.sql")["pets"].count()


def test_explain_of_mutations(spark):
    e = Engine(spark)
    e.sql("CREATE TABLE t (k INT PRIMARY KEY, v INT); INSERT INTO t VALUES (1, 1)")
    for s in ("UPDATE t SET v = 2 WHERE k = 1", "DELETE FROM t WHERE k = 1", "INSERT INTO t SELECT 2, 2"):
        lines = [r.plan for r in e.sql(f"EXPLAIN {s}").collect()]
        assert s.split()[0] in lines[0] and any("Physical Plan" in x for x in lines)
    assert e.sql("SELECT * FROM t").collect()[0][:] == (1, 1)
