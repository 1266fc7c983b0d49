"""Stored functions, procedures and triggers."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .q_statements import engine
from .registry import Tables, query


@query("UDF1_functions", "SELECT c_custkey, round(c_acctbal * 1.1 + c_nationkey, 4) AS v FROM customer")
def functions(t: Tables) -> DataFrame:
    e = engine(t, "customer")
    e.sql("CREATE FUNCTION fee(balance DOUBLE, nation INT) RETURNS DOUBLE RETURN balance * 1.1 + nation")
    return e.sql("SELECT c_custkey, round(fee(c_acctbal, c_nationkey), 4) AS v FROM customer")


@query("UDF2_shadowing", "SELECT 'mine x' AS v, 'upper is built in' AS message")
def shadowing(t: Tables) -> DataFrame:
    e = engine(t)
    message = ""
    try:
        e.sql("DROP FUNCTION upper")
    except ValueError as x:
        message = str(x)
    e.sql("CREATE FUNCTION ucase(s TEXT) RETURNS TEXT RETURN concat('mine ', s)")
    v = e.sql("SELECT ucase('x') AS v").first()[0]
    e.sql("DROP FUNCTION ucase")
    return t.spark.createDataFrame([(v, message)], "v string, message string")


@query("UDF3_procedure", "SELECT 110 AS a, 15 AS b")
def procedure(t: Tables) -> DataFrame:
    e = engine(t)
    e.sql("CREATE PROCEDURE p(IN x INT, OUT y INT, INOUT z INT) BEGIN SET y = x * 11; SET z = z + x; END")
    e.sql("SET @z = 5; CALL p(10, @y, @z)")
    return e.sql("SELECT @y AS a, @z AS b")


@query("UDF4_if", "SELECT 'neg' AS a, 'zero' AS b, 'pos' AS c")
def if_(t: Tables) -> DataFrame:
    e = engine(t)
    e.sql("CREATE PROCEDURE sgn(IN x INT, OUT s TEXT) BEGIN IF x < 0 THEN SET s = 'neg'; ELSEIF x = 0 THEN SET s = 'zero'; ELSE SET s = 'pos'; END IF; END")
    e.sql("CALL sgn(-4, @a); CALL sgn(0, @b); CALL sgn(9, @c)")
    return e.sql("SELECT @a AS a, @b AS b, @c AS c")


@query("UDF5_case", "SELECT 'one' AS a, 'many' AS b, 'big' AS c")
def case(t: Tables) -> DataFrame:
    e = engine(t)
    e.sql("CREATE PROCEDURE word(IN x INT, OUT s TEXT) BEGIN CASE x WHEN 1 THEN SET s = 'one'; WHEN 2 THEN SET s = 'two'; ELSE CASE WHEN x > 100 THEN SET s = 'big'; ELSE SET s = 'many'; END CASE; END CASE; END")
    e.sql("CALL word(1, @a); CALL word(7, @b); CALL word(700, @c)")
    return e.sql("SELECT @a AS a, @b AS b, @c AS c")


@query("UDF6_loops", "SELECT 10 AS w, 3 AS r, 12 AS l")
def loops(t: Tables) -> DataFrame:
    e = engine(t)
    e.sql("""
        CREATE PROCEDURE loops(OUT w INT, OUT r INT, OUT l INT) BEGIN
            DECLARE i INT DEFAULT 0;
            SET w = 0, r = 0, l = 0;
            WHILE i < 4 DO SET i = i + 1; SET w = w + i; END WHILE;
            REPEAT SET r = r + 1; UNTIL r >= 3 END REPEAT;
            SET i = 0;
            outer_loop: LOOP
                SET i = i + 1;
                IF i > 7 THEN LEAVE outer_loop; END IF;
                IF i % 2 = 1 THEN ITERATE outer_loop; END IF;
                SET l = l + i;
            END LOOP outer_loop;
        END""")
    e.sql("CALL loops(@w, @r, @l)")
    return e.sql("SELECT @w AS w, @r AS r, @l AS l")


@query("UDF7_scopes", "SELECT 1 AS outer_x, 2 AS inner_x")
def scopes(t: Tables) -> DataFrame:
    e = engine(t)
    e.sql("CREATE PROCEDURE scopes(OUT a INT, OUT b INT) BEGIN DECLARE x INT DEFAULT 1; BEGIN DECLARE x INT DEFAULT 2; SET b = x; END; SET a = x; END; CALL scopes(@a, @b)")
    return e.sql("SELECT @a AS outer_x, @b AS inner_x")


@query("UDF8_cursor", "SELECT CAST(sum(n_nationkey * n_regionkey) AS INTEGER) AS total, CAST(count(*) AS INTEGER) AS n FROM nation WHERE n_nationkey < 8")
def cursor(t: Tables) -> DataFrame:
    e = engine(t, "nation")
    e.sql("""
        CREATE PROCEDURE walk(IN most INT, OUT total INT, OUT n INT) BEGIN
            DECLARE done INT DEFAULT 0;
            DECLARE k, r INT;
            DECLARE c CURSOR FOR SELECT n_nationkey, n_regionkey FROM nation WHERE n_nationkey < most ORDER BY n_nationkey;
            DECLARE CONTINUE HANDLER FOR NOT FOUND SET done = 1;
            SET total = 0, n = 0;
            OPEN c;
            rows_: LOOP
                FETCH c INTO k, r;
                IF done = 1 THEN LEAVE rows_; END IF;
                SET total = total + k * r, n = n + 1;
            END LOOP rows_;
            CLOSE c;
        END""")
    e.sql("CALL walk(8, @total, @n)")
    return e.sql("SELECT @total AS total, @n AS n")


@query("UDF9_handlers", "SELECT 'caught, on' AS a, 'caught' AS b")
def handlers(t: Tables) -> DataFrame:
    e = engine(t)
    e.sql("CREATE TABLE u (k INT PRIMARY KEY); INSERT INTO u VALUES (1)")
    e.sql("CREATE PROCEDURE go_on(OUT s TEXT) BEGIN DECLARE CONTINUE HANDLER FOR SQLEXCEPTION SET s = 'caught'; INSERT INTO u VALUES (1); SET s = concat(s, ', on'); END")
    e.sql("CREATE PROCEDURE stop(OUT s TEXT) BEGIN DECLARE EXIT HANDLER FOR SQLEXCEPTION SET s = 'caught'; INSERT INTO u VALUES (1); SET s = 'not here'; END")
    e.sql("CALL go_on(@a); CALL stop(@b)")
    return e.sql("SELECT @a AS a, @b AS b")


@query("UDF10_local_tables", "SELECT 5 AS n, false AS left_over")
def local_tables(t: Tables) -> DataFrame:
    e = engine(t, "region")
    e.sql("CREATE PROCEDURE tmp(OUT n INT) BEGIN CREATE TEMPORARY TABLE scratch AS SELECT r_regionkey FROM region; SELECT count(*) INTO n FROM scratch; END; CALL tmp(@n)")
    n = int(e.sql("SELECT @n AS n").first()[0])
    return t.spark.createDataFrame([(n, e._key("scratch") in e.state.tables)], "n int, left_over boolean")


@query("UDF11_triggers", "SELECT 'BEFORE' AS time, 'INSERT' AS event, 'a' AS table_name, 0 AS fired")
def triggers(t: Tables) -> DataFrame:
    """Kept, and not fired."""
    e = engine(t)
    e.sql("CREATE TABLE a (k INT); CREATE TABLE log (k INT)")
    e.sql("CREATE TRIGGER tr BEFORE INSERT ON a FOR EACH ROW BEGIN INSERT INTO log VALUES (1); END")
    e.sql("INSERT INTO a VALUES (1)")
    time, event, table, _ = e.triggers["tr"]
    return t.spark.createDataFrame([(time, event, table, e.sql("SELECT * FROM log").count())], "time string, event string, table_name string, fired int")


@query("UDF12_validation", "SELECT 'no label nowhere' AS a, 'no cursor c' AS b, 2 AS sets, 1 AS loops")
def validation(t: Tables) -> DataFrame:
    from ..routines import manifest

    e = engine(t)
    messages = []
    for body in ("LEAVE nowhere;", "OPEN c;"):
        try:
            e.sql(f"CREATE PROCEDURE bad() BEGIN {body} END")
        except ValueError as x:
            messages.append(str(x))
    e.sql("CREATE PROCEDURE good(OUT x INT) BEGIN SET x = 0; WHILE x < 3 DO SET x = x + 1; END WHILE; END")
    m = manifest(e.routines["good"].body)
    return t.spark.createDataFrame([(*messages, m["set"], m["loop"])], "a string, b string, sets int, loops int")
