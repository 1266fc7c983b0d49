"""Statements: data, definitions, the session.  Each query ends with a table that SQL can give too."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .registry import Tables, query


def engine(t: Tables, *names: str, **primary: tuple[str, ...]):
    from ..engine import Engine

    e = Engine(t.spark)
    for n in names:
        e.register(n, getattr(t, n), primary.get(n, ()))
    return e


ACCOUNTS = "CREATE TABLE accounts (id BIGINT PRIMARY KEY, name VARCHAR(40), balance DOUBLE NOT NULL DEFAULT 0, tier VARCHAR(8) DEFAULT 'basic')"
FILL = "INSERT INTO accounts (id, name, balance) SELECT c_custkey, c_name, c_acctbal FROM customer"
BASE = "(SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, 'basic' AS tier FROM customer)"


def accounts(t: Tables):
    e = engine(t, "customer", "orders", "nation")
    e.sql(f"{ACCOUNTS}; {FILL}")
    return e


def _final(name: str, statements: str, sql: str) -> None:
    """What a table holds after some statements."""

    def run(t: Tables) -> DataFrame:
        e = accounts(t)
        e.sql(statements)
        return e.sql("SELECT id, name, balance, tier FROM accounts")

    query(name, sql)(run)


def _returned(name: str, statement: str, sql: str) -> None:
    """What the last of some statements returns."""
    query(name, sql)(lambda t: accounts(t).sql(statement))


_final(
    "DML1_insert_values",
    "INSERT INTO accounts VALUES (9000001001, 'Ann', 5.5, 'gold'), (9000001002, 'Bo', 6, DEFAULT); INSERT INTO accounts SET id = 9000001003, name = 'Cy'; INSERT INTO accounts (id) VALUES (9000001004)",
    f"SELECT * FROM {BASE} UNION ALL SELECT * FROM (VALUES (9000001001, 'Ann', 5.5, 'gold'), (9000001002, 'Bo', 6, 'basic'), (9000001003, 'Cy', 0, 'basic'), (9000001004, NULL, 0, 'basic'))",
)
_final("DML2_insert_select", "INSERT INTO accounts (id, name, balance) SELECT o_orderkey + 1000000000, o_orderpriority, o_totalprice FROM orders", f"SELECT * FROM {BASE} UNION ALL SELECT o_orderkey + 1000000000, o_orderpriority, o_totalprice, 'basic' FROM orders")
_final("DML3_insert_ignore", "INSERT IGNORE INTO accounts (id, name) VALUES (1, 'clash'), (9000002001, 'first'), (9000002001, 'second')", f"SELECT * FROM {BASE} UNION ALL SELECT 9000002001, 'first', 0, 'basic'")
_final("DML4_replace", "REPLACE INTO accounts (id, name, balance, tier) VALUES (1, 'one', 1, 'new'), (2, 'two', 2, 'new'), (2, 'two again', 3, 'new')", f"SELECT * FROM {BASE} WHERE id NOT IN (1, 2) UNION ALL SELECT * FROM (VALUES (1, 'one', 1.0, 'new'), (2, 'two again', 3.0, 'new'))")
_final(
    "DML5_upsert",
    "INSERT INTO accounts (id, name, balance) VALUES (1, 'up', 10), (1, 'up2', 20), (9000003001, 'in', 7) ON DUPLICATE KEY UPDATE name = VALUES(name), balance = (balance + VALUES(balance)) * 2, tier = 'upsert'",
    f"SELECT id, CASE WHEN id = 1 THEN 'up2' ELSE name END AS name, CASE WHEN id = 1 THEN ((balance + 10) * 2 + 20) * 2 ELSE balance END AS balance, CASE WHEN id = 1 THEN 'upsert' ELSE tier END AS tier FROM {BASE} UNION ALL SELECT 9000003001, 'in', 7, 'basic'",
)
_final("DML6_update", "UPDATE accounts SET balance = balance * 2 + 1, tier = CASE WHEN balance > 0 THEN 'plus' ELSE 'minus' END WHERE id % 3 = 0", f"SELECT id, name, CASE WHEN id % 3 = 0 THEN balance * 2 + 1 ELSE balance END AS balance, CASE WHEN id % 3 <> 0 THEN tier WHEN balance > 0 THEN 'plus' ELSE 'minus' END AS tier FROM {BASE}")
_final("DML7_update_from", "UPDATE accounts SET tier = 'buyer' FROM orders o WHERE accounts.id = o.o_custkey AND o.o_totalprice > 200000", f"SELECT id, name, balance, CASE WHEN id IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) THEN 'buyer' ELSE tier END AS tier FROM {BASE}")
_final("DML8_delete", "DELETE FROM accounts WHERE balance < 0; DELETE FROM accounts USING orders o WHERE accounts.id = o.o_custkey AND o.o_orderstatus = 'P'", f"SELECT * FROM {BASE} WHERE balance >= 0 AND id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
_final("DML9_ordered_limit", "UPDATE accounts SET tier = 'top' ORDER BY ROUND(balance) DESC, id LIMIT 5; DELETE FROM accounts WHERE tier = 'basic' ORDER BY id LIMIT 10", f"SELECT id, name, balance, tier FROM (SELECT * EXCLUDE (r), row_number() OVER (PARTITION BY tier ORDER BY id) AS n FROM (SELECT id, name, balance, r, CASE WHEN r <= 5 THEN 'top' ELSE tier END AS tier FROM (SELECT *, row_number() OVER (ORDER BY round(balance) DESC, id) AS r FROM {BASE}))) WHERE tier = 'top' OR n > 10")
_returned("DML10_returning", "UPDATE accounts SET balance = 0 WHERE id <= 5 RETURNING id, balance, upper(name) AS name", f"SELECT id, CAST(0 AS DOUBLE) AS balance, upper(name) AS name FROM {BASE} WHERE id <= 5")
_final("DML12_truncate", "TRUNCATE TABLE accounts; INSERT INTO accounts (id) VALUES (1)", "SELECT CAST(1 AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS name, CAST(0 AS DOUBLE) AS balance, 'basic' AS tier")


@query("DML11_unique", "SELECT * FROM (VALUES ('duplicate key (id) in accounts'), ('duplicate key (hall, seat) in seats'), ('id can''t be null'), ('name is over 40 characters')) v(message)")
def unique(t: Tables) -> DataFrame:
    from ..operators.tables import ConstraintError

    e = accounts(t)
    e.sql("CREATE TABLE seats (ticket INT PRIMARY KEY, hall INT, seat VARCHAR(4), UNIQUE (hall, seat)); INSERT INTO seats VALUES (1, 7, 'A12'), (2, 8, 'A12')")
    messages = []
    for s in ("INSERT INTO accounts (id) VALUES (1)", "INSERT INTO seats VALUES (3, 7, 'A12')", "INSERT INTO accounts (name) VALUES ('x')", f"INSERT INTO accounts (id, name) VALUES (9999, '{'x' * 41}')"):
        try:
            e.sql(s)
        except ConstraintError as x:
            messages.append((str(x),))
    return t.spark.createDataFrame(messages, "message string")


@query("DML13_foreign_keys", "SELECT 'c' AS child_column, 'parent' AS parent, 'id' AS parent_column, 1 AS children")
def foreign_keys(t: Tables) -> DataFrame:
    """Kept, and not acted upon."""
    e = engine(t)
    e.sql("CREATE TABLE parent (id INT PRIMARY KEY); CREATE TABLE child (c INT, FOREIGN KEY (c) REFERENCES parent (id) ON DELETE CASCADE)")
    e.sql("INSERT INTO parent VALUES (1); INSERT INTO child VALUES (1); DELETE FROM parent")
    column, parent, key = e.table("child").foreign[0]
    return t.spark.createDataFrame([(column, parent, key, e.sql("SELECT * FROM child").count())], "child_column string, parent string, parent_column string, children int")


@query("DML14_last_insert_id", "SELECT 3 AS id")
def last_insert_id(t: Tables) -> DataFrame:
    from ..functions import call

    e = engine(t)
    e.sql("CREATE TABLE notes (id INT PRIMARY KEY AUTO_INCREMENT, body TEXT); INSERT INTO notes (body) VALUES ('a'), ('b'); INSERT INTO notes (body) VALUES ('c'), ('d')")
    out = t.spark.range(1).select(call("last_insert_id").cast("int").alias("id"))
    call("last_insert_id", 0)
    return out


@query("DDL1_databases", "SELECT * FROM (VALUES ('main'), ('sales')) v(name)")
def databases(t: Tables) -> DataFrame:
    return engine(t).sql("CREATE DATABASE sales; CREATE DATABASE IF NOT EXISTS sales; CREATE DATABASE old; DROP DATABASE old; SHOW DATABASES")


DESCRIBED = "SELECT * FROM (VALUES ('id', 'BIGINT', 'NO', 'PRI', NULL, 'auto_increment'), ('email', 'VARCHAR(64)', 'NO', 'UNI', NULL, ''), ('state', 'ENUM(on,off)', 'YES', 'MUL', '''on''', ''), ('age', 'SMALLINT', 'YES', '', NULL, ''), ('seen', 'DATETIME', 'YES', '', NULL, '')) v(field, type, nullable, key, \"default\", extra)"
PEOPLE = "CREATE TABLE people (id BIGINT NOT NULL AUTO_INCREMENT, email VARCHAR(64) NOT NULL UNIQUE, state ENUM('on','off') DEFAULT 'on', age TINYINT UNSIGNED, seen DATETIME COMMENT 'last', PRIMARY KEY (id), KEY by_state (state)) ENGINE=x CHARSET=utf8mb4"


@query("DDL2_create_table", DESCRIBED)
def create_table(t: Tables) -> DataFrame:
    return engine(t).sql(f"{PEOPLE}; DESCRIBE people")


_returned("DDL3_alter_table", "ALTER TABLE accounts ADD COLUMN level INT DEFAULT 2, DROP COLUMN tier, RENAME COLUMN name TO title, MODIFY COLUMN balance BIGINT; SELECT id, title, balance, level FROM accounts", f"SELECT id, name AS title, CAST(trunc(balance) AS BIGINT) AS balance, 2 AS level FROM {BASE}")


@query("DDL4_views", f"SELECT id, tier FROM {BASE} WHERE balance > 500")
def views(t: Tables) -> DataFrame:
    return accounts(t).sql("CREATE VIEW rich AS SELECT id, tier FROM accounts WHERE balance > 900; ALTER VIEW rich AS SELECT id, tier FROM accounts WHERE balance > 500; CREATE VIEW other AS SELECT 1 AS x; DROP VIEW other; SELECT * FROM rich")


@query("DDL5_indexes", "SELECT * FROM (VALUES ('PRIMARY', 1, 'id', 0), ('by_name', 1, 'name', 0), ('by_tier', 1, 'tier', 1), ('by_tier', 2, 'balance', 1)) v(key_name, seq, column_name, non_unique)")
def indexes(t: Tables) -> DataFrame:
    return accounts(t).sql("CREATE UNIQUE INDEX by_name ON accounts (name); CREATE INDEX by_tier ON accounts (tier, balance); CREATE INDEX gone ON accounts (name); DROP INDEX gone ON accounts; SHOW INDEX FROM accounts")


@query("DDL6_drop", "SELECT 'customer' AS name UNION ALL SELECT 'nation' UNION ALL SELECT 'orders'")
def drop(t: Tables) -> DataFrame:
    return accounts(t).sql("DROP TABLE accounts; DROP TABLE IF EXISTS accounts; DROP VIEW IF EXISTS nothing; SHOW TABLES")


@query("DDL7_show", "SELECT 'ALL' AS privilege, 'Server Admin' AS context, '' AS comment")
def show(t: Tables) -> DataFrame:
    return engine(t).sql("SHOW PRIVILEGES")


@query("DDL8_show_columns", DESCRIBED)
def show_columns(t: Tables) -> DataFrame:
    return engine(t).sql(f"{PEOPLE}; SHOW COLUMNS FROM people")


@query("DDL9_explain", "SELECT '== Physical Plan ==' AS plan")
def explain(t: Tables) -> DataFrame:
    return accounts(t).sql("EXPLAIN SELECT id FROM accounts WHERE balance > 0").where("line = 0").select("plan")


@query("DDL10_advisor", "SELECT 'inline' AS a, 'adaptive_materialize' AS b, 'scoped_ephemeral' AS c")
def advisor(t: Tables) -> DataFrame:
    from ..statements import advise

    return t.spark.createDataFrame([(advise(10, 8, 1)[0], advise(10_000_000, 1, 3)[0], advise(100_000_000, 10, 5)[0])], "a string, b string, c string")


@query("DDL11_set_variables", "SELECT 5 AS a, 'x' AS b")
def set_variables(t: Tables) -> DataFrame:
    return engine(t).sql("SET @a = 2 + 3, @b = 'x'; SELECT @a AS a, @b AS b")


_returned("DDL12_transactions", "BEGIN; DELETE FROM accounts; ROLLBACK; START TRANSACTION; LOCK TABLES accounts WRITE; DELETE FROM accounts WHERE id > 10; UNLOCK TABLES; COMMIT; SELECT id, balance FROM accounts", f"SELECT id, balance FROM {BASE} WHERE id <= 10")
_returned("DDL13_for_update", "SELECT id FROM accounts WHERE id < 5 FOR UPDATE SKIP LOCKED", f"SELECT id FROM {BASE} WHERE id < 5")


@query("DDL16_batch", "SELECT 2 AS n")
def batch(t: Tables) -> DataFrame:
    """Statements up to the first error take effect."""
    e = engine(t)
    e.sql("CREATE TABLE b (k INT PRIMARY KEY)")
    try:
        e.sql("INSERT INTO b VALUES (1); INSERT INTO b VALUES (2); INSERT INTO b VALUES (2); INSERT INTO b VALUES (3)")
    except ValueError:
        pass
    return e.sql("SELECT CAST(count(*) AS INT) AS n FROM b")


_returned("DDL17_hints", "SELECT /*+ MAX_EXECUTION_TIME(10) */ SQL_NO_CACHE HIGH_PRIORITY id FROM accounts USE INDEX (by_name) WHERE id < 4 -- a remark", f"SELECT id FROM {BASE} WHERE id < 4")


@query("DDL18_typed_api", "SELECT 1 AS k, 'uno' AS v")
def typed_api(t: Tables) -> DataFrame:
    from pyspark.sql import types as T

    from ..operators.tables import Field

    e = engine(t)
    e.create_table("kv", [Field("k", T.IntegerType()), Field("v", T.StringType())], primary=("k",))
    e.insert("kv", t.spark.createDataFrame([(1, "one"), (2, "two")], "k int, v string"))
    e.update("kv", {"v": "'uno'"}, "k = 1")
    e.delete("kv", "k = 2")
    return e.query("SELECT k, v FROM kv")


def _front(name: str, text: str, sql: str, tables: str = "customer orders nation part events") -> None:
    """A SELECT of the dialect."""
    query(name, sql)(lambda t: engine(t, *tables.split()).sql(text))


_front("SQL1_top_ties", "SELECT TOP 10 WITH TIES p_partkey, p_size FROM part ORDER BY p_size DESC", "SELECT p_partkey, p_size FROM (SELECT *, rank() OVER (ORDER BY p_size DESC) AS r FROM part) WHERE r <= 10")
_front("SQL2_fetch_percent", "SELECT p_partkey FROM part ORDER BY p_partkey FETCH FIRST 5 PERCENT ROWS ONLY", "SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS n, count(*) OVER () AS c FROM part) WHERE n <= ceil(c * 5 / 100.0)")
_front("SQL3_limit_by", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 2 BY o_custkey OFFSET 10", "SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n <= 2 ORDER BY o_orderkey OFFSET 10")
_front("SQL4_qualify", "SELECT o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1", "SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
_front("SQL5_prewhere_like", "SELECT c_custkey FROM customer PREWHERE c_nationkey < 9 WHERE c_mktsegment LIKE '%in%'", "SELECT c_custkey FROM customer WHERE c_nationkey < 9 AND c_mktsegment ILIKE '%in%'")
_front("SQL6_any_all", "SELECT p_partkey FROM part WHERE p_retailprice >= ALL (SELECT p_retailprice FROM part WHERE p_size < 3) OR p_size = ANY (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)", "SELECT p_partkey FROM part WHERE p_retailprice >= (SELECT max(p_retailprice) FROM part WHERE p_size < 3) OR p_size IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
_front("SQL7_window_chain", "SELECT event_id, sum(event_id) OVER (w ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s FROM events WINDOW base AS (PARTITION BY user_id), w AS (base ORDER BY event_id)", "SELECT event_id, CAST(sum(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM events")
_front("SQL8_set_order", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_nationkey > 12 ORDER BY k DESC LIMIT 9", "SELECT k FROM (SELECT c_custkey AS k FROM customer EXCEPT (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_nationkey > 12)) ORDER BY k DESC LIMIT 9")
_front("SQL9_recursive_union", "WITH RECURSIVE r (node) AS (SELECT 1 UNION SELECT (n_nationkey * 3 + 1) % 25 FROM r JOIN nation ON n_nationkey = node) SELECT node FROM r", "WITH RECURSIVE r AS (SELECT 1 AS node UNION SELECT (n_nationkey * 3 + 1) % 25 FROM r JOIN nation ON n_nationkey = node) SELECT node FROM r")
_front("SQL10_functions", "SELECT o_orderkey, yearweek(o_orderdate) AS w, mid(o_orderpriority, 1, 3) AS m, to_days(o_orderdate) AS d, CAST(o_totalprice AS SIGNED) AS s FROM orders", "SELECT o_orderkey, CAST(isoyear(o_orderdate) * 100 + weekofyear(o_orderdate) AS INTEGER) AS w, left(o_orderpriority, 3) AS m, CAST(datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 719528 AS INTEGER) AS d, CAST(trunc(o_totalprice) AS BIGINT) AS s FROM orders")
