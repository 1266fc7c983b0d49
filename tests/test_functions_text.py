"""Functions in SQL text are those of the library, not Spark's of the same name."""

import pytest

from quarry.engine import Engine
from quarry.functions import REGISTRY

VALUES = {
    "greatest(1, NULL)": None,
    "acos(2)": None,
    "power(10, 400)": None,
    "log(1, 5)": None,
    "mod(5, 0)": None,
    "div(5, 0)": None,
    "length('é')": 2,
    "ascii('é')": 195,
    "instr('ABC', 'b')": 2,
    "find_in_set('B', 'a,b')": 2,
    "substr('abc', 0, 2)": "",
    "lpad('a', 3, '')": None,
    "avg(1, 2, 3)": 2.0,
    "sum(1, NULL, 3)": 4.0,
    "date_format('2024-03-05', '%Y/%m')": "2024/03",
    "insert('abcdef', 2, 3, 'X')": "aXef",
    "extract(year_month FROM '2024-03-05')": 202403,
    "position('B' IN 'abc')": 2,
    "convert('5', signed)": 5,
    "if(0, 'a', 'b')": "b",
    "field('b', 'A', 'B')": 2,
    "connection_id()": 1,
    "upper(concat('a', insert('bc', 1, 1, lower('X'))))": "AXC",
    "greatest(greatest(greatest(greatest(greatest(1, 2), 3), 4), 5), 6)": 6.0,
}


@pytest.mark.parametrize("call", VALUES)
def test_value(spark, call):
    df = Engine(spark).sql(f"SELECT {call}")
    assert df.first()[0] == VALUES[call]
    assert len(df.columns) == 1


def test_names_and_places(spark):
    e = Engine(spark)
    e.register("t", spark.createDataFrame([(1, 5, "A"), (2, 0, "b"), (3, None, "a")], "id int, x int, s string"))
    assert e.sql("SELECT greatest(id, x) FROM t").columns == ["greatest(id, x)"]
    assert [tuple(r) for r in e.sql("SELECT instr(s, 'A') AS p, count(*) AS n, max(x) AS m FROM t WHERE length(s) = 1 GROUP BY instr(s, 'A') HAVING count(*) > 0 ORDER BY instr(s, 'A')").collect()] == [(0, 1, 0), (1, 2, 5)]
    assert [r[0] for r in e.sql("SELECT id FROM t WHERE mod(5, x) = 0 ORDER BY greatest(id, 1) DESC").collect()] == [1]
    e.sql("CREATE TABLE u (id INT PRIMARY KEY, s VARCHAR(9)); INSERT INTO u VALUES (1, insert('abc', 2, 1, 'X'))")
    assert e.sql("SELECT left(s, 2) AS s FROM u").first()[0] == "aX"


def test_every_name_is_reachable(spark):
    """No name is left to Spark, but aggregates of one argument, SQL's own syntax, and the lookup, which is a join."""
    from quarry.functions import text

    args = {"field": 2, "lookup": None}
    for name, (_, low, _) in REGISTRY.items():
        if name == "lookup":
            continue
        n = max(args.get(name, low), 2 if name in text.AGGREGATES | text.SYNTAX else low)
        parts = [x for _ in range(n) for x in (",", "'1'")][1:]
        try:
            assert text.expand(name, parts) is not None, name
        except Exception:  # '1' is no type, unit or format
            assert name in ("cast", "convert", "extract", "case"), name
