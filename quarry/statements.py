"""Statements that change data, definitions or the session, by their first word."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

from .operators import cte, tables
from .operators.olap import OlapView
from .plans import dialect as d

if TYPE_CHECKING:
    from .engine import Engine

Parts = list[str]


def _find(parts: Parts, *words: str, start: int = 0) -> int | None:
    """The place of a word outside of parentheses."""
    depth = 0
    for i, p in enumerate(parts):
        depth += (p == "(") - (p == ")")
        if i >= start and not depth and p.upper() in words:
            return i
    return None


def _take(parts: Parts, *words: str) -> tuple[Parts, Parts | None]:
    """The parts before the last clause with a word, and that clause."""
    at = _find(parts, *words)
    return (parts, None) if at is None else (parts[:at], parts[at + 1 :])


def _name(parts: Parts, at: int) -> tuple[str, int]:
    """A name, perhaps with its database, and the place after it."""
    if at + 2 < len(parts) and parts[at + 1] == ".":
        return f"{parts[at].strip('`')}.{parts[at + 2].strip('`')}", at + 3
    return parts[at].strip("`"), at + 1


def _skip(parts: Parts, at: int, *words: str) -> int:
    while at < len(parts) and parts[at].upper() in words:
        at += 1
    return at


def _assignments(parts: Parts) -> dict[str, str]:
    out = {}
    for one in d.split_at(parts):
        at = one.index("=")
        out[one[at - 1].strip("`")] = d._join(d.words(one[at + 1 :]))
    return out


def insert(e: Engine, parts: Parts, text: str) -> DataFrame:
    mode = "replace" if parts[0].upper() == "REPLACE" else "error"
    at = 1
    if parts[at].upper() == "IGNORE":
        mode, at = "ignore", at + 1
    at = _skip(parts, at, "INTO")
    name, at = _name(parts, at)
    table = e.table(name)
    body, returning = _take(parts[at:], "RETURNING")
    assign = None
    dup = _find(body, "DUPLICATE")
    if dup is not None:
        assign, body, mode = _assignments(body[dup + 3 :]), body[: dup - 1], "upsert"
    columns = None
    if body[0] == "(" and (len(body) < 2 or body[1].upper() not in ("SELECT", "WITH")):
        end = d.closing(body, 0)
        columns, body = [x[0].strip("`") for x in d.split_at(body[1:end])], body[end + 1 :]
    word = body[0].upper()
    if word == "SET":
        values = _assignments(body[1:])
        new = e._spark("SELECT " + ", ".join(f"{v} AS `{k}`" for k, v in values.items()))
    elif word == "DEFAULT":
        new = e.spark.range(1).select()
    elif word in ("VALUES", "VALUE"):
        columns = columns or table.columns
        lists, i = [], 1
        while i < len(body):
            end = d.closing(body, i)
            lists.append(d.split_at(body[i + 1 : end]))
            i = end + 2
        kinds = {f.name: f for f in table.fields}
        rows = []
        for values in lists:
            if len(values) != len(columns):
                raise ValueError(f"{len(values)} values for {len(columns)} columns")
            cells = []
            for c, v in zip(columns, values, strict=True):
                if len(v) == 1 and v[0].upper() == "DEFAULT":
                    v = [kinds[c].default or "NULL"]
                cells.append(f"CAST({d._join(d.words(e._names(v)))} AS {kinds[c].kind.simpleString()}) AS `{c}`")
            rows.append(f"SELECT {', '.join(cells)}")
        new = e._spark(" UNION ALL ".join(rows)) if len(rows) == 1 else e._spark(" UNION ALL ".join(rows)).coalesce(1)
    else:
        new = e._select(body)
        new = new.toDF(*(columns or table.columns))
    return e._changed(name, tables.insert(table, new, mode, assign), returning)


def _targets(parts: Parts) -> tuple[Parts, list[str] | None, int | None, Parts | None]:
    """What is before ORDER BY, the order, the limit and the returned columns."""
    parts, returning = _take(parts, "RETURNING")
    parts, limit = _take(parts, "LIMIT")
    parts, order = _take(parts, "ORDER")
    keys = [d._join(x) for x in d.split_at(order[1:])] if order else None
    return parts, keys, int(limit[0]) if limit else None, returning


def _qualified(e: Engine, parts: Parts) -> DataFrame:
    name, at = _name(parts, 0)
    alias = parts[at + 1] if at < len(parts) and parts[at].upper() == "AS" else parts[at] if at < len(parts) else name.split(".")[-1]
    return e.table(name).df.alias(alias)


def update(e: Engine, parts: Parts, text: str) -> DataFrame:
    name, at = _name(parts, _skip(parts, 1, "LOW_PRIORITY", "IGNORE"))
    rest, order, limit, returning = _targets(parts[at:])
    rest, where = _take(rest, "WHERE")
    rest, source = _take(rest, "FROM")
    join = _find(rest, "JOIN")
    condition = d._join(d.words(where)) if where else None
    if join is not None:  # UPDATE t JOIN s ON ... SET ...
        on, set_ = _find(rest, "ON"), _find(rest, "SET")
        source, rest = rest[join + 1 : on], rest[set_:]
        test = d._join(d.words(parts[at:][on + 1 : set_]))
        condition = f"({test}) AND ({condition})" if condition else test
    change = tables.update(e.table(name), _assignments(rest[1:]), condition, _qualified(e, source) if source else None, order, limit)
    return e._changed(name, change, returning)


def delete(e: Engine, parts: Parts, text: str) -> DataFrame:
    at = _find(parts, "FROM")
    name, at = _name(parts, at + 1)
    rest, order, limit, returning = _targets(parts[at:])
    rest, where = _take(rest, "WHERE")
    rest, source = _take(rest, "USING")
    condition = d._join(d.words(where)) if where else None
    change = tables.delete(e.table(name), condition, _qualified(e, source) if source else None, order, limit)
    return e._changed(name, change, returning)


def truncate(e: Engine, parts: Parts, text: str) -> DataFrame:
    name, _ = _name(parts, _skip(parts, 1, "TABLE"))
    return e._changed(name, tables.truncate(e.table(name)), None)


def _done(e: Engine) -> DataFrame:
    return e._rows([(True,)], "ok boolean")


def _exists(parts: Parts, at: int) -> tuple[bool, int]:
    """Whether IF [NOT] EXISTS stands here, and the place after it."""
    if at < len(parts) and parts[at].upper() == "IF":
        return True, at + (3 if parts[at + 1].upper() == "NOT" else 2)
    return False, at


def create(e: Engine, parts: Parts, text: str) -> DataFrame:
    from . import routines
    from .engine import parse_field

    at = _skip(parts, 1, "OR", "REPLACE", "TEMPORARY", "UNIQUE", "DEFINER")
    what = parts[at].upper()
    if what in ("FUNCTION", "PROCEDURE"):
        return routines.create(e, parts, text)
    lenient, at = _exists(parts, at + 1)
    if what == "DATABASE" or what == "SCHEMA":
        name = parts[at].strip("`").lower()
        if name in e.databases and not lenient:
            raise ValueError(f"database {name} is there already")
        e.databases.add(name)
        return _done(e)
    name, at = _name(parts, at)
    if what == "VIEW":
        if "OR" not in [x.upper() for x in parts[:3]] and e._key(name) in e.state.views:
            raise ValueError(f"view {name} is there already")
        e.state.views[e._key(name)] = d._join(parts[at + 1 :])
        return _done(e)
    if what == "OLAPVIEW":
        as_ = _find(parts, "AS")
        dims = tuple(x[0].strip("`") for x in d.split_at(parts[at + 1 : as_]))
        source = e._select(parts[as_ + 1 :])
        keys = tuple({k for t in e.state.tables.values() for k in t.primary if k in source.columns})
        missing = set(dims) - set(source.columns)
        if missing:
            raise ValueError(f"{name} has no column {', '.join(sorted(missing))}")
        e.olap[name.lower()] = OlapView(name, dims, source, keys)
        return _done(e)
    if what == "INDEX":
        on = _find(parts, "ON")
        table_name, at = _name(parts, on + 1)
        if parts[at : at + 1] != ["("] or len(parts) > d.closing(parts, at) + 1:
            raise ValueError("an index takes columns and nothing else")
        columns = tuple(x[0].strip("`") for x in d.split_at(parts[at + 1 : d.closing(parts, at)]))
        table = e.table(table_name)
        from dataclasses import replace

        unique = (*table.unique, columns) if "UNIQUE" in [x.upper() for x in parts[:2]] else table.unique
        made = replace(table, indexes={**table.indexes, name: columns}, unique=unique)
        tables._check_unique(made, made.rows)
        e._put(table_name, made)
        return _done(e)
    if what == "TRIGGER":
        e.triggers[name.lower()] = (parts[at].upper(), parts[at + 1].upper(), _name(parts, at + 3)[0], text)
        return _done(e)
    if what != "TABLE":
        raise ValueError(f"CREATE {what} isn't known")
    if e._key(name) in e.state.tables:
        if lenient:
            return _done(e)
        raise ValueError(f"table {name} is there already")
    if parts[at].upper() == "AS" or parts[at].upper() == "SELECT":
        from .operators.storage import cut

        e.register(name, cut(e._select(parts[at + 1 :] if parts[at].upper() == "AS" else parts[at:])))
        return _done(e)
    fields, primary, unique, indexes, foreign = [], (), [], {}, []
    for one in d.split_at(parts[at + 1 : d.closing(parts, at)]):
        head = one[0].upper()
        if head == "CONSTRAINT":
            one = one[2:]
            head = one[0].upper()
        listed = [tuple(x[0].strip("`") for x in d.split_at(one[i + 1 : d.closing(one, i)])) for i, p in enumerate(one) if p == "("]
        if head == "PRIMARY":
            primary = listed[0]
        elif head == "UNIQUE":
            unique.append(listed[0])
        elif head in ("KEY", "INDEX"):
            indexes[one[1] if one[1] != "(" else "_".join(listed[0])] = listed[0]
        elif head == "FOREIGN":
            foreign.append((listed[0][0], one[one.index("REFERENCES") + 1] if "REFERENCES" in one else one[[x.upper() for x in one].index("REFERENCES") + 1], listed[1][0]))
        elif head != "CHECK":
            f, is_key, is_unique = parse_field(one)
            fields.append(f)
            primary = (f.name,) if is_key else primary
            unique += [(f.name,)] if is_unique else []
    e._put(name, tables.create(e.spark, name.split(".")[-1], fields, primary, tuple(unique), indexes=indexes, foreign=tuple(foreign)))
    return _done(e)


def alter(e: Engine, parts: Parts, text: str) -> DataFrame:
    from .engine import parse_field

    if parts[1].upper() == "VIEW":
        name, at = _name(parts, 2)
        if e._key(name) not in e.state.views:
            raise ValueError(f"no view {name}")
        e.state.views[e._key(name)] = d._join(parts[at + 1 :])
        return _done(e)
    name, at = _name(parts, 2)
    for one in d.split_at(parts[at:]):
        table, word = e.table(name), one[0].upper()
        i = _skip(one, 1, "COLUMN")
        if word == "ADD":
            table = tables.add_column(table, parse_field(one[i:])[0])
        elif word == "DROP":
            table = tables.drop_column(table, one[i].strip("`"))
        elif word == "RENAME":
            table = tables.rename_column(table, one[i].strip("`"), one[i + 2].strip("`"))
        elif word == "MODIFY":
            table = tables.modify_column(table, parse_field(one[i:])[0])
        else:
            raise ValueError(f"ALTER TABLE {word} isn't known")
        e._put(name, table)
    return _done(e)


def drop(e: Engine, parts: Parts, text: str) -> DataFrame:
    at = _skip(parts, 1, "TEMPORARY")
    what = parts[at].upper()
    lenient, at = _exists(parts, at + 1)
    if what in ("DATABASE", "SCHEMA"):
        name = parts[at].strip("`").lower()
        if name not in e.databases and not lenient:
            raise ValueError(f"no database {name}")
        e.databases.discard(name)
        for key in [k for k in e.state.tables if k.startswith(f"{name}.")]:
            del e.state.tables[key]
        return _done(e)
    name, at = _name(parts, at)
    if what == "INDEX":
        from dataclasses import replace

        table_name, _ = _name(parts, at + 1)
        table = e.table(table_name)
        rest = {k: v for k, v in table.indexes.items() if k != name}
        e._put(table_name, replace(table, indexes=rest, unique=tuple(u for u in table.unique if u != table.indexes.get(name) or u in rest.values())))
        return _done(e)
    found = {"TABLE": (e.state.tables, e._key(name)), "VIEW": (e.state.views, e._key(name)), "OLAPVIEW": (e.olap, name.lower()), "TRIGGER": (e.triggers, name.lower()), "FUNCTION": (e.routines, name.lower()), "PROCEDURE": (e.routines, name.lower())}[what]
    if found[1] not in found[0]:
        from .functions import REGISTRY

        if what == "FUNCTION" and name.lower() in REGISTRY:
            raise ValueError(f"{name} is built in")
        if not lenient:
            raise ValueError(f"no {what.lower()} {name}")
    found[0].pop(found[1], None)
    return _done(e)


def set_(e: Engine, parts: Parts, text: str) -> DataFrame:
    """Variables; if one value is out of range none changes."""
    guards, values = {}, {}
    for one in d.split_at(parts[1:]):
        if one[0].upper() == "GLOBAL":
            raise ValueError("only SESSION and LOCAL variables can be set")
        one = one[1:] if one[0].upper() in ("SESSION", "LOCAL") else one
        at = next(i for i, p in enumerate(one) if p in ("=", ":="))
        name, value = "".join(one[:at]).lower(), e._spark("SELECT " + d._join(d.words(e._names(one[at + 1 :])))).first()[0]
        if name.startswith("cte."):
            guards[name[4:]] = value
        else:
            values[name.lstrip("@")] = value
    new = cte.set_guards(e.guards, **guards)
    e.guards = new
    e.variables |= values
    return _done(e)


def show(e: Engine, parts: Parts, text: str) -> DataFrame:
    from .engine import describe
    from .functions.conditional import SESSION

    words = [p.upper() for p in parts]
    what = words[1]
    if what == "SLICES":
        return _slices(e, parts)
    if what == "DATABASES":
        return e._rows([(x,) for x in sorted(e.databases)], "name string")
    if what == "TABLES":
        return e._rows([(k.split(".")[1],) for k in sorted([*e.state.tables, *e.state.views]) if k.startswith(f"{e.database}.")], "name string")
    if what in ("VARIABLES", "VARIABLE"):
        rows = {f"cte.{k}": str(int(v)) for k, v in vars(e.guards).items()} | {k: str(v) for k, v in e.variables.items()}
        like = parts[words.index("LIKE") + 1].strip("'") if "LIKE" in words else "".join(parts[2:]).lower() if what == "VARIABLE" else "%"
        pattern = re.compile(re.escape(like).replace("%", ".*").replace("_", "."), re.I)
        return e._rows([(k, v) for k, v in sorted(rows.items()) if pattern.fullmatch(k)], "name string, value string")
    if what == "PRIVILEGES":
        return e._rows([("ALL", "Server Admin", "")], "privilege string, context string, comment string")
    if what == "USER":
        return e._rows([(SESSION.user,)], "user string")
    if what in ("COLUMNS", "FIELDS"):
        return describe_(e, ["DESCRIBE", *parts[3:]], text)
    if what in ("INDEX", "INDEXES", "KEYS"):
        name, _ = _name(parts, 3)
        t = e.table(name)
        rows = [("PRIMARY", i + 1, c, 0) for i, c in enumerate(t.primary)]
        rows += [("_".join(u), i + 1, c, 0) for u in t.unique for i, c in enumerate(u) if u not in t.indexes.values()]
        rows += [(n, i + 1, c, int(cols not in t.unique)) for n, cols in t.indexes.items() for i, c in enumerate(cols)]
        return e._rows(rows, "key_name string, seq int, column_name string, non_unique int")
    if what == "CREATE":
        name, _ = _name(parts, 3)
        if words[2] == "VIEW":
            return e._rows([(e.state.views[e._key(name)],)], "sql string")
        return e._rows([(", ".join(f"{r[0]} {r[1]}" for r in describe(e.table(name))),)], "sql string")
    raise ValueError(f"SHOW {what} isn't known")


def _slices(e: Engine, parts: Parts) -> DataFrame:
    name, at = _name(parts, 3)
    rest, limit = _take(parts[at:], "LIMIT")
    rest, order = _take(rest, "ORDER")
    _, where = _take(rest, "WHERE")
    conditions = []
    for one in d.split_at(where or [], "AND"):
        conditions.append((one[0], one[1], e._spark("SELECT " + d._join(one[2:])).first()[0]))
    keys = [(x[0], x[-1].upper() == "DESC") for x in d.split_at(order[1:])] if order else []
    return e.olap[name.lower()].slices(conditions, keys, int(limit[0]) if limit else None)


def describe_(e: Engine, parts: Parts, text: str) -> DataFrame:
    from .engine import describe

    name, _ = _name(parts, _skip(parts, 1, "TABLE"))
    return e._rows(describe(e.table(name)), "field string, type string, nullable string, key string, default string, extra string")


def explain(e: Engine, parts: Parts, text: str) -> DataFrame:
    """The plan of a SELECT as rows; of another statement, what it does, without doing it."""
    if parts[1].upper() in ("SELECT", "WITH", "("):
        df = e._select(parts[1:])
        lines = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).splitlines()
        return e._rows([(i, x) for i, x in enumerate(lines)], "line int, plan string")
    word = parts[1].upper()
    lines = [f"{word} on a new snapshot"]
    up = [x.upper() for x in parts]
    where = up.index("WHERE") if "WHERE" in up else None
    if word in ("UPDATE", "DELETE"):
        name = parts[3] if word == "DELETE" else parts[2]
        other = up[up.index("USING" if word == "DELETE" else "FROM", 3) + 1 :] if ("USING" if word == "DELETE" else "FROM") in up[3:] else None
        if where is not None and other is None:
            stop = next((i for i in range(where, len(up)) if up[i] in ("ORDER", "LIMIT", "RETURNING")), len(parts))
            df = e._select(["SELECT", "*", "FROM", name, *parts[where:stop]])
        else:
            df = e._select(["SELECT", "*", "FROM", name])
        table = e.table(name)
        lines.append(f"Table {table.name}: {'every row is written once' if where is None or not table.files else 'read and written once'}")
        lines += df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).splitlines()
    elif word in ("INSERT", "REPLACE") and "SELECT" in up:
        df = e._select(parts[up.index("SELECT") : up.index("ON") if "DUPLICATE" in up else len(parts)])
        lines.append("the new rows are appended, after a look for their keys" if word == "INSERT" and "DUPLICATE" not in up else "rows of equal keys are replaced")
        lines += df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).splitlines()
    elif word in ("INSERT", "REPLACE"):
        lines.append("the new rows are appended, after a look for their keys" if word == "INSERT" and "DUPLICATE" not in up else "rows of equal keys are replaced")
    return e._rows(list(enumerate(lines)), "line int, plan string")


def use(e: Engine, parts: Parts, text: str) -> DataFrame:
    e.set_database(parts[1].strip("`"))
    return _done(e)


def begin(e: Engine, parts: Parts, text: str) -> DataFrame:
    e.begin()
    return _done(e)


def commit(e: Engine, parts: Parts, text: str) -> DataFrame:
    e.commit()
    return _done(e)


def rollback(e: Engine, parts: Parts, text: str) -> DataFrame:
    e.rollback()
    return _done(e)


def lock(e: Engine, parts: Parts, text: str) -> DataFrame:
    """Snapshots need no locks."""
    return _done(e)


def export(e: Engine, parts: Parts, text: str) -> DataFrame:
    """EXPORT DATABASE, TABLE or VIEW name TO 'path'."""
    from .sources import dump

    what = parts[1].upper()
    name, at = _name(parts, 2)
    path = parts[at + 1].strip("'")
    if what == "DATABASE":
        for key, t in e.state.tables.items():
            if key.startswith(f"{name.lower()}."):
                dump.export_table(t.df, key.split(".")[1], path)
    elif what == "TABLE":
        e.export(name, path)
    else:
        sql = e.state.views[e._key(name)] if what == "VIEW" else e.routines[name.lower()].text
        head = f"CREATE VIEW {name} AS {sql};" if what == "VIEW" else sql
        e._rows([(head,)], "value string").coalesce(1).write.mode("append").text(path)
    return _done(e)


def call(e: Engine, parts: Parts, text: str) -> DataFrame | None:
    from . import routines

    return routines.call(e, parts)


def advise(rows: int, width: int, uses: int) -> tuple[str, float]:
    """Whether a step's result is better kept: a score of its size and uses, and inline, adaptive_materialize or scoped_ephemeral."""
    score = uses * (1 + rows * width / 1e6)
    return ("inline" if uses < 2 or score < 3 else "adaptive_materialize" if score < 100 else "scoped_ephemeral"), score


HANDLERS: dict[str, Callable[[Engine, Parts, str], DataFrame | None]] = {
    "INSERT": insert, "REPLACE": insert, "UPDATE": update, "DELETE": delete, "TRUNCATE": truncate, "CREATE": create, "ALTER": alter, "DROP": drop, "SET": set_, "SHOW": show,
    "DESCRIBE": describe_, "DESC": describe_, "EXPLAIN": explain, "USE": use, "BEGIN": begin, "START": begin, "COMMIT": commit, "ROLLBACK": rollback, "LOCK": lock, "UNLOCK": lock, "EXPORT": export, "CALL": call,
}
