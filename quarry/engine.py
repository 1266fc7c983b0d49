"""The engine: databases, tables and views, and statements in SQL or as methods."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import REGISTRY, text
from .functions.conditional import SESSION
from .operators import cte, limits, setops, tables
from .operators.olap import OlapView
from .operators.tables import Change, Field, Table
from .plans import dialect as d
from .sources import dump
from .types import length_of, parse_type, sql_name, variants_of

READS = ("SELECT", "WITH", "(", "VALUES")
@dataclass
class State:
    """What a transaction can take back."""

    tables: dict[str, Table] = field(default_factory=dict)
    views: dict[str, str] = field(default_factory=dict)


class Engine:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.databases: set[str] = {"main"}
        self.database = "main"
        self.state = State()
        self.olap: dict[str, OlapView] = {}
        self.routines: dict[str, object] = {}
        self.triggers: dict[str, tuple[str, str, str, str]] = {}
        self.guards = cte.Guards()
        self.variables: dict[str, object] = {}
        self.prefix = f"q{uuid.uuid4().hex[:12]}"
        self.affected = 0
        self._saved: State | None = None

    # -- the catalogue ---------------------------------------------------------------------

    def _key(self, name: str) -> str:
        parts = [x.strip('`"').lower() for x in name.split(".")]
        return ".".join(parts) if len(parts) > 1 else f"{self.database}.{parts[0]}"

    def table(self, name: str) -> Table:
        key = self._key(name)
        if key not in self.state.tables:
            raise ValueError(f"no table {name}")
        return self.state.tables[key]

    def register(self, name: str, df: DataFrame, primary: tuple[str, ...] = (), unique: tuple[tuple[str, ...], ...] = ()) -> None:
        """A table over a DataFrame."""
        self._put(name, tables.wrap(name.split(".")[-1], df, primary, unique))

    def _put(self, name: str, table: Table) -> None:
        self.state.tables[self._key(name)] = table

    def _view(self, key: str) -> str:
        """The temporary view of a table or a view, up to date."""
        view = f"{self.prefix}_{key.replace('.', '_')}"
        if key in self.state.tables:
            self.state.tables[key].df.createOrReplaceTempView(view)
        else:
            self._select(d.tokens(self.state.views[key])).createOrReplaceTempView(view)
        return view

    def _bind(self, parts: list[str], scope: frozenset[str] = frozenset()) -> list[str]:
        """Names of tables and views after FROM and JOIN as those of their temporary views."""
        out: list[str] = []
        i, depth, expect, listing = 0, 0, False, []
        while i < len(parts):
            p = parts[i]
            up = p.upper()
            if up in ("FROM", "JOIN"):
                expect = True
                listing = [*listing, depth] if up == "FROM" else listing
            elif p == "," and listing and listing[-1] == depth:
                expect = True
            elif up in ("WHERE", "GROUP", "ORDER", "HAVING", "LIMIT", "UNION", "EXCEPT", "INTERSECT", "SELECT", "ON") and listing and listing[-1] == depth:
                listing = listing[:-1] if up != "ON" else listing
                expect = False
            elif expect and re.match(r"[A-Za-z_`]", p):
                name, n = p, 1
                if i + 2 < len(parts) and parts[i + 1] == ".":
                    name, n = f"{p}.{parts[i + 2]}", 3
                key = self._key(name)
                expect = False
                if (key in self.state.tables or key in self.state.views) and name.lower() not in scope:
                    out.append(self._view(key))
                    after = parts[i + n].upper() if i + n < len(parts) else ""
                    if not (after == "AS" or re.match(r"[A-Z_`]", after) and after not in RESERVED):
                        out.append(name.split(".")[-1])
                    i += n
                    continue
            elif p not in (",",):
                expect = expect and p == "("
            depth += (p == "(") - (p == ")")
            if p == ")":
                listing = [x for x in listing if x <= depth]
            out.append(p)
            i += 1
        return out

    def _names(self, parts: list[str]) -> list[str]:
        """Variables in place, and calls of the registry's functions as their expressions."""
        out: list[str] = []
        i = 0
        while i < len(parts):
            p, low = parts[i], parts[i].lower()
            called = i + 1 < len(parts) and parts[i + 1] == "(" and out[-1:] != ["."]
            own = self.routines.get(low)
            if own is not None and own.expression is not None and called:
                out.append(f"{self.prefix}_{low}")
            elif called and low in REGISTRY:
                end = d.closing(parts, i + 1)
                made = text.expand(low, self._names(parts[i + 2 : end]))
                if made is None:
                    out.append(p)
                else:
                    alone = out and out[-1].upper() in ("SELECT", ",") and (end + 1 == len(parts) or parts[end + 1] == "," or parts[end + 1].upper() == "FROM")
                    selected = alone and _clause(out) == "SELECT"
                    out += [*made, "AS", "`" + d._join(parts[i : end + 1]).replace("`", "") + "`"] if selected else made
                    i = end
            elif low.startswith("@") and low[1:] in self.variables:
                out.append(_literal(self.variables[low[1:]]))
            elif out[-2:] and out[-1] == "." and out[-2].lower() == "cte" and hasattr(self.guards, low):
                del out[-2:]
                out.append(_literal(getattr(self.guards, low)))
            else:
                out.append(p)
            i += 1
        return out

    # -- reading ---------------------------------------------------------------------------

    def _spark(self, text: str) -> DataFrame:
        return self.spark.sql(text)

    def _select(self, parts: list[str]) -> DataFrame:
        parts = self._names(parts)
        if parts and parts[0].upper() == "WITH":
            return self._with(parts)
        return self._query(parts)

    def _with(self, parts: list[str]) -> DataFrame:
        """Common table expressions as views of this statement; a name that a table has is an error."""
        recursive = parts[1].upper() == "RECURSIVE"
        i = 2 if recursive else 1
        added = []
        try:
            while True:
                name, i = parts[i], i + 1
                key = self._key(name)
                if key in self.state.tables or key in self.state.views:
                    raise ValueError(f"{name} is a table already")
                columns = None
                if parts[i] == "(":
                    end = d.closing(parts, i)
                    columns, i = [x[0] for x in d.split_at(parts[i + 1 : end])], end + 1
                end = d.closing(parts, i + 1)
                body = parts[i + 2 : end]
                if recursive and any(x.lower() == name.lower() for x in body):
                    df = self._recursive(name, columns, body)
                else:
                    df = self._query(body)
                    df = df.toDF(*columns) if columns else df
                self._put(name, tables.wrap(name, df))
                added.append(key)
                i = end + 1
                if i >= len(parts) or parts[i] != ",":
                    break
                i += 1
            return self._query(parts[i:])
        finally:
            for key in added:
                self.state.tables.pop(key, None)

    def _recursive(self, name: str, columns: list[str] | None, body: list[str]) -> DataFrame:
        at = next(i for i, x in enumerate(body) if x.upper() == "UNION" and _depth(body, i) == 0)
        every = body[at + 1].upper() == "ALL"
        seed = self._query(body[:at])
        seed = seed.toDF(*columns) if columns else seed
        key = self._key(name)

        def step(frontier: DataFrame) -> DataFrame:
            self.state.tables[key] = tables.wrap(name, frontier)
            out = self._query(body[at + (2 if every else 1) :]).toDF(*seed.columns)
            return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in seed.schema])

        return cte.recursive(seed, step, distinct=not every, guards=self.guards)

    def _query(self, parts: list[str]) -> DataFrame:
        """A SELECT, or set operations of some with the order and limits of the whole."""
        while parts and parts[0] == "(" and d.closing(parts, 0) == len(parts) - 1:
            parts = parts[1:-1]
        ops = [i for i, x in enumerate(parts) if x.upper() in ("UNION", "EXCEPT", "MINUS", "INTERSECT") and _depth(parts, i) == 0]
        if not ops:
            if parts[0].upper() != "SELECT":
                return self._spark(d._join(self._bind(parts)))
            return self._limited(d.select(parts))
        tail: list[str] = []
        last = parts[ops[-1] + 1 :]
        cut = next((i for i, x in enumerate(last) if x.upper() in ("ORDER", "LIMIT", "FETCH", "OFFSET") and _depth(last, i) == 0), None)
        if cut is not None:
            tail, parts = last[cut:], parts[: ops[-1] + 1 + cut]
        sides, signs, at = [], [], 0
        for i in ops:
            sides.append(parts[at:i])
            sign = parts[i].upper().replace("MINUS", "EXCEPT")
            at = i + 1
            if parts[at].upper() in ("ALL", "DISTINCT"):
                if parts[at].upper() == "ALL":
                    if sign != "UNION":
                        raise ValueError(f"{sign} ALL isn't supported")
                    sign = "UNION ALL"
                at += 1
            signs.append(sign)
        sides.append(parts[at:])
        postfix: list[int | str] = [0]  # INTERSECT binds closer
        held: list[str] = []
        for n, sign in enumerate(signs, 1):
            while held and (held[-1] == "INTERSECT" or sign != "INTERSECT"):
                postfix.append(held.pop())
            held.append(sign)
            postfix.append(n)
        out = setops.evaluate([self._query(s) for s in sides], postfix + held[::-1])
        if tail:
            view = f"{self.prefix}_set{uuid.uuid4().hex[:6]}"
            out.createOrReplaceTempView(view)
            return self._limited(d.select(["SELECT", *_comma(out.columns), "FROM", view, *tail]))
        return out

    def _limited(self, s: d.Select) -> DataFrame:
        df = self._spark(d._join(self._bind(d.tokens(s.text))))
        keys = [F.desc(o.split()[0]) if o.endswith(" desc") else F.asc(o) for o in s.order]
        ties = [o.split()[0] for o in s.order]
        if s.by:
            df = limits.limit_by(df, s.by[0], [h for h in s.hidden if h.startswith("__b")], keys or [F.lit(1)])
            df = df.orderBy(*keys) if keys else df
        if s.limit is not None:
            if s.percent:
                df = limits.top_percent(df, s.limit, keys, ties if s.ties else None)
            else:
                df = limits.top(df, int(s.limit), keys, ties if s.ties else None)
        if s.offset:
            df = df.offset(s.offset)
        return df.drop(*s.hidden) if s.hidden else df

    # -- statements ------------------------------------------------------------------------

    def query(self, text: str) -> DataFrame:
        return self.sql(text)

    def query_as(self, kind: type, text: str) -> list:
        """The rows as objects of a class whose arguments are the columns."""
        return [kind(**r.asDict()) for r in self.sql(text).toLocalIterator()]

    def execute(self, text: str) -> int:
        """Runs statements; the rows that the last one changed."""
        self.affected = 0
        self.sql(text)
        return self.affected

    def set_database(self, name: str) -> None:
        if name.lower() not in self.databases:
            raise ValueError(f"no database {name}")
        self.database = name.lower()
        SESSION.database = self.database

    def sql(self, text: str) -> DataFrame:
        """Runs the statements of a text, up to the first error; the result of the last one."""
        from . import routines

        out = None
        for one in routines.split(text):
            out = self._one(one)
        return out if out is not None else self._rows([], "ok boolean")

    def _one(self, text: str) -> DataFrame | None:
        from . import routines, statements

        parts = d.tokens(d.HINTS.sub(" ", text))
        word = parts[0].upper()
        if word in READS:
            parts = _without_locks(parts)
            if "INTO" in [x.upper() for x in parts] and word == "SELECT":
                return routines.select_into(self, parts, self.variables)
            return self._select(parts)
        handler = statements.HANDLERS.get(word)
        if handler is None:
            raise ValueError(f"unknown statement {word}")
        return handler(self, parts, text)

    def _rows(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def _changed(self, name: str, change: Change, returning: list[str] | None) -> DataFrame:
        self._put(name, change.table)
        self.affected = change.rows.count()
        if change.last_id is not None:
            SESSION.last_insert_id = change.last_id
        if returning is None:
            return self._rows([(self.affected,)], "affected long")
        view = f"{self.prefix}_changed{uuid.uuid4().hex[:6]}"
        change.rows.createOrReplaceTempView(view)
        return self._spark(f"SELECT {d._join(returning)} FROM {view} AS {change.table.name}")

    # -- the same as methods -----------------------------------------------------------------

    def create_table(self, name: str, fields: list[Field], primary: tuple[str, ...] = (), unique: tuple[tuple[str, ...], ...] = ()) -> None:
        self._put(name, tables.create(self.spark, name.split(".")[-1], fields, primary, unique))

    def insert(self, name: str, rows: DataFrame, mode: str = "error", assign: dict[str, str] | None = None) -> DataFrame:
        change = tables.insert(self.table(name), rows, mode, assign)
        self._changed(name, change, None)
        return change.rows

    def update(self, name: str, assign: dict[str, str], where: str | None = None, **more: object) -> DataFrame:
        change = tables.update(self.table(name), assign, where, **more)
        self._changed(name, change, None)
        return change.rows

    def delete(self, name: str, where: str | None = None, **more: object) -> DataFrame:
        change = tables.delete(self.table(name), where, **more)
        self._changed(name, change, None)
        return change.rows

    def begin(self) -> None:
        if self._saved is not None:
            raise ValueError("a transaction is open")
        self._saved = State(dict(self.state.tables), dict(self.state.views))

    def commit(self) -> None:
        self._saved = None

    def rollback(self) -> None:
        if self._saved is not None:
            self.state, self._saved = self._saved, None

    def export(self, name: str, path: str) -> None:
        dump.export_table(self.table(name).df, name.split(".")[-1], path)


RESERVED = frozenset("WHERE GROUP ORDER HAVING LIMIT UNION EXCEPT INTERSECT MINUS ON JOIN INNER LEFT RIGHT FULL CROSS NATURAL USING WINDOW QUALIFY SET OFFSET FETCH SELECT SEMI ANTI LATERAL TABLESAMPLE PIVOT VALUES".split())


def _comma(names: list[str]) -> list[str]:
    return [x for c in names for x in (",", f"`{c}`")][1:]


def _clause(parts: list[str]) -> str:
    """The clause of the innermost query, or parenthesis, that the end of some tokens is in."""
    depth = 0
    for p in reversed(parts):
        depth += (p == ")") - (p == "(")
        if depth < 0:
            return "("
        if not depth and p.upper() in ("SELECT", "FROM", "WHERE", "BY", "HAVING", "ON", "QUALIFY", "LIMIT", "OFFSET"):
            return p.upper()
    return ""


def _depth(parts: list[str], at: int) -> int:
    return sum((x == "(") - (x == ")") for x in parts[:at])


def _literal(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, (int, float)):
        return repr(x)
    return "'" + str(x).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _without_locks(parts: list[str]) -> list[str]:
    """FOR UPDATE and FOR SHARE, with OF, NOWAIT and SKIP LOCKED, mean nothing to snapshots."""
    for i, p in enumerate(parts):
        if p.upper() == "FOR" and i + 1 < len(parts) and parts[i + 1].upper() in ("UPDATE", "SHARE") and _depth(parts, i) == 0:
            return parts[:i]
    return parts


def describe(table: Table) -> list[tuple[str, str, str, str, str | None, str]]:
    out = []
    for f in table.fields:
        key = "PRI" if f.name in table.primary else "UNI" if (f.name,) in table.unique else "MUL" if any(f.name in c for c in table.indexes.values()) else ""
        out.append((f.name, f"ENUM({','.join(f.variants)})" if f.variants else f"VARCHAR({f.length})" if f.length else sql_name(f.kind), "YES" if f.nullable and f.name not in table.primary else "NO", key, f.default, "auto_increment" if f.auto else ""))
    return out


def parse_field(parts: list[str]) -> tuple[Field, bool, bool]:
    """A column of CREATE TABLE; whether it is the primary key, and unique."""
    name, rest = parts[0].strip('`"'), parts[1:]
    kind, i = [rest[0]], 1
    if i < len(rest) and rest[i] == "(":
        end = d.closing(rest, i)
        kind, i = rest[: end + 1], end + 1
    if i < len(rest) and rest[i].upper() == "UNSIGNED":
        kind, i = [*kind, "UNSIGNED"], i + 1
    text = " ".join(kind)
    tail = [x.upper() for x in rest[i:]]
    joined = " ".join(tail)
    default = None
    if "DEFAULT" in tail:
        at = i + tail.index("DEFAULT") + 1
        end = at + 1
        if end < len(rest) and rest[end] == "(":
            end = d.closing(rest, end) + 1
        if rest[at] == "-":
            end += 1
        default = d._join(rest[at:end])
        default = None if default.upper() == "NULL" else default
    comment = rest[i + tail.index("COMMENT") + 1].strip("'") if "COMMENT" in tail else None
    variants = variants_of(text)
    made = Field(name, parse_type(text), "NOT NULL" not in joined, default, "AUTO_INCREMENT" in tail, length_of(text), tuple(variants) if variants else None, comment)
    return made, "PRIMARY KEY" in joined, "UNIQUE" in tail
