"""Stored functions and procedures: a small interpreter over statements.

Expressions go to Spark as one-row queries with the variables in place; rows
are only fetched one at a time, by cursors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

from .plans import dialect as d

if TYPE_CHECKING:
    from .engine import Engine

Parts = list[str]
#: Turns that a loop may take.
MOST_TURNS = 100_000
OPENS = ("BEGIN", "IF", "CASE", "WHILE", "REPEAT", "LOOP")


def split(text: str) -> list[str]:
    """The statements of a text; those inside of a routine's BEGIN and END stay together."""
    out, now, depth = [], "", 0
    body = False
    pieces = d.TOKEN.findall(text)
    before = ""
    for i, t in enumerate(pieces):
        up = t.upper()
        if not now.strip():
            rest = [x.upper() for x in pieces[i:] if not x.isspace()][:4]
            body = rest[:1] == ["CREATE"] and bool({"FUNCTION", "PROCEDURE", "TRIGGER"} & set(rest))
        if body and not t.isspace():
            following = next((x.upper() for x in pieces[i + 1 :] if not x.isspace()), "")
            if up in OPENS and before != "END" and not (up == "REPEAT" and following == "(") and not (up == "IF" and following == "("  and before not in ("", ";", "BEGIN", "THEN", "ELSE", "DO", "LOOP", "REPEAT")) and not (up == "IF" and following in ("EXISTS", "NOT") and depth == 0):
                depth += 1
            elif up == "END":
                depth -= 1
        if t == ";" and depth <= 0:
            if now.strip():
                out.append(now.strip())
            now, depth = "", 0
        elif not t.startswith("--"):
            now += t
        if not t.isspace():
            before = up
    if now.strip():
        out.append(now.strip())
    return out


class Leave(Exception):
    def __init__(self, label: str | None):
        self.label = label


class Iterate(Exception):
    def __init__(self, label: str | None):
        self.label = label


class Return(Exception):
    def __init__(self, value: object):
        self.value = value


class NotFound(Exception):
    """A cursor or a SELECT INTO without a row."""


@dataclass
class Routine:
    name: str
    kind: str
    params: list[tuple[str, str, str]]  # mode, name, type
    body: list
    text: str
    expression: Parts | None = None


@dataclass
class Scope:
    values: dict[str, object]
    up: Scope | None = None
    cursors: dict[str, list] = field(default_factory=dict)
    handlers: list[tuple[str, str, list]] = field(default_factory=list)
    temporary: list[str] = field(default_factory=list)

    def holder(self, name: str) -> Scope | None:
        s: Scope | None = self
        while s is not None and name not in s.values:
            s = s.up
        return s

    def visible(self) -> dict[str, object]:
        return (self.up.visible() if self.up else {}) | self.values

    def cursor(self, name: str) -> list:
        s: Scope | None = self
        while s is not None:
            if name in s.cursors:
                return s.cursors[name]
            s = s.up
        raise ValueError(f"no cursor {name}")


# -- reading a body --------------------------------------------------------------------------


class Reader:
    """Statements from tokens; a statement is a tuple whose first entry says what it is."""

    def __init__(self, parts: Parts):
        self.parts, self.at = parts, 0

    def word(self, ahead: int = 0) -> str:
        return self.parts[self.at + ahead].upper() if self.at + ahead < len(self.parts) else ""

    def expect(self, *words: str) -> None:
        for w in words:
            if self.word() != w:
                raise ValueError(f"{w} is expected, not {self.word() or 'the end'}")
            self.at += 1

    def until(self, *words: str) -> Parts:
        out, depth, cases = [], 0, 0
        while self.at < len(self.parts):
            p = self.parts[self.at]
            up = p.upper()
            if not depth and not cases and up in words:
                return out
            depth += (p == "(") - (p == ")")
            cases += (up == "CASE") - (up == "END" and cases > 0)
            out.append(p)
            self.at += 1
        raise ValueError(f"{' or '.join(words)} is missing")

    def block(self, *ends: str) -> list:
        out = []
        while self.word() not in ends:
            if not self.word():
                raise ValueError(f"{' or '.join(ends)} is missing")
            out.append(self.statement())
        return out

    def semicolon(self) -> None:
        if self.word() == ";":
            self.at += 1

    def statement(self) -> tuple:
        label = None
        if self.word(1) == ":":
            label = self.parts[self.at].lower()
            self.at += 2
        w = self.word()
        read = getattr(self, f"_{w.lower()}", None) if w in ("BEGIN", "IF", "CASE", "WHILE", "REPEAT", "LOOP", "DECLARE", "SET", "RETURN", "LEAVE", "ITERATE", "OPEN", "CLOSE", "FETCH") else None
        if read is None:
            body = self.until(";")
            self.semicolon()
            return ("sql", body)
        self.at += 1
        out = read(label)
        self.semicolon()
        return out

    def _begin(self, label: str | None) -> tuple:
        body = self.block("END")
        self.at += 1
        self._label(label)
        return ("block", label, body)

    def _label(self, label: str | None) -> None:
        if label is not None and self.word().lower() == label:
            self.at += 1

    def _if(self, label: str | None) -> tuple:
        branches, other = [], []
        cond = self.until("THEN")
        while True:
            self.expect("THEN")
            branches.append((cond, self.block("ELSEIF", "ELSE", "END")))
            if self.word() == "ELSEIF":
                self.at += 1
                cond = self.until("THEN")
                continue
            if self.word() == "ELSE":
                self.at += 1
                other = self.block("END")
            self.expect("END", "IF")
            return ("if", branches, other)

    def _case(self, label: str | None) -> tuple:
        subject = self.until("WHEN")
        branches, other = [], None
        while self.word() == "WHEN":
            self.at += 1
            cond = self.until("THEN")
            self.at += 1
            body = self.block("WHEN", "ELSE", "END")
            branches.append(([*subject, "=", *cond] if subject else cond, body))
        if self.word() == "ELSE":
            self.at += 1
            other = self.block("END")
        self.expect("END", "CASE")
        return ("if", branches, other if other is not None else [("fail", "no case fits")])

    def _while(self, label: str | None) -> tuple:
        cond = self.until("DO")
        self.at += 1
        body = self.block("END")
        self.expect("END", "WHILE")
        self._label(label)
        return ("loop", label, cond, body, None)

    def _repeat(self, label: str | None) -> tuple:
        body = self.block("UNTIL")
        self.at += 1
        cond = self.until("END")
        self.expect("END", "REPEAT")
        self._label(label)
        return ("loop", label, None, body, cond)

    def _loop(self, label: str | None) -> tuple:
        body = self.block("END")
        self.expect("END", "LOOP")
        self._label(label)
        return ("loop", label, None, body, None)

    def _declare(self, label: str | None) -> tuple:
        if self.word() in ("CONTINUE", "EXIT"):
            action = self.word()
            self.at += 2
            self.expect("FOR")
            kind = self.word()
            self.at += 2 if kind == "NOT" else 1
            return ("handler", action, "NOT FOUND" if kind == "NOT" else kind, [self.statement()])
        if self.word(1) == "CURSOR":
            name = self.parts[self.at].lower()
            self.at += 3
            return ("cursor", name, self.until(";"))
        rest = self.until(";")
        up = [x.upper() for x in rest]
        default = rest[up.index("DEFAULT") + 1 :] if "DEFAULT" in up else ["NULL"]
        names, i = [rest[0].lower()], 1
        while i < len(rest) and rest[i] == ",":
            names.append(rest[i + 1].lower())
            i += 2
        return ("declare", names, default)

    def _set(self, label: str | None) -> tuple:
        out = []
        for one in d.split_at(self.until(";")):
            at = next(i for i, p in enumerate(one) if p in ("=", ":="))
            out.append(("".join(one[:at]).lower().lstrip("@"), one[at + 1 :]))
        return ("set", out)

    def _return(self, label: str | None) -> tuple:
        return ("return", self.until(";"))

    def _leave(self, label: str | None) -> tuple:
        self.at += 1
        return ("leave", self.parts[self.at - 1].lower())

    def _iterate(self, label: str | None) -> tuple:
        self.at += 1
        return ("iterate", self.parts[self.at - 1].lower())

    def _open(self, label: str | None) -> tuple:
        self.at += 1
        return ("open", self.parts[self.at - 1].lower())

    def _close(self, label: str | None) -> tuple:
        self.at += 1
        return ("close", self.parts[self.at - 1].lower())

    def _fetch(self, label: str | None) -> tuple:
        rest = [x for x in self.until(";") if x.upper() not in ("NEXT", "FROM")]
        at = [x.upper() for x in rest].index("INTO")
        return ("fetch", rest[0].lower(), [x[0].lower().lstrip("@") for x in d.split_at(rest[at + 1 :])])


def validate(body: list, labels: frozenset[str] = frozenset(), cursors: frozenset[str] = frozenset()) -> None:
    """Labels and cursors that a body uses must be there; an error at CREATE, not at the call."""
    cursors = cursors | {s[1] for s in body if s[0] == "cursor"}
    for s in body:
        kind = s[0]
        if kind in ("leave", "iterate") and s[1] not in labels:
            raise ValueError(f"no label {s[1]}")
        if kind in ("open", "close", "fetch") and s[1] not in cursors:
            raise ValueError(f"no cursor {s[1]}")
        inner = labels | ({s[1]} if kind in ("block", "loop") and s[1] else set())
        if kind == "block":
            validate(s[2], inner, cursors)
        elif kind == "loop":
            validate(s[3], inner, cursors)
        elif kind == "if":
            for _, b in s[1]:
                validate(b, labels, cursors)
            validate(s[2], labels, cursors)
        elif kind == "handler":
            validate(s[3], labels, cursors)


def manifest(body: list) -> dict[str, int]:
    """How many statements of each kind a body holds."""
    out: dict[str, int] = {}
    for s in body:
        out[s[0]] = out.get(s[0], 0) + 1
        inner = {"block": [s[2]] if s[0] == "block" else [], "loop": [s[3]] if s[0] == "loop" else [], "if": [b for _, b in s[1]] + [s[2]] if s[0] == "if" else [], "handler": [s[3]] if s[0] == "handler" else []}.get(s[0], [])
        for b in inner:
            for k, n in manifest(b).items():
                out[k] = out.get(k, 0) + n
    return out


def create(e: Engine, parts: Parts, text: str) -> DataFrame:
    at = next(i for i, p in enumerate(parts) if p.upper() in ("FUNCTION", "PROCEDURE"))
    kind, at = parts[at].upper(), at + 1
    lenient = parts[at].upper() == "IF"
    at += 3 if lenient else 0
    name = parts[at].strip("`").lower()
    if name in e.routines and "REPLACE" not in [p.upper() for p in parts[:4]]:
        if lenient:
            return e._rows([(True,)], "ok boolean")
        raise ValueError(f"{name} is there already")
    end = d.closing(parts, at + 1)
    params = []
    for one in d.split_at(parts[at + 2 : end]):
        mode = one[0].upper() if one[0].upper() in ("IN", "OUT", "INOUT") else "IN"
        one = one[1:] if one[0].upper() in ("IN", "OUT", "INOUT") else one
        params.append((mode, one[0].strip("`").lower(), " ".join(one[1:])))
    rest = parts[end + 1 :]
    start = next(i for i, p in enumerate(rest) if p.upper() in ("RETURN", "BEGIN"))
    if rest[start].upper() == "RETURN":
        made = Routine(name, kind, params, [("return", rest[start + 1 :])], text, rest[start + 1 :])
    else:
        reader = Reader([*rest[start:], ";"])
        made = Routine(name, kind, params, [reader.statement()], text)
        validate(made.body)
    e.routines[name] = made
    if made.expression is not None:
        _declare(e, made)
    return e._rows([(True,)], "ok boolean")


def _declare(e: Engine, r: Routine) -> None:
    """A function of one expression is a SQL function of Spark, which Catalyst inlines; its own name may be that of a built-in one."""
    from .types import parse_type

    args = ", ".join(f"{n} {parse_type(t).simpleString()}" for _, n, t in r.params)
    e._spark(f"CREATE OR REPLACE TEMPORARY FUNCTION {e.prefix}_{r.name}({args}) RETURN {d._join(d.words(e._names(r.expression)))}")


# -- running ---------------------------------------------------------------------------------


class Run:
    def __init__(self, e: Engine):
        self.e = e
        self.result: DataFrame | None = None

    def value(self, expr: Parts, scope: Scope) -> object:
        expr = self._calls(self._inline(expr, scope))
        return self.e._select(["SELECT", *expr]).first()[0]

    def truth(self, expr: Parts, scope: Scope) -> bool:
        return bool(self.value(expr, scope))

    def _inline(self, parts: Parts, scope: Scope) -> Parts:
        """Variables as literals; a name after a dot, before one, or called isn't a variable."""
        from .engine import _literal

        known, out = scope.visible(), []
        for i, p in enumerate(parts):
            key = p.lower().lstrip("@")
            near = (i and parts[i - 1] == ".") or (i + 1 < len(parts) and parts[i + 1] in (".", "("))
            if key in known and not near and re.match(r"@?[A-Za-z_]", p):
                out.append(f"({_literal(known[key])})" if isinstance(known[key], (int, float)) and not isinstance(known[key], bool) and known[key] < 0 else _literal(known[key]))
            else:
                out.append(p)
        return out

    def _calls(self, parts: Parts) -> Parts:
        """Calls of functions with a body, run first, the inner ones before the outer."""
        from .engine import _literal

        out, i = [], 0
        while i < len(parts):
            r = self.e.routines.get(parts[i].lower())
            if r is not None and r.kind == "FUNCTION" and r.expression is None and i + 1 < len(parts) and parts[i + 1] == "(":
                end = d.closing(parts, i + 1)
                args = [self.value(a, Scope({})) for a in d.split_at(parts[i + 2 : end])]
                out.append(_literal(call_function(self.e, r, args)))
                i = end + 1
            else:
                out.append(parts[i])
                i += 1
        return out

    def body(self, statements: list, scope: Scope) -> None:
        for s in statements:
            if s[0] == "handler":
                scope.handlers.insert(0, (s[1], s[2], s[3]))
        for s in statements:
            if s[0] == "handler":
                continue
            try:
                self.one(s, scope)
            except (Leave, Iterate, Return, ExitBlock):
                raise
            except Exception as error:  # noqa: BLE001
                self.handle(error, scope)

    def handle(self, error: Exception, scope: Scope) -> None:
        kinds = ("NOT FOUND",) if isinstance(error, NotFound) else ("SQLEXCEPTION", "SQLWARNING")
        s: Scope | None = scope
        while s is not None:
            for action, kind, body in s.handlers:
                if kind in kinds:
                    self.body(body, Scope({}, s))
                    if action == "EXIT":
                        raise ExitBlock(s)
                    return
            s = s.up
        raise error

    def assign(self, name: str, value: object, scope: Scope) -> None:
        holder = scope.holder(name)
        if holder is not None:
            holder.values[name] = value
        else:
            self.e.variables[name] = value

    def one(self, s: tuple, scope: Scope) -> None:
        kind = s[0]
        if kind == "declare":
            value = self.value(s[2], scope)
            scope.values |= dict.fromkeys(s[1], value)
        elif kind == "set":
            for name, expr in s[1]:
                self.assign(name, self.value(expr, scope), scope)
        elif kind == "block":
            inner = Scope({}, scope)
            try:
                self.body(s[2], inner)
            except Leave as x:
                if x.label != s[1]:
                    raise
            except ExitBlock as x:
                if x.scope is not inner:
                    raise
            finally:
                for name in inner.temporary:
                    self.e.state.tables.pop(self.e._key(name), None)
        elif kind == "if":
            for cond, body in s[1]:
                if self.truth(cond, scope):
                    return self.body(body, scope)
            self.body(s[2], scope)
        elif kind == "loop":
            self.loop(s, scope)
        elif kind == "leave":
            raise Leave(s[1])
        elif kind == "iterate":
            raise Iterate(s[1])
        elif kind == "return":
            raise Return(self.value(s[1], scope))
        elif kind == "cursor":
            scope.cursors[s[1]] = [s[2], None]
        elif kind == "open":
            cursor = scope.cursor(s[1])
            cursor[1] = self.e._select(self._inline(cursor[0], scope)).toLocalIterator()
        elif kind == "fetch":
            rows: Iterator | None = scope.cursor(s[1])[1]
            if rows is None:
                raise ValueError(f"cursor {s[1]} isn't open")
            row = next(rows, None)
            if row is None:
                raise NotFound(s[1])
            for name, v in zip(s[2], row, strict=True):
                self.assign(name, v, scope)
        elif kind == "close":
            scope.cursor(s[1])[1] = None
        elif kind == "fail":
            raise ValueError(s[1])
        else:
            self.sql(s[1], scope)

    def loop(self, s: tuple, scope: Scope) -> None:
        _, label, before, body, after = s
        for _ in range(MOST_TURNS):
            if before is not None and not self.truth(before, scope):
                return
            try:
                self.body(body, Scope({}, scope))
            except Leave as x:
                if x.label != label:
                    raise
                return
            except Iterate as x:
                if x.label != label:
                    raise
            if after is not None and self.truth(after, scope):
                return
        raise RuntimeError(f"over {MOST_TURNS} turns")

    def sql(self, parts: Parts, scope: Scope) -> None:
        words = [p.upper() for p in parts]
        if words[0] == "SELECT" and "INTO" in words:
            return self.into(parts, scope)
        if words[0] == "CALL":
            return call(self.e, parts, scope, self)
        if words[:3] == ["CREATE", "TEMPORARY", "TABLE"]:
            at = 3 if words[3] != "IF" else 6
            s = scope
            s.temporary.append(parts[at])
        if words[0] == "INSERT":  # column names aren't variables
            at = next((i for i, w in enumerate(words) if w in ("VALUES", "SELECT")), len(parts))
            parts = parts[:at] + self._inline(parts[at:], scope)
        else:
            parts = self._inline(parts, scope)
        out = self.e._one(d._join(self._calls(parts)))
        if words[0] in ("SELECT", "WITH"):
            self.result = out

    def into(self, parts: Parts, scope: Scope) -> None:
        words = [p.upper() for p in parts]
        at = words.index("INTO")
        end = next((i for i in range(at, len(parts)) if words[i] in ("FROM", "WHERE", "LIMIT", "ORDER")), len(parts))
        names = [x[0].lower().lstrip("@") for x in d.split_at(parts[at + 1 : end])]
        rows = self.e._select(self._calls(self._inline(parts[:at] + parts[end:], scope))).limit(2).collect()
        if not rows:
            raise NotFound("SELECT INTO")
        if len(rows) > 1:
            raise ValueError("SELECT INTO gives more than one row")
        for name, v in zip(names, rows[0], strict=True):
            self.assign(name, v, scope)


class ExitBlock(Exception):
    def __init__(self, scope: Scope):
        self.scope = scope


def call_function(e: Engine, r: Routine, args: list[object]) -> object:
    if len(args) != len(r.params):
        raise ValueError(f"{r.name} takes {len(r.params)} arguments, not {len(args)}")
    scope = Scope({n: v for (_, n, _), v in zip(r.params, args, strict=True)})
    try:
        Run(e).body(r.body, scope)
    except Return as x:
        return x.value
    return None


def call(e: Engine, parts: Parts, scope: Scope | None = None, run: Run | None = None) -> DataFrame | None:
    """CALL name(arguments): OUT and INOUT arguments are variables."""
    name = parts[1].strip("`").lower()
    r = e.routines.get(name)
    if r is None or r.kind != "PROCEDURE":
        raise ValueError(f"no procedure {name}")
    args = d.split_at(parts[3 : d.closing(parts, 2)]) if len(parts) > 2 else []
    if len(args) != len(r.params):
        raise ValueError(f"{name} takes {len(r.params)} arguments, not {len(args)}")
    outer, mine = run or Run(e), Run(e)
    place = scope or Scope({})
    values = {}
    for (mode, n, _), a in zip(r.params, args, strict=True):
        if mode == "OUT":
            values[n] = None
        elif mode == "INOUT" and scope is None:
            values[n] = e.variables.get(a[0].lower().lstrip("@"))
        else:
            values[n] = outer.value(a, place)
    inner = Scope(values)
    try:
        mine.body(r.body, inner)
    except (Return, ExitBlock):
        pass
    for (mode, n, _), a in zip(r.params, args, strict=True):
        if mode != "IN":
            outer.assign(a[0].lower().lstrip("@"), inner.values[n], place)
    if run is not None:
        run.result = mine.result
    return mine.result


def select_into(e: Engine, parts: Parts, variables: dict[str, object]) -> DataFrame:
    """SELECT ... INTO @a outside of a routine."""
    Run(e).into(parts, Scope({}))
    return e._rows([(True,)], "ok boolean")
