"""Calls in SQL text as the expressions of the registry, so that SQL and Columns share one library."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import dialect as d
from .base import REGISTRY, call

#: Functions that Spark writes as operators; as names they need quotes.
OPERATORS = frozenset("+ - * / % = == <=> < <= > >= ! and or not & | ^ ~".split())
#: With one argument these are aggregates; the registry has those over the cells of a row.
AGGREGATES = frozenset("avg count max min sum".split())
#: With one argument these are SQL's own syntax.
SYNTAX = frozenset("cast case".split())
#: Longer arguments that an expression has more than once are bound to a name.
LONG = 120


def sql_of(column: Column) -> list[str]:
    """The tokens of a Column as SQL."""
    parts = d.tokens(column._jc.node().sql())
    out: list[str] = []
    for i, p in enumerate(parts):
        if p.lower() in OPERATORS and i + 1 < len(parts) and parts[i + 1] == "(":
            out.append(f"`{p}`")
        elif p in ("Infinity", "NaN"):
            out += ["DOUBLE", "(", f"'{p}'", ")"]
        elif re.fullmatch(r"\d+\.\d+(?:[eE][+-]?\d+)?", p):
            out.append(f"{p}D")
        elif i > 1 and parts[i - 2].lower() in ("timestampdiff", "timestampadd"):
            out.append(p.strip("'"))
        else:
            out.append(p)
    return out


def _value(parts: list[str]) -> object:
    """A literal's value; of anything else None."""
    text = "".join(parts)
    if re.fullmatch(r"-?\d+", text):
        return int(text)
    if re.fullmatch(r"-?\d+\.\d+(?:[eE][+-]?\d+)?", text):
        return float(text)
    if len(parts) == 1 and parts[0][0] in "'\"":
        return re.sub(r"\\(.)|''", lambda m: m[1] or "'", parts[0][1:-1])
    return None


def _arguments(name: str, parts: list[str]) -> list[list[str]] | None:
    """The arguments of a call; None if it is left to Spark."""
    args = d.split_at(parts)
    if name == "lookup" or args and (args[0][0].upper() in ("DISTINCT", "ALL", "BOTH", "LEADING", "TRAILING") or args[0] == ["*"]):
        return None
    if name in AGGREGATES | SYNTAX and len(args) < 2 or any(a[0].upper() == "INTERVAL" for a in args):
        return None
    if len(args) == 1 and name in ("extract", "position", "convert"):
        for word in ("FROM", "IN", "USING"):
            two = d.split_at(args[0], word)
            if len(two) == 2:
                return two[:1] if word == "USING" else two
    return args


def expand(name: str, parts: list[str]) -> list[str] | None:
    """The tokens that stand for a call of a registered function; None if it is none, or Spark's own.

    ``parts`` are the tokens between its parentheses, expanded already.
    """
    key = name.lower()
    args = _arguments(key, parts) if key in REGISTRY else None
    if args is None:
        return None
    given: list[object] = []
    for i, a in enumerate(args):
        value = _value(a)
        if key == "convert" and i == 1 or key == "extract" and i == 0:
            value = value if isinstance(value, str) else " ".join("bigint" if x.upper() in ("SIGNED", "UNSIGNED") else x for x in a)
        given.append(value if value is not None else F.lit(None) if [x.upper() for x in a] == ["NULL"] else F.expr(f"a__{i}"))
    if key == "convert" and len(given) == 1:
        return ["(", *args[0], ")"]
    out: list[str] = []
    body = sql_of(call(key, *given))
    bound = {f"a__{i}": a for i, a in enumerate(args) if len("".join(a)) > LONG and body.count(f"a__{i}") > 1}
    for p in body:
        plain = re.fullmatch(r"a__(\d+)", p)
        out += ["(", *args[int(plain[1])], ")"] if plain and p not in bound else [p]
    for variable, a in bound.items():
        out = ["element_at", "(", "transform", "(", "array", "(", *a, ")", ",", variable, "->", *out, ")", ",", "1", ")"]
    return ["(", *out, ")"]
