"""The SQL front end: texts in the dialect as texts that Spark reads, and clauses that Spark lacks."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

TOKEN = re.compile(r"\s+|--[^\n]*|/\*.*?\*/|'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|@?[A-Za-z_]\w*|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?(?:(?:L|BD|D)\b)?|<=>|->|<>|!=|<=|>=|:=|\|\||.", re.S)
CLAUSES = ("SELECT", "FROM", "PREWHERE", "WHERE", "GROUP BY", "HAVING", "WINDOW", "QUALIFY", "ORDER BY", "CLUSTER BY", "DISTRIBUTE BY", "SORT BY", "LIMIT", "OFFSET", "FETCH", "FOR")
#: Words that say how a statement runs, not what it gives.
HINTS = re.compile(r"\b(?:SQL_NO_CACHE|SQL_CACHE|SQL_CALC_FOUND_ROWS|SQL_BUFFER_RESULT|HIGH_PRIORITY|LOW_PRIORITY|DELAYED|STRAIGHT_JOIN)\b|\b(?:USE|FORCE|IGNORE)\s+(?:INDEX|KEY)\s*\([^)]*\)", re.I)


def tokens(text: str) -> list[str]:
    """The tokens of a text without white space and comments."""
    return [t for t in TOKEN.findall(text) if not t.isspace() and not t.startswith(("--", "/*"))]



def _join(parts: list[str]) -> str:
    out = ""
    for p in parts:
        glue = "" if not out or p in (".", ",", ")") or out[-1] in ".(" or (p == "(" and re.search(r"\w$", out) and not re.search(r"(?i)\b(?:and|or|not|in|on|where|when|then|else|select|from|values|over|as|by|using|exists|any|all|union|except|intersect)$", out)) else " "
        out += glue + p
    return out


def split_at(parts: list[str], sep: str = ",") -> list[list[str]]:
    """The pieces between separators that no parenthesis encloses."""
    out: list[list[str]] = [[]]
    depth = 0
    for p in parts:
        depth += (p == "(") - (p == ")")
        if p.upper() == sep and not depth:
            out.append([])
        else:
            out[-1].append(p)
    return [x for x in out if x]


def closing(parts: list[str], at: int) -> int:
    """The place of the parenthesis that closes the one at ``at``."""
    depth = 0
    for i in range(at, len(parts)):
        depth += (parts[i] == "(") - (parts[i] == ")")
        if not depth:
            return i
    raise ValueError("a parenthesis isn't closed")


def clauses(parts: list[str]) -> dict[str, list[str]]:
    """The clauses of one SELECT by name."""
    out: dict[str, list[str]] = {}
    name, depth, i = "", 0, 0
    while i < len(parts):
        p = parts[i].upper()
        two = f"{p} {parts[i + 1].upper()}" if i + 1 < len(parts) else ""
        depth += (p == "(") - (p == ")")
        if not depth and (two in CLAUSES or p in CLAUSES) and not (p == "FOR" and name == "FETCH"):
            name = two if two in CLAUSES else p
            out[name] = []
            i += 2 if two in CLAUSES else 1
            continue
        out.setdefault(name, []).append(parts[i])
        i += 1
    return out


@dataclass
class Select:
    """A SELECT in the dialect: what Spark runs, and the row limits to apply to its result."""

    text: str
    order: list[str] = field(default_factory=list)  # hidden columns, with their directions
    limit: float | None = None
    percent: bool = False
    ties: bool = False
    offset: int = 0
    by: tuple[int, list[str]] | None = None  # rows for each value of some columns
    hidden: list[str] = field(default_factory=list)


def _by_extremes(value: list[str], op: str, every: bool, source: list[str]) -> list[str]:
    """A quantified comparison as a CASE over one-row subqueries: empty, decided by an extreme, open because of a null, or not."""

    def one(*what: str) -> list[str]:
        return ["(", "SELECT", *what, "FROM", *source, ")"]

    low, high = one("min", "(", "__v", ")"), one("max", "(", "__v", ")")
    nulls = [*one("count", "(", "*", ")"), ">", *one("count", "(", "__v", ")")]
    if op in ("=", "<>"):
        hit = ["(", *value, op, *low, "AND" if op == "=" else "OR", *value, op, *high, ")"]
    else:
        hit = ["(", *value, op, *(high if (op[0] == ">") == every else low), ")"]
    decided = ["NOT", *hit] if every else hit
    empty, first = ("true", "false") if every else ("false", "true")
    return ["(", "CASE", "WHEN", *one("count", "(", "*", ")"), "=", "0", "THEN", empty, "WHEN", *decided, "THEN", first, "WHEN", *nulls, "THEN", "NULL", "ELSE", *hit, "END", ")"]


def quantifiers(parts: list[str]) -> list[str]:
    """x op ANY (q) and x op ALL (q) by the subquery's least and greatest value and its counts, which are one row; = ANY as IN, <> ALL as NOT IN."""
    out: list[str] = []
    i, n = 0, 0
    while i < len(parts):
        word = parts[i].upper()
        if word in ("ANY", "SOME", "ALL") and i + 2 < len(parts) and parts[i + 1] == "(" and parts[i + 2].upper() == "SELECT" and out and out[-1] in ("=", "<>", "!=", "<", ">", "<=", ">="):
            end = closing(parts, i + 1)
            op = out.pop()
            start = len(out) - 1
            while start > 1 and out[start - 1] == ".":
                start -= 2
            value = out[start:]
            del out[start:]
            sub = quantifiers(parts[i + 2 : end])
            op = "<>" if op == "!=" else op
            if (word == "ALL", op) in ((False, "="), (True, "<>")):
                out += ["(", *value, *(["NOT"] if word == "ALL" else []), "IN", "(", *sub, ")", ")"]
            else:
                out += _by_extremes(value, op, word == "ALL", ["(", *sub, ")", f"__q{n}", "(", "__v", ")"])
            n += 1
            i = end + 1
        else:
            out.append(parts[i])
            i += 1
    return out


def words(parts: list[str]) -> list[str]:
    """Small differences: SIGNED types, quotes and LIKE, which ignores case."""
    out = []
    for i, p in enumerate(parts):
        up = p.upper()
        before = out[-1].upper() if out else ""
        if up in ("SIGNED", "UNSIGNED") and before == "AS":
            out.append("BIGINT")
        elif up == "INTEGER" and before in ("SIGNED", "UNSIGNED", "BIGINT"):
            continue
        elif p.startswith('"'):
            out.append("'" + p[1:-1].replace("'", "\\'") + "'")
        elif up == "LIKE":
            out.append("ILIKE")
        else:
            out.append(p)
    return out


def inline_windows(parts: list[str]) -> list[str]:
    """OVER (w ORDER BY ...) with w's definition in place, as Spark can't build on a named window."""
    defs: dict[str, list[str]] = {}
    c = clauses(parts)
    for d in split_at(c.get("WINDOW", [])):
        defs[d[0].lower()] = d[3:-1]

    def full(spec: list[str]) -> list[str]:
        if spec and spec[0].lower() in defs:
            base, own = full(defs[spec[0].lower()]), spec[1:]
            heads = {x.upper() for x in own}
            if "PARTITION" in heads:
                base = _without(base, "PARTITION")
            if "ORDER" in heads:
                base = _without(base, "ORDER")
            if heads & {"ROWS", "RANGE", "GROUPS"}:
                base = _without(base, "ROWS", "RANGE", "GROUPS")
            return _ordered(base + own)
        return spec

    out, i = [], 0
    while i < len(parts):
        if parts[i].upper() == "OVER" and i + 1 < len(parts) and defs:
            if parts[i + 1] == "(":
                end = closing(parts, i + 1)
                out += ["OVER", "(", *full(parts[i + 2 : end]), ")"]
                i = end + 1
                continue
            if parts[i + 1].lower() in defs:
                out += ["OVER", "(", *full([parts[i + 1]]), ")"]
                i += 2
                continue
        out.append(parts[i])
        i += 1
    return out


STARTS = ("PARTITION", "ORDER", "ROWS", "RANGE", "GROUPS")


def _sections(spec: list[str]) -> list[list[str]]:
    out: list[list[str]] = []
    for p in spec:
        if p.upper() in STARTS:
            out.append([])
        out[-1].append(p)
    return out


def _without(spec: list[str], *names: str) -> list[str]:
    return [p for s in _sections(spec) if s[0].upper() not in names for p in s]


def _ordered(spec: list[str]) -> list[str]:
    return [p for s in sorted(_sections(spec), key=lambda s: min(STARTS.index(s[0].upper()), 2)) for p in s]


def select(parts: list[str]) -> Select:
    """One SELECT without set operations on its level."""
    parts = inline_windows(words(quantifiers(parts)))
    c = clauses(parts)
    head = c["SELECT"]
    out = Select("")
    distinct = []
    if head and head[0].upper() in ("DISTINCT", "ALL"):
        distinct, head = [head[0]], head[1:]
    if head and head[0].upper() == "TOP":
        head = head[1:]
        if head[0] == "(":
            end = closing(head, 0)
            number, head = head[1:end], head[end + 1 :]
        else:
            number, head = head[:1], head[1:]
        out.limit = float(number[0])
        if head[0].upper() == "PERCENT":
            out.percent, head = True, head[1:]
        if head[0].upper() == "WITH" and head[1].upper() == "TIES":
            out.ties, head = True, head[2:]
    where = [c[k] for k in ("PREWHERE", "WHERE") if k in c]
    order = next((c[k] for k in ("ORDER BY", "CLUSTER BY", "DISTRIBUTE BY", "SORT BY") if k in c), [])
    if "FETCH" in c:
        f = [x.upper() for x in c["FETCH"]]
        f = f[1:] if f[0] in ("FIRST", "NEXT") else f
        out.limit = float(f[0]) if re.match(r"\d", f[0]) else 1.0
        out.percent, out.ties = "PERCENT" in f, "TIES" in f
    if "LIMIT" in c:
        limit = c["LIMIT"]
        names = [x.upper() for x in limit]
        if "BY" in names:
            at = names.index("BY")
            out.by = (int(limit[0]), [_join(x) for x in split_at(limit[at + 1 :])])
        elif "," in limit:
            out.offset, out.limit = int(limit[0]), float(limit[2])
        else:
            out.limit = float(limit[0])
    if "OFFSET" in c:
        out.offset = int(c["OFFSET"][0])
    body = []
    if "FROM" in c:
        body += ["FROM", *c["FROM"]]
    if where:
        body += ["WHERE"]
        for i, w in enumerate(where):
            body += [*(["AND"] if i else []), "(", *w, ")"]
    for k in ("GROUP BY", "HAVING"):
        if k in c:
            body += [*k.split(), *c[k]]
    items = list(head)
    special = out.by or out.percent or out.ties
    if special and not distinct:  # the order's expressions become hidden columns
        aliases = {x[-1].lower() for x in split_at(head)}
        for i, o in enumerate(split_at(order)):
            down = o[-1].upper() == "DESC"
            expr = o[:-1] if o[-1].upper() in ("ASC", "DESC") else o
            if len(expr) == 1 and expr[0].isdigit():
                item = split_at(head)[int(expr[0]) - 1]
                expr = item[: [x.upper() for x in item].index("AS")] if "AS" in [x.upper() for x in item] else item
            if len(expr) == 1 and expr[0].lower() in aliases and not any(len(x) == 1 and x[0].lower() == expr[0].lower() for x in split_at(head)):
                expr = next(x[:-1] if x[-2].upper() != "AS" else x[:-2] for x in split_at(head) if x[-1].lower() == expr[0].lower())
            items += [",", *expr, "AS", f"__o{i}"]
            out.order.append(f"__o{i}" + (" desc" if down else ""))
            out.hidden.append(f"__o{i}")
        if out.by:
            for i, b in enumerate(out.by[1]):
                items += [",", *tokens(b), "AS", f"__b{i}"]
                out.hidden.append(f"__b{i}")
    if "QUALIFY" in c:
        cond, extra, i, n = c["QUALIFY"], [], 0, 0
        test: list[str] = []
        while i < len(cond):
            if cond[i].upper() == "OVER":
                end = closing(cond, i + 1) if cond[i + 1] == "(" else i + 1
                start = len(test) - 1
                depth = 0
                while True:
                    depth += (test[start] == ")") - (test[start] == "(")
                    if not depth:
                        break
                    start -= 1
                start -= 1
                extra += [",", *test[start:], *cond[i : end + 1], "AS", f"__w{n}"]
                test[start:] = [f"__w{n}"]
                out.hidden.append(f"__w{n}")
                n += 1
                i = end + 1
                continue
            test.append(cond[i])
            i += 1
        text = ["SELECT", "*", "FROM", "(", "SELECT", *distinct, *items, *extra, *body, ")", "WHERE", *test]
    else:
        text = ["SELECT", *distinct, *items, *body]
    if order and not special:
        text += ["ORDER", "BY", *order]
    if not special:
        if out.limit is not None:
            text += ["LIMIT", str(int(out.limit))]
        if out.offset:
            text += ["OFFSET", str(out.offset)]
        out.limit, out.offset = None, 0
    out.text = _join(text)
    return out
