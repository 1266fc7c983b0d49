"""SQL scripts as a source and a sink: CREATE TABLE and INSERT statements."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import parse_type, sql_name

#: Statements that set up a client and mean nothing here.
IGNORED = re.compile(r"^\s*(?:SET|LOCK|UNLOCK|USE|START|COMMIT|BEGIN|DROP|CREATE\s+(?!TABLE)|ALTER\s+TABLE\s+\S+\s+(?:DISABLE|ENABLE))\b", re.I)
CREATE = re.compile(r"^\s*CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?([`\"\w.]+)\s*\((.*)\)[^)]*$", re.I | re.S)
INSERT = re.compile(r"^\s*INSERT\s+(?:IGNORE\s+)?INTO\s+([`\"\w.]+)\s*(?:\(([^)]*)\))?\s*VALUES\s*", re.I)


def statements(text: str) -> Iterator[str]:
    """The statements of a script: quotes, comments and DELIMITER are understood."""
    delimiter, at, start, n = ";", 0, 0, len(text)
    while at < n:
        if at == start or text[at - 1] == "\n":
            m = re.compile(r"[ \t]*DELIMITER[ \t]+(\S+)[ \t]*(?:\n|$)", re.I).match(text, at)
            if m and not text[start:at].strip():
                delimiter, at = m[1], m.end()
                start = at
                continue
        ch = text[at]
        if ch in "'\"`":
            at += 1
            while at < n and text[at] != ch:
                at += 2 if text[at] == "\\" and ch != "`" else 1
            at += 1
        elif text.startswith("--", at) or ch == "#":
            end = text.find("\n", at)
            end = n if end < 0 else end
            text = text[:at] + " " * (end - at) + text[end:]
            at = end
        elif text.startswith("/*", at):
            end = text.find("*/", at)
            end = n if end < 0 else end + 2
            text = text[:at] + " " * (end - at) + text[end:]
            at = end
        elif text.startswith(delimiter, at):
            if text[start:at].strip():
                yield text[start:at].strip()
            at += len(delimiter)
            start = at
        else:
            at += 1
    if text[start:].strip():
        yield text[start:].strip()


TUPLE_TOKEN = re.compile(r"\s*(?:'((?:[^'\\]|\\.|'')*)'|([^,()'\s][^,()']*)|([,()]))", re.S)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "Z": "\x1a"}


def _unescape(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), s.replace("''", "'"), flags=re.S)


def tuples(text: str) -> Iterator[list[str | None]]:
    """The value lists of an INSERT as texts; NULL is None."""
    row: list[str | None] | None = None
    for m in TUPLE_TOKEN.finditer(text):
        if m[3] == "(":
            row = []
        elif m[3] == ")":
            yield row or []
            row = None
        elif row is not None and m[3] != ",":
            if m[1] is not None:
                row.append(_unescape(m[1]))
            else:
                word = m[2].strip()
                row.append(None if word.upper() == "NULL" else {"TRUE": "true", "FALSE": "false"}.get(word.upper(), word))


def _name(s: str) -> str:
    return s.strip().strip('`"').split(".")[-1].strip('`"')


def _columns(body: str) -> list[tuple[str, T.DataType]]:
    found = []
    for part in re.split(r",(?![^(]*\))", body):
        m = re.match(r"\s*([`\"]?\w+[`\"]?)\s+(\w+(?:\s*\([^)]*\))?(?:\s+UNSIGNED)?)", part, re.I)
        if m and m[1].upper() not in ("PRIMARY", "KEY", "UNIQUE", "INDEX", "CONSTRAINT", "FOREIGN", "CHECK"):
            found.append((_name(m[1]), parse_type(m[2])))
    return found


def import_dump(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a script, in one file or many.

    Files are read in parallel, in records that end with a semicolon at the
    end of a line; a record may hold comments and several statements, of
    several lines.  Only scripts with a DELIMITER are read as whole files, as
    a semicolon ends nothing in them.  Text that belongs to no statement is an
    error.  Only CREATE TABLE statements come to the driver.
    """
    whole = spark.read.text(path).where(F.col("value").rlike(r"(?i)^\s*DELIMITER\s")).limit(1).collect()
    records = spark.read.text(path, wholetext=True) if whole else spark.read.text(path, lineSep=";\n")

    def known(batches):
        import pyarrow as pa

        for b in batches:
            found = [(s, *_kind(s)) for record in b.column("value").to_pylist() for s in statements(record)]
            yield pa.RecordBatch.from_pydict({"kind": [k for _, k, _ in found], "name": [n for _, _, n in found], "value": [s for s, _, _ in found]}, schema=pa.schema([("kind", pa.string()), ("name", pa.string()), ("value", pa.string())]))

    parts = records.mapInArrow(known, "kind string, name string, value string")
    heads = parts.where("kind = 'create'").select("value").collect()  # a row for each table
    out = {}
    for (head,) in heads:
        m = CREATE.match(head)
        name, columns = _name(m[1]), _columns(m[2])
        inserts = parts.where((F.col("kind") == "insert") & (F.col("name") == name)).select("value")

        def rows(batches, names=[c for c, _ in columns]):
            import pyarrow as pa

            schema = pa.schema([(c, pa.string()) for c in names])
            for b in batches:
                found = []
                for line in b.column("value").to_pylist():
                    m = INSERT.match(line)
                    order = [_name(x) for x in m[2].split(",")] if m[2] else names
                    found += [dict(zip(order, r, strict=True)) for r in tuples(line[m.end() :])]
                yield pa.RecordBatch.from_pylist(found, schema=schema)

        raw = inserts.mapInArrow(rows, T.StructType([T.StructField(c, T.StringType()) for c, _ in columns]))
        out[name] = raw.select(*[F.col(f"`{c}`").cast(k).alias(c) for c, k in columns])
    return out


def _kind(statement: str) -> tuple[str, str | None]:
    """What a statement of a script is: create or insert with the table's name, or one that a script may have and that means nothing here."""
    if m := CREATE.match(statement):
        return "create", _name(m[1])
    if m := INSERT.match(statement):
        if statement.count("'") % 2 and not statement.rstrip().endswith(")"):
            raise ValueError(f"an INSERT isn't closed: {statement[:80]}")
        return "insert", _name(m[1])
    if IGNORED.match(statement):
        return "other", None
    raise ValueError(f"no statement of a script: {statement[:80]}")


def read_script(spark: SparkSession, text: str) -> dict[str, DataFrame]:
    """The tables of a small script given as text."""
    kinds: dict[str, list[tuple[str, T.DataType]]] = {}
    rows: dict[str, list[dict[str, str | None]]] = {}
    for s in statements(text):
        if IGNORED.match(s):
            continue
        if m := CREATE.match(s):
            kinds[_name(m[1])] = _columns(m[2])
        elif m := INSERT.match(s):
            name = _name(m[1])
            order = [_name(x) for x in m[2].split(",")] if m[2] else [c for c, _ in kinds[name]]
            rows.setdefault(name, []).extend(dict(zip(order, r, strict=True)) for r in tuples(s[m.end() :]))
    out = {}
    for name, columns in kinds.items():
        schema = T.StructType([T.StructField(c, T.StringType()) for c, _ in columns])
        raw = spark.createDataFrame([tuple(r.get(c) for c, _ in columns) for r in rows.get(name, [])], schema)
        out[name] = raw.select(*[F.col(f"`{c}`").cast(k).alias(c) for c, k in columns])
    return out


def literal(c: Column, kind: T.DataType) -> Column:
    """A value as SQL text."""
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        text = c.cast("string")
    else:
        s = c.cast("string")
        for a, b in (("\\", "\\\\"), ("'", "''"), ("\n", "\\n"), ("\r", "\\r")):
            s = F.replace(s, F.lit(a), F.lit(b))
        text = F.concat(F.lit("'"), s, F.lit("'"))
    return F.coalesce(text, F.lit("NULL"))


def ddl(df: DataFrame, name: str) -> str:
    return f"CREATE TABLE `{name}` ({', '.join(f'`{f.name}` {sql_name(f.dataType)}' for f in df.schema)});"


def export_table(df: DataFrame, name: str, path: str) -> None:
    """Writes a table as a script: its DDL in one file, an INSERT a row in the others, in parallel."""
    head = df.sparkSession.createDataFrame([(ddl(df, name),)], "value string")
    values = F.concat_ws(", ", *[literal(F.col(f"`{f.name}`"), f.dataType) for f in df.schema])
    names = ", ".join(f"`{c}`" for c in df.columns)
    rows = df.select(F.concat(F.lit(f"INSERT INTO `{name}` ({names}) VALUES ("), values, F.lit(");")).alias("value"))
    head.coalesce(1).write.mode("append").text(path)
    rows.write.mode("append").text(path)


def python_literal(text: str) -> object:
    """A literal of a VALUES list as a Python value."""
    try:
        return ast.literal_eval(text)
    except (SyntaxError, ValueError):
        return text
