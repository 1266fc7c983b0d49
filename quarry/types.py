"""SQL type names and the Spark types that stand for them."""

from __future__ import annotations

import re

from pyspark.sql import types as T

#: Spellings without a length.  Unsigned integers take the next wider signed type.
KINDS: dict[str, tuple[T.DataType, T.DataType]] = {
    "TINYINT": (T.ByteType(), T.ShortType()),
    "SMALLINT": (T.ShortType(), T.IntegerType()),
    "INT": (T.IntegerType(), T.LongType()),
    "INTEGER": (T.IntegerType(), T.LongType()),
    "MEDIUMINT": (T.IntegerType(), T.LongType()),
    "BIGINT": (T.LongType(), T.DecimalType(20, 0)),
    "FLOAT": (T.FloatType(), T.FloatType()),
    "REAL": (T.FloatType(), T.FloatType()),
    "DOUBLE": (T.DoubleType(), T.DoubleType()),
    "DECIMAL": (T.DoubleType(), T.DoubleType()),
    "NUMERIC": (T.DoubleType(), T.DoubleType()),
    "DATE": (T.DateType(), T.DateType()),
    "DATETIME": (T.TimestampNTZType(), T.TimestampNTZType()),
    "TIMESTAMP": (T.TimestampType(), T.TimestampType()),
    "BOOL": (T.BooleanType(), T.BooleanType()),
    "BOOLEAN": (T.BooleanType(), T.BooleanType()),
    "BLOB": (T.BinaryType(), T.BinaryType()),
    "BINARY": (T.BinaryType(), T.BinaryType()),
    "VARBINARY": (T.BinaryType(), T.BinaryType()),
}


def parse_type(text: str) -> T.DataType:
    """A type's name; what isn't known is text, as VARCHAR, ENUM and UUID are."""
    words = re.sub(r"\(.*?\)", "", text.upper(), flags=re.S).split()
    plain, unsigned = KINDS.get(words[0], (T.StringType(), T.StringType()))
    return unsigned if "UNSIGNED" in words else plain


def length_of(text: str) -> int | None:
    """The greatest length of a VARCHAR or CHAR."""
    m = re.match(r"\s*(?:VAR)?CHAR\s*\(\s*(\d+)\s*\)", text, re.I)
    return int(m[1]) if m else None


def variants_of(text: str) -> list[str] | None:
    """The values of an ENUM."""
    m = re.match(r"\s*ENUM\s*\((.*)\)", text, re.I | re.S)
    return [x.replace("''", "'") for x in re.findall(r"'((?:[^']|'')*)'", m[1])] if m else None


def sql_name(kind: T.DataType) -> str:
    names = {T.ByteType: "TINYINT", T.ShortType: "SMALLINT", T.IntegerType: "INT", T.LongType: "BIGINT", T.FloatType: "FLOAT", T.DoubleType: "DOUBLE", T.DateType: "DATE", T.TimestampNTZType: "DATETIME", T.TimestampType: "TIMESTAMP", T.BooleanType: "BOOLEAN", T.BinaryType: "BLOB"}
    return names.get(type(kind), "TEXT")
