"""Conditions, conversions and facts of the session."""

from __future__ import annotations

import os
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import arg, named


@dataclass
class Session:
    """What session functions report."""

    connection_id: int = 1
    user: str = "root@localhost"
    database: str | None = None
    last_insert_id: int = 0
    version: str = "1.0.0"


SESSION = Session()


def truthy(x: object) -> Column:
    """A number that isn't zero, or a text other than empty, 0, false and null."""
    s = F.lower(F.trim(arg(x).cast("string")))
    number = s.try_cast("double")
    return F.coalesce(F.when(number.isNotNull(), number != 0).otherwise(~s.isin("", "false", "null")), F.lit(False))  # booleans read as text


@named("bin", args=(1, 1))
def bin(x: object) -> Column:
    """Binary digits of a 64-bit number, in two's complement."""
    return F.bin(arg(x).cast("long"))


@named("binary", args=(1, 1))
def binary(x: object) -> Column:
    return arg(x)


@named("case", args=(2, None))
def case(*xs: object) -> Column:
    """Pairs of condition and value, and perhaps a last value for all else."""
    out = None
    for cond, value in zip(xs[0::2], xs[1::2], strict=False):
        out = F.when(truthy(cond), arg(value)) if out is None else out.when(truthy(cond), arg(value))
    return out.otherwise(arg(xs[-1])) if len(xs) % 2 else out


@named("cast", args=(1, 2))
def cast(x: object, kind: str | None = None) -> Column:
    """The value itself; with a type that Spark knows, converted, null where that fails."""
    return arg(x) if kind is None else arg(x).try_cast(kind)


@named("convert", args=(1, 2))
def convert(x: object, kind: str | None = None) -> Column:
    return cast(x, kind)


@named("coalesce", args=(0, None))
def coalesce(*xs: object) -> Column:
    return F.coalesce(*[arg(x) for x in xs]) if xs else F.lit(None)


@named("connection_id", args=(0, 0))
def connection_id() -> Column:
    return F.lit(SESSION.connection_id).cast("long")


@named("conv", args=(3, 3))
def conv(x: object, a: int, b: int) -> Column:
    """From base a to base b, 2 to 36; a negative number keeps its sign."""
    s = F.trim(arg(x).cast("string"))
    digits = F.conv(F.ltrim(s, F.lit("-")), int(a), abs(int(b)))
    return F.when(s.startswith("-") & (digits != "0"), F.concat(F.lit("-"), digits)).otherwise(digits)


@named("current_user", args=(0, 0))
def current_user() -> Column:
    return F.lit(SESSION.user)


@named("user", args=(0, 0))
def user() -> Column:
    return F.lit(SESSION.user)


@named("system_user", args=(0, 0))
def system_user() -> Column:
    return F.lit(SESSION.user)


@named("session_user", args=(0, 0))
def session_user() -> Column:
    """The user without a host."""
    return F.lit(SESSION.user.split("@")[0])


@named("database", args=(0, 0))
def database() -> Column:
    return F.lit(SESSION.database).cast("string")


@named("version", args=(0, 0))
def version() -> Column:
    return F.lit(SESSION.version)


@named("if", args=(3, 3))
def if_(cond: object, a: object, b: object) -> Column:
    return F.when(truthy(cond), arg(a)).otherwise(arg(b))


@named("ifnull", args=(2, 2))
def ifnull(a: object, b: object) -> Column:
    return F.coalesce(arg(a), arg(b))


@named("isnull", args=(1, 1))
def isnull(x: object) -> Column:
    return arg(x).isNull().cast("int")


@named("last_insert_id", args=(0, 1))
def last_insert_id(x: int | None = None) -> Column:
    """The session's number; with an argument, sets it."""
    if x is not None:
        SESSION.last_insert_id = int(x)
    return F.lit(SESSION.last_insert_id).cast("long")


@named("nullif", args=(2, 2))
def nullif(a: object, b: object) -> Column:
    return F.nullif(arg(a), arg(b))


@named("lookup", args=(4, 4))
def lookup(table: str, row: object, column: str, default: object) -> Column:
    """The value that a join has bound as ``table__column``, else the default; see operators.joins.lookup."""
    return F.coalesce(F.col(f"{table}__{column}"), arg(default))


@named("newuuid", args=(0, 0))
def newuuid() -> Column:
    """A version 7 UUID for each row: the time in milliseconds, then random bits."""
    millis = F.lpad(F.lower(F.hex(F.unix_millis(F.current_timestamp()))), 12, "0")
    bits = F.replace(F.uuid(), F.lit("-"), F.lit(""))
    return F.concat(F.substring(millis, 1, 8), F.lit("-"), F.substring(millis, 9, 4), F.lit("-7"), F.substring(bits, 14, 3), F.lit("-"), F.substring(bits, 17, 4), F.lit("-"), F.substring(bits, 21, 12))


def uuid7() -> str:
    """A version 7 UUID made here."""
    n = int(time.time() * 1000) << 80 | int.from_bytes(os.urandom(10))
    return str(uuid.UUID(int=n & ~(0xF << 76) & ~(0x3 << 62) | 0x7 << 76 | 0x2 << 62))
