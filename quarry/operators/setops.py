"""Set operations whose sides are brought to common types first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
#: Decimal digits that each holds.
DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 20}


def common_type(a: T.DataType, b: T.DataType, unsigned: bool = False) -> T.DataType:
    """The type that both sides take: wider integers, 64 bits for signed with unsigned, decimals for decimals with those or integers, doubles for floats, text for text with numbers."""
    if a == b:
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(b, T.NullType):
        return a
    both = (a, b)
    if all(isinstance(x, INTEGERS) for x in both):
        return T.LongType() if unsigned else max(both, key=lambda x: INTEGERS.index(type(x)))
    if all(isinstance(x, (*INTEGERS, T.DecimalType)) for x in both):
        a, b = (x if isinstance(x, T.DecimalType) else T.DecimalType(DIGITS[type(x)], 0) for x in both)
        scale = max(a.scale, b.scale)
        whole = max(a.precision - a.scale, b.precision - b.scale)
        return T.DecimalType(min(38, whole + scale), min(scale, max(38 - whole, 0)))
    if all(isinstance(x, T.NumericType) for x in both):
        return T.DoubleType()
    if all(isinstance(x, (T.DateType, T.TimestampType, T.TimestampNTZType)) for x in both):
        return next(x for x in both if not isinstance(x, T.DateType))
    if any(isinstance(x, T.BinaryType) for x in both):
        raise ValueError(f"{a.simpleString()} and {b.simpleString()} don't go together")
    return T.StringType()


def reconcile(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with the left one's names and common types."""
    if len(left.columns) != len(right.columns):
        raise ValueError("set operations need equally many columns")
    kinds = [common_type(a.dataType, b.dataType) for a, b in zip(left.schema, right.schema, strict=True)]
    right = right.toDF(*left.columns)
    cast = [F.col(f"`{n}`").cast(k).alias(n) for n, k in zip(left.columns, kinds, strict=True)]
    return left.select(*cast), right.select(*cast)


def union(left: DataFrame, right: DataFrame, every: bool = False) -> DataFrame:
    a, b = reconcile(left, right)
    return a.unionAll(b) if every else a.unionAll(b).distinct()


def except_(left: DataFrame, right: DataFrame) -> DataFrame:
    a, b = reconcile(left, right)
    return a.subtract(b)


def intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    a, b = reconcile(left, right)
    return a.intersect(b)


def collation(a: str | None, b: str | None) -> str | None:
    """The collation of both sides; different ones are an error."""
    if a and b and a.lower() != b.lower():
        raise ValueError(f"collations {a} and {b} don't go together")
    return a or b


def union_ci(left: DataFrame, right: DataFrame) -> DataFrame:
    """UNION under a collation that ignores case: of texts that differ in case only, the least stays."""
    a, b = reconcile(left, right)
    both = a.unionAll(b)
    keys = [F.lower(f.name).alias(f"__k{i}") if isinstance(f.dataType, T.StringType) else F.col(f.name).alias(f"__k{i}") for i, f in enumerate(both.schema)]
    grouped = both.groupBy(*keys).agg(F.min(F.struct(*both.columns)).alias("__r"))
    return grouped.select("__r.*")


def evaluate(operands: list[DataFrame], postfix: list[int | str]) -> DataFrame:
    """A mixed expression in postfix order: numbers of operands, and UNION, UNION ALL, EXCEPT, INTERSECT."""
    stack: list[DataFrame] = []
    for x in postfix:
        if isinstance(x, int):
            stack.append(operands[x])
            continue
        b, a = stack.pop(), stack.pop()
        stack.append({"UNION": lambda: union(a, b), "UNION ALL": lambda: union(a, b, every=True), "EXCEPT": lambda: except_(a, b), "INTERSECT": lambda: intersect(a, b)}[x]())  # noqa: B023
    return stack.pop()
