"""Tables as immutable snapshots, and the statements that make new ones.

A snapshot is a DataFrame over Parquet files with a hidden row number.  A
statement computes the next snapshot and the changed rows as DataFrames; no
row comes to the driver, only whether a constraint is broken.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import cut, stored

ROW = "__rid"


class ConstraintError(ValueError):
    pass


@dataclass(frozen=True)
class Field:
    name: str
    kind: T.DataType
    nullable: bool = True
    default: str | None = None  # an expression
    auto: bool = False
    length: int | None = None
    variants: tuple[str, ...] | None = None
    comment: str | None = None


@dataclass(frozen=True)
class Table:
    name: str
    fields: tuple[Field, ...]
    rows: DataFrame  # with ROW
    primary: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    indexes: dict[str, tuple[str, ...]] = field(default_factory=dict)
    foreign: tuple[tuple[str, str, str], ...] = ()
    #: The Parquet folders whose rows these are, if they are whole folders.
    files: tuple[str, ...] = ()
    #: Whether the rows are a DataFrame that is computed anew each time.
    wrapped: bool = False

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def df(self) -> DataFrame:
        return self.rows.select(*[f"`{c}`" for c in self.columns])

    def keys(self) -> list[tuple[str, ...]]:
        return [k for k in (self.primary, *self.unique) if k]

    def _typed(self, rows: DataFrame) -> DataFrame:
        return rows.select(ROW, *[F.col(f"`{f.name}`").cast(f.kind).alias(f.name) for f in self.fields])

    def with_rows(self, rows: DataFrame) -> Table:
        """A snapshot of other rows, written as one folder."""
        done, path = stored(self._typed(rows))
        return replace(self, rows=done, files=(path,), wrapped=False)

    def with_stored(self, rows: DataFrame) -> Table:
        """A snapshot of rows that are in the shared folder already."""
        return replace(self, rows=self._typed(rows), files=(), wrapped=False)

    def with_added(self, rows: DataFrame) -> Table:
        """A snapshot that also has these rows: old folders stay as they are, one is added.

        Beyond MANY folders, or many unions, all are written as one.
        """
        new, path = stored(self._typed(rows))
        files = (*self.files, path)
        if self.files and len(files) <= MANY:
            return replace(self, rows=new.sparkSession.read.schema(new.schema).parquet(*files), files=files)
        both = replace(self, rows=self.rows.unionByName(new), files=())
        return both if not self.files and not _is_union(self.rows) else self.with_rows(both.rows)


@dataclass(frozen=True)
class Change:
    table: Table
    rows: DataFrame  # what was inserted, updated or deleted
    last_id: int | None = None


#: Folders that a snapshot may have.
MANY = 64
#: New rows that are sent to all tasks to look for their keys; more are joined as Spark sees fit.
SMALL_ROWS = 100_000


def _is_union(df: DataFrame) -> bool:
    return df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "Union"


def numbered(df: DataFrame, base: int = 0) -> DataFrame:
    return df.withColumn(ROW, F.monotonically_increasing_id() + base)


def create(spark: SparkSession, name: str, fields: list[Field], primary: tuple[str, ...] = (), unique: tuple[tuple[str, ...], ...] = (), **more: object) -> Table:
    schema = T.StructType([T.StructField(ROW, T.LongType()), *[T.StructField(f.name, f.kind) for f in fields]])
    return Table(name, tuple(fields), spark.createDataFrame([], schema), primary, unique, **more)


def wrap(name: str, df: DataFrame, primary: tuple[str, ...] = (), unique: tuple[tuple[str, ...], ...] = ()) -> Table:
    """A table over a DataFrame, without copying it."""
    return Table(name, tuple(Field(f.name, f.dataType) for f in df.schema), numbered(df), primary, unique, wrapped=True)


def _check_fields(table: Table, rows: DataFrame) -> None:
    broken = []
    for f in table.fields:
        c = F.col(f"`{f.name}`")
        if not f.nullable or f.name in table.primary:
            broken.append((c.isNull(), f"{f.name} can't be null"))
        if f.length is not None:
            broken.append((F.char_length(c) > f.length, f"{f.name} is over {f.length} characters"))
        if f.variants is not None:
            broken.append((~c.isin(*f.variants), f"{f.name} isn't one of its values"))
    if broken:
        text = F.coalesce(*[F.when(bad, F.lit(message)) for bad, message in broken])
        found = rows.select(text.alias("m")).where("m is not null").limit(1).collect()
        if found:
            raise ConstraintError(found[0][0])


def _check_new(table: Table, rows: DataFrame) -> None:
    """New rows against each other, and by a semi join against the old ones, which aren't grouped or shuffled for it."""
    _check_unique(table, rows)
    for k in table.keys():
        cols = [f"`{c}`" for c in k]
        if table.rows.select(*cols).join(F.broadcast(rows.select(*cols)) if _small(rows) else rows.select(*cols), list(k), "left_semi").limit(1).collect():
            raise ConstraintError(f"duplicate key ({', '.join(k)}) in {table.name}")


def _small(rows: DataFrame) -> bool:
    """Whether rows that are written already are few enough to be sent to all tasks."""
    return rows.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS


def _check_unique(table: Table, rows: DataFrame, changed: set[str] | None = None) -> None:
    """Keys with a null in them are all different, but not primary ones; with ``changed`` only keys that have such a column."""
    for k in table.keys():
        if changed is not None and not changed & set(k):
            continue
        cols = [f"`{c}`" for c in k]
        if rows.dropna(subset=list(k)).groupBy(*cols).agg(F.count("*").alias("__n")).where("__n > 1").limit(1).collect():
            raise ConstraintError(f"duplicate key ({', '.join(k)}) in {table.name}")


def _complete(table: Table, new: DataFrame) -> tuple[DataFrame, int | None]:
    """New rows with defaults and automatic numbers, in the table's types, with row numbers after the old ones."""
    last = table.rows.agg(F.max(ROW)).first()[0]
    out = numbered(new, 0 if last is None else last + 1)
    have, first = set(new.columns), None
    for f in table.fields:
        if f.auto:
            top = table.rows.agg(F.max(f"`{f.name}`")).first()[0] or 0
            if f.name not in have:
                out = out.withColumn(f.name, F.lit(None).cast(f.kind))
            missing = out.where(F.col(f"`{f.name}`").isNull()).select(ROW)
            if missing.limit(1).collect():
                given = out.agg(F.max(F.col(f"`{f.name}`").cast("long"))).first()[0] or 0
                start = max(int(top), int(given)) + 1
                ids = _consecutive(missing, start)
                out = out.join(ids, ROW, "left").withColumn(f.name, F.coalesce(F.col(f"`{f.name}`"), F.col("__id").cast(f.kind))).drop("__id")
                first = start
        elif f.name not in have:
            out = out.withColumn(f.name, F.expr(f.default) if f.default is not None else F.lit(None))
    return cut(out.select(ROW, *[F.col(f"`{f.name}`").cast(f.kind).alias(f.name) for f in table.fields])), first


def _consecutive(rows: DataFrame, start: int) -> DataFrame:
    """Numbers without gaps from ``start`` in the order of the row numbers, by the counts of their partitions."""
    part = F.shiftright(F.col(ROW), 20)
    sized = rows.groupBy(part.alias("__p")).agg(F.count("*").alias("__n"))
    from pyspark.sql import Window

    before = sized.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__b"))  # a row for each million rows at most
    inner = F.row_number().over(Window.partitionBy("__p").orderBy(ROW))
    return rows.withColumn("__p", part).join(before, "__p").select(ROW, (F.lit(start) + F.col("__b") + inner - 1).alias("__id"))


def _match(a: str, b: str, keys: list[tuple[str, ...]]) -> Column:
    out = F.lit(False)
    for k in keys:
        one = F.lit(True)
        for c in k:
            one = one & (F.col(f"{a}.`{c}`") == F.col(f"{b}.`{c}`"))
        out = out | one
    return out


def insert(table: Table, new: DataFrame, mode: str = "error", assign: dict[str, str] | None = None) -> Change:
    """INSERT; mode: error, ignore (INSERT IGNORE), replace (REPLACE), upsert (ON DUPLICATE KEY UPDATE)."""
    if set(new.columns) - set(table.columns):
        raise ValueError(f"{table.name} has no column {', '.join(sorted(set(new.columns) - set(table.columns)))}")
    rows, first = _complete(table, new)
    keys = table.keys()
    if mode == "error" or not keys:
        _check_fields(table, rows)
        _check_new(table, rows)
        return Change(table.with_added(rows), rows.drop(ROW), first)
    if mode == "upsert":
        return _upsert(table, rows, assign or {}, first)
    if mode == "ignore":
        for k in keys:  # of new rows with equal keys the first, and none whose key is there
            same = rows.dropna(subset=list(k)).groupBy(*[f"`{c}`" for c in k]).agg(F.min(ROW).alias("__first"))
            rows = rows.join(same, list(k), "left").where(F.col("__first").isNull() | (F.col("__first") == F.col(ROW))).drop("__first")
            rows = rows.join(table.rows.select(*[f"`{c}`" for c in k]).dropna(), list(k), "left_anti")
        rows = cut(rows.select(ROW, *table.columns))
        _check_fields(table, rows)
        return Change(table.with_added(rows), rows.drop(ROW), first)
    _check_fields(table, rows)
    old = table.rows
    for k in keys:  # of new rows with equal keys the last, and no old row whose key comes
        same = rows.dropna(subset=list(k)).groupBy(*[f"`{c}`" for c in k]).agg(F.max(ROW).alias("__last"))
        rows = rows.join(same, list(k), "left").where(F.col("__last").isNull() | (F.col("__last") == F.col(ROW))).drop("__last")
        old = old.join(rows.select(*[f"`{c}`" for c in k]).dropna(), list(k), "left_anti")
    rows = cut(rows.select(ROW, *table.columns))
    return Change(table.with_rows(old.select(ROW, *table.columns).unionByName(rows)), rows.drop(ROW), first)


def _upsert(table: Table, rows: DataFrame, assign: dict[str, str], first: int | None) -> Change:
    """Rows whose key is there, or came before in the statement, change it; they are folded in their order, a key at a time."""
    key = next(k for k in table.keys() if all(c in rows.columns for c in k))
    if set(assign) & set(table.primary):
        raise ConstraintError("an upsert can't change the primary key")
    columns = table.columns
    struct = F.struct(ROW, *[f"`{c}`" for c in columns])
    grouped = rows.groupBy(*[f"`{c}`" for c in key]).agg(F.sort_array(F.collect_list(struct)).alias("__new"))
    old = table.rows.select(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(key)], struct.alias("__old"))
    on = F.lit(True)
    for i, c in enumerate(key):
        on = on & (F.col(f"`{c}`") == F.col(f"__k{i}"))
    both = old.join(grouped, on, "full")

    def side(name: str) -> str:
        text = assign.get(name)
        if text is None:
            return f"acc.`{name}`"
        text = re.sub(r"(?i)\bVALUES\s*\(\s*`?(\w+)`?\s*\)", lambda m: f"x.`{m[1]}`", text)
        return re.sub(r"(?<![\w.`'])`?([A-Za-z_]\w*)`?(?!\w*[(`'])", lambda m: f"acc.`{m[1]}`" if m[1] in columns else m[0], text)

    kinds = {f.name: f.kind.simpleString() for f in table.fields}
    merged = ", ".join(f"'{c}', cast({side(c)} as {kinds[c]})" for c in columns)
    fold = f"aggregate(if(__old is null, slice(__new, 2, size(__new)), __new), coalesce(__old, __new[0]), (acc, x) -> named_struct('{ROW}', acc.{ROW}, {merged}))"
    done = both.select(F.expr(f"case when __new is null then __old else {fold} end").alias("__r"), F.col("__new").isNotNull().alias("__changed"))
    done = cut(done.select("__r.*", "__changed"))
    _check_fields(table, done)
    _check_unique(table, done)
    return Change(table.with_stored(done), done.where("__changed").select(*columns), first)


def update(table: Table, assign: dict[str, str], where: str | None = None, source: DataFrame | None = None, order: list[str] | None = None, limit: int | None = None) -> Change:
    """UPDATE; with a source, of a row's matches one counts; an order and a limit choose the rows."""
    missing = set(assign) - set(table.columns)
    if missing:
        raise ValueError(f"{table.name} has no column {', '.join(sorted(missing))}")
    if source is not None or limit is not None:
        table = _fixed(table)
    rows = table.rows.alias(table.name)
    condition = F.expr(where) if where else F.lit(True)
    if source is None and limit is None:
        done = rows.withColumn("__hit", F.coalesce(condition, F.lit(False)))
        done = done.select(ROW, "__hit", *[F.when(F.col("__hit"), F.expr(assign[f.name])).otherwise(F.col(f"`{f.name}`")).cast(f.kind).alias(f.name) if f.name in assign else F.col(f"`{f.name}`") for f in table.fields])
    else:
        chosen = _chosen(rows, condition, source, order, limit, {c: F.expr(e) for c, e in assign.items()})
        done = table.rows.join(chosen, ROW, "left").withColumn("__hit", F.coalesce("__hit", F.lit(False)))
        done = done.select(ROW, "__hit", *[F.when(F.col("__hit"), F.col(f"__v_{f.name}")).otherwise(F.col(f"`{f.name}`")).cast(f.kind).alias(f.name) if f.name in assign else F.col(f"`{f.name}`") for f in table.fields])
    done = cut(done)
    _check_fields(table, done)
    _check_unique(table, done, set(assign))
    return Change(table.with_stored(done), done.where("__hit").select(*table.columns))


def _fixed(table: Table) -> Table:
    """Row numbers that hold still: those of a DataFrame that is computed anew each time are written first."""
    return table.with_rows(table.rows) if table.wrapped else table


def _chosen(rows: DataFrame, condition: Column, source: DataFrame | None, order: list[str] | None, limit: int | None, values: dict[str, Column]) -> DataFrame:
    """The row numbers that a statement hits, with the new values.

    The condition stays as it was given, so Spark finds the equal keys of a join in it; null hits nothing anyway.
    If no value needs the source, a semi join finds each row once; else of a row's matches one is kept.
    """
    wanted = [F.col(ROW), *[v.alias(f"__v_{c}") for c, v in values.items()], *[F.expr(re.sub(r"(?i)\s+(asc|desc)$", "", o)).alias(f"__o{i}") for i, o in enumerate(order or [])]]
    if source is None:
        found = rows.where(condition).select(*wanted)
    else:
        found = rows.join(source, condition).select(*wanted)
        found = rows.join(source, condition, "left_semi").select(*wanted) if _resolved(rows, wanted) else found.dropDuplicates([ROW])
    if limit is not None:
        keys = [F.desc(f"__o{i}") if re.search(r"(?i)\sdesc$", o) else F.asc(f"__o{i}") for i, o in enumerate(order or [])]
        found = found.orderBy(*keys, ROW).limit(limit)
    return found.select(ROW, F.lit(True).alias("__hit"), *[f"__v_{c}" for c in values])


def _resolved(rows: DataFrame, columns: list[Column]) -> bool:
    """Whether expressions need no columns but these rows' own."""
    try:
        return bool(rows.select(*columns).columns)
    except AnalysisException:
        return False


def delete(table: Table, where: str | None = None, source: DataFrame | None = None, order: list[str] | None = None, limit: int | None = None) -> Change:
    if source is not None or limit is not None:
        table = _fixed(table)
    rows = table.rows.alias(table.name)
    condition = F.expr(where) if where else F.lit(True)
    if source is None and limit is None:
        done = cut(rows.withColumn("__hit", F.coalesce(condition, F.lit(False))))
    else:
        chosen = _chosen(rows, condition, source, order, limit, {})
        done = cut(table.rows.join(chosen, ROW, "left").withColumn("__hit", F.coalesce("__hit", F.lit(False))))
    return Change(table.with_stored(done.where("not __hit")), done.where("__hit").select(*table.columns))


def truncate(table: Table) -> Change:
    return Change(table.with_rows(table.rows.limit(0)), table.df)


# -- changes of the schema -----------------------------------------------------------------


def add_column(table: Table, f: Field) -> Table:
    rows = table.rows.withColumn(f.name, (F.expr(f.default) if f.default is not None else F.lit(None)).cast(f.kind))
    return replace(table, fields=(*table.fields, f)).with_rows(rows)


def drop_column(table: Table, name: str) -> Table:
    if name in table.primary:
        raise ConstraintError(f"{name} is part of the primary key")
    return replace(table, fields=tuple(f for f in table.fields if f.name != name), rows=table.rows.drop(name), files=())


def rename_column(table: Table, old: str, new: str) -> Table:
    swap = lambda cols: tuple(new if c == old else c for c in cols)
    fields = tuple(replace(f, name=new) if f.name == old else f for f in table.fields)
    return replace(table, fields=fields, rows=table.rows.withColumnRenamed(old, new), files=(), primary=swap(table.primary), unique=tuple(swap(u) for u in table.unique))


def modify_column(table: Table, f: Field) -> Table:
    """A new type; values that can't be converted are an error."""
    old = F.col(f"`{f.name}`")
    lost = table.rows.where(old.isNotNull() & old.try_cast(f.kind).isNull()).limit(1).collect()
    if lost:
        raise ConstraintError(f"{f.name} holds values that aren't {f.kind.simpleString()}")
    out = replace(table, fields=tuple(f if g.name == f.name else g for g in table.fields))
    out = out.with_rows(table.rows.withColumn(f.name, old.try_cast(f.kind)))
    _check_fields(out, out.rows)
    return out
