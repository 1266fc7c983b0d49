"""Embedding near-dedup by sorted projection passes.

1. Equal vectors of a label are one node with a count.
2. Each pass hashes the nodes, less their label's mean, by random hyperplanes,
   orders them by label and the concatenated bits, and compares each with the
   next ``window`` nodes in double precision.  All passes of a round run as one
   sort.  A partition hands on a spanning forest of the links it verified, not
   the links, and its first and last rows, for the windows over its borders.
   Rounds of new hyperplanes go on until one joins no more components.
3. The forests are joined to components.  Within a component, which may be a
   dense cluster wider than any window, all nodes are compared with each other
   in square blocks: a task holds two blocks, and hands on counts and a
   spanning forest.  So links inside a component are found without exception.

Missed are links between components that no pass of any round saw.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from .components import components, forest

PASSES = 16
WINDOW = 24
BITS = 48
#: Nodes in a block of a component.
BLOCK = 256

LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of equal length as one array of unit vectors, and which rows are usable."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = [np.array([np.nan if y is None else y for y in x], np.float64) if x is not None else np.empty(0) for x in column.to_pylist()] if column.null_count or column.flatten().null_count else None
    if rows is None:
        size = np.diff(column.offsets.to_numpy())
        flat = column.flatten().to_numpy().astype(np.float64)
        ends = np.cumsum(size)
        rows = [flat[e - n : e] for e, n in zip(ends, size, strict=True)]
    dim = max((len(x) for x in rows), default=0)
    good = np.array([len(x) > 0 and bool(np.isfinite(x).all()) and bool((x != 0).any()) for x in rows], bool)
    out = np.zeros((len(rows), dim))
    for i in np.flatnonzero(good):
        out[i, : len(rows[i])] = rows[i]
    # scaled first, so that squares neither overflow nor vanish
    top = np.abs(out).max(1, initial=0.0, keepdims=True)
    out = np.divide(out, top, out=np.zeros_like(out), where=top > 0)
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0), good


def _bits(x: np.ndarray, number: int) -> np.ndarray:
    """The sort key of a pass: the signs of random projections, as a signed long."""
    planes = np.random.Generator(np.random.PCG64([2718, number])).standard_normal((x.shape[1], BITS))
    return ((x @ planes) > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        _, good = matrix(b.column("embedding"))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(good)], names=[*b.schema.names, "good"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of the unit vectors of each label in a batch, and their number."""
    for b in batches:
        x, _ = matrix(b.column("embedding"))
        labels, which = np.unique(b.column("label").to_numpy(), return_inverse=True)
        total = np.zeros((len(labels), x.shape[1]))
        np.add.at(total, which, x)
        yield pa.RecordBatch.from_pydict({"label": labels, "total": pa.array(total.tolist(), pa.list_(pa.float64())), "n": np.bincount(which, minlength=len(labels))})


def _means(nodes: DataFrame) -> DataFrame:
    """The mean of the unit vectors of each label."""
    sums = nodes.select("label", "embedding").mapInArrow(_sums, "label long, total array<double>, n long")
    zero = F.lit(0.0)
    add = F.aggregate(F.collect_list("total"), F.array().cast("array<double>"), lambda x, y: F.zip_with(x, y, lambda a, b: F.coalesce(a, zero) + F.coalesce(b, zero)))
    return sums.groupBy("label").agg(add.alias("total"), F.sum("n").alias("n")).select("label", F.transform("total", lambda x: x / F.col("n")).alias("mean"))


def _keyed(batches: Iterator[pa.RecordBatch], numbers: range) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, _ = matrix(b.column("embedding"))
        mean = [m[: x.shape[1]] for m in b.column("mean").to_pylist()]
        x = x - np.array([m + [0.0] * (x.shape[1] - len(m)) for m in mean]).reshape(x.shape)
        b = b.select(["label", "node", "embedding"])
        for number in numbers if b.num_rows else ():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, number, np.int32)), pa.array(_bits(x, number) if x.shape[1] else np.zeros(b.num_rows, np.int64)), *b.columns], names=["pass", "key", *b.schema.names])


def _forest(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """A spanning forest of the links between ids."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = np.array(forest(len(ids), at[: len(a)].tolist(), at[len(a) :].tolist()), np.int64)
    far = np.flatnonzero(root != np.arange(len(ids)))
    return pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(ids[root[far]])], schema=LINKS)


def _windows(batches: Iterator[pa.RecordBatch], window: int, least: float) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by pass, label and key; gives links, and the first and last ``window`` rows."""
    rest, head, tail, seen = None, [], None, 0
    for batch in batches:
        x, _ = matrix(batch.column("embedding"))
        now = [batch.column("pass").to_numpy(), batch.column("label").to_numpy(), batch.column("node").to_numpy(), x]
        if not len(x):
            continue
        if seen < window:
            head.append(batch.slice(0, window - seen))
        late = pa.Table.from_batches([batch.slice(max(0, window - seen))])
        tail = late if tail is None else pa.concat_tables([tail, late])
        tail = tail.slice(max(0, tail.num_rows - window))
        seen += batch.num_rows
        if rest is not None:
            dim = max(rest[3].shape[1], x.shape[1])
            grown = [np.pad(v, ((0, 0), (0, dim - v.shape[1]))) for v in (rest[3], x)]
            now = [np.concatenate(v) for v in zip(rest[:3], now[:3], strict=True)] + [np.concatenate(grown)]
        number, label, node, x = now
        a, b = [], []
        for d in range(1, min(window, len(x) - 1) + 1):
            same = np.flatnonzero((number[d:] == number[:-d]) & (label[d:] == label[:-d]))
            cos = np.einsum("ij,ij->i", x[same], x[same + d])
            hit = same[cos >= least]
            a.append(node[hit])
            b.append(node[hit + d])
        if a and sum(map(len, a)):
            f = _forest(np.concatenate(a), np.concatenate(b))
            yield pa.RecordBatch.from_arrays([*f.columns, *(pa.nulls(f.num_rows, t.type) for t in list(batch.schema))], names=["a", "b", *batch.schema.names])
        rest = [v[-window:] for v in now]
    for e in [*head, *(tail.to_batches() if tail is not None else [])]:
        yield pa.RecordBatch.from_arrays([pa.nulls(e.num_rows, pa.int64()), pa.nulls(e.num_rows, pa.int64()), *e.columns], names=["a", "b", *e.schema.names])


def _round(nodes: DataFrame, numbers: range, window: int, least: float, n: int) -> DataFrame:
    """The links that some passes find, windows over the borders of partitions included."""
    row = "pass int, key long, label long, node long, embedding array<double>"
    keyed = nodes.select("label", "node", "embedding", "mean").mapInArrow(lambda it: _keyed(it, numbers), row)
    ordered = keyed.repartitionByRange(n, "pass", "label", "key").sortWithinPartitions("pass", "label", "key")
    found = c.written(ordered.mapInArrow(lambda it: _windows(it, window, least), f"a long, b long, {row}"), "windows")
    border = found.where("pass is not null").drop("a", "b").repartition(len(numbers), "pass").sortWithinPartitions("pass", "label", "key")
    over = border.mapInArrow(lambda it: _windows(it, window, least), f"a long, b long, {row}")
    return found.where("pass is null").select("a", "b").unionByName(over.where("pass is null").select("a", "b"))


def _squares(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by pair of blocks and side; gives (node, links) and, for the forest, (node, links 0, root)."""
    like = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
    rest: list[np.ndarray] | None = None

    def of(v: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        _, _, _, _, side, node, count, x = v
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = not len(b)
        b = a if same else b
        hit = x[a] @ x[b].T >= least
        if same:
            np.fill_diagonal(hit, False)
        out = [(node[a], hit @ count[b])]
        if not same:
            out.append((node[b], hit.T @ count[a]))
        for ids, links in out:
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links.astype(np.int64)), pa.nulls(len(ids), pa.int64())], schema=like)
        i, j = np.nonzero(hit)
        if len(i):
            f = _forest(node[a[i]], node[b[j]])
            yield pa.RecordBatch.from_arrays([f.column(0), pa.array(np.zeros(f.num_rows, np.int64)), f.column(1)], schema=like)

    for batch in batches:
        x, _ = matrix(batch.column("embedding"))
        if not len(x):
            continue
        now = [batch.column(n).to_numpy() for n in ("label", "component", "low", "high", "side", "node", "n")] + [x]
        if rest is not None:
            dim = max(rest[7].shape[1], x.shape[1])
            now = [np.concatenate(v) for v in zip(rest[:7], now[:7], strict=True)] + [np.concatenate([np.pad(v, ((0, 0), (0, dim - v.shape[1]))) for v in (rest[7], x)])]
        new = np.ones(len(now[0]), bool)
        new[1:] = np.logical_or.reduce([v[1:] != v[:-1] for v in now[:4]])
        first = np.flatnonzero(new)
        for s, e in zip(first, first[1:], strict=False):
            yield from of([v[s:e] for v in now])
        rest = [v[first[-1] :] for v in now]
    if rest is not None:
        yield from of(rest)


def near_duplicates(vectors: DataFrame, least: float = 0.98, passes: int = PASSES, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """One row for each vector: vec_id, n_links, component_id, kept.

    Vectors of equal, non-null labels link at a cosine of ``least`` or more in
    double precision.  Null, empty or zero vectors, and those with null or
    non-finite components, link with nothing: no links, their own id, kept.
    Vectors of unequal length compare as if padded with zeros.  Repeated rows
    link with each other, and so do rows with equal ids.  A null vec_id keeps
    its row and links, but names no component.  Of ties nothing depends.  An
    empty table gives an empty one.  Other columns are not read.

    Inside a component all pairs are compared, in squares of two blocks, as
    exact counts of links need it: a component of m different vectors costs
    m * m / 2 comparisons and sends each vector m / ``block`` times.
    """
    spark = vectors.sparkSession
    c.small_batches(spark)
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = c.written(base.mapInArrow(_usable, "vec_id long, label long, embedding array<double>, good boolean").withColumn("good", F.col("good") & F.col("label").isNotNull()), "vectors")
    usable = good.where("good").withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))
    nodes = usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    nodes = c.written(nodes.withColumn("node", F.xxhash64("label", "embedding")), "nodes")
    n = c.width(nodes)
    centred = c.written(nodes.join(_means(nodes), "label"), "centred")
    found, joined, start = None, -1, 0
    while True:
        new = _round(centred, range(start, start + passes), window, least, n)
        forest_ = new if found is None else new.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b")))
        found = c.written(components(forest_), "found")
        now = found.where("node <> component").count()
        if now <= joined or not now:
            break
        joined, start = now, start + passes
    # all pairs in a component, by squares of two blocks
    member = nodes.join(found, "node").select("label", "component", "node", "n", "embedding")
    size = member.groupBy("component").agg(F.count("*").alias("size")).withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    placed = member.join(size, "component").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    squares = other.select("label", "component", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "node", "n", "embedding")
    squares = squares.repartition(n, "component", "low", "high").sortWithinPartitions("component", "low", "high", "side")
    counted = c.written(squares.mapInArrow(lambda it: _squares(it, least), "node long, links long, root long"), "links")
    links = counted.groupBy("node").agg(F.sum("links").alias("links"))
    comp = components(counted.where(F.col("root").isNotNull()).select(F.col("node").alias("a"), F.col("root").alias("b")))
    of_node = nodes.join(links, "node", "left").join(comp, "node", "left").select("label", "embedding", "n", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component"))
    of_node = of_node.join(of_node.groupBy("component").agg(F.min("least").alias("component_id")), "component")
    keys = of_node.select("label", F.col("embedding").alias("e"), (F.col("n") - 1 + F.col("links")).alias("n_links"), "component_id")
    joined = usable.join(keys, (usable["label"] == keys["label"]) & (usable["embedding"] == keys["e"])).select("vec_id", "n_links", "component_id")
    alone = good.where("good is null or not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
