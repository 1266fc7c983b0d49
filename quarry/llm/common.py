"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one Arrow batch may hold: texts are long, so batches stay small.
BATCH_ROWS = 1024
#: Symbols (bytes or words) that one numpy pass works on.
PIECE = 1 << 19

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of long texts small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``).

    A folder of our own is used only where the setting is missing and all runs on one machine, as in tests.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir isn't set: executors need a folder that they share")
        root = f"file://{tempfile.mkdtemp(prefix='quarry-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/quarry-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes a table to the shared folder and reads it back."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that no plan reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path
        for folder in {f.rsplit("/", 2)[0] for f in df.inputFiles()}:
            at = path(folder)
            if at.getName().startswith("quarry-"):
                at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that no column of df has."""
    have, name = {c.lower() for c in df.columns}, base
    while name.lower() in have:
        name += "_"
    return name


def width(df: DataFrame, factor: int = 2) -> int:
    """Number of partitions that follows the size of the input."""
    conf = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(conf, factor * df.rdd.getNumPartitions())


class Recent(dict):
    """What ``make`` gives for keys seen lately: two generations of at most ``most`` keys each.

    A full generation becomes the old one; a key of the old one that is asked
    for again moves on, so frequent keys stay however many others pass by.
    """

    def __init__(self, make: Callable[[Any], Any], most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: Any) -> Any:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.put(key, value)
        return value

    def put(self, key: Any, value: Any) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value

    def knows(self, key: Any) -> bool:
        return key in self or key in self.old


# -- bytes, words and hashes ------------------------------------------------------------


def texts(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def words(text: bytes) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+``: exactly what bytes.split() does."""
    return text.split()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(29))) * U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> U64(32))


def powers(n: int, base: int = _BASE) -> np.ndarray:
    out = np.full(n, U64(base), dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_POW = powers(1 << 12)
_INV = powers(1 << 12, _BASE_INV)


def tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    global _POW, _INV
    if len(_POW) < n:
        m = 1 << (n - 1).bit_length()
        _POW, _INV = powers(m), powers(m, _BASE_INV)
    return _POW, _INV


def grams(x: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k symbols, by joining runs of half the length."""
    n = len(x) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, have, run, size = None, 0, x, 1
    while True:
        if k & size:
            if out is None:
                out, have = run, size
            else:
                m = len(x) - have - size + 1
                out = out[:m] * U64(pow(_BASE, size, 1 << 64)) + run[have : have + m]
                have += size
        if have == k:
            return mix(out[:n])
        m = len(x) - 2 * size + 1
        run = run[:m] * U64(pow(_BASE, size, 1 << 64)) + run[size : size + m]
        size *= 2


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n, size, run = len(x) - w + 1, 1, x
    if n <= 0:
        return x[:0]
    while size * 2 <= w:
        run = np.minimum(run[: len(run) - size], run[size:])
        size *= 2
    return np.minimum(run[:n], run[w - size : w - size + n])


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[s:e] for each span, from prefix sums."""
    n = len(values)
    up, down = tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def byte_symbols(buf: np.ndarray) -> np.ndarray:
    return _BYTE[buf]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word in a buffer of bytes."""
    inside = np.concatenate([[False], ~_SPACE[buf], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[0::2], edge[1::2]


class Piece:
    """Some documents, or a part of one, as one array of symbols.

    ``x`` holds the symbols, ``row`` and ``at`` the document and the position
    of each one.  A window belongs to exactly one piece.
    """

    __slots__ = ("x", "row", "at", "valid")

    def __init__(self, x: np.ndarray, row: np.ndarray, at: np.ndarray, window: int):
        self.x, self.row, self.at = x, row, at
        n = len(x) - window + 1
        self.valid = row[:n] == row[window - 1 :] if n > 0 else np.empty(0, bool)


def pieces(symbols: Iterable[tuple[int, np.ndarray]], window: int) -> Iterator[Piece]:
    """Packs (row, symbols) into pieces; a long document is cut into parts that overlap by window - 1."""
    xs: list[np.ndarray] = []
    rows: list[int] = []
    starts: list[int] = []
    n = 0

    def out() -> Piece:
        size = [len(x) for x in xs]
        at = np.concatenate([np.arange(s, s + m) for s, m in zip(starts, size, strict=True)])
        return Piece(np.concatenate(xs), np.repeat(np.array(rows), size), at, window)

    for row, x in symbols:
        for s in range(0, max(1, len(x) - window + 1), PIECE):
            part = x[s : s + PIECE + window - 1]
            if len(part) < window:
                continue
            if n and n + len(part) > PIECE + window:
                yield out()
                xs, rows, starts, n = [], [], [], 0
            xs.append(part)
            rows.append(row)
            starts.append(s)
            n += len(part)
    if n:
        yield out()


def anchors(p: Piece, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Winnowing: of each window, the k symbols of least hash, leftmost among equals.

    Equal windows have the same anchor at the same place in them.  Returns the
    anchors' hashes, their positions, and the first and last start of the
    windows that have this anchor; every valid window belongs to one anchor.
    """
    h = grams(p.x, k)
    order = (h & ~U64((1 << 20) - 1)) | np.arange(len(h), dtype=np.uint64)
    best = sliding_min(order, window - k + 1)
    start = np.flatnonzero(p.valid)
    if not len(start):
        e = np.empty(0, np.int64)
        return np.empty(0, np.uint64), e, e, e
    at = (best[start] & U64((1 << 20) - 1)).astype(np.int64)
    new = np.empty(len(at), bool)
    new[0] = True
    new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return h[at[first]], at[first], start[first], start[last]


def member(sorted_set: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether each x is in a sorted array."""
    if not len(sorted_set):
        return np.zeros(len(x), bool)
    i = np.searchsorted(sorted_set, x)
    i[i == len(sorted_set)] = 0
    return sorted_set[i] == x


def dealt(keys: np.ndarray, n: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by bucket, and (bucket, from, to) of those that hold any keys."""
    bucket = ((keys >> U64(20)) % U64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cut = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else np.empty(0, np.int64)
    ends = np.append(cut[1:], len(b))
    return order, [(int(b[s]), int(s), int(e)) for s, e in zip(cut, ends, strict=True)]


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of equal keys."""
    if not len(sorted_keys):
        e = np.empty(0, np.int64)
        return e, e
    first = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1]))
    return first, np.diff(np.append(first, len(sorted_keys)))


def in_blocks(docs: DataFrame, n: int) -> tuple[DataFrame, str]:
    """All columns of docs, and a column with the row's block: n blocks, dealt by a hash of the row.

    Every pass of a query reads the same exchange, which Spark then reuses.
    """
    block = fresh(docs, "block")
    return docs.withColumn(block, F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")).repartition(n, block), block


def word_hashes(batch: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes of the words) of each text, in order."""
    group: list[int] = []
    size = 0

    def out() -> Iterator[tuple[int, np.ndarray]]:
        buf = np.frombuffer(b"\n".join(batch[i] for i in group), np.uint8)
        s, e = word_spans(buf)
        h = spans_hash(_BYTE[buf], s, e)
        starts = np.cumsum([0, *(len(batch[i]) + 1 for i in group[:-1])])
        yield from zip(group, np.split(h, np.searchsorted(s, starts[1:])), strict=True)

    for i, text in enumerate(batch):
        if len(text) > PIECE:
            if group:
                yield from out()
                group, size = [], 0
            yield i, _long_word_hashes(text)
            continue
        if group and size + len(text) > PIECE:
            yield from out()
            group, size = [], 0
        group.append(i)
        size += len(text) + 1
    if group:
        yield from out()


def _long_word_hashes(text: bytes) -> np.ndarray:
    """The hashes of a very long text, by parts that end at white space."""
    buf, found, at = np.frombuffer(text, np.uint8), [], 0
    while at < len(buf):
        end = min(len(buf), at + PIECE)
        while end < len(buf) and not _SPACE[buf[end]]:
            step = _SPACE[buf[end : end + PIECE]]
            end += int(step.argmax()) if step.any() else len(step)
        s, e = word_spans(buf[at:end])
        found.append(spans_hash(_BYTE[buf[at:end]], s, e))
        at = end
    return np.concatenate(found) if found else np.empty(0, np.uint64)
