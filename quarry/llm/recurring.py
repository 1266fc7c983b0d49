"""Finding hashes that occur more than once, without a row for each of them.

A block of documents sends the distinct hashes that it holds, packed by bucket
into binary values, so a very frequent hash costs one entry a block.  The
lowest bit of an entry says that the block holds it more than once.  A bucket
answers each block with those of its hashes that recur.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as c

SENT = "bucket int, block int, data binary"
ANSWER = "block int, data binary"
ONE = c.U64(1)


def entries(hashes: np.ndarray, owners: np.ndarray | None = None) -> np.ndarray:
    """Sorted distinct hashes with their lowest bit set where they repeat.

    With owners a hash repeats if two owners have it, without if it is there twice.
    """
    if owners is None:
        k = np.sort(hashes | ONE)
        first, n = c.runs(k)
        return (k[first] ^ ONE) | (n > 1).astype(np.uint64)
    order = np.lexsort((owners, hashes | ONE))
    k, o = (hashes | ONE)[order], owners[order]
    first, n = c.runs(k)
    return (k[first] ^ ONE) | (o[first] != o[first + n - 1]).astype(np.uint64)


def packed(block: int, found: np.ndarray, buckets: int) -> dict[str, list]:
    order, cuts = c.dealt(found, buckets)
    found = found[order]
    return {"bucket": [b for b, _, _ in cuts], "block": [block] * len(cuts), "data": [found[s:e].tobytes() for _, s, e in cuts]}


def answer(hot: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of a partition of buckets, the recurring hashes of each block; the lowest bit says that over ``hot`` blocks have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, blocks = [], []
        for b in batches:
            for block, x in zip(b.column("block").to_pylist(), b.column("data").to_pylist(), strict=True):
                data.append(np.frombuffer(x, np.uint64))
                blocks.append(np.full(len(data[-1]), block, np.int32))
        if not data:
            return
        k, owner = np.concatenate(data), np.concatenate(blocks)
        order = np.argsort(k, kind="stable")
        k, owner = k[order], owner[order]
        first, n = c.runs(k | ONE)
        multi = np.logical_or.reduceat((k & ONE).astype(bool), first)
        keep = np.repeat((n > 1) | multi, n)
        k = (k & ~ONE) | np.repeat(n > hot, n).astype(np.uint64)
        k, owner = k[keep], owner[keep]
        order = np.argsort(owner, kind="stable")
        k, owner = k[order], owner[order]
        first, n = c.runs(owner)
        yield pa.RecordBatch.from_pydict({"block": owner[first].tolist(), "data": [k[s : s + m].tobytes() for s, m in zip(first, n, strict=True)]}, schema=pa.schema([("block", pa.int32()), ("data", pa.binary())]))

    return run


def recurring(sent: DataFrame, buckets: int, hot: int = 1 << 30) -> DataFrame:
    return sent.repartition(buckets, "bucket").mapInArrow(answer(hot), ANSWER)


def known(right: pa.Table) -> np.ndarray:
    """The recurring hashes of a block, sorted, with their lowest bits."""
    data = [np.frombuffer(x, np.uint64) for x in right.column("data").to_pylist()]
    return np.sort(np.concatenate(data)) if data else np.empty(0, np.uint64)
