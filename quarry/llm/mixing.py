"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents of a source are dealt to blocks by a hash.  A source's target is met
by drawing each of its blocks a number of times, a permuted part of them once
more, and of one block a few documents.  The exact numbers of draws of all
sources are split among the output shards by a tree: a node halves its shards
and gives one half a multivariate-hypergeometric sample of its quotas.  The
draws of a source, permuted, go to the shards by these quotas, so each draw is
in exactly one shard; a shard is then shuffled on its own.

The driver handles a row for each source (and its quotas for each shard);
block and document rows stay distributed, and no step groups by source alone
but sums and the one block that is drawn in part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c

WEIGHTS = (5, 2, 1)
#: Documents in a block, about; positions that one prefix sum covers.
BLOCK_DOCS, RANGE = 256, 1024
REPEATS = 3
SEED = 11


def word_count(text: str = "text") -> Column:
    """The number of words ``[^\\x20\\x09-\\x0D]+``; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], most: float = REPEATS) -> list[float]:
    """Shares of the sum of sizes by weight; none over ``most`` times its size, whose excess the others share by weight."""
    total, fixed = float(sum(sizes)), [False] * len(sizes)
    out = [0.0] * len(sizes)
    while True:
        rest = total - sum(most * s for s, f in zip(sizes, fixed, strict=True) if f)
        weight = sum(w for w, f in zip(weights, fixed, strict=True) if not f)
        out = [most * s if f else rest * w / weight for s, w, f in zip(sizes, weights, fixed, strict=True)]
        over = [i for i, (t, s, f) in enumerate(zip(out, sizes, fixed, strict=True)) if not f and t > most * s]
        if not over:
            return out
        for i in over:
            fixed[i] = True
        if all(fixed):
            return [float(most * s) for s in sizes]


def split(quotas: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """The quotas of each shard, one row a shard; columns add up to ``quotas``, rows differ by at most one draw a tree level."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def down(q: np.ndarray, low: int, high: int) -> None:
        if high - low == 1:
            out[low] = q
            return
        middle = (low + high) // 2
        rng = np.random.Generator(np.random.PCG64([seed, low, high]))
        left, need, rest = np.zeros_like(q), int(q.sum()) * (middle - low) // (high - low), int(q.sum())
        for i, n in enumerate(q.tolist()):  # a multivariate hypergeometric, one source after another
            rest -= n
            left[i] = _hypergeometric(rng, n, rest, need)
            need -= int(left[i])
        down(left, low, middle)
        down(q - left, middle, high)

    down(np.asarray(quotas, np.int64), 0, shards)
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    if draws == 0 or good == 0:
        return 0
    if bad == 0:
        return draws
    if max(good, bad) < 10**9:
        return int(rng.hypergeometric(good, bad, draws))
    # beyond the sampler's range: the normal limit, within the possible numbers
    n, p = good + bad, good / (good + bad)
    sd = (draws * p * (1 - p) * (n - draws) / (n - 1)) ** 0.5
    return int(min(max(round(rng.normal(draws * p, sd)), draws - bad, 0), good, draws))


def permute(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A permutation of 0..n-1 at x: a Feistel network that walks on until it is in range."""
    if n <= 1:
        return x.copy()
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> np.uint64(half), v & mask
        for k in range(4):
            left, right = right, left ^ (c.mix(right + np.uint64((seed * 8 + k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) & mask)
        return left << np.uint64(half) | right

    v = once(x.astype(np.uint64))
    out = np.flatnonzero(v >= n)
    while len(out):
        v[out] = once(v[out])
        out = out[v[out] >= n]
    return v.astype(np.int64)


class Plan:
    """The sources and what the mix takes of each."""

    def __init__(self, rows: list[tuple[str | None, int, int]], weights: tuple[float, ...]):
        rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or ""))
        self.names = [r[0] for r in rows]
        self.docs, self.sizes = [r[1] for r in rows], [int(r[2]) for r in rows]
        self.targets = targets(self.sizes, [weights[i % len(weights)] for i in range(len(rows))]) if rows else []
        self.blocks = [max(1, -(-d // BLOCK_DOCS)) for d in self.docs]
        whole = [round(t) for t in self.targets]
        self.full = [min(REPEATS, q // s) if s else 0 for q, s in zip(whole, self.sizes, strict=True)]
        self.rest = [q - f * s if f < REPEATS else 0 for q, f, s in zip(whole, self.full, self.sizes, strict=True)]


def _draws(docs: DataFrame, weights: tuple[float, ...], shards: int) -> tuple[DataFrame, dict[str, str]]:
    """docs, the source's numbers, and for each row ``draws``: of each copy the shard, its block's place among the source's draws in it, and their number, the quota."""
    spark = docs.sparkSession
    used = {n: c.fresh(docs, n) for n in ("size", "src", "source_size", "target", "block", "draws", "extra")}
    u = used
    sized = docs.withColumn(u["size"], word_count())
    rows = sized.groupBy("source").agg(F.count("*").alias("n"), F.sum(u["size"]).alias("s")).collect()  # a row for each source
    plan = Plan([(r["source"], r["n"], r["s"]) for r in rows], weights)
    key = c.fresh(docs, "source_key")
    source = spark.createDataFrame([(n, i, s, float(t), b) for i, (n, s, t, b) in enumerate(zip(plan.names, plan.sizes, plan.targets, plan.blocks, strict=True))], T.StructType([T.StructField(key, T.StringType()), T.StructField(u["src"], T.IntegerType()), T.StructField(u["source_size"], T.LongType()), T.StructField(u["target"], T.DoubleType()), T.StructField(u["block"], T.LongType())]))
    placed = sized.join(F.broadcast(source), F.col("source").cast("string").eqNullSafe(F.col(key))).drop(key)  # a row for each source
    placed = placed.withColumn(u["block"], F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "source", u["size"]), F.col(u["block"])))

    # blocks in permuted order, and the words before each, by sums over ranges of positions
    blocks = placed.groupBy(F.col(u["src"]).alias("src"), F.col(u["block"]).alias("block")).agg(F.sum(u["size"]).alias("words"))

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            src, block = b.column("src").to_numpy(), b.column("block").to_numpy()
            at = np.zeros(len(src), np.int64)
            for s in np.unique(src):
                at[src == s] = permute(block[src == s], plan.blocks[s], SEED + 2 * int(s))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at)], names=[*b.schema.names, "at"])

    blocks = c.written(blocks.mapInArrow(positions, "src int, block long, words long, at long").withColumn("range", F.floor(F.col("at") / RANGE)), "blocks")
    ranges = blocks.groupBy("src", "range").agg(F.sum("words").alias("w"))
    ranges = ranges.select("src", "range", (F.sum("w").over(Window.partitionBy("src").orderBy("range")) - F.col("w")).alias("base"))
    inner = Window.partitionBy("src", "range").orderBy("at")
    ordered = blocks.join(ranges, ["src", "range"]).withColumn("end", F.col("base") + F.sum("words").over(inner)).withColumn("begin", F.col("end") - F.col("words"))
    rest = F.element_at(F.array(*[F.lit(x).cast("long") for x in plan.rest]), F.col("src") + 1) if plan.rest else F.lit(0)
    ordered = c.written(ordered.withColumn("part", F.when(F.col("end") <= rest, 1).when(F.col("begin") < rest, 2).otherwise(0)).withColumn("left", rest - F.col("begin")), "ordered")

    # positions of the blocks that are drawn once more, in part too, come first; so a source's draws are numbered without gaps
    last = {r["src"]: r["at"] for r in ordered.where("part > 0").groupBy("src").agg(F.max("at").alias("at")).collect()}  # a row for each source
    quotas = np.array([f * b + last.get(i, -1) + 1 for i, (f, b) in enumerate(zip(plan.full, plan.blocks, strict=True))], np.int64)
    given = split(quotas, shards) if len(quotas) else np.zeros((shards, 0), np.int64)
    ends = np.cumsum(given, axis=0)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            src, at, part = (b.column(n).to_numpy() for n in ("src", "at", "part"))
            shard, place = np.full((len(src), REPEATS), -1, np.int64), np.zeros((len(src), REPEATS), np.int64)
            for s in np.unique(src):
                mine = np.flatnonzero(src == s)
                for copy in range(REPEATS):
                    on = mine if copy < plan.full[s] else mine[part[mine] > 0] if copy == plan.full[s] else mine[:0]
                    x = permute(copy * plan.blocks[s] + at[on], int(quotas[s]), SEED + 2 * int(s) + 1)
                    to = np.searchsorted(ends[:, s], x, side="right")
                    shard[on, copy], place[on, copy] = to, x - ends[to, s] + given[to, s]
            lists = [[{"shard": int(y), "place": int(z), "quota": int(given[y, s])} for y, z in zip(sh, pl, strict=True) if y >= 0] for s, sh, pl in zip(src, shard, place, strict=True)]
            kind = pa.list_(pa.struct([("shard", pa.int32()), ("place", pa.int64()), ("quota", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("src"), b.column("block"), b.column("part"), b.column("left"), pa.array(lists, kind)], names=["b_src", "b_block", "b_part", "b_left", "b_draws"])

    dealt = ordered.select("src", "block", "part", "left", "at").mapInArrow(deal, "b_src int, b_block long, b_part int, b_left long, b_draws array<struct<shard:int,place:bigint,quota:bigint>>")
    clash = {n: c.fresh(placed, n) for n in ("b_src", "b_block", "b_part", "b_left", "b_draws")}
    dealt = dealt.select(*[F.col(n).alias(m) for n, m in clash.items()])
    joined = placed.join(dealt, (F.col(u["src"]) == F.col(clash["b_src"])) & (F.col(u["block"]) == F.col(clash["b_block"])))
    joined = joined.withColumn(u["draws"], F.col(clash["b_draws"]))

    # the block that is drawn in part: the documents that fit, the longest first
    def fitting(group: pa.Table) -> pa.Table:
        size, left = group.column(u["size"]).to_pylist(), group.column(clash["b_left"])[0].as_py()
        draws = group.column(u["draws"]).to_pylist()
        ids = group.column("doc_id").to_pylist()
        for i in sorted(range(len(size)), key=lambda i: (-size[i], ids[i] is None, ids[i] or 0)):
            if size[i] <= left:
                left -= size[i]
            else:
                draws[i] = draws[i][:-1]
        at = group.schema.get_field_index(u["draws"])
        return group.set_column(at, group.schema.field(at), pa.array(draws, group.schema.field(at).type))

    whole = joined.where(F.col(clash["b_part"]) != 2)
    some = joined.where(F.col(clash["b_part"]) == 2)
    some = some.groupBy(u["src"], u["block"]).applyInArrow(fitting, some.schema)
    return whole.unionByName(some).drop(*clash.values()), used


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, shards: int | None = None) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, taken, and one entry for each copy in shards, places, quotas.

    A copy goes to the shard that the splitting tree gives its block's draw;
    ``places`` is the draw's place among those of its source in the shard, and
    ``quotas`` how many the tree put there, so every place is under its quota.

    The texts are whole, however long; null and empty ones have size 0.  A null
    source is a source of its own, the last.  Rows with equal ids, and repeated
    rows, count each on their own; ties in size go by doc_id.  An empty table
    gives an empty one.  Reruns over the same rows agree.  Other columns of
    docs aren't read.
    """
    narrow = docs.select("doc_id", F.col("source").cast("string").alias("source"), "text")
    out, u = _draws(narrow, weights, shards or c.width(docs))
    return out.select("doc_id", "source", F.col(u["size"]).alias("size"), F.col(u["source_size"]).alias("source_size"), F.col(u["target"]).alias("target"), (F.col(u["size"]) * F.size(u["draws"])).alias("taken"), *[F.col(u["draws"])[k].alias(f"{k}s") for k in ("shard", "place", "quota")])


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, shards: int | None = None) -> DataFrame:
    """The mixed corpus: docs' columns, each document as often as it is drawn, dealt to shards and shuffled within them.

    Nulls, empty texts, ties, repeated rows and empty tables are as in plan_mix().
    """
    n = shards or c.width(docs)
    out, u = _draws(docs, weights, n)
    shard, order = c.fresh(out, "shard"), c.fresh(out, "order")
    copies = out.select("*", F.posexplode(F.col(u["draws"])["shard"]).alias(order, shard))
    shuffled = copies.repartition(n, shard).sortWithinPartitions(shard, F.xxhash64(F.lit(SEED), "doc_id", order))
    return shuffled.select(*docs.columns)
