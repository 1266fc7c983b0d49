"""SimHash near-dedup with pivot distance tables.

Fingerprints: 64 bits by majority over the XXH64 of word shingles, repeats
included.  Equal fingerprints are one node, whatever number of documents has
them.  Two fingerprints within ``bits`` bits agree in at least two of
``bits`` + 2 parts of their bits; each pair of parts (six, for two bits, of 32
bits) deals the nodes to groups, as one table of all would be all pairs.  In a group a table holds the distances of every node to
many reference fingerprints (pivots).  By the triangle inequality the
distances of linked nodes to any pivot differ by no more than ``bits``: nodes
are sorted by the first pivot, only neighbours in that order are considered,
pairs whose largest coordinate difference is over ``bits`` go, and survivors
are compared bit by bit.  A group passes on a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c
from .components import components, forest

SEED = 42
#: Pivots in a table.
PIVOTS = 16
PIVOT_BITS = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 64, PIVOTS, dtype=np.uint64)
#: Pairs that one comparison step holds.
STEP = 1 << 20
#: Nodes of a group that near_tree compares with each other.
BLOCK = 256

# Fixed values of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rot(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def xxh64(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of buf[s:e] for each span, vectorised for spans under 32 bytes."""
    size = end - start
    out = np.empty(len(start), np.uint64)
    for i in np.flatnonzero(size >= 32):
        out[i] = xxhash.xxh64_intdigest(buf[start[i] : end[i]].tobytes(), seed)
    short = np.flatnonzero(size < 32)
    if not len(short):
        return out
    padded = np.concatenate([buf, np.zeros(8, np.uint8)]).astype(np.uint64)
    two = padded[:-1] | padded[1:] << np.uint64(8)
    four = two[:-2] | two[2:] << np.uint64(16)
    eight = four[:-4] | four[4:] << np.uint64(32)
    at, left = start[short].copy(), size[short].copy()
    h = np.uint64(seed) + P5 + left.astype(np.uint64)
    for _ in range(3):
        on = np.flatnonzero(left >= 8)
        if not len(on):
            break
        k = _rot(eight[at[on]] * P2, 31) * P1
        h[on] = _rot(h[on] ^ k, 27) * P1 + P4
        at[on] += 8
        left[on] -= 8
    on = np.flatnonzero(left >= 4)
    h[on] = _rot(h[on] ^ (four[at[on]] * P1), 23) * P2 + P3
    at[on] += 4
    left[on] -= 4
    for _ in range(3):
        on = np.flatnonzero(left > 0)
        if not len(on):
            break
        h[on] = _rot(h[on] ^ (padded[at[on]] * P5), 11) * P1
        at[on] += 1
        left[on] -= 1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    out[short] = h ^ (h >> np.uint64(32))
    return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def fingerprints(batch: list[bytes], words: int = 3) -> np.ndarray:
    """The fingerprint of each text."""
    out = np.zeros(len(batch), np.uint64)
    group: list[int] = []
    size = 0
    for i, text in enumerate(batch):
        if group and size + len(text) > c.PIECE:
            out[group] = _fingerprints([batch[g] for g in group], words)
            group, size = [], 0
        group.append(i)
        size += len(text)
    if group:
        out[group] = _fingerprints([batch[g] for g in group], words)
    return out


def _fingerprints(batch: list[bytes], words: int) -> np.ndarray:
    split = [x.split() for x in batch]
    count = np.array([len(w) for w in split])
    buf = _LOWER[np.frombuffer(b" ".join(b" ".join(w) for w in split if w), np.uint8)]
    if not len(buf):
        return np.zeros(len(batch), np.uint64)
    gap = np.flatnonzero(buf == 32)
    start, end = np.append(0, gap + 1), np.append(gap, len(buf))
    first = np.cumsum(count) - count
    shingles = np.where(count > 0, np.maximum(count - words + 1, 1), 0)
    a = np.repeat(first - np.cumsum(shingles) + shingles, shingles) + np.arange(shingles.sum())
    b = np.minimum(a + words - 1, np.repeat(first + count - 1, shingles))
    return majority(xxh64(buf, start[a], end[b]), shingles)


def majority(h: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """The fingerprint of each text, of which ``shingles`` says how many of the hashes are its own; zero if none."""
    total = np.zeros((len(shingles), 64), np.int64)
    some = np.flatnonzero(shingles)
    edge = (np.cumsum(shingles) - shingles)[some]
    step = 1 << 14
    bounds = np.append(edge, len(h))
    for s in range(0, len(h), step):
        bits = np.unpackbits(h[s : s + step].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        inside = np.flatnonzero((bounds[:-1] < s + step) & (bounds[1:] > s))
        cut = np.maximum(bounds[inside], s) - s
        total[some[inside]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
    set_ = (total * 2 > shingles[:, None]).astype(np.uint8)
    return np.packbits(set_, axis=1).view(">u8").ravel().astype(np.uint64)


def distances(x: np.ndarray, pivots: np.ndarray = PIVOT_BITS) -> np.ndarray:
    """The pivot distance table of some fingerprints."""
    return np.bitwise_count(x[:, None] ^ pivots[None, :]).astype(np.int8)


def close_pairs(x: np.ndarray, bits: int, pivots: np.ndarray = PIVOT_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of fingerprints that differ in at most ``bits`` bits, in steps of bounded size."""
    table = distances(x, pivots)
    order = np.lexsort((table[:, 1], table[:, 0]))
    table, y = table[order], x[order]
    lead = table[:, 0].astype(np.int64) * 128 + table[:, 1]
    # of each node, the later ones with the same first coordinate and a second one that is not too far, then those with the next first coordinates
    for d in range(bits + 1):
        low = np.searchsorted(lead, (table[:, 0].astype(np.int64) + d) * 128 + table[:, 1] - bits)
        high = np.searchsorted(lead, (table[:, 0].astype(np.int64) + d) * 128 + table[:, 1] + bits, side="right")
        if d == 0:
            low = np.arange(len(x)) + 1
        size = np.maximum(high - low, 0)
        done = 0
        cum = np.cumsum(size)
        while done < len(x):
            base = cum[done - 1] if done else 0
            to = max(done + 1, int(np.searchsorted(cum, base + STEP, side="right")))
            m = size[done:to]
            if m.sum():
                i = np.repeat(np.arange(done, to), m)
                j = np.repeat(low[done:to] - np.cumsum(m) + m, m) + np.arange(m.sum())
                for col in range(2, table.shape[1]):
                    keep = np.abs(table[i, col] - table[j, col]) <= bits
                    i, j = i[keep], j[keep]
                keep = np.bitwise_count(y[i] ^ y[j]) <= bits
                yield order[i[keep]], order[j[keep]]
            done = to


def leaders(x: np.ndarray, bits: int) -> np.ndarray:
    """At most PIVOTS of the fingerprints, each over ``bits`` from those before it: pivots for a radius at which all are about as far from a random one."""
    found, far = [], np.full(len(x), 65)
    while len(found) < PIVOTS and (far > bits).any():
        found.append(x[np.argmax(far > bits)])
        far = np.minimum(far, np.bitwise_count(x ^ found[-1]))
    return np.array(found, np.uint64)


def near_tree(node: np.ndarray, x: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Pairs of nodes within ``bits`` bits, the closest first, that join all nodes which such pairs join.

    Over BLOCK nodes are dealt to the nearest of their leaders and compared in
    blocks of like distance from it, each with the leader: linear in the number
    of nodes, and pairs between blocks don't come.
    Equal distances go by the nodes, so that groups with the same nodes give the same pairs.
    """
    pivots = leaders(x, bits)
    if len(x) <= BLOCK:
        blocks = [np.arange(len(x))]
    else:
        table = distances(x, pivots)
        own = table.argmin(1)
        blocks = []
        for k in range(len(pivots)):
            cell = np.flatnonzero(own == k)
            cell = cell[np.lexsort((node[cell], table[cell, k]))]
            blocks += [np.append(cell[0], cell[s : s + BLOCK]) for s in range(1, len(cell), BLOCK)]
    pivots = np.append(pivots, PIVOT_BITS)[:PIVOTS]
    out = []
    for at in blocks:
        pairs = [p for p in close_pairs(x[at], bits, pivots) if len(p[0])]
        if not pairs:
            continue
        i, j = (np.concatenate(v) for v in zip(*pairs, strict=True))
        a, b = np.minimum(node[at[i]], node[at[j]]), np.maximum(node[at[i]], node[at[j]])
        order = np.lexsort((b, a, np.bitwise_count(x[at[i]] ^ x[at[j]])))
        out += tree(len(at), i[order], j[order], a[order], b[order])
    return out


def tree(n: int, i: np.ndarray, j: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Of the pairs (a, b) between items i and j of n, in their order, those that join what pairs before them didn't."""
    up, out = list(range(n)), []
    for p, q, v, w in zip(i.tolist(), j.tolist(), a.tolist(), b.tolist(), strict=True):
        while up[p] != p:
            up[p] = up[up[p]]
            p = up[p]
        while up[q] != q:
            up[q] = up[up[q]]
            q = up[q]
        if p != q:
            up[p] = q
            out.append((v, w))
            if len(out) == n - 1:
                break
    return out


def _parts(bits: int) -> list[int]:
    """Masks of bits + 2 parts of the 64 bits."""
    edges = np.linspace(0, 64, bits + 3).astype(int)
    return [((1 << int(b - a)) - 1) << int(a) for a, b in zip(edges, edges[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _links(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group; each group gives a spanning forest of its links."""
    like = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    rest: tuple[np.ndarray, ...] | None = None

    def of(kind: np.ndarray, key: np.ndarray, fp: np.ndarray, last: bool) -> tuple[list[pa.RecordBatch], tuple[np.ndarray, ...] | None]:
        new = np.flatnonzero(np.append(True, (kind[1:] != kind[:-1]) | (key[1:] != key[:-1])))
        end = np.append(new[1:], len(kind))
        a: list[int] = []
        b: list[int] = []
        for s, e in zip(new, end if last else end[:-1], strict=False):
            if e - s < 2:
                continue
            x = fp[s:e].view(np.uint64)
            found = [p for p in close_pairs(x, bits) if len(p[0])]
            if found:
                i, j = (np.concatenate(v).tolist() for v in zip(*found, strict=True))
                root = np.array(forest(len(x), i, j))
                far = np.flatnonzero(root != np.arange(len(x)))
                a += fp[s:e][far].tolist()
                b += fp[s:e][root[far]].tolist()
        out = [pa.RecordBatch.from_pydict({"a": a, "b": b}, schema=like)] if a else []
        return out, None if last else tuple(v[new[-1] :] for v in (kind, key, fp))

    for batch in batches:
        cols = tuple(batch.column(n).to_numpy(zero_copy_only=False) for n in ("kind", "key", "fp"))
        if rest is not None:
            cols = tuple(np.concatenate(v) for v in zip(rest, cols, strict=True))
        if len(cols[0]):
            out, rest = of(*cols, last=False)
            yield from out
    if rest is not None:
        yield from of(*rest, last=True)[0]


def with_fingerprints(docs: DataFrame, words: int = 3) -> tuple[DataFrame, str]:
    """docs and a column with the fingerprint of each text, as a signed long."""
    c.small_batches(docs.sparkSession)
    name = c.fresh(docs, "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = fingerprints(c.texts(b.column("text")), words)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp.view(np.int64))], names=[*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])), name


def near_duplicates(docs: DataFrame, bits: int = 2, words: int = 3) -> DataFrame:
    """One row for each document: doc_id, fingerprint (16 hex digits), component_id.

    Documents link if their fingerprints differ in at most ``bits`` bits;
    component_id is the smallest doc_id that links reach, itself included.
    Null and empty texts have fingerprint zero and link like any other.  A
    null doc_id keeps its row and gets the component of its links, or null.
    Texts are read whole, however long.  Rows with equal ids, and repeated
    rows, stay; an empty table gives an empty one.  Other columns of docs are
    not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked, _ = with_fingerprints(docs, words)
    marked = c.written(marked.select("doc_id", "fp"), "fingerprints")
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    masks = [sum(x) for x in combinations(_parts(bits), 2)]
    keys = F.array(*[F.struct(F.lit(i).alias("kind"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])
    dealt = nodes.select("fp", F.explode(keys).alias("k")).select("k.kind", "k.key", "fp")
    n = c.width(marked)
    edges = dealt.repartition(n, "kind", "key").sortWithinPartitions("kind", "key").mapInArrow(lambda it: _links(it, bits), "a long, b long")
    comp = components(edges)
    # of each component of fingerprints, the least document
    of_node = nodes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = of_node.groupBy("component").agg(F.min("least").alias("component_id"))
    node_id = of_node.join(least, "component").select("fp", "component_id")
    out = marked.join(node_id, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, bits: int = 2, words: int = 3) -> DataFrame:
    """The rows of docs whose doc_id is the component_id of near_duplicates(); of rows with equal ids, one.

    All columns stay.  Rows with a null doc_id stay, as nothing names them.
    """
    comp = near_duplicates(docs, bits, words)
    kept = comp.where("doc_id = component_id").select("doc_id").distinct()
    mine = c.fresh(docs, "kept_id")
    named = docs.where(F.col("doc_id").isNotNull()).join(kept.withColumnRenamed("doc_id", mine), F.col("doc_id").cast("long") == F.col(mine), "left_semi")
    once = named.dropDuplicates(["doc_id"])
    return once.unionByName(docs.where(F.col("doc_id").isNull()))
