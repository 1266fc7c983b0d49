"""Document fingerprints by consistent weighted sampling.

A document is the bag of its words with their counts.  Each of ``SAMPLES``
samples draws for every word two gamma variates and a uniform one from the
word's hash alone, and keeps the word and the level that win (Ioffe, "Improved
consistent sampling, weighted minhash and L1 sketching", ICDM 2010).  Two
documents keep the same with a probability equal to their generalised Jaccard
similarity, the sum of smaller counts over the sum of larger ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c

SAMPLES = 128
#: Words of documents that one step works on, and words whose variates are drawn at once.
STEP, BLOCK = 32_768, 128

_SALT = c.mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * c.U64(0x9E3779B97F4A7C15))


def _gamma_quantiles(n: int = 1 << 16) -> np.ndarray:
    """Gamma(2, 1) at the middles of n equal parts of its mass, by Newton steps on 1 - (1 + x) exp(-x)."""
    p = (np.arange(n) + 0.5) / n
    x = np.maximum(np.sqrt(2 * p), -np.log1p(-p))
    for _ in range(40):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / (x * np.exp(-x)), 1e-9)
    return x.astype(np.float32)


_GAMMA = _gamma_quantiles()


def variates(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word hash and sample: r and log c, of gamma(2, 1) variates, and a uniform beta.

    Of a 64-bit hash, 16 bits choose a quantile for r and 16 beta; c, whose
    least values decide, comes from two uniform numbers of 32 bits.  The steps
    of r and beta move a likeness by no more than 2**-15 on average, as they
    are that near to the exact variates; a test compares with those.
    """
    h = c.mix(words[:, None] ^ _SALT[None, :])
    r = _GAMMA[(h & c.U64(0xFFFF)).astype(np.int32)]
    beta = ((h >> c.U64(16)) & c.U64(0xFFFF)).astype(np.float32) * np.float32(2.0**-16)
    a = (h >> c.U64(32)).astype(np.float32) + np.float32(0.5)
    b = (h * c.U64(0xD6E8FEB86659FD93) >> c.U64(32)).astype(np.float32) + np.float32(0.5)
    logc = np.log(np.maximum(-np.log(a * np.float32(2.0**-32) * b * np.float32(2.0**-32)), np.float32(1e-7)))
    return r, logc, beta


def _packed(value: np.ndarray, words: np.ndarray, level: np.ndarray | None = None) -> np.ndarray:
    """Values as integers of the same order, with 32 bits below that name the word and its level."""
    bits = value.view(np.uint32)
    high = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(np.uint64) << c.U64(32)
    name = words[:, None] if level is None else words[:, None] + c.U64(0x9E3779B9) * level.astype(np.int64).astype(np.uint64)
    return high | c.mix(name + c.U64(1)) >> c.U64(32)


class Sampler:
    """Fingerprints bags of words; the values of the words of the last step, with their counts, are kept."""

    def __init__(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.values = np.empty((0, SAMPLES), np.uint64)

    def _values(self, keys: np.ndarray, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Of distinct sorted keys of words with their counts, the values; in blocks that stay in the processor's cache."""
        out = np.empty((len(keys), SAMPLES), np.uint64)
        old = c.member(self.keys, keys)
        out[old] = self.values[np.searchsorted(self.keys, keys[old])]
        new = np.flatnonzero(~old)
        for some in (new[counts[new] == 1], new[counts[new] > 1]):
            for s in range(0, len(some), BLOCK):
                at = some[s : s + BLOCK]
                r, logc, beta = variates(words[at])
                if counts[at[0]] == 1:  # level zero
                    out[at] = _packed(logc - r * (1 - beta), words[at])
                else:
                    level = np.floor(np.log(counts[at]).astype(np.float32)[:, None] / r + beta)
                    out[at] = _packed(logc - r * (level - beta + 1), words[at], level)
        self.keys, self.values = keys, out
        return out

    def signatures(self, bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Of bags of (distinct word hashes, counts), 16 bits for each sample; of an empty bag zeros."""
        best = np.full((len(bags), SAMPLES), np.iinfo(np.uint64).max, np.uint64)
        some: list[tuple[int, int, int]] = []
        size = 0
        for i, (w, _) in enumerate(bags):
            for s in range(0, len(w), STEP):
                e = min(s + STEP, len(w))
                if some and size + e - s > STEP:
                    self._lower(bags, some, best)
                    some, size = [], 0
                some.append((i, s, e))
                size += e - s
        if some:
            self._lower(bags, some, best)
        found = np.array([len(w) > 0 for w, _ in bags], bool)
        return np.where(found[:, None], (best >> c.U64(16)) & c.U64(0xFFFF), c.U64(0)).astype(np.uint16)

    def _lower(self, bags: list[tuple[np.ndarray, np.ndarray]], some: list[tuple[int, int, int]], best: np.ndarray) -> None:
        """Lowers the best values by those of some parts of bags."""
        words, counts = (np.concatenate([bags[i][k][s:e] for i, s, e in some]) for k in (0, 1))
        keys, first, which = np.unique(words ^ c.mix((counts - 1).astype(np.uint64)), return_index=True, return_inverse=True)
        values, at = self._values(keys, words[first], counts[first]), 0
        for i, s, e in some:
            np.minimum(best[i], values[which[at : at + e - s]].min(0), out=best[i])
            at += e - s


def bags(batch: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The distinct words of each text, as sorted hashes, and their counts."""
    return [np.unique(h, return_counts=True) for _, h in c.word_hashes(batch)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of samples that agree."""
    return (a == b).mean(axis=-1)


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as much of the beginning of the next one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _stream(batches: Iterator[pa.RecordBatch], order: str) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by part and doc_id; the last of each part is the first of the next one and is only looked at."""
    sampler = Sampler()
    held: tuple[int, int | None, str, np.ndarray] | None = None
    for b in batches:
        parts = b.column(order).to_pylist()
        text = ["" if x is None else x for x in b.column("text").to_pylist()]
        ids, tails = b.column("doc_id").to_pylist(), b.column("tail").to_pylist()
        for s in range(0, len(text), 64):
            e = min(s + 64, len(text))
            own = sampler.signatures(bags([x.encode() for x in text[s:e]]))
            rows = [*([held] if held else []), *zip(parts[s:e], ids[s:e], text[s:e], own, strict=True)]
            skip = [*([False] if held else []), *tails[s:e]]
            pairs = [(x, y) for x, y, t in zip(rows, rows[1:], skip, strict=False) if x[0] == y[0] and not t]
            held = None if skip[-1] else rows[-1]
            if not pairs:
                continue
            new = [edited(x[2], y[2]) for x, y in pairs]
            sig = sampler.signatures(bags([x.encode() for x in new]))
            mine, following = np.stack([x[3] for x, _ in pairs]), np.stack([y[3] for _, y in pairs])
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": [x[1] for x, _ in pairs],
                    "n_chars": [len(x[2]) for x, _ in pairs],
                    "edited_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in new],
                    "fingerprint": [x.astype(">u2").tobytes().hex() for x in mine],
                    "edited_fingerprint": [x.astype(">u2").tobytes().hex() for x in sig],
                    "near_edited": likeness(mine, sig),
                    "near_next": likeness(mine, following),
                },
                schema=pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]),
            )


def fingerprint(docs: DataFrame) -> DataFrame:
    """docs with ``fingerprint``: four hex digits for each of SAMPLES samples of the whole text.

    Equal texts have equal fingerprints, in whatever row or task; null and
    empty texts have zeros.  Words that tie in a sample go by their hash.  Long
    texts go by steps of bounded size.  All columns and rows stay, repeated
    ones too; an empty table gives an empty one; the new column gets a trailing
    underscore where docs has such a name already.
    """
    c.small_batches(docs.sparkSession)
    name = c.fresh(docs, "fingerprint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        for b in batches:
            found = sampler.signatures(bags(c.texts(b.column("text"))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x.astype(">u2").tobytes().hex() for x in found], pa.string())], names=[*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.StringType())]))


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is that of the next larger doc_id, of the largest the
    first; a null id comes first, and equal ids follow by text.  A lone
    document is its own next.  Null texts are empty.  Other columns of docs
    aren't read.

    Documents are dealt to ranges of ids; the first of each range also goes to
    the range before, so no row has to be looked up.  Ranges come from the
    quantiles of the ids, of which the driver holds one a range.
    """
    c.small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = c.width(docs)
    cuts = sorted(set(rows.select(F.expr(f"approx_percentile(doc_id, array({', '.join(str(i / n) for i in range(1, n))}), 10000)").alias("q")).first()["q"] or [])) if n > 1 else []
    part = F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in cuts]), lambda x: x <= F.col("doc_id"))) if cuts else F.lit(0)
    rows = rows.withColumn("part", F.coalesce(F.greatest(part, F.lit(0)), F.lit(0)))
    # the first row of each range that isn't empty, and the range that it follows
    first = rows.groupBy("part").agg(F.min(F.struct(F.col("doc_id"), F.sha2("text", 256).alias("sha"))).alias("lead"))
    ring = Window.orderBy("part")
    first = first.select("part", "lead", F.coalesce(F.lag("part").over(ring), F.max("part").over(Window.partitionBy(F.lit(1)))).alias("before"))
    lead = [(r["part"], r["lead"]["doc_id"], r["lead"]["sha"], r["before"]) for r in first.collect()]  # a row for each range
    named = docs.sparkSession.createDataFrame(lead, "lead_part int, lead_id long, lead_sha string, before int")
    tails = rows.join(F.broadcast(named), (F.col("part") == F.col("lead_part")) & F.col("doc_id").eqNullSafe(F.col("lead_id")))
    tails = tails.where(F.sha2("text", 256) == F.col("lead_sha")).dropDuplicates(["before"])
    both = rows.withColumn("tail", F.lit(False)).unionByName(tails.select("doc_id", "text", F.col("before").alias("part"), F.lit(True).alias("tail")))
    ordered = both.repartition(n, "part").sortWithinPartitions("part", "tail", "doc_id", F.sha2("text", 256))
    return ordered.mapInArrow(lambda it: _stream(it, "part"), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
