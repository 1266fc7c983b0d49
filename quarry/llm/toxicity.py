"""Toxicity by FTRL-proximal logistic regression.

A text's features are its hashed words, pairs of neighbouring words and pairs
with one word between them (skip-grams), each present or not.  FTRL-proximal
(McMahan et al., "Ad click prediction", KDD 2013) learns with a rate for each
coordinate, and its L1 term leaves few weights that aren't zero; only those
are sent to the tasks that score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c

#: Feature hashes.
DIM = 1 << 20
#: Labelled rows that the model is fitted on, at most, toxic and other ones.  Which: the least by crc32 of the id.
MOST = (4000, 8000)
EPOCHS = 8
ALPHA, BETA, L1, L2, BALANCE = 1.0, 1.0, 16.0, 0.01, 1.0

_CLEAN = np.full(256, 32, np.uint8)
_CLEAN[128:] = np.arange(128, 256)
for _a, _b in ((48, 58), (97, 123)):
    _CLEAN[_a:_b] = np.arange(_a, _b)
_CLEAN[65:91] = np.arange(97, 123)


def features(batch: list[bytes]) -> Iterator[np.ndarray]:
    """The sorted distinct feature numbers of each text."""
    clean = [_CLEAN[np.frombuffer(x, np.uint8)].tobytes() for x in batch]
    for _, h in c.word_hashes(clean):
        near = c.mix(h[:-1] * c.U64(0x9E3779B1) + h[1:])
        skip = c.mix(h[:-2] * c.U64(0x85EBCA77) + h[2:])
        yield np.unique((np.concatenate([h, near, skip]) % c.U64(DIM)).astype(np.int32))


def _sigmoid(x: float) -> float:
    return 1.0 / (1.0 + float(np.exp(-np.clip(x, -35.0, 35.0))))


def ftrl(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS, balance: float = BALANCE) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and weights that aren't zero; number DIM is the intercept.

    Rows of the rarer label weigh more, by the power ``balance`` of how much
    rarer they are, so that few of them aren't outvoted.
    """
    ones = sum(y for _, y in rows)
    heavy = max(len(rows) - ones, 1) / max(ones, 1)
    weight = {1: max(heavy, 1.0) ** balance, 0: max(1 / heavy, 1.0) ** balance}
    z, n = np.zeros(DIM + 1), np.zeros(DIM + 1)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        shrunk = np.sign(zi) * np.maximum(np.abs(zi) - L1, 0.0)
        return -shrunk / ((BETA + np.sqrt(ni)) / ALPHA + L2)

    for _ in range(epochs):
        for f, y in rows:
            i = np.append(f, DIM)
            zi, ni = z[i], n[i]
            w = weights(zi, ni)
            g = weight[y] * (_sigmoid(w.sum()) - y)
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[i] = zi + g - sigma * w
            n[i] = ni + g * g
    w = weights(z, n)
    at = np.flatnonzero(w)
    return at, w[at]


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for b in batches:
        rows += zip(features(c.texts(b.column("text"))), b.column("label").to_pylist(), strict=True)
    at, w = ftrl(rows) if rows else (np.empty(0, np.int64), np.empty(0))
    yield pa.RecordBatch.from_pydict({"at": at, "w": w}, schema=pa.schema([("at", pa.int64()), ("w", pa.float64())]))


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether a row is kept from training: crc32 of its id as text leaves no remainder by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: tuple[int, int] = MOST) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and weights, learned from labelled rows that aren't held out.

    Null labels don't count; of several labels of an id the largest does.  The
    sample is bounded by ``most`` rows of label 1 and label 0, so one task fits
    it and the driver gets the weights that aren't zero.
    """
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    order = [F.crc32(F.col("doc_id").cast("string")), F.col("doc_id")]
    sample = marked.where("label = 1").orderBy(*order).limit(most[0]).unionByName(marked.where("label = 0").orderBy(*order).limit(most[1]))
    texts = docs.select(F.col("doc_id").alias("own_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(sample), F.col("own_id") == F.col("doc_id")).select("doc_id", "text", "label")
    one = rows.repartition(1).sortWithinPartitions(F.crc32(F.concat_ws("-", F.lit("order"), F.col("doc_id").cast("string"))), "doc_id", "text")
    found = one.mapInArrow(_fit, "at long, w double").toPandas()
    return found["at"].to_numpy(), found["w"].to_numpy()


def score(docs: DataFrame, labels: DataFrame, train_on: DataFrame | None = None, most: tuple[int, int] = MOST) -> DataFrame:
    """docs with ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (1 from 0.5).

    The whole text is read, however long.  Null and empty texts have no
    features and get the score of the intercept; without any labelled row all
    scores are 0.  Equal texts have equal scores, a score of exactly 0.5
    predicts 1, repeated rows stay, and an empty table gives an empty one.  A
    null doc_id is scored and never learned from.  All columns and rows stay;
    the new columns get a trailing underscore where docs has such a name
    already.  ``most`` bounds the labelled rows that the model is fitted on.
    """
    c.small_batches(docs.sparkSession)
    at, w = train(docs if train_on is None else train_on, labels, most)
    dense = docs.sparkSession.sparkContext.broadcast((at, w))
    name, predicted = c.fresh(docs, "score"), c.fresh(docs, "predicted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w = dense.value
        table = np.zeros(DIM + 1)
        table[at] = w
        for b in batches:
            s = [_sigmoid(table[f].sum() + table[DIM]) if len(at) else 0.0 for f in features(c.texts(b.column("text")))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], names=[*b.schema.names, name, predicted])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType()), T.StructField(predicted, T.IntegerType())]))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that score() predicts to be toxic; the same columns.

    Nulls, empty texts, repeated rows and empty tables are as in score().
    """
    scored = score(docs, labels)
    predicted = scored.columns[-1]
    return scored.where(F.col(predicted) == 0).select(*docs.columns)
