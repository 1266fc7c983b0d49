"""Token ids in ORC files: run-length encoded integers, row indexes and Bloom filters on document ids.

Documents are dealt to ranges of ascending doc_id, encoded, and written in
that order, one file a range.  A row holds the ids of a document and where
they start in its file, so any stripe can be read on its own, and a reader
who wants a few documents skips files, stripes and row groups by their
statistics and Bloom filters.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as c

#: Words and pieces of words whose ids a worker keeps, in each of two generations.
WORDS = 400_000
OPTIONS = {
    "compression": "snappy",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
}
SCHEMA = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
DDL = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"


class WordEncoder:
    """Encodes whole texts by a tokenizer of the tokenizers library.

    The ids of a text are little-endian unsigned 32-bit integers.  Where the
    tokenizer's own definition shows that no piece reaches over ASCII white
    space (see ``_pattern``), a text is normalised as a whole, and each
    different word of it taken apart by the tokenizer's pattern and given to
    its model once; words and pieces seen lately are kept.  With any other
    definition, and where a text holds an added token, the whole text goes
    through the whole tokenizer.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pattern = _pattern(definition)
        self.known = c.Recent(self._ids, WORDS)

    def _ids(self, word: bytes) -> bytes:
        text = word.decode()
        if not text.isalpha():
            found = self.pattern.findall(text)
            if len(found) != 1:
                return b"".join([self.known[x.encode()] for x in found])
        return _bytes([t.id for t in self.model.tokenize(_visible(text))])

    def _words(self, text: str) -> list[bytes]:
        # lower() is what the normaliser does to composed characters, but for a sigma at the end of a word
        plain = text.isascii() or "Σ" not in text and is_normalized("NFC", text)
        return (text.lower() if plain else self.tokenizer.normalizer.normalize_str(text)).encode().split()

    def encode(self, batch: list[str]) -> list[bytes]:
        """The ids of each text."""
        get = self.known.__getitem__
        whole = [self.pattern is None or any(x in text for x in self.added) for text in batch]
        return [_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids) if w else b"".join(map(get, self._words(text))) for text, w in zip(batch, whole, strict=True)]


def _bytes(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


#: Fixed value: the pattern by which a tokenizer of lower-cased words takes letters, digits and marks apart.
LETTERS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _pattern(definition: str) -> regex.Pattern[str] | None:
    """The pattern that takes a tokenizer's words apart, if it works word by word; else None.

    It does if its normaliser only composes characters, makes white space
    single and lower-cases, and its pieces are the matches of a pattern that
    takes no white space, shown byte by byte.
    """
    d = json.loads(definition)
    steps = [x["type"] for x in (d.get("normalizer") or {}).get("normalizers", [])]
    splits = (d.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if steps != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in splits] != ["Split", "ByteLevel"] or d.get("post_processor"):
        return None
    first, second = splits
    if (first["pattern"], first["behavior"], first["invert"]) != ({"Regex": LETTERS}, "Removed", True) or second["add_prefix_space"] or second["use_regex"]:
        return None
    return regex.compile(LETTERS)


def _alphabet() -> dict[int, int]:
    """Byte-level BPE shows bytes as themselves where they print, the others as characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in set(plain))}


_ALPHABET = _alphabet()


def _visible(piece: str) -> str:
    return piece if piece.isascii() else piece.encode().decode("latin-1").translate(_ALPHABET)


#: One encoder a worker process and tokenizer.
_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(definition: str) -> WordEncoder:
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(definition)
    return _ENCODERS[key]


def _encode(batches: Iterator[pa.RecordBatch], definition: str, end: int) -> Iterator[pa.RecordBatch]:
    encoder, last = _encoder(definition), np.array([end], "<u4").tobytes()
    part, start = TaskContext.get().partitionId(), 0
    for b in batches:
        raw = [x or "" for x in b.column("text").to_pylist()]
        for s in range(0, len(raw), 256):
            ids = [x + last for x in encoder.encode(raw[s : s + 256])]
            size = np.array([len(x) // 4 for x in ids], np.int64)
            flat = pa.Array.from_buffers(pa.int32(), int(size.sum()), [None, pa.py_buffer(b"".join(ids))])
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([b.column("doc_id")[s : s + len(ids)], pa.array(np.full(len(ids), part, np.int32)), pa.array(start + np.cumsum(size) - size), pa.array(size), lists], schema=SCHEMA)
            start += int(size.sum())


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end: int = 1) -> None:
    """Writes the ids of all whole texts, each followed by ``end``, in ascending doc_id order.

    Null and empty texts have only ``end``.  Null ids come first; rows with
    equal ids are ordered by their texts.  Other columns aren't read.
    ``tokenizer`` is a file that the driver reads; its fixed content goes to
    the tasks.
    """
    c.small_batches(docs.sparkSession)
    with open(tokenizer, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange(c.width(docs), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(lambda it: _encode(it, shared.value, end), DDL).write.options(**OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids of the files of write_tokens().

    Null ids, repeated rows and rows with equal ids come back as they were
    written, one row each; files of an empty table give an empty one.
    """
    files = spark.read.schema(DDL).orc(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))  # a row for each file
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    # a row of two numbers for each file, which is no more than the driver lists when it plans the scan
    return files.join(F.broadcast(before), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of some documents; files and stripes without them are skipped by their statistics and Bloom filters.

    All rows of an id come, also where it is repeated; an id that isn't there
    gives none, and null ids can't be asked for.
    """
    return read_tokens(spark, path).where(F.col("doc_id").isin(doc_ids))


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of read_tokens(), from the ids themselves; a row for each row, null ids and repeats included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
            crc = [zlib.crc32(flat[s:e].astype("<i4", copy=False).tobytes()) for s, e in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
