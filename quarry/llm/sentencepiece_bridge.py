"""SentencePiece models on the tokenizers library.

The model's protobuf is read here, field by field.  Its normaliser, the marker
of white space, its pieces (unigram scores, or the merges that BPE scores
imply) and byte fallback are rebuilt as a Tokenizer.  As no piece goes on
after a word into the marker of the next, a text is a row of units (markers
and the word after them), so a very long one can be cut between units; batches
are encoded multithreaded.  The ids are the rebuilt tokenizer's, and what its
decoder makes of them is the text.  ``disagreements`` compares whole texts
with SentencePiece.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common as c

MARK = "▁"
UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: A place where a text can be cut: a marker after something else.
BREAK = re.compile(f"[^ {MARK}][ {MARK}]")
#: Characters of a text that are encoded as one, about, and of the texts in a batch.
LONG, STEP = 1 << 16, 1 << 18

# Fixed values of sentencepiece_model.proto: kinds of pieces, kinds of models.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protobuf message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            yield key >> 3, data[at : at + size]
            at += size
        elif kind == 2:
            size = number()
            yield key >> 3, data[at : at + size]
            at += size
        else:
            raise ValueError(f"protobuf wire type {kind}")


class Model:
    """What a SentencePiece model file holds."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.unknown, self.byte_fallback = UNIGRAM, 0, False
        self.charsmap, self.prefix, self.squeeze, self.escape = b"", True, True, True
        for n, v in fields(data):
            if n == 1:
                p = dict(fields(v))
                self.pieces.append((p[1].decode(), struct.unpack("<f", p.get(2, b"\0\0\0\0"))[0], p.get(3, NORMAL)))
            elif n == 2:
                t = dict(fields(v))
                self.kind, self.unknown, self.byte_fallback = t.get(3, UNIGRAM), t.get(40, 0), bool(t.get(35, 0))
            elif n == 3:
                t = dict(fields(v))
                self.charsmap, self.prefix, self.squeeze, self.escape = t.get(2, b""), bool(t.get(3, 1)), bool(t.get(4, 1)), bool(t.get(5, 1))

    def merges(self) -> list[tuple[str, str]]:
        """The pairs that BPE joins, best first.

        The best score goes first; of equal scores SentencePiece takes the
        leftmost pair, so a longer left part, which has grown from the left,
        goes before a shorter one.
        """
        usable = {p: s for p, s, k in self.pieces if k in (NORMAL, USER, UNUSED)}
        found = [(-s, -i, p[:i], p[i:]) for p, s in usable.items() for i in range(1, len(p)) if p[:i] in usable and p[i:] in usable]
        return [(a, b) for _, _, a, b in sorted(found)]

    def tokenizer(self, parts: bool = False):
        """A Tokenizer with the model's normaliser, marker, pieces, byte fallback and decoder.

        With ``parts`` for parts of texts that are normalised and have their
        first marker already.
        """
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        if self.kind == BPE:
            vocab = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            out = Tokenizer(models.BPE(vocab, self.merges(), unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback))
        elif self.kind == UNIGRAM:
            least = min((s for _, s, k in self.pieces if k == NORMAL), default=0.0)
            scores = [(p, s if k in (NORMAL, USER) else least - 10.0) for p, s, k in self.pieces]
            out = Tokenizer(models.Unigram(scores, self.unknown, self.byte_fallback))
        else:
            raise ValueError(f"model type {self.kind}")
        steps = [] if parts else self._normalisers(normalizers, Regex)
        if self.prefix and not parts:
            steps.append(normalizers.Prepend(MARK))
        out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
        out.pre_tokenizer = pre_tokenizers.Split(Regex(UNIT.pattern), "isolated")
        out.decoder = decoders.Sequence([decoders.Replace(self.pieces[self.unknown][0], " ⁇ "), decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if self.prefix and not parts else [])])
        return out

    def _normalisers(self, normalizers, Regex) -> list:
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        return steps

    def normaliser(self):
        """What is done to a text before the marker; None if nothing."""
        from tokenizers import Regex, normalizers

        steps = self._normalisers(normalizers, Regex)
        return normalizers.Sequence(steps) if steps else None


class Encoder:
    """Encodes whole texts by the rebuilt tokenizer, in multithreaded batches, and decodes ids.

    What the rebuilt decoder makes of each piece is a table; runs of bytes
    that pieces of byte fallback name are joined before they are read as UTF-8.
    """

    def __init__(self, data: bytes):
        self.model = Model(data)
        self.normaliser = self.model.normaliser()
        self.parts = self.model.tokenizer(parts=True)
        one = self.parts.decoder.decode
        self.bytes = [bytes([int(p[3:5], 16)]) if k == BYTE else one([p]).encode() if k != CONTROL else b"" for p, _, k in self.model.pieces]

    def _parts(self, text: str) -> list[str]:
        """A text, cut before markers where it is long."""
        text = self.normaliser.normalize_str(text) if self.normaliser is not None else text
        if not text:
            return []
        text = MARK + text if self.model.prefix else text
        out, at = [], 0
        while len(text) - at > LONG:
            cut = BREAK.search(text, at + LONG)
            if cut is None:
                break
            out.append(text[at : cut.start() + 1])
            at = cut.start() + 1
        return [*out, text[at:]]

    def encode(self, batch: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in batch]
        held: list[tuple[int, str]] = []
        size = 0

        def flush() -> None:
            for (i, _), e in zip(held, self.parts.encode_batch_fast([x for _, x in held], add_special_tokens=False), strict=True):
                out[i].append(struct.pack(f"<{len(e)}I", *e.ids))
            held.clear()

        for i, text in enumerate(batch):
            for part in self._parts(text):
                held.append((i, part))
                size += len(part)
                if size > STEP:
                    flush()
                    size = 0
        flush()
        return [b"".join(x) for x in out]

    def decode(self, ids: bytes) -> str:
        """The text of some ids; bytes that aren't UTF-8 become replacement characters."""
        table = self.bytes
        text = b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode(errors="replace")
        return text[1:] if self.model.prefix and text.startswith(" ") else text


#: One encoder a worker process and model.
_ENCODERS: dict[bytes, Encoder] = {}


def _encoder(data: bytes) -> Encoder:
    key = hashlib.sha256(data).digest()
    if key not in _ENCODERS:
        os.environ.setdefault("RAYON_NUM_THREADS", "2")  # the threads of a batch; an executor runs several workers
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(data)
    return _ENCODERS[key]


def _texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def _lists(found: list[bytes]) -> pa.Array:
    size = np.array([len(x) // 4 for x in found], np.int64)
    flat = pa.Array.from_buffers(pa.int32(), int(size.sum()), [None, pa.py_buffer(b"".join(found))])
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), flat)


def _shared(docs: DataFrame, model: str | bytes):
    """The model's bytes, of a fixed size, for the tasks."""
    c.small_batches(docs.sparkSession)
    return docs.sparkSession.sparkContext.broadcast(model if isinstance(model, bytes) else open(model, "rb").read())


def encode(docs: DataFrame, model: str | bytes) -> DataFrame:
    """docs with ``ids`` (array of int) and ``decoded`` (their text).

    Texts are read whole, however long.  Null and empty texts have no ids and
    decode to the empty text.  Rows are encoded on their own, so ties and
    repeated rows don't matter; an empty table gives an empty one.  All
    columns and rows stay; new columns get a trailing underscore where docs
    has such a name already.  ``model`` is a path that the driver can read, or
    the file's bytes.
    """
    shared = _shared(docs, model)
    names = [c.fresh(docs, n) for n in ("ids", "decoded")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                found = encoder.encode(_texts(part.column("text")))
                yield pa.RecordBatch.from_arrays([*part.columns, _lists(found), pa.array([encoder.decode(x) for x in found], pa.string())], names=[*b.schema.names, *names])

    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.ArrayType(T.IntegerType())), T.StructField(names[1], T.StringType())])
    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, model: str | bytes) -> DataFrame:
    """One row for each document: doc_id, n_tokens, ids_crc32 (unsigned, of little-endian unsigned 32-bit ids), decoded_sha256, round_trip (whether the ids decode to the text).

    Nulls, empty and long texts, ties, repeats and empty tables are as in
    encode(); other columns than doc_id and text aren't read.
    """
    shared = _shared(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                texts = _texts(part.column("text"))
                found = encoder.encode(texts)
                back = [encoder.decode(x) for x in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(x) // 4 for x in found], pa.int64()), pa.array([zlib.crc32(x) for x in found], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back], pa.string()), pa.array([x == y for x, y in zip(texts, back, strict=True)], pa.bool_())],
                    names=["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip"],
                )

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean")


def disagreements(docs: DataFrame, model: str | bytes) -> DataFrame:
    """doc_id of the documents whose whole texts SentencePiece itself encodes to other ids, or decodes to another text.

    The parity check, which costs as much again as encoding and so isn't part of it.
    """
    shared = _shared(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        encoder, own = _encoder(shared.value), sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        for b in batches:
            texts = _texts(b.column("text"))
            theirs = own.encode(texts, num_threads=1)
            bad = [struct.pack(f"<{len(y)}I", *y) != x or encoder.decode(x) != own.decode(y) for x, y in zip(encoder.encode(texts), theirs, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").filter(pa.array(bad, pa.bool_()))], names=["doc_id"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long")
