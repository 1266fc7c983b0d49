"""Substring dedup over words: repeated-phrase automata.

1. Every window of ``window`` words has an anchor: of its runs of eight words,
   the one of least hash.  Anchors that occur once can't be in a repeated
   window; the distinct ones of each block of documents are counted.
2. The windows around recurring anchors are counted the same way.  Windows
   that start in two places are confirmed; runs of them are passages.
3. Each block compiles its passages into Aho-Corasick automata, sharded to a
   bounded size, and streams all its documents through each: every occurrence
   of a passage is found by exact comparison, and its words are removed.  A
   very long passage goes in as parts that share a window less one word.

A frequent phrase is one entry a block in each count, whatever its copies.
Hashes have 63 bits: the chance that a given window is taken for a repeat by
mistake is the number of windows around recurring anchors over 2**63.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common as c
from . import recurring as r

ANCHOR = 8
#: Characters of the passages in one automaton, about, and windows in one passage: longer ones are cut into parts that overlap.
SHARD_CHARS, LONG = 2_000_000, 4096


def _pieces(batch: list[bytes], window: int) -> Iterator[c.Piece]:
    return c.pieces(c.word_hashes(batch), window)


def _no_rows(fields: str) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in fields.split(", "))]).empty_table()


def _as(cols: dict[str, list], like: pa.Table) -> pa.Table:
    return pa.table(cols, schema=like.schema)


def _anchors(batches: Iterator[pa.RecordBatch], text: str, block: str, window: int, k: int, buckets: int) -> Iterator[pa.RecordBatch]:
    found: dict[int, list[np.ndarray]] = {}
    for b in batches:
        blocks = np.array(b.column(block).to_pylist())
        batch = c.texts(b.column(text))
        for which in np.unique(blocks):
            mine = [batch[i] for i in np.flatnonzero(blocks == which)]
            for p in _pieces(mine, window):
                found.setdefault(int(which), []).append(c.anchors(p, k, window)[0])
    like = _no_rows(r.SENT)
    for which, h in found.items():
        yield from _as(r.packed(which, r.entries(np.concatenate(h)), buckets), like).to_batches()


def covered_words(text: list[str], passages: list[str]) -> list[np.ndarray]:
    """For each text, of words joined and framed by one space, the spans [start, end) of its words that a passage covers."""
    out: list[list[tuple[int, int]]] = [[] for _ in text]
    shard: list[str] = []
    size = 0

    def stream() -> None:
        machine = ahocorasick.Automaton()
        for p in shard:
            machine.add_word(p, len(p))
        machine.make_automaton()
        for i, x in enumerate(text):
            spans, low, high = out[i], -1, -1
            for end, n in machine.iter(x):
                start = end - n + 1
                if low <= start <= high:
                    high = max(high, end)
                elif start < low and end >= low:
                    low, high = start, max(high, end)
                else:
                    if high >= 0:
                        spans.append((low, high))
                    low, high = start, end
            if high >= 0:
                spans.append((low, high))

    for p in passages:
        if shard and size + len(p) > SHARD_CHARS:
            stream()
            shard, size = [], 0
        shard.append(p)
        size += len(p)
    if shard:
        stream()
    marks = []
    for x, spans in zip(text, out, strict=True):
        if not spans:
            marks.append(np.empty((0, 2), np.int64))
            continue
        gaps = np.flatnonzero(np.frombuffer(x.encode("utf-32-le"), np.uint32) == 32)
        s = np.array(spans)
        marks.append(np.stack([np.searchsorted(gaps, s[:, 0]), np.searchsorted(gaps, s[:, 1])], 1))
    return marks


def remove_repeats(docs: DataFrame, window: int = 35, anchor: int = ANCHOR) -> DataFrame:
    """docs with ``text`` less its repeated words, and ``n_words``, ``n_removed``, ``spans``.

    A word goes if a window of ``window`` consecutive words that covers it also
    starts anywhere else in the table.  Kept words are joined by one space.

    Null and empty texts have no words and become empty.  Texts of fewer words
    than a window lose nothing.  Rows that are repeated, with equal ids too,
    are copies of each other.  Other columns stay as they are; the three new
    ones get a trailing underscore where docs has such a name already.
    ``spans`` holds the removed [start, end) word positions.
    """
    c.small_batches(docs.sparkSession)
    n = c.width(docs)
    dealt, block = c.in_blocks(docs, n)
    schema = T.StructType([f for f in docs.schema if f.name != "text"] + [T.StructField("text", T.StringType())])
    names = [c.fresh(docs, x) for x in ("n_words", "n_removed", "spans")]
    for name, kind in zip(names, (T.LongType(), T.LongType(), T.ArrayType(T.IntegerType())), strict=True):
        schema = schema.add(name, kind)
    kept = [f.name for f in docs.schema if f.name != "text"]

    anchors_known = r.recurring(dealt.mapInArrow(lambda it: _anchors(it, "text", block, window, anchor, n), r.SENT), n)

    def windows(left: pa.Table, right: pa.Table) -> pa.Table:
        like = _no_rows(r.SENT)
        rec = r.known(right) & ~r.ONE
        if not left.num_rows or not len(rec):
            return like
        found = []
        for p in _pieces(c.texts(left.column("text")), window):
            h, _, first, last = c.anchors(p, anchor, window)
            hit = c.member(rec, h & ~r.ONE)
            if hit.any():
                found.append(c.grams(p.x, window)[_ranges(first[hit], last[hit] + 1)])
        if not found:
            return like
        return _as(r.packed(left.column(block)[0].as_py(), r.entries(np.concatenate(found)), n), like)

    def final(left: pa.Table, right: pa.Table) -> pa.Table:
        rec = r.known(right) & ~r.ONE
        raw = c.texts(left.column("text"))
        confirmed: list[list[np.ndarray]] = [[] for _ in raw]
        if len(rec):
            for p in _pieces(raw, window):
                at = np.flatnonzero(p.valid)
                at = at[c.member(rec, c.grams(p.x, window)[at] & ~r.ONE)]
                rows = p.row[at]
                first, m = c.runs(rows)
                for s, k in zip(first, m, strict=True):
                    confirmed[rows[s]].append(p.at[at[s : s + k]])
        split = [x.split() for x in raw]
        passages: set[str] = set()
        for w, at in zip(split, confirmed, strict=True):
            if at:
                a = np.concatenate(at)
                s = a[np.append(True, a[1:] != a[:-1] + 1)]
                e = a[np.append(a[1:] != a[:-1] + 1, True)] + window
                for i, j in zip(s.tolist(), e.tolist(), strict=True):
                    passages.update(f" {b' '.join(w[k : min(k + LONG + window - 1, j)]).decode()} " for k in range(i, j - window + 1, LONG))
        framed = [f" {b' '.join(w).decode()} " for w in split]
        marks = covered_words(framed, sorted(passages)) if passages else [np.empty((0, 2), np.int64)] * len(raw)
        text, n_removed, spans = [], [], []
        for w, x, m in zip(split, framed, marks, strict=True):
            gone = np.zeros(len(w) + 1, np.int32)
            np.add.at(gone, m[:, 0], 1)
            np.add.at(gone, m[:, 1], -1)
            gone = np.cumsum(gone)[:-1] > 0
            edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
            n_removed.append(int(gone.sum()))
            spans.append(edge.tolist())
            text.append(x[1:-1] if not n_removed[-1] else b" ".join(a for a, g in zip(w, gone, strict=True) if not g).decode())
        cols = {k: left.column(k) for k in kept} | {"text": pa.array(text, pa.string()), names[0]: pa.array([len(w) for w in split], pa.int64()), names[1]: pa.array(n_removed, pa.int64()), names[2]: pa.array(spans, pa.list_(pa.int32()))}
        return pa.table(cols)

    by = dealt.groupBy(block)
    sent = by.cogroup(anchors_known.groupBy("block")).applyInArrow(windows, r.SENT)
    out = by.cogroup(r.recurring(sent, n).groupBy("block")).applyInArrow(final, schema)
    return out.select(*docs.columns, *names)


def _ranges(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All positions of some ranges [first, end), one after another."""
    size = end - first
    return np.repeat(end - np.cumsum(size), size) + np.arange(size.sum())
