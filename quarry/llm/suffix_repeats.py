"""Substring dedup over bytes: the interval tree of an enhanced suffix array.

1. Every window of ``window`` bytes has an anchor: of its runs of 16 bytes,
   the one of least hash.  Only anchors that two documents hold can lie in a
   repeat; each block of documents counts its distinct ones once.
2. The text that the windows of a recurring anchor span is its segment.  Blocks
   send each distinct (anchor, segment) once, with the least document that has
   it, to the anchor's shard.  Equal segments need no more.  Of the different
   segments of an anchor, a shard builds a suffix array with common-prefix
   lengths, scans it with a stack for its intervals, keeps those whose left
   neighbours differ (the maximal repeats), and gives every occurrence that a
   smaller document precedes its covered bytes.
3. Blocks apply the answers to all occurrences.

An anchor that very many blocks hold, so whose segments might not fit one
shard, is split by a longer context: of each of its windows, the run of 40
bytes of least hash names the shard, and the segments are those of the
windows that share it.  They go through the same interval tree.  All is exact
up to 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common as c
from . import recurring as r

ANCHOR = 16
#: An anchor that more blocks hold than this is split by a context of DEEP bytes.
HOT_BLOCKS, DEEP = 256, 40

SENT = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("segments", pa.binary()), ("docs", pa.binary()), ("sizes", pa.binary()), ("bytes", pa.binary())])
SENT_DDL = "bucket int, block int, keys binary, segments binary, docs binary, sizes binary, bytes binary"
ANSWER = pa.schema([("block", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary()), ("counts", pa.binary()), ("spans", pa.binary())])
ANSWER_DDL = "block int, keys binary, docs binary, counts binary, spans binary"
NONE = np.iinfo(np.int64).max
_PLACE = c.U64((1 << 20) - 1)


def _pieces(raw: list[bytes], window: int) -> Iterator[c.Piece]:
    return c.pieces(((i, np.frombuffer(x, np.uint8)) for i, x in enumerate(raw)), window)


def _marked(p: c.Piece, k: int, window: int) -> tuple[np.ndarray, ...]:
    """The symbols of a piece as hashes, and its anchors."""
    p = _symbols(p)
    return p.x, *c.anchors(p, k, window)


def _symbols(p: c.Piece) -> c.Piece:
    q = object.__new__(c.Piece)
    q.x, q.row, q.at, q.valid = c.byte_symbols(p.x), p.row, p.at, p.valid
    return q


def _deeper(x: np.ndarray, first: np.ndarray, last: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Runs of windows [first, last] split by the longer context: its hashes and places, and the first and last window of each part."""
    h = c.grams(x, DEEP)
    best = c.sliding_min((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), window - DEEP + 1)
    w, run = _ranges(first, last + 1), np.repeat(np.arange(len(first)), last + 1 - first)
    at = (best[w] & _PLACE).astype(np.int64)
    new = np.ones(len(w), bool)
    new[1:] = (run[1:] != run[:-1]) | (at[1:] != at[:-1])
    f = np.flatnonzero(new)
    e = np.append(f[1:], len(w)) - 1
    return h[at[f]], at[f], w[f], w[e]


def _segment_keys(x: np.ndarray, h: np.ndarray, at: np.ndarray, start: np.ndarray, end: np.ndarray, deep: bool = False) -> np.ndarray:
    """A hash of the segment [start, end) and of where the anchor is in it; odd for parts of a split anchor."""
    return (c.mix(c.spans_hash(x, start, end) ^ c.mix(h + (at - start).astype(np.uint64))) & ~r.ONE) | c.U64(deep)


def _least(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first of each key with the least doc, in the order of keys."""
    order = np.lexsort((docs, keys))
    first, _ = c.runs(keys[order])
    return order[first], docs[order[first]]


def _anchors(batches: Iterator[pa.RecordBatch], block: str, window: int, k: int, buckets: int) -> Iterator[pa.RecordBatch]:
    found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    like = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("data", pa.binary())])
    for b in batches:
        blocks, raw = np.array(b.column(block).to_pylist()), c.texts(b.column("text"))
        ids = b.column("doc_id").to_pylist()
        for which in np.unique(blocks):
            mine = np.flatnonzero(blocks == which)
            owner = np.array([NONE if ids[i] is None else ids[i] for i in mine], np.int64)
            for p in _pieces([raw[i] for i in mine], window):
                _, h, at, _, _ = _marked(p, k, window)
                found.setdefault(int(which), []).append((h, owner[p.row[at]]))
    for which, parts in found.items():
        h, o = (np.concatenate(x) for x in zip(*parts, strict=True))
        yield pa.RecordBatch.from_pydict(r.packed(which, r.entries(h, o), buckets), schema=like)


def maximal_repeats(segments: list[bytes], least: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """All maximal repeats of at least ``least`` bytes: (length, [(segment, start), ...]) with every occurrence.

    A repeat is maximal if its occurrences differ, or end, both to the right
    (so it is an interval of common prefixes) and to the left.
    """
    text = np.frombuffer(b"".join(segments), np.uint8)
    size = np.array([len(s) for s in segments])
    if not len(text) or size.max() < least:
        return []
    owner = np.repeat(np.arange(len(segments)), size)
    ends = np.repeat(np.cumsum(size), size)
    begin = np.repeat(np.cumsum(size) - size, size)
    at = np.flatnonzero(ends - np.arange(len(text)) >= least)
    # suffixes whose first bytes nobody shares can't be in a repeat
    h = c.grams(c.byte_symbols(text), least)[at]
    order = np.argsort(h, kind="stable")
    first, n = c.runs(h[order])
    at = at[order[np.repeat(n > 1, n)]]
    if not len(at):
        return []
    longest = int((ends[at] - at).max())
    cols = -(-longest // 8)
    left = ends[at] - at
    padded = np.concatenate([text, np.zeros(cols * 8, np.uint8)])
    keys = []
    for j in range(cols):
        block = padded[at[:, None] + np.arange(8 * j, 8 * j + 8)]
        block = np.where(np.arange(8 * j, 8 * j + 8) < left[:, None], block, 0)
        keys.append(np.ascontiguousarray(block).view(">u8").ravel().astype(np.uint64))
    sa = np.lexsort([left, *keys[::-1]])
    at, left = at[sa], left[sa]
    lcp = np.zeros(len(at) + 1, np.int64)
    going = np.ones(len(at) - 1, bool)
    for k in keys:
        a, b = k[sa][:-1], k[sa][1:]
        diff = a ^ b
        lead = np.full(len(diff), 8)
        odd = diff != 0
        lead[odd] = (np.frombuffer(diff[odd].astype(">u8").tobytes(), np.uint8).reshape(-1, 8) != 0).argmax(1)
        lcp[1:-1] += np.where(going, lead, 0)
        going &= ~odd
    lcp[1:-1] = np.minimum(lcp[1:-1], np.minimum(left[:-1], left[1:]))
    before = np.where(at > begin[at], text[np.maximum(at - 1, 0)].astype(np.int64), -1 - np.arange(len(at)))
    found = []
    stack: list[tuple[int, int]] = []
    for i, n in enumerate(lcp.tolist()):
        lo = i
        while stack and stack[-1][0] > n:
            depth, lo = stack.pop()
            if depth >= least:
                hi = i
                around = before[lo - 1 : hi] if lo else before[lo:hi]
                if around[0] < 0 or (around != around[0]).any():
                    which = slice(max(lo - 1, 0), hi)
                    found.append((depth, list(zip(owner[at[which]].tolist(), (at[which] - begin[at[which]]).tolist(), strict=True))))
        if n and (not stack or stack[-1][0] < n):
            stack.append((n, lo))
    return found


def _covered(segments: list[bytes], docs: np.ndarray, least: int) -> list[list[tuple[int, int]]]:
    """For each segment the spans that also occur in one with a smaller doc."""
    out: list[list[tuple[int, int]]] = [[] for _ in segments]
    for n, where in maximal_repeats(segments, least):
        owners = np.array([s for s, _ in where])
        low = docs[owners].min()
        for s, start in where:
            if docs[s] > low:
                out[s].append((start, start + n))
    return out


def _resolve(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, segments, docs, sizes, owners, text = [], [], [], [], [], []
        unsqueeze = zstandard.ZstdDecompressor()
        for b in batches:
            cols = {n: b.column(n).to_pylist() for n in b.schema.names}
            for i in range(b.num_rows):
                keys.append(np.frombuffer(cols["keys"][i], np.uint64))
                segments.append(np.frombuffer(cols["segments"][i], np.uint64))
                docs.append(np.frombuffer(cols["docs"][i], np.int64))
                sizes.append(np.frombuffer(cols["sizes"][i], np.int32))
                owners.append(np.full(len(keys[-1]), cols["block"][i], np.int32))
                text.append(cols["bytes"][i])
        if not keys:
            return
        key, seg, doc, size, owner = (np.concatenate(x) for x in (keys, segments, docs, sizes, owners))
        data = b"".join(unsqueeze.decompress(x) for x in text if x)
        start = np.cumsum(size.astype(np.int64)) - size
        order = np.lexsort((doc, seg, key))
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (seg[order][1:] != seg[order][:-1])
        group = np.cumsum(new) - 1  # of each ordered entry, its distinct (key, segment)
        one = order[new]  # the entry with the least doc
        low = doc[one]
        first, n = c.runs(key[one])
        many = np.repeat(n > 1, n)
        which = np.flatnonzero(many)
        spans: dict[int, list[tuple[int, int]]] = {}
        # equal windows have equal anchors, so shards can be done in parts that keep an anchor together
        part, size_now, last = [], 0, None
        for g in which:
            if size_now > 4_000_000 and key[one[g]] != last:
                _take(part, one, start, size, data, low, window, spans)
                part, size_now = [], 0
            part.append(g)
            size_now += int(size[one[g]])
            last = key[one[g]]
        if part:
            _take(part, one, start, size, data, low, window, spans)
        back = np.argsort(owner[order], kind="stable")
        entry, grp = order[back], group[back]
        first, n = c.runs(owner[entry])
        rows: dict[str, list] = {x: [] for x in ANSWER.names}
        for s, m in zip(first, n, strict=True):
            e, g = entry[s : s + m], grp[s : s + m]
            mine = [spans.get(int(x), []) for x in g]
            rows["block"].append(int(owner[e[0]]))
            rows["keys"].append(seg[e].tobytes())
            rows["docs"].append(low[g].tobytes())
            rows["counts"].append(np.array([len(x) for x in mine], np.int32).tobytes())
            rows["spans"].append(np.array([y for x in mine for y in x], np.int32).tobytes())
        yield pa.RecordBatch.from_pydict(rows, schema=ANSWER)

    return run


def _take(part: list[int], one: np.ndarray, start: np.ndarray, size: np.ndarray, data: bytes, low: np.ndarray, window: int, spans: dict[int, list[tuple[int, int]]]) -> None:
    found = _covered([data[start[one[g]] : start[one[g]] + size[one[g]]] for g in part], low[np.array(part)], window)
    spans.update({int(g): s for g, s in zip(part, found, strict=True) if s})


def remove_repeats(docs: DataFrame, window: int = 50, anchor: int = ANCHOR, hot_blocks: int = HOT_BLOCKS) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed, n_spans, spans, kept (binary).

    A byte goes if a string of ``window`` bytes that covers it also starts in a
    document with a smaller doc_id.  Null and empty texts have no bytes; texts
    shorter than the window lose nothing.  Rows with equal ids are no reason
    for each other; a null id is larger than any other, and no reason for any
    null id.  ``spans`` holds the removed [start, end) byte positions.  Other
    columns of docs are not read.
    """
    c.small_batches(docs.sparkSession)
    n = c.width(docs, 4)
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    dealt, block = c.in_blocks(docs, n)
    like = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("data", pa.binary())])
    known = r.recurring(dealt.mapInArrow(lambda it: _anchors(it, block, window, anchor, n), r.SENT), n, hot_blocks)

    def prepared(left: pa.Table, right: pa.Table) -> Iterator[tuple]:
        """Of each piece: its rows, anchors that recur, whether they are hot."""
        rec = r.known(right)
        plain = rec & ~r.ONE
        if not len(rec):
            return
        for p in _pieces(c.texts(left.column("text")), window):
            x, h, at, first, last = _marked(p, anchor, window)
            hit = c.member(plain, h & ~r.ONE)
            if hit.any():
                h, at, first, last = h[hit], at[hit], first[hit], last[hit]
                hot = (rec[np.searchsorted(plain, h & ~r.ONE)] & r.ONE).astype(bool)
                yield p, x, h, at, first, last, hot

    def ids(left: pa.Table) -> np.ndarray:
        return np.array([NONE if i is None else i for i in left.column("doc_id").to_pylist()], np.int64)

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        doc = ids(left) if left.num_rows else np.empty(0, np.int64)
        keys, segs, owners, at_piece, places, kept = [], [], [], [], [], []
        for p, x, *runs, hot in prepared(left, right):
            parts = [(False, [v[~hot] for v in runs])]
            if hot.any():
                parts.append((True, list(_deeper(x, runs[2][hot], runs[3][hot], window))))
            for deep, (h, at, first, last) in parts:
                end = last + window
                keys.append(h)
                segs.append(_segment_keys(x, h, at, first, end, deep))
                owners.append(doc[p.row[at]])
                at_piece.append(np.full(len(h), len(kept)))
                places.append(np.stack([first, end], 1))
            kept.append(p.x)
        rows: dict[str, list] = {x: [] for x in SENT.names}
        squeeze = zstandard.ZstdCompressor(level=3)
        if keys:
            which = left.column(block)[0].as_py()
            k, s, o, piece, place = (np.concatenate(v) for v in (keys, segs, owners, at_piece, places))
            if len(k):
                one, low = _least(s, o)
                order, cuts = c.dealt(k[one], n)
                for b, lo, hi in cuts:
                    e = one[order[lo:hi]]
                    size = (place[e, 1] - place[e, 0]).astype(np.int32)
                    _row(rows, b, which, k[e], s[e], low[order[lo:hi]], size, squeeze.compress(b"".join(kept[piece[i]][place[i, 0] : place[i, 1]].tobytes() for i in e)))
        return pa.table(rows, schema=SENT)

    def final(left: pa.Table, right: pa.Table) -> pa.Table:
        raw, doc = c.texts(left.column("text")), ids(left)
        known_rows = {x: right.column(x).to_pylist() for x in right.column_names}
        gone = [np.zeros(len(x) + 1, np.int32) for x in raw]
        if known_rows["keys"]:
            key = np.concatenate([np.frombuffer(x, np.uint64) for x in known_rows["keys"]])
            low = np.concatenate([np.frombuffer(x, np.int64) for x in known_rows["docs"]])
            count = np.concatenate([np.frombuffer(x, np.int32) for x in known_rows["counts"]])
            spans = np.concatenate([np.frombuffer(x, np.int32).reshape(-1, 2) for x in known_rows["spans"]])
            order = np.argsort(key, kind="stable")
            sorted_key, split = key[order], bool((key & r.ONE).any())
            offset = np.cumsum(count) - count
            for p in _pieces(raw, window):
                x, h, at, first, last = _marked(p, anchor, window)
                marks = []
                for deep in (False, True) if split else (False,):
                    if deep:  # what isn't a segment may be an anchor that is split
                        h, at, first, last = _deeper(x, first[~found], last[~found], window)
                    seg = _segment_keys(x, h, at, first, last + window, deep)
                    found = c.member(sorted_key, seg)
                    hit = np.flatnonzero(found)
                    e = order[np.searchsorted(sorted_key, seg[hit])]
                    # segments, as a whole or in parts
                    whole = doc[p.row[at[hit]]] > low[e]
                    marks.append(np.stack([first[hit][whole], last[hit][whole] + window], 1))
                    some = np.flatnonzero(~whole & (count[e] > 0))
                    if len(some):
                        which = _ranges(offset[e[some]], offset[e[some]] + count[e[some]])
                        marks.append(spans[which] + np.repeat(first[hit][some], count[e[some]])[:, None])
                for m in marks:
                    rows = p.row[m[:, 0]]
                    by = np.argsort(rows, kind="stable")
                    m, rows = m[by], rows[by]
                    f, size = c.runs(rows)
                    for s, k in zip(f, size, strict=True):
                        i = int(rows[s])
                        np.add.at(gone[i], p.at[m[s : s + k, 0]], 1)
                        np.add.at(gone[i], p.at[m[s : s + k, 1] - 1] + 1, -1)
        rows = {x: [] for x in ("n_removed", "n_spans", "spans", "kept")}
        for x, g in zip(raw, gone, strict=True):
            out = np.cumsum(g)[:-1] > 0
            edge = np.flatnonzero(np.diff(np.concatenate([[False], out, [False]])))
            rows["n_removed"].append(int(out.sum()))
            rows["n_spans"].append(len(edge) // 2)
            rows["spans"].append(edge.tolist())
            rows["kept"].append(np.frombuffer(x, np.uint8)[~out].tobytes() if len(edge) else x)
        return pa.table({"doc_id": left.column("doc_id"), "n_bytes": pa.array([len(x) for x in raw], pa.int64()), "n_removed": pa.array(rows["n_removed"], pa.int64()), "n_spans": pa.array(rows["n_spans"], pa.int64()), "spans": pa.array(rows["spans"], pa.list_(pa.int32())), "kept": pa.array(rows["kept"], pa.binary())})

    by = dealt.groupBy(block)
    sent = by.cogroup(known.groupBy("block")).applyInArrow(send, SENT_DDL)
    answers = sent.repartition(n, "bucket").mapInArrow(_resolve(window), ANSWER_DDL)
    schema = T.StructType().add("doc_id", "long").add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("spans", T.ArrayType(T.IntegerType())).add("kept", "binary")
    return by.cogroup(answers.groupBy("block")).applyInArrow(final, schema)


def _row(rows: dict[str, list], *values: object) -> None:
    for name, v in zip(SENT.names, values, strict=True):
        rows[name].append(v.tobytes() if isinstance(v, np.ndarray) else v)


def _ranges(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All positions of some ranges [first, end), one after another."""
    size = end - first
    return np.repeat(end - np.cumsum(size), size) + np.arange(size.sum())
