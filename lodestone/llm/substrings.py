"""Removal of repeated passages with FM-indexes of shards.

A window is ``window`` consecutive words. Each window contains a least-hash k-word
sequence, its anchor (8 words, or the window where that is shorter), so equal windows
share an anchor at the same place: shards are sets of anchors. The windows of one anchor occurrence form a segment of at most
2 * window - k words, of which a bit mask says what windows repeat. Anchors that occur once in the table have no repeated window and
are left out; equal segments are one, with a weight. Each shard indexes its segments in
a compressed FM-index; backward search over its wavelet matrix computes the matching
statistics of the segments streamed through it, and windows whose match reaches the
threshold elsewhere are reported as word intervals, which go back to the documents.

0. frequent sequences: counters of all k-word sequences in a table of fixed size
1. anchors: documents -> (anchor, segment, row) by shard -> repeated ones (saved table)
2. words: one row of each distinct segment sends its words to the shard
3. index: each shard's FM-index -> repeated windows of each segment (saved table)
4. answer: shard -> rows; documents with repeats meet their intervals

Frequent sequences are anchors only of windows that have no other, so a window across
the edge of a passage that a third of all documents share is anchored outside it, and
those inside it make few distinct segments, however many documents have them. The rows
of such anchors are dealt out once more by a salt, and each part is answered for itself.
Which sequences count as frequent changes shards, never the result.

A shard whose segments are too many words for one index is cut into chunks of them: each
chunk is indexed by a task of its own, through which the segments of all the shard's
chunks are streamed; a window repeats if its own chunk has it twice or another one has it.

Rows that need no words or intervals skip the exchanges of texts: bit sets of row keys
(of bounded size, so at worst all rows take part) say which. Words are compared as
48-bit hashes of their bytes, anchors and segments as 64-bit ones.

Defined cases: null, empty and short texts lose nothing; a window that repeats within
one text or in a repeated row counts as repeated; texts of any length are whole;
ties don't arise, every occurrence is removed; an empty table gives an empty result;
other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from . import cluster, text
from .fm_index import FMIndex

ANCHOR = 8
SHARD_WORDS = 600_000  # expected words of the segments of a shard
INDEX_WORDS = 2_000_000  # expected words of an index at most
HEAVY = 100_000  # shards that are cut into chunks at most, the largest first
BOX_BYTES = 8 << 20  # expected text of the rows that meet in one group
SALTS = 64  # parts of the rows of a frequent anchor
_BATCH = 2000
_ENTRY = np.dtype([("anchor", "<u8"), ("segment", "<u8"), ("row", "<u8")])
_OWNED = np.dtype([("row", "<u8"), ("anchor", "<u8"), ("segment", "<u8"), ("reply", "<u4"), ("weight", "u1")])
_SEEN = np.dtype([("segment", "<u8"), ("row", "<u8")])


def anchor_length(window: int) -> int:
    return min(ANCHOR, window)


def mask_words(window: int) -> int:
    """64-bit words of a mask of the windows of a segment."""
    return (window - anchor_length(window)) // 64 + 1


def _mark(window: int, row: bool = True) -> np.dtype:
    """(row,) segment and mask of its windows."""
    return np.dtype([("row", "<u8")] * row + [("segment", "<u8"), ("mask", "<u8", (mask_words(window),))])


def merged(marks: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending keys and one mark of each, its mask all its marks' masks together."""
    order = np.argsort(key, kind="stable")
    key, first = np.unique(key[order], return_index=True)
    out = marks[order][first]
    if len(key):
        out["mask"] = np.bitwise_or.reduceat(marks["mask"][order], first, axis=0)
    return key, out


@dataclass
class Segments:
    """Segments of a block: first and last window start (words of the block), anchor and content hashes, text row."""

    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    content: np.ndarray
    doc: np.ndarray
    frequent: np.ndarray


def segments(w: text.Words, window: int, frequent: np.ndarray) -> Segments:
    n, k = len(w.hash), anchor_length(window)
    none = np.zeros(0, np.int64)
    at, h = text.ngrams(w, k)
    i = np.flatnonzero(w.doc[: n - window + 1] == w.doc[window - 1 :]) if n >= window else none
    if not len(i):
        return Segments(none, none, none.astype(np.uint64), none.astype(np.uint64), none, none > 0)
    bits = max(20, int(n).bit_length())
    low = np.uint64((1 << bits) - 1)
    key = np.full(n, ~np.uint64(0))
    last = _in(frequent, h).astype(np.uint64) << np.uint64(63)
    key[at] = last | ((h >> np.uint64(1)) & ~low) | at.astype(np.uint64)
    whole = np.zeros(n, np.uint64)
    whole[at] = h
    width, m, s = window - k + 1, key, 1
    while 2 * s <= width:  # least of s neighbours, s doubling
        m = np.minimum(m[:-s], m[s:])
        s *= 2
    if s < width:
        m = np.minimum(m[: len(m) - (width - s)], m[width - s :])
    m = m[i]
    place = (m & low).astype(np.int64)
    new = np.ones(len(i), bool)
    new[1:] = (place[1:] != place[:-1]) | (i[1:] != i[:-1] + 1)
    begin = np.flatnonzero(new)
    first, last = i[begin], i[np.append(begin[1:], len(i)) - 1]
    power, inverse = text._power(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(w.hash * power[:n], out=total[1:])
    stop = last + window
    content = text.mix((total[stop] - total[first]) * inverse[first] + (stop - first).astype(np.uint64))
    return Segments(first, last, whole[place[begin]], content, w.doc[first], m[begin] >> np.uint64(63) > 0)


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def _dealt(key: np.ndarray, rows: np.ndarray, names: tuple[str, str]) -> pa.RecordBatch:
    """One row a key, with the bytes of its records."""
    order = np.argsort(key, kind="stable")
    keys, edge = np.unique(key[order], return_index=True)
    edge = np.append(edge, len(key))
    rows = rows[order]
    return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array([rows[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])], pa.binary())], list(names))


def _joined(column: pa.ChunkedArray | pa.Array, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


# -- 0. frequent sequences --------------------------------------------------------


def frequent_sequences(docs: DataFrame, size: int, k: int = ANCHOR) -> np.ndarray:
    """A bit set of k-word sequence hashes that occur often; docs: (rid, text), ``size``: bytes of all texts.

    Counters of a number fixed by the size, at most 2 ** 24, are added up slice by slice
    over all texts; frequent is what reaches 8 times the mean counter and 1000.
    """
    slots = 1 << min(24, max(18, int(size // 4000).bit_length()))
    limit = max(1000, 8 * size // (6 * slots))
    slices = 16

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n = np.zeros(slots, np.int64), [], 0
        for batch in cluster.batches(it, _BATCH):
            for w in text.blocks(batch.column(1)):
                held.append(text.ngrams(w, k)[1] % np.uint64(slots))
                n += len(held[-1])
                if n > slots:
                    total += np.bincount(np.concatenate(held).astype(np.int64), minlength=slots)
                    held, n = [], 0
        if n:
            total += np.bincount(np.concatenate(held).astype(np.int64), minlength=slots)
        parts = np.minimum(total, 2**31 - 1).astype("<u4").reshape(slices, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["slice", "bits"])

    def add(table: pa.Table) -> pa.Table:
        n = sum(np.frombuffer(x.as_buffer(), "<u4").astype(np.int64) for x in table.column("bits"))
        return pa.table({"slice": table.column("slice")[:1], "bits": pa.array([np.packbits(n >= limit).tobytes()], pa.binary())})

    out = np.zeros((slices, slots // slices // 8), np.uint8)
    for r in docs.mapInArrow(run, "slice int, bits binary").groupBy("slice").applyInArrow(add, "slice int, bits binary").collect():
        out[r["slice"]] = np.frombuffer(r["bits"], np.uint8)  # 16 rows of together ``slots`` bits
    return out.reshape(-1)


# -- 1. anchors -------------------------------------------------------------------


def repeated_anchors(docs: DataFrame, window: int, shards: int, boxes: int, frequent) -> DataFrame:
    """(kind, key, rows) of anchors that occur twice or more; docs: (rid, text).

    kind 0: by shard or its salted part, (segment, row) of every occurrence; kind 1: by
    box of rows, the anchor, segment and weight that a row has to send words for, and
    which part is to be answered. Parts of frequent anchors count what they have alone,
    so they send all their segments. kind 2: by shard, how many segments are sent to it.
    """

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cluster.batches(it, _BATCH):
            rid = batch.column(0).to_numpy().view(np.uint64)
            parts, keys = [], []
            for w in text.blocks(batch.column(1)):
                s = segments(w, window, frequent.value)
                e = np.empty(len(s.first), _ENTRY)
                e["anchor"], e["segment"], e["row"] = s.anchor, s.content, rid[w.rows][s.doc]
                parts.append(e)
                salted = text.mix(s.anchor + text.mix(e["row"]) % np.uint64(SALTS))
                keys.append(np.where(s.frequent, np.uint64(shards) + _shard(salted, shards), _shard(s.anchor, shards)))
            yield _dealt(np.concatenate(keys), np.concatenate(parts), ("key", "rows"))

    def meet(shard: int, held: list[bytes]) -> Iterator[pa.RecordBatch]:
        e = np.frombuffer(b"".join(held), _ENTRY)
        e = e[np.lexsort((e["row"], e["segment"], e["anchor"]))]
        new = np.ones(len(e) + 1, bool)
        new[1:-1] = e["anchor"][1:] != e["anchor"][:-1]
        edge = np.flatnonzero(new)
        if shard < shards:
            e = e[np.repeat(np.diff(edge) > 1, np.diff(edge))]
        if not len(e):
            return
        new = np.ones(len(e) + 1, bool)
        new[1:-1] = (e["segment"][1:] != e["segment"][:-1]) | (e["anchor"][1:] != e["anchor"][:-1])
        edge = np.flatnonzero(new)
        owned = np.empty(len(edge) - 1, _OWNED)
        for name in ("row", "anchor", "segment"):
            owned[name] = e[name][edge[:-1]]
        owned["weight"], owned["reply"] = np.minimum(np.diff(edge), 2), shard
        twice = np.ones(len(e), bool)
        twice[1:] = (e["segment"][1:] != e["segment"][:-1]) | (e["row"][1:] != e["row"][:-1])
        seen = np.empty(int(twice.sum()), _SEEN)
        seen["segment"], seen["row"] = e["segment"][twice], e["row"][twice]
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([shard], pa.int32()), pa.array([seen.tobytes()], pa.binary())], ["kind", "key", "rows"])
        to, n = np.unique(_shard(owned["anchor"], shards), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(to), 2, np.int32)), pa.array(to.astype(np.int32)), pa.array([int(x).to_bytes(8, "big") for x in n], pa.binary())], ["kind", "key", "rows"])
        b = _dealt(_shard(text.mix(owned["row"]), boxes), owned, ("key", "rows"))
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(b.num_rows, np.int32)), *b.columns], ["kind", "key", "rows"])

    def find(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in it:
            for key, rows in zip(batch.column(0).to_pylist(), batch.column(1)):
                if key != now and held:
                    yield from meet(now, held)
                    held = []
                now = key
                held.append(rows.as_py())
        if held:
            yield from meet(now, held)

    dealt = docs.mapInArrow(deal, "key int, rows binary").repartition(_tasks(docs, 2 * shards), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(find, "kind int, key int, rows binary")


def _tasks(df: DataFrame, groups: int) -> int:
    return max(1, min(groups, 4 * cluster.partitions(df.sparkSession)))


# -- which rows take part ---------------------------------------------------------


def row_set(rows: DataFrame, kind: np.dtype, bits: int) -> np.ndarray:
    """A bit set of the row keys in binary records, combined slice by slice; ``bits`` is its fixed size."""
    slices = 16

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros(bits, bool)
        some = False
        for batch in it:
            for x in batch.column(0):
                have[np.frombuffer(x.as_buffer(), kind)["row"] % np.uint64(bits)] = some = True
        if some:
            packed = np.packbits(have).reshape(slices, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([p.tobytes() for p in packed], pa.binary())], ["slice", "bits"])

    def merge(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint8) for x in table.column("bits").to_pylist()]
        return pa.table({"slice": table.column("slice")[:1], "bits": pa.array([np.bitwise_or.reduce(parts).tobytes()], pa.binary())})

    out = np.zeros((slices, bits // slices // 8), np.uint8)
    merged = rows.select("rows").coalesce(2 * cluster.partitions(rows.sparkSession)).mapInArrow(run, "slice int, bits binary").groupBy("slice").applyInArrow(merge, "slice int, bits binary")
    for r in merged.collect():  # 16 rows of together ``bits`` bits
        out[r["slice"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def _bits(n: int) -> int:
    return 1 << min(26, max(16, int(16 * max(n, 1)).bit_length()))


def _in(packed: np.ndarray, row: np.ndarray) -> np.ndarray:
    i = row % np.uint64(len(packed) * 8)
    return (packed[i >> np.uint64(3)] >> (np.uint64(7) - (i & np.uint64(7))).astype(np.uint8)) & 1 > 0


# -- 2. and 3. words, index -------------------------------------------------------


def heavy_shards(sent: DataFrame, window: int) -> dict[int, int]:
    """Into how many chunks to cut each shard that takes more than an index holds; at most HEAVY of them.

    sent: (key, rows), the numbers of segments that are sent to each shard.
    """
    n = F.conv(F.hex("rows"), 16, 10).cast("long")  # eight bytes, the highest first
    words = (F.sum(n) * (3 * window // 2)).alias("words")
    top = sent.groupBy("key").agg(words).filter(F.col("words") > INDEX_WORDS).orderBy(F.desc("words"), "key").limit(HEAVY).collect()
    return {r["key"]: -(-r["words"] // INDEX_WORDS) for r in top}


def send_words(docs: DataFrame, owned: DataFrame, window: int, shards: int, boxes: int, wanted: np.ndarray, frequent, heavy: dict[int, int]) -> DataFrame:
    """(shard, chunk, other, segment, reply, weight, length, words): words of the owned segments, by shard.

    A heavy shard gets them once for each of its chunks; ``other`` marks those of other chunks.
    """
    shared = docs.sparkSession.sparkContext.broadcast((wanted, heavy))  # bounded by _bits and HEAVY

    def choose(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rid = batch.column(0).to_numpy().view(np.uint64)
            at = np.flatnonzero(_in(shared.value[0], rid))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(_shard(text.mix(rid[at]), boxes).astype(np.int32)), *(c.take(pa.array(at)) for c in batch.columns)], ["box", "rid", "text"])

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["shard", "chunk", "other", "segment", "reply", "weight", "length", "words"]
        out: list[list] = [[] for _ in names]
        cut = shared.value[1]
        own = _joined(right.column("rows"), _OWNED) if right.num_rows else np.zeros(0, _OWNED)
        if len(own) and left.num_rows:
            key = text.mix(own["row"] + own["segment"] * np.uint64(3) + own["anchor"])
            order = np.argsort(key)
            key, own = key[order], own[order]
            left = left.combine_chunks()
            rid = left.column("rid").to_numpy().view(np.uint64)
            sent = np.zeros(len(own), bool)
            column = left.column("text")
            for w in text.blocks(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column):
                s = segments(w, window, frequent.value)
                mine = text.mix(rid[w.rows][s.doc] + s.content * np.uint64(3) + s.anchor)
                at = np.minimum(np.searchsorted(key, mine), len(key) - 1)
                hit = np.flatnonzero(key[at] == mine)
                at = at[hit]
                _, one = np.unique(at, return_index=True)
                one = one[~sent[at[one]]]
                hit, at = hit[one], at[one]
                sent[at] = True
                size = (s.last - s.first)[hit] + window
                shard = _shard(s.anchor[hit], shards).astype(np.int64)
                chunks = np.array([cut.get(k, 1) for k in shard.tolist()], np.uint64) if cut else np.ones(len(shard), np.uint64)
                part = (text.mix(s.content[hit]) % chunks).astype(np.int64)
                order = np.lexsort((part, shard))
                hit, at, size, shard, part = hit[order], at[order], size[order], shard[order], part[order]
                start = np.concatenate([[0], np.cumsum(size)])
                index = np.repeat(s.first[hit] - start[:-1], size) + np.arange(start[-1])
                words = np.ascontiguousarray(w.hash[index].view(np.uint8).reshape(-1, 8)[:, :6])
                edge = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (part[1:] != part[:-1]), [True]])) if len(shard) else [0]
                for a, b in zip(edge[:-1], edge[1:]):
                    row = (s.content[hit[a:b]].tobytes(), own["reply"][at[a:b]].tobytes(), own["weight"][at[a:b]].tobytes(), size[a:b].astype("<u4").tobytes(), words[start[a] : start[b]].tobytes())
                    for chunk in range(cut.get(int(shard[a]), 1)):
                        for column_, x in zip(out, (int(shard[a]), chunk, int(chunk != part[a]), *row)):
                            column_.append(x)
        kinds = [pa.int32()] * 3 + [pa.binary()] * 5
        return pa.table({n: pa.array(x, k) for n, x, k in zip(names, out, kinds)})

    rows = docs.mapInArrow(choose, "box int, rid long, text string")
    return rows.groupBy("box").cogroup(owned.select(F.col("key").alias("box"), "rows").groupBy("box")).applyInArrow(send, "shard int, chunk int, other int, segment binary, reply binary, weight binary, length binary, words binary")


def index_shards(words: DataFrame, window: int, groups: int) -> DataFrame:
    """(key, rows): by part to answer, segments with repeated windows and the mask of those, from the FM-index of each shard or chunk."""
    kind = _mark(window, row=False)

    def unpacked(held: list[tuple]) -> tuple[np.ndarray, ...]:
        segment, reply, weight, length, raw = (b"".join(x) for x in zip(*held))
        wide = np.zeros((len(raw) // 6, 8), np.uint8)
        wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
        return np.frombuffer(segment, "<u8"), np.frombuffer(reply, "<u4"), np.frombuffer(weight, "u1").astype(np.int32), np.frombuffer(length, "<u4").astype(np.int64), wide.view("<u8").ravel()

    def answer(index: FMIndex, held: tuple[np.ndarray, ...], least: int) -> pa.RecordBatch:
        segment, reply, _, length, symbols = held
        found = index.matching_statistics(symbols, length, least) >= window
        start = np.cumsum(length) - length
        out = np.zeros(len(segment), kind)
        out["segment"] = segment
        for j in range(int(length.max()) - window + 1):
            has = np.flatnonzero(length - window >= j)
            out["mask"][has, j >> 6] |= found[start[has] + j].astype(np.uint64) << np.uint64(j & 63)
        hit = np.flatnonzero(out["mask"].any(1))
        return _dealt(reply[hit], out[hit], ("key", "rows"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by shard, chunk and other: what a chunk indexes is there before what is streamed through it."""
        now, held, size, index = None, [], 0, None

        def flush() -> pa.RecordBatch:
            nonlocal held, size, index
            rows = unpacked(held)
            held, size = [], 0
            if index is None:
                index = FMIndex(rows[4], rows[3], rows[2])
                return answer(index, rows, 2)
            return answer(index, rows, 1)

        for batch in it:
            for key, *row in zip(zip(*(batch.column(i).to_pylist() for i in range(3))), *(batch.column(i) for i in range(3, 8))):
                if key != now and held:
                    yield flush()
                if now is None or key[:2] != now[:2]:
                    index = None
                elif key[2] and index is None:
                    index = FMIndex(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32))  # a chunk without own segments
                now = key
                held.append(tuple(x.as_py() for x in row))
                size += len(held[-1][4])
                if key[2] and size > 6 * INDEX_WORDS:
                    yield flush()
        if held:
            yield flush()

    dealt = words.repartition(_tasks(words, groups), "shard", "chunk").sortWithinPartitions("shard", "chunk", "other")
    return dealt.mapInArrow(run, "key int, rows binary")


# -- 4. answer --------------------------------------------------------------------


def row_masks(seen: DataFrame, masks: DataFrame, window: int, boxes: int) -> DataFrame:
    """(key, rows): by box of rows, the segments of each row that have repeated windows."""
    kind, mark = _mark(window, row=False), _mark(window)

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, bytes]] = []
        if left.num_rows and right.num_rows:
            m = _joined(right.column("rows"), kind)
            key, m = merged(m, m["segment"])
            s = _joined(left.column("rows"), _SEEN)
            if len(m):
                at = np.minimum(np.searchsorted(key, s["segment"]), len(m) - 1)
                hit = np.flatnonzero(key[at] == s["segment"])
                x = np.empty(len(hit), mark)
                x["row"], x["segment"], x["mask"] = s["row"][hit], s["segment"][hit], m["mask"][at[hit]]
                b = _dealt(_shard(text.mix(x["row"]), boxes), x, ("key", "rows"))
                out = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        return pa.table({"key": pa.array([o[0] for o in out], pa.int32()), "rows": pa.array([o[1] for o in out], pa.binary())})

    return seen.groupBy("key").cogroup(masks.groupBy("key")).applyInArrow(join, "key int, rows binary")


def mark_key(row: np.ndarray, segment: np.ndarray) -> np.ndarray:
    return text.mix(row + segment * np.uint64(3))


def covered(w: text.Words, rid: np.ndarray, key: np.ndarray, marks: np.ndarray, window: int, frequent: np.ndarray) -> np.ndarray:
    """Which words of a block lie in a repeated window; marks by ascending key."""
    s = segments(w, window, frequent)
    mine = mark_key(rid[s.doc], s.content)
    change = np.zeros(len(w.hash) + 1, np.int64)
    if len(key) and len(mine):
        at = np.minimum(np.searchsorted(key, mine), len(key) - 1)
        mask = np.where((key[at] == mine)[:, None], marks["mask"][at], np.uint64(0))
        for j in range(int((s.last - s.first).max()) + 1):
            hit = s.first[(mask[:, j >> 6] >> np.uint64(j & 63)) & np.uint64(1) > 0] + j
            np.add.at(change, hit, 1)
            np.add.at(change, hit + window, -1)
    return np.cumsum(change)[:-1] > 0


class Plan:
    """The steps up to the marks of each row, for one table; ``answers`` maps a function over all rows."""

    def __init__(self, docs: DataFrame, window: int):
        spark = docs.sparkSession
        self.window = window
        docs_rows = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
        n, size = docs_rows[0], docs_rows[1] or 0
        least = cluster.partitions(spark)
        self.shards = max(least, -(-size // SHARD_WORDS))
        self.boxes = max(least, -(-size // BOX_BYTES))
        self.rows = docs.select("rid", "text")
        if window < 1:
            raise ValueError("a window has a word at least")
        self.frequent = spark.sparkContext.broadcast(frequent_sequences(self.rows, size, anchor_length(window)))  # at most 2 MB
        anchors = cluster.saved(repeated_anchors(self.rows, window, self.shards, self.boxes, self.frequent), "anchors")
        owned, seen = anchors.filter("kind = 1"), anchors.filter("kind = 0")
        wanted = row_set(owned, _OWNED, _bits(n))
        heavy = heavy_shards(anchors.filter("kind = 2"), window)
        words = send_words(self.rows, owned, window, self.shards, self.boxes, wanted, self.frequent, heavy)
        masks = cluster.saved(index_shards(words, window, self.shards + sum(heavy.values())), "masks")
        self.marks = cluster.saved(row_masks(seen.select("key", "rows"), masks, window, self.boxes), "marks")
        self.marked = row_set(self.marks, _mark(window), _bits(n))

    def answers(self, docs: DataFrame, plain, changed, schema: str | StructType) -> DataFrame:
        """Rows of ``schema`` for each row of docs (rid, text and any others, by position).

        plain(batch) answers a batch of rows without repeats, changed(batch, removed)
        one of rows that may have some, ``removed`` giving their words' flags.
        """
        shared = docs.sparkSession.sparkContext.broadcast(self.marked)  # bounded by _bits
        docs = cluster.by_position(docs)
        names = docs.columns
        boxes, window, frequent, mark = self.boxes, self.window, self.frequent, _mark(self.window)

        def split(marked: bool):
            def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in cluster.batches(it, 500):
                    rid = batch.column(0).to_numpy().view(np.uint64)
                    have = _in(shared.value, rid)
                    part = batch.take(pa.array(np.flatnonzero(have == marked)))
                    if marked:
                        if part.num_rows:
                            box = _shard(text.mix(rid[have]), boxes).astype(np.int32)
                            yield pa.RecordBatch.from_arrays([pa.array(box), *part.columns], ["box", *names])
                    elif part.num_rows:
                        yield plain(part)

            return run

        def finish(left: pa.Table, right: pa.Table) -> pa.Table:
            marks = _joined(right.column("rows"), mark) if right.num_rows else np.zeros(0, mark)
            key, marks = merged(marks, mark_key(marks["row"], marks["segment"]))
            out = []
            for batch in left.combine_chunks().select(names).to_batches():
                rid = batch.column(0).to_numpy().view(np.uint64)
                removed = []
                for w in text.blocks(batch.column(1)):
                    gone = covered(w, rid[w.rows], key, marks, window, frequent.value)
                    removed += [gone[a:b] for a, b in zip(w.first[:-1], w.first[1:])]
                out.append(changed(batch, removed))
            return pa.Table.from_batches(out) if out else pa.Table.from_batches([plain(pa.RecordBatch.from_pylist([], left.select(names).schema))])

        direct = docs.mapInArrow(split(False), schema)
        boxed = docs.mapInArrow(split(True), StructType([StructField("box", IntegerType()), *docs.schema.fields]))
        met = boxed.groupBy("box").cogroup(self.marks.select(F.col("key").alias("box"), "rows").groupBy("box")).applyInArrow(finish, schema)
        return direct.unionByName(met)


def row_id(key: Column, body: Column) -> Column:
    return F.xxhash64(key.isNull(), key, body.isNull(), body)


def repeats(docs: DataFrame, window: int = 50, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row: what the removal of repeated windows leaves."""
    from hashlib import sha256

    key, body = cluster.at(docs, id_column), cluster.at(docs, text_column)
    src = cluster.by_position(docs).select(row_id(key, body).alias("rid"), F.coalesce(body.cast("string"), F.lit("")).alias("text"), key.cast("long").alias("doc_id"))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]

    def rows(batch: pa.RecordBatch, removed: list | None) -> pa.RecordBatch:
        n, gone, digest = [], [], []
        for i, x in enumerate(batch.column(1)):
            split = x.as_buffer().to_pybytes().split() if x.is_valid else []
            kept = split if removed is None else list(compress(split, ~removed[i]))
            n.append(len(split))
            gone.append(len(split) - len(kept))
            digest.append(sha256(b" ".join(kept)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(2), *(pa.array(x, k) for x, k in zip((n, gone, digest), kinds[1:]))], names)

    plan = Plan(src, window)
    return plan.answers(src, lambda b: rows(b, None), rows, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = 50, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows and columns of ``docs``, the words of repeated windows cut out of the text.

    What stays keeps its own white space; a text without repeats is unchanged.
    """
    key, body = cluster.at(docs, id_column), cluster.at(docs, text_column)
    rows = cluster.by_position(docs)
    names = rows.columns
    src = rows.select(row_id(key, body), F.coalesce(body.cast("string"), F.lit("")), *names).toDF("rid", "text", *names)
    at = docs.columns.index(text_column)

    def cut(raw: bytes, removed: np.ndarray) -> str:
        w = text.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        change = np.diff(np.concatenate([[0], removed.astype(np.int8), [0]]))
        parts, last = [], 0
        for a, b in zip(np.flatnonzero(change == 1), np.flatnonzero(change == -1)):
            parts.append(raw[last : w.starts[a]])
            last = w.starts[b] if b < len(w.starts) else len(raw)
        return b"".join([*parts, raw[last:]]).decode()

    def plain(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(batch.columns[2:], names)

    def changed(batch: pa.RecordBatch, removed: list) -> pa.RecordBatch:
        texts = [None if not t.is_valid else cut(t.as_buffer().to_pybytes(), r) if r.any() else t.as_py() for t, r in zip(batch.column(2 + at), removed)]
        columns = batch.columns[2:]
        columns[at] = pa.array(texts, columns[at].type)
        return pa.RecordBatch.from_arrays(columns, names)

    return Plan(src, window).answers(src, plain, changed, rows.schema).toDF(*docs.columns)
