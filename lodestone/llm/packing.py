"""Packing of sequences into bins of several permitted lengths.

Variable-capacity best fit: sequences go longest first into the open bin with the least
space that takes them. Where none does, a bin is opened, and its length is chosen over
all permitted ones jointly: for each, the rest of the length histogram tells what the bin
would come to hold, largest first, and the length with the least cost for each token that
it would hold is opened. A bin of n tokens costs ``overhead + n + n * n / span``: what any
bin costs, what its tokens cost, and what attention costs between them, so that neither
the largest nor the least length is always best. The plan is held against those that
prefer one length throughout, and the cheapest of all is taken; at the end each bin is
cut down to the least permitted length that holds its contents.

Sequences are dealt by hash to shards of a bounded number of sequences, and each shard
is packed in one task; only ids and lengths are exchanged. A sequence longer than the
largest length is split into pieces of that length and a rest.

Defined cases: null lengths, and where words are counted null, empty and blank texts, have
no tokens and get no bin (null bin and capacity, length 0); they are dealt by the
partition that they come from. Equal lengths go by id; repeated rows are packed each for themselves; an empty
table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cluster, text

LENGTHS = (512, 1024, 2048, 4096, 8192)
OVERHEAD = 32.0  # cost of a bin besides its tokens
SPAN = 16384.0  # a bin of this length costs as much for attention as for its tokens
SHARD = 5000  # sequences of a shard
OUTPUT = "doc_id long, piece int, start long, length long, bin_id long, capacity long, offset long"


def bin_cost(length: int, overhead: float = OVERHEAD, span: float = SPAN) -> float:
    return overhead + length + length * length / span


def total_cost(capacities: list[int], overhead: float = OVERHEAD, span: float = SPAN) -> float:
    return sum(bin_cost(c, overhead, span) for c in capacities)


class _Openings:
    """Which length to open for a sequence: ``preferred`` where it fits, else by least cost for each token."""

    def __init__(self, ascending: list[int], lengths: tuple[int, ...], preferred: int | None, overhead: float, span: float):
        self.sizes, self.lengths, self.preferred = ascending, lengths, preferred
        self.sums = list(accumulate(ascending, initial=0))
        self.cost = {c: bin_cost(c, overhead, span) for c in lengths}

    def held(self, space: int, left: int) -> int:
        """Tokens that a space would come to hold of the ``left`` shortest sequences, largest first."""
        total = 0
        while left and space >= self.sizes[0]:
            fit = bisect_right(self.sizes, space, 0, left)
            left = bisect_left(self.sums, self.sums[fit] - space, 0, fit)  # a run of the largest that fit, at once
            total += self.sums[fit] - self.sums[left]
            space -= self.sums[fit] - self.sums[left]
        return total

    def choose(self, n: int, left: int) -> int:
        """The length to open for a sequence of n tokens, the ``left`` shortest ones being still to pack."""
        fits = self.lengths[bisect_left(self.lengths, n) :]
        if self.preferred is not None:
            return max(self.preferred, fits[0])
        best = None
        for c in fits:
            tokens = n + self.held(c - n, left)
            each = self.cost[self.lengths[bisect_left(self.lengths, tokens)]] / tokens
            if best is None or each < best[0]:
                best = each, c
        return best[1]


def _packed(order: list[int], sizes: list[int], openings: _Openings) -> tuple[list[tuple[int, int]], list[int]]:
    room: list[tuple[int, int]] = []  # (space, bin) of open bins, ascending
    used: list[int] = []
    place: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    least = openings.sizes[0]
    for done, i in enumerate(order, 1):
        n = sizes[i]
        at = bisect_left(room, (n, -1))
        if at < len(room):
            space, b = room.pop(at)
        else:
            space, b = openings.choose(n, len(order) - done), len(used)
            used.append(0)
        place[i] = (b, used[b])
        used[b] += n
        if space - n >= least:
            insort(room, (space - n, b))
    return place, [openings.lengths[bisect_left(openings.lengths, u)] for u in used]


def best_fit(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, overhead: float = OVERHEAD, span: float = SPAN) -> tuple[list[tuple[int, int]], list[int]]:
    """(bin, offset) of each sequence and the length of each bin; sizes are at most the largest length."""
    if not sizes:
        return [], []
    lengths = tuple(sorted(lengths))
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    ascending = sorted(sizes)
    plans = [_packed(order, sizes, _Openings(ascending, lengths, c, overhead, span)) for c in (None, *(lengths if len(lengths) > 1 else ()))]
    return min(plans, key=lambda p: total_cost(p[1], overhead, span))


def pieces_of(n: int, largest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a sequence."""
    return [(a, min(largest, n - a)) for a in range(0, n, largest)]


def word_lengths(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, length): words of each whole text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            sizes = [np.diff(w.first) for w in text.blocks(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(sizes) if sizes else [], pa.int64())], ["doc_id", "length"])

    return cluster.texts(docs, id_column, text_column).mapInArrow(run, "doc_id long, length long")


def token_lengths(docs: DataFrame, tokenizer: str, extra: int = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, length): tokens of each whole text under a tokenizer file, and ``extra`` for what ends it."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder_of

        encoder = encoder_of(tokenizer)
        for batch in cluster.batches(it, 1000):
            sizes = [n + extra for n in encoder.counts(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["doc_id", "length"])

    return cluster.texts(docs, id_column, text_column).mapInArrow(run, "doc_id long, length long")


def pack(sequences: DataFrame, lengths: tuple[int, ...] = LENGTHS, overhead: float = OVERHEAD, span: float = SPAN, rows: int | None = None) -> DataFrame:
    """Bins of (doc_id, length) rows: one row a piece. ``rows``: how many there are, counted where not given."""
    rows = sequences.count() if rows is None else rows
    shards = max(1, math.ceil(rows / SHARD))
    largest = max(lengths)

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        out: list[list] = [[] for _ in range(7)]
        sizes, pieces, bare = [], [], []
        for doc, n in sorted(zip(table.column("doc_id").to_pylist(), table.column("length").to_pylist()), key=lambda r: (r[0] is None, r[0] or 0, r[1])):
            if n <= 0:
                bare.append(doc)
            for k, (a, m) in enumerate(pieces_of(n, largest)):
                pieces.append((doc, k, a, m))
                sizes.append(m)
        place, capacity = best_fit(sizes, lengths, overhead, span)
        for row, (b, offset) in zip(pieces, place):
            for column, x in zip(out, (*row, (shard << 32) + b, capacity[b], offset)):
                column.append(x)
        for column, x in zip(out, (bare, *([v] * len(bare) for v in (0, 0, 0, None, None, None)))):
            column += x
        names = [f.split()[0] for f in OUTPUT.split(", ")]
        return pa.table({n: pa.array(x, pa.int32() if n == "piece" else pa.int64()) for n, x in zip(names, out)})

    known = cluster.by_position(sequences).select(cluster.at(sequences, "doc_id").cast("long").alias("doc_id"), F.coalesce(cluster.at(sequences, "length").cast("long"), F.lit(0)).alias("length"))
    shard = F.when(F.col("length") > 0, F.pmod(F.xxhash64("doc_id", "length"), F.lit(shards))).otherwise(F.pmod(F.spark_partition_id(), F.lit(shards)))
    return known.withColumn("shard", shard.cast("long")).groupBy("shard").applyInArrow(run, OUTPUT)


def pack_documents(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, tokenizer: str | None = None, overhead: float = OVERHEAD, span: float = SPAN) -> DataFrame:
    """Bins of the texts of ``docs``, their lengths in tokens of a tokenizer file (with an end id each) or in words."""
    sizes = word_lengths(docs) if tokenizer is None else token_lengths(docs, tokenizer)
    return pack(sizes, lengths, overhead, span, docs.count())
