"""N-gram Jaccard join with a token-group matrix.

Sharding, without loss: the hash space is cut into d + 2 ranges, where d is how many
shingles two linked sets of a size class can differ in at most, so linked sets agree on
the whole content of two ranges at least. Sets that share the content of a range are
connected, or, of ranges that are empty or nearly so, those of two ranges; the connected
components are the shards. Equal sets are one before that, and what shares a content in
one batch goes on as one set. ``exact=False``, the default below a similarity of 8/9
where ranges hold few shingles, connects sets that agree on one of 44 bands of 5 minimum
hashes instead: a pair at 0.8 is missed by all bands with a probability of 3e-8, a closer
one less.

In a shard, sets are ordered by similarity and cut into small groups. The token-group
matrix holds each group's token union; a query's overlap with the union bounds its
overlap with every member, and only groups whose bound and sizes reach the threshold
are opened and compared exactly. Groups that are connected to the query already are not
opened again. Shards of any size are compared chunk by chunk. ``group_report`` counts
what was bounded, opened and compared.

Sets are held as 64-bit hashes; a set is known by the 64-bit sum of its mixed hashes.

Defined cases: null, empty and blank texts have no shingles and link with nothing;
repeated rows and equal texts are linked; ties go to the smallest doc_id; a null doc_id
is larger than any other, and a component of such rows has none; an empty table gives
an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cluster, text

CHUNK_TOKENS = 400_000  # tokens of a chunk of a shard
BUCKET_ENTRIES = 2_000_000  # range contents of a bucket
GROUP = 8  # sets of a group
_BATCH = 2000  # documents at a time


def size_classes(most: int, num: int, den: int) -> np.ndarray:
    """Lower bounds of the size classes: a set and a linked one of its size or more are in one class or in neighbours."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, (out[-1] - 1) * den // num + 1))
    return np.array(out, np.int64)


def differing(bounds: np.ndarray, num: int, den: int) -> np.ndarray:
    """By class of the smaller set: in how many shingles linked sets can differ at most."""
    return (bounds[1:] - 1) * (den - num) // num


def signatures(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit value of each set, 0 for the empty one."""
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(text.mix(h + np.uint64(0x51ED270B)), out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def range_contents(h: np.ndarray, first: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(set, content hash) of each range of each set, in its own class's cut and the next smaller one's.

    Unlike sets may well agree on a range that holds next to nothing, so such ranges
    count by twos: where linked sets agree on no other range, they agree on two of these.
    """
    few = 1 if num >= 8 * (den - num) else 0
    size = np.diff(first)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    bounds = size_classes(int(size.max()), num, den)
    parts = differing(bounds, num, den) + 2
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(text.mix(h), out=total[1:])
    owner = np.repeat(np.arange(len(size)), size)
    sets, keys = [], []
    for below in (0, 1):
        kind = np.searchsorted(bounds, size, side="right") - 1 - below
        m = np.where((size > 0) & (kind >= 0), parts[np.maximum(kind, 0)], 0)
        m = np.where(m > 2, m, 0)  # two ranges: linked sets are equal
        base = np.concatenate([[0], np.cumsum(m)])
        use = m[owner] > 0
        cell = base[owner[use]] + (((h[use] >> np.uint64(32)) * m[owner[use]].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        count = np.bincount(cell, minlength=int(base[-1]))
        # The hashes of a set ascend, so those of a cell are neighbours.
        at = np.flatnonzero(use)
        stop = np.cumsum(count)
        edge = np.concatenate([at, [len(h)]])
        lo, hi = edge[stop - count], np.where(count > 0, edge[np.maximum(stop - 1, 0)] + 1, edge[stop - count])
        content = total[hi] - total[lo]
        of = np.repeat(np.arange(len(size)), m)
        part = np.arange(int(base[-1])) - base[of]
        salt = text.mix(part.astype(np.uint64) * np.uint64(1_000_003) + kind[of].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        key = text.mix(content ^ salt)
        sets.append(of[count > few])
        keys.append(key[count > few])
        bare = np.flatnonzero(count <= few)
        for step in range(1, len(bare)):
            a = bare[:-step][of[bare[:-step]] == of[bare[step:]]]
            if not len(a):
                break
            b = bare[step:][of[bare[:-step]] == of[bare[step:]]]
            sets.append(of[a])
            keys.append(text.mix(key[a] * np.uint64(3) + key[b]))
    return np.concatenate(sets), np.concatenate(keys)


ROWS, BANDS = 5, 44
_rng = np.random.default_rng(7)
_TURN = _rng.integers(0, 2**32, (2, ROWS * BANDS), dtype=np.uint64).astype(np.uint32)


def band_contents(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set, band hash) of each band of minimum hashes of each set that isn't empty."""
    full = np.flatnonzero(np.diff(first))
    if not len(full):
        return full, np.zeros(0, np.uint64)
    x, starts = (h >> np.uint64(32)).astype(np.uint32), first[full]
    keys = []
    for band in range(BANDS):
        key = np.full(len(full), band + 1, np.uint64)
        for turn in range(band * ROWS, (band + 1) * ROWS):
            least = np.minimum.reduceat((x ^ _TURN[0, turn]) * (_TURN[1, turn] | np.uint32(1)), starts)
            key = text.mix(key * np.uint64(0x9E3779B97F4A7C15) + least.astype(np.uint64))
        keys.append(key)
    return np.tile(full, BANDS), np.concatenate(keys)


class _Joined:
    """Which sets are connected so far."""

    def __init__(self, n: int):
        self.low = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        at, low = cluster.forest(len(self.low), self.low[a], self.low[b])
        if len(at):
            to = np.arange(len(self.low))
            to[at] = low
            self.low = to[self.low]


def links_of(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, num: int, den: int, every: bool = False) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
    """Linked pairs (one of ``left``, one of ``right``) of a shard, through its token-group matrix.

    As many as connect what is linked, or ``every`` pair. Also what the bounds did:
    (query, group) pairs bounded, pairs opened, sets compared.
    """
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), size)
    tokens, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1  # tokens of one set only never overlap
    use = count[place] > 1
    width = max(1, int((count > 1).sum() + 63) // 64)
    bits = np.zeros((len(sets), width), np.uint64)
    col = shared[place[use]]
    np.bitwise_or.at(bits, (owner[use], col // 64), np.uint64(1) << (col % 64).astype(np.uint64))
    # Similar sets side by side: by the first tokens, then by size.
    lead = np.array([s[0] if len(s) else 0 for s in sets], np.uint64)
    order = right[np.lexsort((size[right], lead[right]))]
    seen = {"bounded": 0, "opened": 0, "compared": 0}
    out_a, out_b = [], []
    step = max(1, (1 << 21) // width)
    both = np.array_equal(left, right)
    joined = _Joined(len(sets))
    for lo in range(0, len(order), GROUP):
        group = order[lo : lo + GROUP]
        union = np.bitwise_or.reduce(bits[group], axis=0)
        least, most = size[group].min(), size[group].max()
        q = left[(size[left] > 0) & (size[left] * den >= num * least) & (num * size[left] <= den * most)]
        if not every:
            q = q[(joined.low[q][:, None] != joined.low[group][None, :]).any(1)]
        if not len(q):
            continue
        bound = np.concatenate([np.bitwise_count(bits[q[i : i + step]] & union).sum(1) for i in range(0, len(q), step)]).astype(np.int64)
        # den * i >= num * (a + b - i) needs (den + num) * i >= num * (a + b)
        other = np.maximum(least, (num * size[q] + den - 1) // den)
        seen["bounded"] += len(q)
        q = q[(den + num) * bound >= num * (size[q] + other)]
        seen["opened"] += len(q)
        rows = max(1, step // len(group))
        for i in range(0, len(q), rows):
            part = q[i : i + rows]
            inter = np.bitwise_count(bits[part][:, None, :] & bits[group][None, :, :]).sum(2).astype(np.int64)
            seen["compared"] += inter.size
            x, y = np.nonzero((den + num) * inter >= num * (size[part][:, None] + size[group][None, :]))
            x, y = part[x], group[y]
            keep = x < y if both and every else x != y
            x, y = np.minimum(x, y)[keep] if both else x[keep], np.maximum(x, y)[keep] if both else y[keep]
            out_a.append(x)
            out_b.append(y)
            joined.add(x, y)
    empty = np.zeros(0, np.int64)
    return (np.concatenate(out_a), np.concatenate(out_b), seen) if out_a else (empty, empty, seen)


def _sets_of(column: pa.Array, n: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    for w in text.blocks(column, lower=True):
        h, first = text.shingle_sets(w, n)
        yield w.rows, h, first


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def document_sets(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, rid, n_shingles, sig) of each row; rid is a hash of the row's id and text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cluster.batches(it, _BATCH):
            size, sig = [], []
            for _, h, first in _sets_of(batch.column(2), n):
                size.append(np.diff(first))
                sig.append(signed(signatures(h, first)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(size)), pa.array(np.concatenate(sig))], ["doc_id", "rid", "n_shingles", "sig"])

    return docs.mapInArrow(run, "doc_id long, rid long, n_shingles long, sig long")


def _shard_edges(docs: DataFrame, n: int, num: int, den: int, buckets: int, exact: bool) -> DataFrame:
    """(a, b): set signatures connected by the content of ranges or a band, as few edges as connect them."""

    def connected(key: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First entry of each key, by key, and edges (a, b) that connect what shares a key."""
        order = np.lexsort((sig, key))
        key, sig = key[order], sig[order]
        same = key[1:] == key[:-1]
        new = same & (sig[1:] != sig[:-1])
        nodes, at = np.unique(np.concatenate([sig[:-1][new], sig[1:][new]]), return_inverse=True)
        k = int(new.sum())
        u, v = cluster.forest(len(nodes), at[:k], at[k:])
        return order[np.concatenate([[True], ~same])] if len(order) else order, nodes[u], nodes[v]

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cluster.batches(it, _BATCH):
            keys, sigs = [], []
            for _, h, first in _sets_of(batch.column(2), n):
                sig = signatures(h, first)
                of, key = range_contents(h, first, num, den) if exact else band_contents(h, first)
                keys.append(key)
                sigs.append(sig[of])
            key, sig = np.concatenate(keys), np.concatenate(sigs)
            one, a, b = connected(key, sig)  # what shares a content in this batch goes on as one
            rows = np.stack([np.concatenate([key[one], a]), np.concatenate([sig[one], b])], 1)
            bucket = (np.concatenate([text.mix(key[one]), text.mix(a)]) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            edge = np.concatenate([np.zeros(len(one), bool), np.ones(len(a), bool)])
            order = np.lexsort((edge, bucket))
            bucket, edge, rows = bucket[order], edge[order], rows[order]
            cut = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (edge[1:] != edge[:-1]), [True]])) if len(order) else [0]
            yield pa.RecordBatch.from_arrays([pa.array([int(bucket[x]) for x in cut[:-1]], pa.int32()), pa.array([bool(edge[x]) for x in cut[:-1]], pa.bool_()), pa.array([rows[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:])], pa.binary())], ["bucket", "edge", "rows"])

    def meet(entries: list[bytes], edges: list[bytes]) -> pa.RecordBatch:
        x = np.frombuffer(b"".join(entries), np.uint64).reshape(-1, 2)
        _, a, b = connected(x[:, 0], x[:, 1])
        y = np.frombuffer(b"".join(edges), np.uint64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate([a, y[:, 0]]))), pa.array(signed(np.concatenate([b, y[:, 1]])))], ["a", "b"])

    def find(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [])
        for batch in it:
            for bucket, edge, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if bucket != now and now is not None:
                    yield meet(*held)
                    held = ([], [])
                now = bucket
                held[edge].append(rows.as_py())
        if now is not None:
            yield meet(*held)

    dealt = docs.mapInArrow(deal, "bucket int, edge boolean, rows binary").repartition(min(buckets, 4 * cluster.partitions(docs.sparkSession)), "bucket")
    return dealt.sortWithinPartitions("bucket").mapInArrow(find, "a long, b long")


def _open_shards(members: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(a, b): links that connect what is linked in each shard; members: (shard, chunks, box, sig, text).

    Also, without a, what the bounds did: (bounded, opened, compared), a row a task's group.
    """

    def fetch(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cluster.batches(it, 200):
            out = []
            for _, h, first in _sets_of(batch.column(4), n):
                out += [h[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(out, pa.binary())], ["shard", "chunks", "box", "sig", "tokens"])

    def opened(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        shard, mine, i, j, sig = (table.column(k).to_numpy() for k in ("shard", "mine", "i", "j", "sig"))
        tokens = table.column("tokens")
        order = np.argsort(shard, kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], shard[order][1:] != shard[order][:-1], [True]]))
        out_a, out_b, counts = [], [], np.zeros(3, np.int64)
        for lo, hi in zip(edge[:-1], edge[1:]):
            at = order[lo:hi]
            _, one = np.unique(sig[at], return_index=True)  # a repeated row is there twice
            at = at[one]
            sets = [np.frombuffer(tokens[int(k)].as_buffer(), np.uint64) for k in at]
            left = np.flatnonzero(mine[at] == i[at[0]])
            right = np.flatnonzero(mine[at] == j[at[0]])
            a, b, seen = links_of(sets, left, right, num, den)
            counts += list(seen.values())
            u, v = cluster.forest(len(at), a, b)
            out_a.append(sig[at[u]])
            out_b.append(sig[at[v]])
        none = [None] * sum(map(len, out_a))
        links = {"a": [*np.concatenate(out_a).tolist(), None], "b": [*np.concatenate(out_b).tolist(), None]} | {k: [*none, int(c)] for k, c in zip(("bounded", "opened", "compared"), counts)}
        return pa.table({k: pa.array(x, pa.int64()) for k, x in links.items()})

    sets = members.mapInArrow(fetch, "shard long, chunks int, box long, sig long, tokens binary")
    sets = sets.withColumn("mine", F.pmod(F.xxhash64("sig"), "chunks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    sets = sets.select("shard", "box", "sig", "tokens", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    return sets.groupBy("box", "i", "j").applyInArrow(opened, "a long, b long, bounded long, opened long, compared long")


@dataclass
class _Found:
    """Tables of a join: rows, classes of equal sets with their shards, and what opening the shards gave."""

    rows: DataFrame
    classes: DataFrame
    opened: DataFrame


def _join(docs: DataFrame, shingle: int, num: int, den: int, id_column: str, text_column: str, exact: bool | None) -> _Found:
    spark = docs.sparkSession
    exact = num >= 8 * (den - num) if exact is None else exact
    src = cluster.by_position(docs).select(cluster.at(docs, id_column).cast("long").alias("doc_id"), cluster.at(docs, text_column).cast("string").alias("text")).select("doc_id", F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text").alias("rid"), "text")
    rows = cluster.saved(document_sets(src, shingle), "sets")
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    entries = total * 5 * (den - num) // (2 * num) if exact else BANDS * rows.count()
    buckets = max(cluster.partitions(spark), -(-entries // BUCKET_ENTRIES))
    classes = rows.filter("n_shingles > 0").groupBy("sig").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")).alias("first"), F.max("n_shingles").alias("n"), F.count("*").alias("weight"))
    shards = cluster.components(_shard_edges(src, shingle, num, den, int(buckets), exact))
    classes = cluster.cut(classes.join(shards, classes.sig == shards.node, "left").select("sig", "first", "n", "weight", F.col("component").alias("shard")))
    inside = classes.filter("shard is not null")
    volume = inside.groupBy("shard").agg(F.sum("n").alias("tokens")).withColumn("chunks", F.ceil(F.col("tokens") / CHUNK_TOKENS).cast("int"))
    boxes = max(4 * cluster.partitions(spark), -(-total // (4 * CHUNK_TOKENS)))
    volume = volume.select("shard", "chunks", F.when(F.col("chunks") > 1, F.col("shard")).otherwise(F.pmod(F.xxhash64("shard"), F.lit(boxes))).alias("box"))
    wanted = inside.join(volume, "shard").select(F.col("first.rid").alias("rid"), "sig", "shard", "chunks", "box")
    wanted = cluster.cut(wanted)
    some = spark.sparkContext.broadcast(cluster.key_set(wanted.select("rid"), wanted.count()))  # other texts stay where they are
    members = cluster.select_rows(src.select("rid", "text"), some, True).join(wanted, "rid").select("shard", "chunks", "box", "sig", "text")
    return _Found(rows, classes, _open_shards(members, shingle, num, den))


def similar(docs: DataFrame, shingle: int = 5, num: int = 4, den: int = 5, id_column: str = "doc_id", text_column: str = "text", exact: bool | None = None) -> DataFrame:
    """(doc_id, rid, n_shingles, component_id, keeper) of each row.

    Two rows link where their sets of ``shingle``-word shingles (A-Z in lower case) have
    a Jaccard similarity of at least num/den. component_id: smallest doc_id reachable by
    links; keeper: rid of one row of the component, of its smallest doc_id.
    """
    found = _join(docs, shingle, num, den, id_column, text_column, exact)
    rows, classes = found.rows, found.classes
    comps = cluster.components(found.opened.select("a", "b"))
    joined = classes.join(comps, classes.sig == comps.node, "left").select("sig", "first", "weight", F.coalesce("component", "sig").alias("component"), F.col("component").isNotNull().alias("linked"))
    linked = joined.filter("linked")
    best = linked.groupBy("component").agg(F.min("first").alias("best"))
    decided = linked.join(best, "component").select("sig", "best").unionByName(joined.filter("not linked and weight > 1").select("sig", F.col("first").alias("best")))
    out = rows.join(decided.withColumn("real", F.lit(1)), (rows.sig == decided.sig) & (rows.n_shingles > 0), "left").drop(decided.sig)
    return out.select("doc_id", "rid", "n_shingles", F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("component_id"), F.coalesce("best.rid", "rid").alias("keeper"))


def group_report(docs: DataFrame, shingle: int = 5, num: int = 4, den: int = 5, id_column: str = "doc_id", text_column: str = "text", exact: bool | None = None) -> DataFrame:
    """One row: sets, sets in shards, shards, (query, group) pairs bounded and opened, and set pairs compared."""
    found = _join(docs, shingle, num, den, id_column, text_column, exact)
    sets = found.classes.agg(F.count("*").alias("sets"), F.count("shard").alias("in_shards"), F.count_distinct("shard").alias("shards"))
    counts = found.opened.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("bounded", "opened", "compared")))
    return sets.crossJoin(F.broadcast(counts))  # one row each


def one_of_each(docs: DataFrame, shingle: int = 5, num: int = 4, den: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` without those that link, directly or not, with a row that stays.

    One row of each component stays, that of the smallest doc_id; rows without words all stay.
    """
    marks = cluster.saved(similar(docs, shingle, num, den, id_column, text_column), "marks")
    gone = marks.filter("keeper <> rid").select("rid").distinct()
    twins = marks.filter("keeper = rid and n_shingles > 0").groupBy("rid").count().filter("count > 1").select("rid")
    fate = cluster.cut(gone.withColumn("gone", F.lit(True)).unionByName(twins.withColumn("gone", F.lit(False))))
    some = docs.sparkSession.sparkContext.broadcast(cluster.key_set(fate.select("rid"), fate.count()))
    key, body = cluster.at(docs, id_column).cast("long"), cluster.at(docs, text_column).cast("string")
    rows = cluster.by_position(docs)  # a column of the rows may be named as ours
    names = rows.columns
    rows = rows.select(F.xxhash64(key.isNull(), key, body.isNull(), body).alias("rid"), *names)
    # Rows that stay for certain are not moved; the others meet their fate.
    sure = cluster.select_rows(rows, some, False)
    asked = cluster.select_rows(rows, some, True).join(fate, "rid", "left").filter("gone is null or not gone")
    # Of a kept row that is there several times, one stays.
    once = asked.filter("gone is not null").drop("gone").dropDuplicates(["rid"])
    kept = sure.unionByName(asked.filter("gone is null").drop("gone")).unionByName(once)
    return kept.select(*names).toDF(*docs.columns)
