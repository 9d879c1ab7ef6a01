"""Exact top-k search and near-duplicates of embedding vectors.

Top-k search (multi-resolution segment statistics): each vector is summarised by the
means and deviations of its segments, at several resolutions. For a segment of n
components the inner product is at most n * (mean * mean + deviation * deviation), so
the score is bounded (the distance from below, the inner product from above) coarse to
fine; only vectors whose bound reaches the current k-th score are computed exactly.
Queries are written as slabs of a fixed number of rows to the shared folder, and each
task takes its own rows through all of them, slab by slab: one scan and one plan,
however many queries there are.

Near-duplicates (pivot permutation index): reference points are rows of smallest id
hash; a vector is described by its nearest ones in order and goes into the inverted list
of each. Two vectors of a list are retrieved by how many pivots they share, counted
through the lists that the members of this list are also in; only pairs that share
``least_shared`` of them are verified, by their cosine in double precision, each in the
first list that both are in. Equal vectors are one class before that; lists of any
length are taken block by block.

Defined cases: vectors that are null or hold null or non-finite components take no part
in either operator (zero vectors: not in the second); vectors of unequal length are
never compared; an empty table gives an empty result; other columns play no part.
Top-k: rows with the query's own id are not its candidates; repeated query rows are
one query. Near-duplicates: repeated rows are different vectors, linked to each other;
a row without id links with nothing and has no component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import cluster

RESOLUTIONS = (1, 4, 16)
DATA_BLOCK, QUERY_SLAB = 8192, 4096
HELD = 64 << 20  # bytes of rows that a task takes through all slabs at once


def usable(vector: str) -> Column:
    """Whether a vector is there, not empty, and has finite components only."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) > 0) & ~bad, F.lit(False))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def blocks(it: Iterator[pa.RecordBatch], rows: int, scale: float | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of at most ``rows`` vectors of equal width, from batches of (id, vector)."""
    held: dict[int, tuple[list, list]] = {}

    def block(width: int) -> tuple[np.ndarray, np.ndarray]:
        ids, data = held.pop(width)
        x = np.concatenate(data)
        return np.concatenate(ids), np.floor(scale * x) if scale is not None else x

    for batch in cluster.batches(it, rows):
        ids, col = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        size = np.diff(np.asarray(col.offsets))
        for width in np.unique(size):
            at = np.flatnonzero(size == width)
            part = col if len(at) == len(size) else col.take(pa.array(at))
            have = held.setdefault(int(width), ([], []))
            if sum(map(len, have[0])) + len(at) > rows:
                yield block(int(width))
                have = held.setdefault(int(width), ([], []))
            have[0].append(ids[at])
            have[1].append(matrix(part, int(width)))
    for width in list(held):
        yield block(width)


def _statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, weighted so that their products bound inner products."""
    out = []
    for part in np.array_split(np.arange(x.shape[1]), min(segments, x.shape[1])):
        n = math.sqrt(len(part))
        out += [x[:, part].mean(1) * n, x[:, part].std(1) * n]
    return np.stack(out, 1)


class _Rows:
    """A block of rows with their statistics, made once for all slabs."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.levels = [_statistics(x, s) for s in RESOLUTIONS]
        self.slack = 1e-9 * (1 + float(np.linalg.norm(x, axis=1).max()))


class _Best:
    """The k best scores of each query of a slab, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.levels = [_statistics(q, s) for s in RESOLUTIONS]
        self.length = np.linalg.norm(q, axis=1)
        self.score = np.full((len(q), k), -np.inf)
        self.found = np.full((len(q), k), -1, np.int64)

    def add(self, rows: _Rows) -> None:
        coarse = rows.levels[0] @ self.levels[0].T
        for j in range(len(self.q)):
            least = self.score[j, -1] - rows.slack * (1 + self.length[j])
            at = np.flatnonzero(coarse[:, j] >= least)
            for level, own in zip(rows.levels[1:], self.levels[1:]):
                if len(at) > self.k:
                    at = at[level[at] @ own[j] >= least]
            at = at[rows.ids[at] != self.ids[j]]
            if not len(at):
                continue
            score = np.concatenate([self.score[j], rows.x[at] @ self.q[j]])
            found = np.concatenate([self.found[j], rows.ids[at]])
            if len(score) > 64:
                floor = np.partition(score, len(score) - self.k)[len(score) - self.k]
                keep = score >= floor
                score, found = score[keep], found[keep]
            order = np.lexsort((found, -score))[: self.k]
            self.score[j], self.found[j] = score[order], found[order]


def _slabs(queries: DataFrame, folder: str, scale: float | None) -> list[tuple[str, int, int]]:
    """Write the queries as slabs of one width; (path, width, rows) of each, under names of the task's attempt."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, path = cluster.open_folder(folder)
        store.create_dir(path, recursive=True)
        for i, (ids, x) in enumerate(blocks(it, QUERY_SLAB, scale)):
            name = f"{path}/slab-{TaskContext.get().taskAttemptId()}-{i}"
            with store.open_output_stream(name) as f:
                f.write(ids.astype("<i8").tobytes())
                f.write(x.astype("<f8").tobytes())
            yield pa.RecordBatch.from_pydict({"path": [name], "width": pa.array([x.shape[1]], pa.int32()), "n": pa.array([len(x)], pa.int32())})

    made = cluster.cut(queries.mapInArrow(run, "path string, width int, n int"))
    return sorted(tuple(r) for r in made.collect())  # one row a slab


def top_k(vectors: DataFrame, queries: DataFrame, k: int, scale: float | None = None) -> DataFrame:
    """The k rows of ``vectors`` of highest inner product for each row of ``queries``.

    Both have (id, vector). With ``scale``, components become floor(scale * x) and scores
    are exact integers up to 2**53. Returns (query_id, rank, id, score double).
    """
    spark = vectors.sparkSession
    good = lambda d: d.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).filter(usable("vector") & F.col("id").isNotNull())
    asked = cluster.cut(good(queries).dropDuplicates(["id", "vector"]))
    folder = cluster.scratch(spark, "slabs")
    slabs = _slabs(asked.repartition(max(1, math.ceil(asked.count() / QUERY_SLAB))), folder, scale)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = cluster.open_folder(folder)

        def through(held: list[_Rows]) -> Iterator[pa.RecordBatch]:
            widths = {r.x.shape[1] for r in held}
            for slab, (path, width, n) in enumerate(slabs):
                if width not in widths:
                    continue
                with store.open_input_stream(path) as f:
                    raw = f.read()
                b = _Best(np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<f8", n * width, 8 * n).reshape(n, width), k)
                for r in held:
                    if r.x.shape[1] == width:
                        b.add(r)
                at, col = np.nonzero(np.isfinite(b.score))
                yield pa.RecordBatch.from_pydict({"slab": pa.array([slab] * len(at), pa.int64()), "at": pa.array(at, pa.int32()), "query_id": b.ids[at], "id": b.found[at, col], "score": b.score[at, col]})

        held: list[_Rows] = []
        for ids, x in blocks(it, DATA_BLOCK, scale):
            held.append(_Rows(ids, x))
            if sum(r.x.nbytes for r in held) >= HELD:
                yield from through(held)
                held = []
        if held:
            yield from through(held)

    found = good(vectors).mapInArrow(run, "slab long, at int, query_id long, id long, score double")
    order = Window.partitionBy("slab", "at").orderBy(F.desc("score"), F.asc("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


PIVOTS = 16384  # at most; 4 * sqrt(rows) below that
PIVOT_CELLS = 1 << 20  # components of all reference points together, at most
NEAREST = 12  # pivots that describe a vector
SHARED = 2  # of them that two vectors must share to be verified
CHUNK = 2048
_PAIRS = 20_000  # pairs verified at a time
_COUNTED = 2_000_000  # list entries and pairs counted at a time, about


APART = 0.8  # cosine of two reference points at most, so that a group of near copies has one of them


def pivot_table(vectors: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Reference points by vector length: rows of smallest id hash, in number bounded by PIVOTS and PIVOT_CELLS, less those near one before."""
    width = max(1, vectors.agg(F.max(F.size("vector"))).first()[0] or 1)
    count = max(16, min(PIVOTS, PIVOT_CELLS // width, math.ceil(4 * math.sqrt(max(n, 1)))))
    column = vectors.orderBy(F.xxhash64("id"), "id").limit(count).select("vector").toArrow().column(0).combine_chunks()
    size = np.diff(np.asarray(column.offsets))
    out: dict[int, np.ndarray] = {}
    for k in np.unique(size):
        x = unit_rows(matrix(column.take(pa.array(np.flatnonzero(size == k))), int(k)))
        free, chosen = np.ones(len(x), bool), []
        for i in range(len(x)):
            if free[i]:
                chosen.append(i)
                free &= x @ x[i] < APART
        out[int(k)] = x[chosen]
    return out


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # first, so that squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _lists(classes: DataFrame, pivots: dict[int, np.ndarray], nearest: int) -> DataFrame:
    """(pivot, id, weight, near, data, single) rows, one for each of a vector's nearest pivots.

    data: the components, as 32-bit numbers where these are exact.
    """
    shared = classes.sparkSession.sparkContext.broadcast(pivots)
    base = dict(zip(sorted(pivots), np.cumsum([0, *(len(pivots[k]) for k in sorted(pivots))])))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cluster.batches(it, 2048):
            ids, weight, col = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            size = np.diff(np.asarray(col.offsets))
            for width in np.unique(size):
                at = np.flatnonzero(size == width)
                x = matrix(col.take(pa.array(at)), int(width))
                p = shared.value.get(int(width))
                if p is None:  # a width no pivot has: all its vectors share one list of their own
                    near = np.full((len(x), 1), -1 - int(width), np.int32)
                else:
                    m = min(nearest, len(p))
                    s = unit_rows(x) @ p.T
                    near = np.argpartition(-s, m - 1, axis=1)[:, :m]
                    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable"), 1)
                    near = (near + base[int(width)]).astype(np.int32)
                m = near.shape[1]
                with np.errstate(over="ignore"):
                    small = x.astype("<f4")
                exact = (small == x).all()
                raw = [r.tobytes() for r in (small if exact else x.astype("<f8"))]
                order = [r.tobytes() for r in near.astype("<i4")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(near.ravel()), pa.array(np.repeat(ids[at], m)), pa.array(np.repeat(weight[at], m)), pa.array([o for o in order for _ in range(m)], pa.binary()), pa.array([r for r in raw for _ in range(m)], pa.binary()), pa.array(np.full(m * len(at), exact))],
                    ["pivot", "id", "weight", "near", "data", "single"],
                )

    return classes.select("id", "weight", "vector").mapInArrow(run, "pivot int, id long, weight long, near binary, data binary, single boolean")


def sharing(a: np.ndarray, b: np.ndarray, pivot: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) of permutations in the list of ``pivot`` that share ``least`` pivots, this one being the first of them.

    The other pivots of a's rows are looked up in the inverted lists of b's rows, and what
    these hold is counted, for so many rows of a at a time that the counts stay small.
    """
    order = np.argsort(b, axis=None, kind="stable")
    lists, member = b.ravel()[order], order // b.shape[1]
    lo = np.searchsorted(lists, a.ravel())
    size = np.searchsorted(lists, a.ravel(), side="right") - lo
    size[a.ravel() == pivot] = 0
    lo, size = lo.reshape(a.shape), size.reshape(a.shape)
    spent = np.cumsum(size.sum(1) + len(b)) // _COUNTED
    edge = np.flatnonzero(np.concatenate([[True], spent[1:] != spent[:-1], [True]]))
    hits = []
    for first, last in zip(edge[:-1], edge[1:]):
        n = size[first:last].ravel()
        stop = np.cumsum(n)
        at = np.arange(int(stop[-1])) + np.repeat(lo[first:last].ravel() - stop + n, n)
        row = np.repeat(np.arange(last - first), n.reshape(last - first, -1).sum(1))
        key = row * len(b) + member[at]
        ok = np.bincount(key, minlength=(last - first) * len(b)) >= least - 1
        ok[key[np.repeat(a[first:last].ravel() < pivot, n)]] = False
        i, j = np.nonzero(ok.reshape(last - first, len(b)))
        hits.append((i + first, j))
    return np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, nearest: int = NEAREST, least_shared: int = SHARED) -> DataFrame:
    """(id, n_links, component_id, kept) of each row of ``vectors`` (id, vector)."""
    src = vectors.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    zero = F.forall("vector", lambda x: x == 0)
    src = src.withColumn("ok", usable("vector") & F.coalesce(~zero, F.lit(False)) & F.col("id").isNotNull()).withColumns({"k1": F.xxhash64("vector"), "k2": F.hash("vector")})
    classes = src.filter("ok").groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count("*").alias("weight"), F.min_by("vector", "id").alias("vector"))
    classes = cluster.saved(classes, "classes")
    n = classes.count()
    pivots = pivot_table(classes.select("id", "vector"), n)
    listed = _lists(classes, pivots, nearest)
    # Long lists are cut into chunks; each pair of chunks is a task's group.
    sizes = listed.groupBy("pivot").count().withColumn("chunks", F.ceil(F.col("count") / CHUNK).cast("int")).select("pivot", "chunks")
    cutup = listed.join(F.broadcast(sizes), "pivot").withColumn("mine", F.pmod(F.xxhash64("id"), "chunks").cast("int"))  # one small row a pivot, of which there are at most PIVOTS and one a width
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    cutup = cutup.withColumn("other", other).select("pivot", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "id", "weight", "near", "data", "single")

    def pairs(table: pa.Table) -> pa.Table:
        one = table.combine_chunks()
        pivot, i, j = (one.column(c)[0].as_py() for c in range(3))
        mine, ids, weight = (one.column(c).to_numpy() for c in (3, 4, 5))
        near = np.frombuffer(b"".join(one.column(6).to_pylist()), "<i4").reshape(len(ids), -1)
        unit = unit_rows(np.stack([np.frombuffer(r, "<f4" if s else "<f8") for r, s in zip(one.column(7).to_pylist(), one.column(8).to_pylist())]).astype(np.float64))
        left = np.flatnonzero(mine == i)
        right = left if i == j else np.flatnonzero(mine == j)
        a, b = sharing(near[left], near[right], pivot, min(least_shared, near.shape[1])) if len(left) and len(right) else (left[:0], right[:0])
        a, b = left[a], right[b]
        if i == j:
            a, b = a[a < b], b[a < b]
        close = [np.einsum("ij,ij->i", unit[a[k : k + _PAIRS]], unit[b[k : k + _PAIRS]]) >= threshold for k in range(0, len(a), _PAIRS)]
        keep = np.concatenate(close) if close else np.zeros(0, bool)
        a, b = a[keep], b[keep]
        links = np.bincount(a, weight[b], len(ids)) + np.bincount(b, weight[a], len(ids))
        at = np.flatnonzero(links)
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        u, v = cluster.forest(len(ids), place[a], place[b])
        u, v = ids[order][u], ids[order][v]
        return pa.table({"a": pa.array(np.concatenate([ids[at], u])), "b": pa.array([None] * len(at) + v.tolist(), pa.int64()), "n": pa.array(links[at].astype(np.int64).tolist() + [None] * len(u), pa.int64())})

    out = cluster.cut(cutup.groupBy("pivot", "i", "j").applyInArrow(pairs, "a long, b long, n long"))
    links = out.filter("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    comps = cluster.components(out.filter("b is not null").select("a", "b"))
    # Of each class, its links and component; a class whose vectors have one row each and no links is not listed.
    known = classes.select("k1", "k2", F.col("id").alias("node"), "weight").join(links, "node", "left").join(comps, "node", "left").filter("n is not null or weight > 1")
    known = known.select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("component", "node").alias("component"), F.lit(True).alias("ok"))
    rows = src.select("id", "ok", "k1", "k2").join(known, ["k1", "k2", "ok"], "left")
    component = F.coalesce("component", "id")
    return rows.select("id", F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
