"""Hard-negative mining by matrix products in a residue number system.

Rows (id, label, vector) have integer components; a row's score for an anchor is their
exact inner product. An anchor's positives are the best other rows of its label; its
hard negatives for a positive are the best rows of other labels whose score lies in a
window below the positive's.

Scores are never rounded: component matrices are reduced modulo a few small primes,
chosen so that every partial sum of a product stays below 2**23 and is exact in 32-bit
floats; the residues of the products give the signed scores back by Chinese remaindering
with balanced mixed-radix digits. How many primes a pair of blocks needs follows from
the lengths of its vectors.

Rows lie as blocks, anchors as slabs of a fixed number of rows in the shared folder. A
task takes one slab through a list of blocks, holding one block at a time, and keeps the
best rows for each of its anchors (and windows) on the way; so what is emitted is
bounded by lists of blocks times anchors, not by rows, and windowed ranks over that
choose what is returned. No row is dealt by label or anchor: a label that has most of the rows
is like any other.

Defined cases: rows take no part whose id, label or vector is null or empty, that hold a
null or non-finite component, or whose scaled components are so large that a 64-bit
score can't hold their products (length * largest**2 >= 2**62). Vectors of unequal
length are never compared. Repeated anchor rows are one anchor; rows of the anchor's own
id are none of its positives; other repeated rows are different rows, with a rank each. An
empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import cluster

BLOCK, SLAB, PANEL = 16384, 1024, 2048
LISTED = 256  # blocks that one task takes its slab through, at most
_EXACT, _INNER = 1 << 23, 4096
_NONE = np.iinfo(np.int64).min
_FAR = np.iinfo(np.int64).max


@lru_cache
def primes(width: int) -> tuple[int, ...]:
    """Odd primes, largest first, whose balanced residues have exact products of ``width`` terms in 32-bit floats."""
    top = 2 * math.isqrt(_EXACT // max(1, min(width, _INNER))) + 1
    found = [n for n in range(min(top, 2047) | 1, 30, -2) if all(n % q for q in range(3, math.isqrt(n) + 1, 2))]
    return tuple(found)


def chosen(width: int, bound: int) -> tuple[int, ...]:
    """The first primes whose product leaves room for any score of at most ``bound`` in size."""
    out, product = [], 1
    for p in primes(width):
        if product > 4 * bound + 4:
            break
        out.append(p)
        product *= p
    return tuple(out)


def balanced(x: np.ndarray, p: int) -> np.ndarray:
    """Residues of whole 32-bit floats below 2**24, about zero."""
    return x - np.float32(p) * np.rint(x * np.float32(1 / p))


class Residues:
    """An integer matrix and its residues modulo the primes asked for so far."""

    def __init__(self, x: np.ndarray):
        self.x, self.by = x, {}
        wide = x.astype(np.float64)
        self.longest = float(np.einsum("ij,ij->i", wide, wide).max(initial=0.0))

    def modulo(self, p: int) -> np.ndarray:
        if p not in self.by:
            r = (self.x.astype(np.int64) + p // 2) % p - p // 2
            self.by[p] = r.astype(np.float32)
        return self.by[p]


def products(a: Residues, b: Residues, rows: np.ndarray | slice, cols: slice) -> np.ndarray:
    """Exact inner products of rows of a with rows of b, as 64-bit integers."""
    width = a.x.shape[1]
    moduli = chosen(width, math.isqrt(math.ceil(a.longest * b.longest * (1 + 1e-9))) + 1)
    digits: list[np.ndarray] = []
    for k, p in enumerate(moduli):
        left, right = a.modulo(p)[rows], b.modulo(p)[cols]
        r = balanced(left[:, :_INNER] @ right[:, :_INNER].T, p)
        for lo in range(_INNER, width, _INNER):
            r = balanced(r + balanced(left[:, lo : lo + _INNER] @ right[:, lo : lo + _INNER].T, p), p)
        if digits:
            # What the digits so far say modulo p, then the next digit.
            have, radix = np.zeros_like(r), math.prod(moduli[:k])
            for q, v in zip(moduli[k - 1 :: -1], digits[::-1]):
                have = balanced(have * np.float32(_centred(q, p)) + v, p)
            r = balanced(balanced(r - have, p) * np.float32(_centred(pow(radix, -1, p), p)), p)
        digits.append(r)
    out = np.zeros(digits[0].shape, np.int64)
    for q, v in zip(moduli[::-1], digits[::-1]):
        out = out * q + v.astype(np.int64)
    return out


def _centred(n: int, p: int) -> int:
    return (n + p // 2) % p - p // 2


def whole_rows(batch: pa.RecordBatch, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, components floor(scale * x)) by vector length; rows that take no part are left out."""
    ids, labels, col = (batch.column(i) for i in range(3))
    size = np.where(np.asarray(col.is_null()), 0, np.diff(np.asarray(col.offsets)))
    size[np.asarray(ids.is_null()) | np.asarray(labels.is_null())] = 0
    for width in np.unique(size[size > 0]):
        at = np.flatnonzero(size == width)
        x = np.floor(scale * col.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width))
        with np.errstate(invalid="ignore"):
            largest = np.abs(x).max(1)
            ok = np.isfinite(x).all(1) & (largest < 2.0**31) & (width * largest**2 < 2.0**62)
        at = at[ok]
        if len(at):
            pick = pa.array(at)
            yield ids.take(pick).to_numpy(), labels.take(pick).to_numpy(), x[ok].astype(np.int64)


def _packed(x: np.ndarray) -> np.ndarray:
    for kind in (np.int16, np.int32):
        if np.abs(x).max(initial=0) <= np.iinfo(kind).max:
            return x.astype(kind)
    return x


def write_blocks(rows: DataFrame, folder: str, size: int, scale: float) -> DataFrame:
    """Rows (id, label, vector) as files of at most ``size`` vectors of one length, by label and id; (path, width) of each."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, path = cluster.open_folder(folder)
        store.create_dir(path, recursive=True)
        held: dict[int, list] = {}
        n = 0

        def written(width: int) -> pa.RecordBatch:
            nonlocal n
            ids, labels, x = (np.concatenate(part) for part in zip(*held.pop(width)))
            order = np.lexsort((ids, labels))
            # The attempt's own name: files of an attempt that was lost are never read.
            name, n = f"{path}/{TaskContext.get().taskAttemptId()}-{n}", n + 1
            with store.open_output_stream(name) as f:
                for part in (ids[order], labels[order], _packed(x[order])):
                    buffer = io.BytesIO()
                    np.save(buffer, part)
                    f.write(buffer.getbuffer())
            return pa.RecordBatch.from_pydict({"path": [name], "width": pa.array([width], pa.int32())})

        for batch in cluster.batches(it, 2048):
            for ids, labels, x in whole_rows(batch, scale):
                for lo in range(0, len(ids), size):
                    part, have = ids[lo : lo + size], held.setdefault(x.shape[1], [])
                    if have and sum(len(h[0]) for h in have) + len(part) > size:
                        yield written(x.shape[1])
                        have = held.setdefault(x.shape[1], [])
                    have.append((part, labels[lo : lo + size], x[lo : lo + size]))
        for width in list(held):
            yield written(width)

    return cluster.cut(rows.mapInArrow(run, "path string, width int"))


class Block:
    def __init__(self, store, path: str):
        with store.open_input_stream(path) as f:
            raw = io.BytesIO(f.read())
        self.ids, self.labels, x = (np.load(raw) for _ in range(3))
        self.rows = Residues(x)
        #: Where each label's rows begin and end.
        self.names, first = np.unique(self.labels, return_index=True)
        self.first = np.append(first, len(self.labels))


class Best:
    """The k best (score, id) of each of n lists, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.score, self.id = np.full((n, k), _NONE), np.full((n, k), _FAR)

    def add(self, lists: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Offer a row of scores to each of ``lists``; what is _NONE is no offer."""
        k = self.score.shape[1]
        floor = self.score[lists, -1]
        offered = (score >= floor[:, None]) & (score != _NONE)
        busy = np.flatnonzero(offered.sum(1) > 8 * k)
        if len(busy) and score.shape[1] > k:
            least = np.partition(score[busy], score.shape[1] - k, axis=1)[:, score.shape[1] - k]
            offered[busy] &= score[busy] >= least[:, None]
        at, col = np.nonzero(offered)
        if not len(at):
            return
        touched = np.unique(at)
        row = np.concatenate([np.repeat(touched, k), at])
        new = np.concatenate([self.score[lists[touched]].ravel(), score[at, col]])
        who = np.concatenate([self.id[lists[touched]].ravel(), ids[col]])
        order = np.lexsort((who, ~new, row))
        row, new, who = row[order], new[order], who[order]
        first = np.searchsorted(row, touched)
        take = first[:, None] + np.arange(k)
        self.score[lists[touched]], self.id[lists[touched]] = new[take], who[take]


def _pieces(lo: int, hi: int) -> Iterator[slice]:
    for at in range(lo, hi, PANEL):
        yield slice(at, min(at + PANEL, hi))


def add_positives(best: Best, slab: Block, block: Block) -> None:
    """Offer each anchor the other rows of its label."""
    for i, name in enumerate(slab.names):
        j = np.searchsorted(block.names, name)
        if j == len(block.names) or block.names[j] != name:
            continue
        own = slice(slab.first[i], slab.first[i + 1])
        for cols in _pieces(block.first[j], block.first[j + 1]):
            score = products(slab.rows, block.rows, own, cols)
            score[slab.ids[own, None] == block.ids[cols]] = _NONE
            best.add(np.arange(own.start, own.stop), score, block.ids[cols])


def add_negatives(best: Best, low: np.ndarray, high: np.ndarray, slab: Block, block: Block) -> None:
    """Offer each window, of which each anchor has as many as ``low`` has columns, the rows of other labels in it."""
    n = low.shape[1]
    for cols in _pieces(0, len(block.ids)):
        score = products(slab.rows, block.rows, slice(None), cols)
        other = slab.labels[:, None] != block.labels[cols]
        for j in range(n):
            lists = np.arange(len(slab.ids)) * n + j
            floor = np.maximum(low[:, j], best.score[lists, -1])
            inside = other & (score <= high[:, j, None]) & (score >= floor[:, None])
            some = np.flatnonzero(inside.any(1))
            if len(some):
                best.add(lists[some], np.where(inside[some], score[some], _NONE), block.ids[cols])


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, least: tuple[int, int] = (80, 100), scale: float = 256.0) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Both tables have (id, label, vector). Components count as floor(scale * x). Of each
    anchor's ``positives`` best rows of its label, the ``negatives`` best rows of other
    labels with least[0] * positive_score <= least[1] * score <= least[1] * positive_score.
    """
    spark = vectors.sparkSession
    good = lambda d: d.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<double>").alias("vector"))
    here = cluster.scratch(spark, "negatives")
    blocks = write_blocks(good(vectors), f"{here}/rows", BLOCK, scale)
    asked = cluster.cut(good(anchors).dropDuplicates(["id", "label", "vector"]))
    slabs = write_blocks(asked.repartition(max(1, math.ceil(asked.count() / SLAB))), f"{here}/anchors", SLAB, scale)
    slabs = cluster.cut(slabs.select(F.monotonically_increasing_id().alias("slab"), F.col("path").alias("anchors"), "width"))

    # Lists of blocks: no longer than LISTED, and enough of them for all cores.
    n_blocks, n_slabs = blocks.count(), slabs.count()
    lists = max(1, math.ceil(n_blocks / LISTED), min(n_blocks, math.ceil(2 * spark.sparkContext.defaultParallelism / max(1, n_slabs))))
    listed = blocks.groupBy("width", F.pmod(F.xxhash64("path"), F.lit(lists)).alias("part")).agg(F.collect_list("path").alias("rows"))  # LISTED paths, about
    work = listed.join(slabs, "width")
    tasks = max(1, min(lists * n_slabs, 1 << 17))

    def blocks_of(rows: pa.Scalar) -> Iterator[Block]:
        store, _ = cluster.open_folder(here)
        for path in rows.as_py():
            yield Block(store, path)

    def near(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = cluster.open_folder(here)
        for batch in it:
            for slab, path, rows in zip(*(batch.column(i) for i in range(3))):
                a = Block(store, path.as_py())
                best = Best(len(a.ids), positives)
                for b in blocks_of(rows):
                    add_positives(best, a, b)
                at, col = np.nonzero(best.score != _NONE)
                yield pa.RecordBatch.from_pydict({"slab": pa.array([slab.as_py()] * len(at), pa.int64()), "at": pa.array(at, pa.int32()), "id": best.id[at, col], "score": best.score[at, col]})

    found = work.select("slab", "anchors", "rows").repartition(tasks).mapInArrow(near, "slab long, at int, id long, score long")
    order = Window.partitionBy("slab", "at").orderBy(F.desc("score"), F.asc("id"))
    first = found.withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= positives)
    # A row a slab: its anchors' positives, SLAB * positives of them at most.
    first = cluster.cut(first.groupBy("slab").agg(F.collect_list(F.struct("at", "turn", "id", "score")).alias("first")))

    def hard(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = cluster.open_folder(here)
        for batch in cluster.batches(it, 1):
            slab, path, rows, have = (batch.column(i)[0] for i in range(4))
            a = Block(store, path.as_py())
            at, turn, who, score = (have.values.field(i).to_numpy() for i in range(4))
            low, high = np.full((len(a.ids), positives), _FAR), np.full((len(a.ids), positives), _NONE)
            name = np.zeros((len(a.ids), positives), np.int64)
            # In Python's integers: a score times least[0] may need more than 64 bits.
            low[at, turn - 1] = [-(-int(s) * least[0] // least[1]) for s in score]
            high[at, turn - 1], name[at, turn - 1] = score, who
            best = Best(low.size, negatives)
            for b in blocks_of(rows):
                add_negatives(best, low, high, a, b)
            i, col = np.nonzero(best.score != _NONE)
            yield pa.RecordBatch.from_pydict(
                {"slab": pa.array([slab.as_py()] * len(i), pa.int64()), "list": pa.array(i, pa.int32()), "anchor_id": a.ids[i // positives], "positive_id": name.ravel()[i], "positive_score": high.ravel()[i], "negative_id": best.id[i, col], "negative_score": best.score[i, col]}
            )

    schema = "slab long, list int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    found = work.join(first, "slab").select("slab", "anchors", "rows", "first").repartition(tasks).mapInArrow(hard, schema)
    order = Window.partitionBy("slab", "list").orderBy(F.desc("negative_score"), F.asc("negative_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
