"""A sparse matrix of rows and words as tiles of the shared folder, and its products with dense blocks of few columns.

A term stays with the task that reads its row. Words are dealt into slabs by ranges of
their 64-bit hashes, rows into blocks as they lie; a tile has the terms of a block and a
slab. A product is a task for each block, or each slab, that goes through its tiles and
through the dense blocks of the other side, one at a time: no term and no sum by term is
shuffled, what is written is the dense result, and a task holds two dense blocks and a
tile, however large the matrix is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.scratch import columns_of, parted, rows_of

LIMIT = 1 << 20  # numbers of a dense block, about
TERMS = 1 << 20  # terms of a tile that are taken at once
PLACED = 1 << 21  # terms that are looked up at once
CACHED = 1 << 21  # words that a task holds while it looks terms up, at least a slab

_WORDS = pa.schema([("word", pa.int64()), ("weight", pa.float64())])
_TILE = "b long, s int, ids array<long>, groups array<long>, at binary, word binary, tf binary"


def _slab(word, slabs: int):
    """The slab of a word, by the upper half of its hash."""
    if isinstance(word, Column):
        return F.shiftright((F.shiftright(word, 32) + F.lit(1 << 31)) * F.lit(slabs).cast("long"), 32).cast("int")
    return ((word >> 32) + (1 << 31)) * slabs >> 32


def words_in(folder: str, s: int) -> tuple[np.ndarray, np.ndarray]:
    """In a task: the words of a slab, sorted, and their weights."""
    t = columns_of(f"{folder}/s={s}", _WORDS)
    return t.column("word").to_numpy(), t.column("weight").to_numpy()


@dataclass
class Dense:
    """A dense block of ``width`` columns for each key: in the folder ``key=<key>``, with the products of its columns."""

    uri: str
    width: int
    spark: SparkSession

    def block(self, key: int) -> np.ndarray:
        """In a task."""
        for (data,) in rows_of(f"{self.uri}/key={key}", "data"):
            return np.frombuffer(data.as_py(), "<f8").reshape(-1, self.width)
        return np.zeros((0, self.width))

    def gram(self) -> np.ndarray:
        """The width by width products of all columns."""
        parts = self.spark.read.schema("gram binary").parquet(self.uri).collect()  # one of width * width numbers a block
        return sum((np.frombuffer(r["gram"], "<f8").reshape(self.width, -1) for r in parts), np.zeros((self.width, self.width)))

    def __getstate__(self):
        return {"uri": self.uri, "width": self.width, "spark": None}


def over(spark: SparkSession, keys: list[int], made: Callable[[int], pa.RecordBatch], schema: str) -> DataFrame:
    """What is made of each key, a task for each."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in batch.column(0).to_pylist():
                yield made(keys[i])

    return spark.range(0, len(keys), 1, max(1, len(keys))).mapInArrow(run, schema)


@dataclass
class Matrix:
    """tiles: folders b=<block>/s=<slab>, of which s=-1 has the rows of a block; words: folders s=<slab>.

    A number of the matrix is tf * weight of a word, divided by the length of its row.
    """

    tiles: str
    words: str
    blocks: list[int]
    slabs: int
    spark: SparkSession

    def __getstate__(self):
        return self.__dict__ | {"spark": None}

    def rows(self, b: int) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
        """In a task: the ids and groups of a block's rows, the squares of their lengths, and the part that words outside of the matrix have in these."""
        for ids, groups, square, own in rows_of(f"{self.tiles}/b={b}/s=-1", "ids", "groups", "at", "word"):
            return ids.values, groups.values, *(np.frombuffer(x.as_buffer(), "<f8") for x in (square, own))
        raise FileNotFoundError(f"{self.tiles}/b={b}/s=-1")

    def _tile(self, b: int, s: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, word, tf) of a tile, in parts of bounded size."""
        held, n = [], 0
        for part in rows_of(f"{self.tiles}/b={b}/s={s}", "at", "word", "tf"):
            at, word, tf = (np.frombuffer(x.as_buffer(), "<u4") for x in part)
            held.append((np.cumsum(at, dtype=np.int64), word.astype(np.int64), tf.astype(np.float64)))
            n += len(at)
            if n >= TERMS:
                yield tuple(map(np.concatenate, zip(*held)))
                held, n = [], 0
        if held:
            yield tuple(map(np.concatenate, zip(*held)))

    def _written(self, keys: list[int], made: Callable[[int], np.ndarray], width: int, name: str) -> Dense:
        def row(key: int) -> pa.RecordBatch:
            x = np.ascontiguousarray(made(key), "<f8")
            return pa.RecordBatch.from_pydict({"key": [key], "data": [x.tobytes()], "gram": [(x.T @ x).tobytes()]})

        return Dense(parted(over(self.spark, keys, row, "key long, data binary, gram binary"), name, "key"), width, self.spark)

    def by_rows(self, block: Callable[[int, np.ndarray], np.ndarray], width: int, plus: Callable[[int, int], np.ndarray] | None = None) -> Dense:
        """The matrix times a dense block, given by slab and words.

        ``plus``: numbers of the rows, by block and number of rows, which words outside of
        the matrix, each of one row, say to that row again.
        """

        def made(b: int) -> np.ndarray:
            _, _, square, own = self.rows(b)
            scale = np.where(square > 0, 1 / np.sqrt(np.where(square > 0, square, 1.0)), 0.0)
            total = np.zeros((width, len(square)))
            for s in range(self.slabs):
                x = None
                for at, word, tf in self._tile(b, s):
                    if x is None:
                        known, weight = words_in(self.words, s)
                        x = np.ascontiguousarray((block(s, known) * weight[:, None]).T)
                    for i in range(width):
                        total[i] += np.bincount(at, tf * x[i][word], len(square))
            if plus is not None:
                total += own * scale * plus(b, len(square)).T
            return (total * scale).T

        return self._written(self.blocks, made, width, "of-rows")

    def by_words(self, rows: Callable[[int, int], np.ndarray], width: int) -> Dense:
        """The transpose times a dense block, given by block and number of rows."""

        def made(s: int) -> np.ndarray:
            known, weight = words_in(self.words, s)
            total = np.zeros((width, len(known)))
            for b in self.blocks:
                x = None
                for at, word, tf in self._tile(b, s):
                    if x is None:
                        square = self.rows(b)[2]
                        x = np.ascontiguousarray((rows(b, len(square)) / np.sqrt(np.where(square > 0, square, 1.0))[:, None]).T)
                    for i in range(width):
                        total[i] += np.bincount(word, tf * x[i][at], len(known))
            return (total * weight).T

        return self._written(list(range(self.slabs)), made, width, "of-words")


def built(terms: DataFrame, words: DataFrame, width: int) -> Matrix:
    """The matrix of (id, terms array<struct<word long, tf long>>), a row for each id, and (word, weight), for dense blocks of ``width`` columns.

    ``terms`` may have ``group``, a number kept with each row, and ``alone``, the weight of
    words that are not in ``words``; these count in a row's length only. Both tables are
    read twice.
    """
    spark = terms.sparkSession
    rows, found = terms.count(), words.count()
    tasks = 2 * spark.sparkContext.defaultParallelism
    most = max(1, LIMIT // width)
    slabs = max(1, -(-found // most), min(tasks, -(-found // 4096)))
    size = min(most, max(1024, -(-rows // tasks)))
    folder = parted(words.select("word", "weight").withColumn("s", _slab(F.col("word"), slabs)).repartition("s").sortWithinPartitions("s", "word"), "words", "s")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(max(1, CACHED * slabs // max(1, found)))(lambda s: words_in(folder, s))
        names = ["b", "s", "ids", "groups", "at", "word", "tf"]
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
        b, held, ids, groups, waiting, n = TaskContext.get().partitionId() << 20, [], [], [], 0, 0
        square, own, alone = np.zeros((3, size))

        def batch_of(made: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([c[0] if isinstance(c[0], pa.Array) else pa.array(c, kind) for c, kind in zip(zip(*made), kinds)], names)

        def listed(parts: list[pa.Array]) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.concat_arrays(parts))

        def placed() -> list[tuple]:
            made = []
            word, tf, at = map(np.concatenate, zip(*held))
            held.clear()
            s = _slab(word, slabs).astype(np.uint16 if slabs < 1 << 16 else np.int64)
            order = np.argsort(s, kind="stable")
            edge = np.searchsorted(s[order], np.arange(slabs + 1))
            for i in range(slabs):
                here = order[edge[i] : edge[i + 1]]
                if not len(here):
                    continue
                w, t, r = word[here], tf[here].astype(np.float64), at[here].astype(np.int64)
                k, weight = known(i)
                place = np.minimum(np.searchsorted(k, w), max(len(k) - 1, 0))
                hit = k[place] == w if len(k) else np.zeros(len(w), bool)
                lost = ~hit
                if lost.any():
                    own[:] += np.bincount(r[lost], (t[lost] * alone[r[lost]]) ** 2, size)
                if hit.any():
                    r, place, t = r[hit], place[hit], t[hit]
                    square[:] += np.bincount(r, (t * weight[place]) ** 2, size)
                    made.append((b, i, None, None, np.diff(r, prepend=0).astype("<u4").tobytes(), place.astype("<u4").tobytes(), t.astype("<u4").tobytes()))
            return made

        def ended() -> tuple:
            row = (b, -1, listed(ids), listed(groups), (square + own)[:n].tobytes(), own[:n].tobytes(), None)
            for x in (square, own, alone):
                x[:] = 0
            ids.clear(), groups.clear()
            return row

        for batch in it:
            offsets, lo = batch.column(1).offsets.to_numpy(), 0
            values = batch.column(1).values
            while lo < batch.num_rows:
                hi = min(batch.num_rows, lo + size - n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + PLACED - waiting, "right")) - 1))
                part = values.slice(offsets[lo], offsets[hi] - offsets[lo])
                at = np.repeat(np.arange(n, n + hi - lo, dtype=np.uint32), np.diff(offsets[lo : hi + 1]))
                held.append((part.field(0).to_numpy().copy(), part.field(1).to_numpy().astype(np.uint32), at))
                for column, to in ((0, ids), (3, groups)):
                    to.append(batch.column(column).take(pa.array(np.arange(lo, hi))))  # a copy: a slice holds its batch
                alone[n : n + hi - lo] = batch.column(2).slice(lo, hi - lo).to_numpy()
                waiting, n, lo = waiting + len(part), n + hi - lo, hi
                if waiting >= PLACED or n == size:
                    if made := placed():
                        yield batch_of(made)
                    waiting = 0
                if n == size:
                    yield batch_of([ended()])
                    b, n = b + 1, 0
        if held and (made := placed()):
            yield batch_of(made)
        if n:
            yield batch_of([ended()])

    given = [F.col(c) if c in terms.columns else F.lit(None if c == "group" else 0.0).cast(kind).alias(c) for c, kind in (("alone", "double"), ("group", "long"))]
    # As many tasks as blocks, not as many blocks as tasks.
    tiles = parted(terms.select("id", "terms", *given).coalesce(max(1, -(-rows // size))).mapInArrow(run, _TILE), "tiles", "b", "s")
    blocks = spark.read.schema(_TILE).parquet(tiles).filter("s = -1").select("b").collect() if rows else []
    return Matrix(tiles, folder, sorted(r["b"] for r in blocks), slabs, spark)
