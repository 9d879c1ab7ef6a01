"""An offline embedder: latent factors of the term-document matrix.

Rows of tf * idf weights, of unit length, are a sparse matrix A of texts and words, which
lies in tiles (``sparse``). Its k leading factors are found by block power iteration: the
products A V and A' U are a pass over the tiles each; between them the block is made
orthonormal by a k by k matrix, which with the k by k products is all that the driver ever
holds, and which is applied where the block is read. The start is a hash of each word, so
a fit is reproduced exactly in law and up to rounding in numbers.

A text's embedding is its row times the factors, of unit length; new texts are embedded
by the words that the fit knows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import sparse
from lodestone.operators.text_index import counted, words_of
from lodestone.sources.scratch import dropped, kept


@dataclass
class Latent:
    """words: (word, idf, v0, ..., v<k-1>); strength: the leading singular values, largest first; texts: (id, embedding) of the texts fitted on."""

    words: DataFrame
    k: int
    strength: list[float]
    texts: DataFrame

    def embed(self, rows: DataFrame, text: str, id_column: str = "id") -> DataFrame:
        """(id, embedding array<double>) of each row; null where it has no known word."""
        t = _counted(rows, text, id_column).join(self.words.hint("merge"), "word").withColumn("x", F.col("tf") * F.col("idf"))
        return rows.select(F.col(id_column).alias("id")).join(self._unit(t).hint("merge"), "id", "left")

    def fitted(self) -> DataFrame:
        """(id, embedding) of the texts fitted on that have a known word, without counting their words again."""
        return self.texts

    def _unit(self, t: DataFrame) -> DataFrame:
        sums = t.groupBy("id").agg(*(F.sum(F.col("x") * F.col(f"v{i}")).alias(f"v{i}") for i in range(self.k)))
        length = F.sqrt(sum((F.col(f"v{i}") * F.col(f"v{i}") for i in range(self.k)), F.lit(0.0)))
        return sums.select("id", F.when(length > 0, F.array(*(F.col(f"v{i}") / length for i in range(self.k)))).alias("embedding"))


def _split(rows: DataFrame, text: str, id_column: str) -> DataFrame:
    """(id, w): a word is a 64-bit hash."""
    return rows.select(F.col(id_column).cast("long").alias("id"), F.transform(words_of(F.coalesce(F.col(text), F.lit(""))), lambda w: F.xxhash64(w)).alias("w"))


def _counted(rows: DataFrame, text: str, id_column: str) -> DataFrame:
    """(id, word, tf), counted within rows."""
    return counted(_split(rows, text, id_column)).select("id", F.inline("terms"))


def weights(rows: DataFrame, text: str, k: int, id_column: str = "id", least_rows: int = 2) -> sparse.Matrix:
    """The matrix with rows of unit length, for blocks of k columns; words of fewer than ``least_rows`` rows are left out."""
    terms = counted(_split(rows, text, id_column))
    n = terms.filter(F.size("terms") > 0).count()
    df = terms.select(F.explode("terms.word").alias("word")).groupBy("word").agg(F.count("*").alias("df")).filter(F.col("df") >= least_rows)
    idf = kept(df.select("word", F.log((F.lit(n) + 1) / (F.col("df") + 1)).alias("weight")).filter("weight > 0"), "idf")
    made = sparse.built(terms, idf, k)
    for used in (terms, idf):
        dropped(used)
    return made


def _start(word: np.ndarray, i: int) -> np.ndarray:
    """Numbers from -1 to 1: ``xxhash64(word, i)`` of Spark."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))

    def mixed(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))

    with np.errstate(over="ignore"):
        h = (np.uint64(42) + p5 + np.uint64(8)) ^ (turned(word.view(np.uint64) * p2, 31) * p1)
        h = mixed(turned(h, 27) * p1 + p4)
        h = (h + p5 + np.uint64(4)) ^ (np.uint64(i) * p1)
        h = mixed(turned(h, 23) * p2 + p3)
    return h.view(np.int64) % 2_000_003 / 1_000_001.0 - 1.0


def fit(rows: DataFrame, text: str, k: int = 16, rounds: int = 6, id_column: str = "id", least_rows: int = 2) -> Latent:
    """The k leading factors of a table of texts."""
    a = weights(rows, text, k, id_column, least_rows)
    block, mix = None, np.eye(k)

    def said(s: int, words: np.ndarray) -> np.ndarray:
        return np.stack([_start(words, i) for i in range(k)], 1) if block is None else block.block(s) @ mix

    for _ in range(rounds):
        texts = a.by_rows(said, k)
        before, block = block, a.by_words(lambda b, n: texts.block(b), k)  # noqa: B023
        for used in (texts, *([before] if before else [])):
            dropped(used.uri)
        values, vectors = np.linalg.eigh(block.gram())
        # Columns of no length beside the largest are left at nothing: the matrix has fewer factors.
        scale = np.where(values > 1e-12 * max(values.max(initial=0.0), 1e-300), 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0)
        mix = (vectors * scale)[:, ::-1]
    # Turned within the space that was found, so that the columns are the factors, strongest first, with a sign that does not depend on the way.
    texts = a.by_rows(said, k)
    values, vectors = np.linalg.eigh(texts.gram())
    turn = vectors[:, ::-1]
    slabs = list(range(a.slabs))

    def cubes(s: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"x": pa.array([(said(s, sparse.words_in(a.words, s)[0]) @ turn).__pow__(3).sum(0).tolist()], pa.list_(pa.float64()))})

    sign = sum((np.array(r["x"]) for r in sparse.over(a.spark, slabs, cubes, "x array<double>").collect()), np.zeros(k))  # k numbers a slab
    turn = turn * np.where(sign < 0, -1.0, 1.0)

    def words(s: int) -> pa.RecordBatch:
        word, idf = sparse.words_in(a.words, s)
        x = said(s, word) @ turn
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (word, idf, *x.T)], ["word", "idf", *(f"v{i}" for i in range(k))])

    def embedded(b: int) -> pa.RecordBatch:
        ids, _, square, _ = a.rows(b)
        x = texts.block(b) @ turn
        length = np.sqrt((x * x).sum(1))
        there = np.flatnonzero(square > 0)
        unit = (x / np.where(length > 0, length, 1.0)[:, None])[there]
        made = pa.ListArray.from_arrays(pa.array(np.arange(len(there) + 1) * k, pa.int32()), pa.array(unit.ravel()), mask=pa.array(length[there] == 0))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(there)), made], ["id", "embedding"])

    columns = ", ".join(f"v{i} double" for i in range(k))
    factors = sparse.over(a.spark, slabs, words, f"word long, idf double, {columns}")
    return Latent(factors, k, np.sqrt(np.maximum(values[::-1], 0)).tolist(), sparse.over(a.spark, a.blocks, embedded, "id long, embedding array<double>"))


def embedder(model: Latent):
    """A hook for ``ingest.code_store`` and the like: adds ``embedding`` to rows by the text of one of their columns."""

    def embed(rows: DataFrame, text: str) -> DataFrame:
        keyed = rows.withColumn("_text_id", F.xxhash64(text))
        made = model.embed(keyed.select("_text_id", text).dropDuplicates(["_text_id"]), text, "_text_id").withColumnRenamed("id", "_text_id")
        return keyed.join(made, "_text_id", "left").drop("_text_id")

    return embed


def similarity(a: Column, b: Column) -> Column:
    """Inner product of two embeddings."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
