"""Shared folders, materialised tables and connected components.

Driver and executors share only the folder in ``spark.checkpoint.dir``, the warehouse
and the inputs. Files that Python writes go to that folder through ``pyarrow.fs``, so
any store with an Arrow file system works; lineage is cut with ``checkpoint()`` or a
Parquet table there.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only where that is unset and all runs on one machine, a local folder of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = known.get() if known.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: driver and executors need a folder that all of them see")
        where = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(where)
    elif not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return where if "://" in where or where.startswith("file:") else "file://" + where


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow file system and path of a folder URI."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


_made: list[str] = []  # scratch folders that are still there


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for one run of an operator, removed by ``released`` or when the driver's Python ends."""
    uri = f"{shared_folder(spark)}/lodestone/{name}-{uuid.uuid4().hex[:12]}"
    _made.append(uri)
    return uri


def _remove(uris: list[str]) -> None:
    for uri in uris:
        _made.remove(uri)
        with suppress(OSError):
            store, path = open_folder(uri)
            store.delete_dir(path)


@atexit.register
def _remove_all() -> None:
    _remove(list(_made))


def released(df: DataFrame, name: str, since: int) -> DataFrame:
    """``df`` saved; the scratch folders made after the first ``since`` that it was made from are removed."""
    out = saved(df, name)
    _remove(_made[since:-1])
    return out


def made() -> int:
    """How many scratch folders there are, for ``released``."""
    return len(_made)


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared folder; cuts its lineage."""
    spark = df.sparkSession
    uri = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(uri)
    return spark.read.schema(df.schema).parquet(uri)


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder, for tables of a few columns."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest node of each node's connected component.

    edges: (a, b) of one comparable type; loops and repeats are allowed. Returns
    (node, component) for each node of an edge with another node; edges with a null end
    are left out. Alternates the large-star and small-star steps until no edge changes;
    each step is one aggregation with partial minima and one join with its result. The
    neighbours of a node meet in no group; where a hub has a large part of all edges,
    adaptive execution splits its side of the join.
    """
    e = cut(edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        e = cut(small.filter("a <> b").distinct())
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components() has not settled")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def by_position(df: DataFrame) -> DataFrame:
    """The rows with columns c0, c1, ...: names that clash, differ in case or hold dots play no part."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def at(df: DataFrame, name: str) -> Column:
    """A column of ``df`` as ``by_position`` names it: that of this very name, else of this name in any case."""
    if name not in df.columns:
        name = {c.lower(): c for c in reversed(df.columns)}[name.lower()]
    return F.col(f"c{df.columns.index(name)}")


def texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id long, text string) of a table of documents, whatever its other columns are called."""
    return by_position(docs).select(at(docs, id_column).cast("long").alias("doc_id"), at(docs, text_column).cast("string").alias("text"))


def seats(spark: SparkSession, n: int) -> list[int]:
    """n keys that hash partitioning into n partitions deals to one partition each."""
    rows = spark.range(32 * n + 64).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p")).groupBy("p").agg(F.min("id").alias("id")).collect()  # n rows
    free = {r["p"]: r["id"] for r in rows}
    return [free.get(p, p) for p in range(n)]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) where they differ, for edges among n nodes."""
    low = np.arange(n)
    while len(a):
        before = low.copy()
        m = np.minimum(low[a], low[b])
        np.minimum.at(low, a, m)
        np.minimum.at(low, b, m)
        low = low[low]
        if np.array_equal(low, before):
            break
    out = np.flatnonzero(low != np.arange(n))
    return out, low[out]


def batches(arrays: Iterator, size: int) -> Iterator:
    """Record batches in slices of at most ``size`` rows."""
    for batch in arrays:
        for lo in range(0, batch.num_rows, size):
            yield batch.slice(lo, size)


def key_set(keys: DataFrame, n: int) -> np.ndarray:
    """A bit set of a table of one long column: 16 bits a key of the ``n`` expected, at most 2 ** 26 bits.

    Tasks' sets are combined slice by slice. Membership may be wrong for keys that are
    not there, so it only spares rows an exchange; a join decides.
    """
    bits, slices = 1 << min(26, max(16, int(16 * max(n, 1)).bit_length())), 16

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros(bits, bool)
        for batch in it:
            have[batch.column(0).to_numpy().view(np.uint64) % np.uint64(bits)] = True
        if have.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([p.tobytes() for p in np.packbits(have).reshape(slices, -1)], pa.binary())], ["slice", "bits"])

    def merge(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint8) for x in table.column("bits").to_pylist()]
        return pa.table({"slice": table.column("slice")[:1], "bits": pa.array([np.bitwise_or.reduce(parts).tobytes()], pa.binary())})

    out = np.zeros((slices, bits // slices // 8), np.uint8)
    for r in keys.mapInArrow(run, "slice int, bits binary").groupBy("slice").applyInArrow(merge, "slice int, bits binary").collect():
        out[r["slice"]] = np.frombuffer(r["bits"], np.uint8)  # 16 rows of together ``bits`` bits
    return out.reshape(-1)


def in_set(packed: np.ndarray, keys: np.ndarray) -> np.ndarray:
    i = keys.view(np.uint64) % np.uint64(len(packed) * 8)
    return (packed[i >> np.uint64(3)] >> (np.uint64(7) - (i & np.uint64(7))).astype(np.uint8)) & 1 > 0


def select_rows(df: DataFrame, packed, member: bool) -> DataFrame:
    """Rows whose first column, a long key, is (or is not) in a broadcast bit set."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            at = np.flatnonzero(in_set(packed.value, batch.column(0).to_numpy()) == member)
            if len(at) == batch.num_rows:
                yield batch
            elif len(at):
                yield batch.take(pa.array(at))

    return df.mapInArrow(run, df.schema)
