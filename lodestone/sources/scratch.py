"""Tables that a plan needs more than once, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEW = 100_000  # narrow rows that the driver may hold

_made: list[tuple] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where that is unset and all runs on one machine, a folder of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = known.get() if known.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: driver and executors need a folder that all of them see")
        where = "file://" + tempfile.mkdtemp(prefix="lodestone-core-")
        spark.sparkContext.setCheckpointDir(where)
    return where if "://" in where or where.startswith("file:") else "file://" + where


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a Parquet table of this session: made once, whatever is lost or reads it again."""
    return df.sparkSession.read.schema(df.schema).parquet(parted(df, name))


def parted(df: DataFrame, name: str, *by: str) -> str:
    """As ``kept``, with a folder for each value of ``by``, which tasks in Python read with ``rows_of`` and ``columns_of``; where it lies."""
    spark = df.sparkSession
    uri = f"{shared_folder(spark)}/lodestone-core/{name}-{uuid.uuid4().hex[:12]}"
    df.write.partitionBy(*by).option("compression", "zstd").parquet(uri)
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    _made.append((path.getFileSystem(spark._jsc.hadoopConfiguration()), path, uri))
    return uri


def dropped(table: DataFrame | str) -> None:
    """Removes a table of ``kept`` or ``parted`` that nothing reads any more."""
    name = table if isinstance(table, str) else next(iter(table.inputFiles()), "").rsplit("/", 1)[0]
    for made in [x for x in _made if name and x[2].rsplit("/", 1)[1] == name.rsplit("/", 1)[1]]:
        made[0].delete(made[1], True)
        _made.remove(made)


def _files(uri: str) -> Iterator[pa.NativeFile]:
    store, path = (fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")) if uri.startswith("file:") else fs.FileSystem.from_uri(uri)
    for f in sorted(store.get_file_info(fs.FileSelector(path, allow_not_found=True)), key=lambda f: f.path):
        if f.base_name.endswith(".parquet") and not f.base_name.startswith(("_", ".")):
            with store.open_input_file(f.path) as file:
                yield file


def rows_of(uri: str, *columns: str) -> Iterator[list[pa.Scalar]]:
    """In a task: the rows of one folder, one at a time."""
    for file in _files(uri):
        for batch in pq.ParquetFile(file).iter_batches(1, columns=list(columns)):
            yield [batch.column(c)[0] for c in columns]


def columns_of(uri: str, schema: pa.Schema) -> pa.Table:
    """In a task: all rows of one folder."""
    return pa.concat_tables([schema.empty_table(), *(pq.ParquetFile(file).read(schema.names).cast(schema) for file in _files(uri))]).combine_chunks()


def looked_up(small: DataFrame) -> DataFrame:
    """The smaller side of a join, a kept table of narrow rows: broadcast if it has few, else hashed partition by partition.

    What a planner takes a Parquet table for is its compressed size, so the larger side, unhinted, may be broadcast though it is ten times that.
    """
    return F.broadcast(small) if small.limit(FEW + 1).count() <= FEW else small.hint("shuffle_hash")


@atexit.register
def _remove() -> None:
    for store, path, _ in _made:
        try:
            store.delete(path, True)
        except Exception:  # noqa: BLE001  the session may have ended before
            return
