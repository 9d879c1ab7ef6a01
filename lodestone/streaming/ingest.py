"""Streaming ingest: pages that arrive are chunked and replace what their URLs had."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from lodestone.operators.ingest import crawled_pages, first_wins


def ingest_pages(pages: DataFrame, target: str, checkpoint: str, size: int = 5000, buckets: int = 64) -> StreamingQuery:
    """Chunk a stream of (url, markdown) into a Parquet table, replacing by URL.

    The table is cut into ``buckets`` by URL. A batch writes new versions of the buckets
    that its URLs are in and then, as one small table of (bucket, version), what is
    current; so a batch that is repeated gives the same table, and other buckets are not
    rewritten. Of several rows of a URL in a batch, the one of the largest text counts.
    """
    spark = pages.sparkSession
    bucket = F.pmod(F.xxhash64("url"), F.lit(buckets)).cast("int")

    def replace(batch: DataFrame, epoch: int) -> None:
        once = first_wins(batch, ["url"], F.desc(F.struct(F.length("markdown"), "markdown")))
        new = crawled_pages(once, size).withColumn("bucket", bucket)
        touched = once.select(bucket.alias("bucket")).distinct()
        current = _current(spark, target, epoch)
        if current is not None:
            old = _rows(spark, target, current.join(touched, "bucket", "left_semi"), new)
            urls = once.select("url")
            new = old.join(urls, "url", "left_anti").select(*new.columns).unionByName(new)
            touched = touched.withColumn("version", F.lit(epoch).cast("long")).unionByName(current.join(touched, "bucket", "left_anti").select("bucket", "version"))
        else:
            touched = touched.withColumn("version", F.lit(epoch).cast("long"))
        new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/rows/version={epoch}")
        touched.coalesce(1).write.mode("overwrite").parquet(f"{target}/current/version={epoch}")  # a row a bucket

    return pages.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, where: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _current(spark: SparkSession, target: str, before: int) -> DataFrame | None:
    """(bucket, version) as the last whole batch before an epoch left it."""
    for epoch in range(before - 1, -1, -1):
        if _exists(spark, f"{target}/current/version={epoch}/_SUCCESS"):
            return spark.read.parquet(f"{target}/current/version={epoch}")
    return None


def _rows(spark: SparkSession, target: str, current: DataFrame, like: DataFrame) -> DataFrame:
    schema = StructType([*like.schema.fields, StructField("version", LongType())])
    rows = spark.read.schema(schema).parquet(f"{target}/rows")  # version and bucket are folders
    return rows.join(F.broadcast(current), ["bucket", "version"], "left_semi").select(*like.columns)  # a row a bucket


def current_pages(spark: SparkSession, target: str, batches: int, schema: StructType) -> DataFrame:
    """The chunk table that a stream of so many batches has left in a folder; schema: that of crawled_pages."""
    current = _current(spark, target, batches)
    like = spark.createDataFrame([], StructType([*schema.fields, StructField("bucket", IntegerType())]))
    return (like if current is None else _rows(spark, target, current, like)).drop("bucket")


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Rows of each key and window of a stream; later rows than ``late`` are not counted."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select("w.start", key, "n")
