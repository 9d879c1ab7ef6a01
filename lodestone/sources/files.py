"""Source trees and pages as DataFrames."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

# Folders and names that are not analysed.
SKIPPED_PYTHON = ("__pycache__", "test", "tests")
SKIPPED_TYPESCRIPT = ("__pycache__", "test", "tests", "__tests__")
SKIPPED_ANY = (".git", "node_modules", "__pycache__", ".next", "dist", "build")
SKIPPED_SUFFIXES = (".pyc", ".pyo", ".log", ".tmp", ".cache")
CONFIG_FILES = ("webpack.config.js", "vite.config.ts", "next.config.js", "tailwind.config.js", "jest.config.js", "babel.config.js")
MAX_BYTES = 500_000


def _below(path: Column, root: str) -> Column:
    """A path from below the root on; what the root itself is called plays no part."""
    plain = lambda x: F.regexp_replace(x, "^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "")
    top = plain(F.lit(root.rstrip("/") + "/"))
    bare = plain(path)
    return F.when(bare.startswith(top), F.substring(bare, F.length(top) + 1, F.length(bare))).otherwise(bare)


def _folders(path: Column) -> Column:
    return F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)


def _visible(path: Column, skipped: tuple[str, ...]) -> Column:
    """Under src/, and in no hidden or skipped folder below that."""
    inside = F.slice(_folders(path), 2, F.greatest(F.size(_folders(path)) - 1, F.lit(0)))
    return path.startswith("src/") & ~F.exists(inside, lambda p: p.startswith(".") | p.isin(*skipped))


def is_python_source(path: Column, size: Column) -> Column:
    """Whether a path below a repository's root is a Python file to analyse."""
    name = F.element_at(F.split(path, "/"), -1)
    test = name.startswith("test") | name.endswith("_test.py") | name.endswith("_tests.py") | name.endswith("test_.py")
    return _visible(path, SKIPPED_PYTHON) & name.endswith(".py") & ~test & (size < MAX_BYTES)


def is_typescript_source(path: Column, size: Column) -> Column:
    """Whether a path below a repository's root is a TypeScript or JavaScript file to analyse."""
    name = F.element_at(F.split(path, "/"), -1)
    return _visible(path, SKIPPED_TYPESCRIPT) & name.rlike(r"\.[jt]sx?$") & ~name.startswith("test") & ~name.rlike(r"\.(test|spec)\.[jt]sx?$") & ~name.isin(*CONFIG_FILES) & (size < MAX_BYTES)


def is_kept_file(path: Column) -> Column:
    """Whether a whole-tree scan keeps a path below the root: no skipped folder, no skipped suffix."""
    name = F.element_at(F.split(path, "/"), -1)
    suffix = F.when(F.substring(name, 2, 1 << 30).contains("."), F.concat(F.lit("."), F.substring_index(name, ".", -1))).otherwise("")
    return ~F.exists(_folders(path), lambda p: p.isin(*SKIPPED_ANY)) & ~suffix.isin(*SKIPPED_SUFFIXES)


def source_tree(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, length, content) of the files of a tree, paths from below the root on."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select(_below(F.col("path"), root).alias("path"), "length", F.col("content").cast("string").alias("content"))


def package_files(spark: SparkSession, root: str, most: int = 16) -> DataFrame:
    """As source_tree, the ``__init__.py`` files of a tree down to a depth, which Spark's own listing takes for hidden."""
    from pyarrow import fs

    jvm = spark._jvm.org.apache.hadoop.fs
    found = []
    for depth in range(most + 1):
        pattern = jvm.Path(f"{root.rstrip('/')}/{'*/' * depth}__init__.py")
        found += [x.getPath().toString() for x in pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            raw = []
            for uri in batch.column(0).to_pylist():
                store, path = (fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")) if uri.startswith("file:") else fs.FileSystem.from_uri(uri)
                with store.open_input_stream(path) as f:
                    raw.append(f.read())
            text = [x.decode("utf-8", "replace") for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array(text, pa.string())], ["path", "length", "content"])

    rows = spark.createDataFrame([(x,) for x in found], "path string").mapInArrow(run, "path string, length long, content string")
    return rows.withColumn("path", _below(F.col("path"), root))


def python_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the Python files under src/ of a repository, without tests."""
    return source_tree(spark, root, "*.py").unionByName(package_files(spark, root)).filter(is_python_source(F.col("path"), F.col("length"))).select("path", "content")


def typescript_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the TypeScript and JavaScript files under src/, without tests and configuration."""
    return source_tree(spark, root, "*.{ts,tsx,js,jsx}").filter(is_typescript_source(F.col("path"), F.col("length"))).select("path", "content")


def all_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, name, extension, size) of every file of a tree that a whole-tree scan keeps."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = source_tree(spark, root).filter(is_kept_file(F.col("path")))
    return rows.select("path", name.alias("name"), F.regexp_extract(name, r"(?<=.)\.[^.]*$", 0).alias("extension"), F.col("length").alias("size"))


def text_file(spark: SparkSession, path: str) -> DataFrame:
    """(url, markdown) of a whole text file."""
    return spark.read.text(path, wholetext=True).select(F.lit(path).alias("url"), F.col("value").alias("markdown"))


def fetched(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages of the wanted URLs that have content."""
    return pages.join(urls.select("url").distinct(), "url", "left_semi").filter(F.length("markdown") > 0)


def hashed_words(texts: list[str | None], dims: int) -> np.ndarray:
    """The offline embedder: signed counts of word hashes, of length one; zeros for no words."""
    out = np.zeros((len(texts), dims))
    for row, text in zip(out, texts):
        h = np.array([zlib.crc32(w.encode()) for w in re.findall(r"\w+", (text or "").lower())], np.int64)
        row += np.bincount(h % dims, np.where(h // dims % 2, -1.0, 1.0), dims)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


def embedded(chunks: DataFrame, dims: int = 64, text: str = "content", model: Callable[[list[str | None], int], np.ndarray] = hashed_words) -> DataFrame:
    """The rows with ``embedding``. ``model``: from texts and a number of components to a matrix; it runs in the tasks, batch by batch."""
    at = chunks.columns.index(text)
    schema = StructType([*chunks.schema.fields, StructField("embedding", ArrayType(DoubleType()))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                vectors = pa.array(list(model(part.column(at).to_pylist(), dims)), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*part.columns, vectors], [*part.schema.names, "embedding"])

    return chunks.mapInArrow(run, schema)
