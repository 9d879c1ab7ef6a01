"""Containment of JSON documents: which rows hold which filter documents.

A document holds a filter if it has all of its fields with values that hold theirs, in
any order; an array holds an array if each element is held by one of its own; scalars
are equal, numbers by value. An array also holds a bare scalar that is the whole filter.

Both sides become rows of (path, value), an array's elements under one path. A document
that holds a filter has all of the filter's rows, so a division of the one table by the
other gives the candidates of all filters at once. For a filter in which some array
element has more than one row, that is not enough (they must be in one element), so its
candidates are then compared as documents.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Decimal
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.sources.scratch import kept, looked_up

LEAVES = "key long, path string, value string"
_LOADS = json.JSONDecoder(parse_float=Decimal, parse_int=Decimal).decode


def scalar(x: Any) -> str:
    """A value as text that is equal where the value is."""
    if x is None:
        return "null"
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, Decimal):
        return f"n{x.normalize()}" if x else "n0"
    return "s" + x


def leaves(x: Any, whole: bool, path: str = "") -> Iterator[tuple[str, str]]:
    """(path, value) rows. Of a document (``whole``), each object and array also says that it is there; of a filter, empty ones do."""
    if isinstance(x, dict):
        if whole or not x:
            yield path, "{}"
        for k, v in x.items():
            yield from leaves(v, whole, f"{path}/{k.replace('~', '~0').replace('/', '~1')}")
    elif isinstance(x, list):
        if whole or not x:
            yield path, "[]"
        for v in x:
            # A bare scalar is held by an array that has it.
            if whole and not path and not isinstance(v, (dict, list)):
                yield "", scalar(v)
            yield from leaves(v, whole, f"{path}/~*")
    else:
        yield path, scalar(x)


def holds(x: Any, want: Any, top: bool = True) -> bool:
    if isinstance(want, dict):
        return isinstance(x, dict) and all(k in x and holds(x[k], v, False) for k, v in want.items())
    if isinstance(want, list):
        return isinstance(x, list) and all(any(holds(e, v, False) for e in x) for v in want)
    if isinstance(x, list):
        return top and any(not isinstance(e, (dict, list)) and scalar(e) == scalar(want) for e in x)
    return not isinstance(x, dict) and scalar(x) == scalar(want)


def entangled(want: Any) -> bool:
    """Whether rows do not decide: some array element has more than one row, or none of its own."""
    if isinstance(want, dict):
        return any(map(entangled, want.values()))
    if isinstance(want, list):
        return any(entangled(v) or len(list(leaves(v, False))) > 1 or isinstance(v, list) for v in want)
    return False


def _json(x: Column | str, df: DataFrame) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    kind = df.select(c).schema[0].dataType
    return c.cast("string") if isinstance(kind, T.StringType) else F.to_json(c)


def _loaded(text: str | None) -> tuple[bool, Any]:
    try:
        return (True, _LOADS(text)) if text is not None else (False, None)
    except (ValueError, RecursionError):
        return False, None


def _rows(df: DataFrame, whole: bool) -> DataFrame:
    """(key, path, value) rows of (key, json), each once; filters also have (need, hard)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for lo in range(0, batch.num_rows, 2000):
                out = []
                for key, text in zip(*(batch.slice(lo, 2000).column(i).to_pylist() for i in range(2))):
                    ok, x = _loaded(text)
                    if ok:
                        made = dict.fromkeys(leaves(x, whole))
                        out += [(key, p, v, len(made), entangled(x)) for p, v in made] if not whole else [(key, p, v) for p, v in made]
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())[: 3 if whole else 5]
                names = ["key", "path", "value", "need", "hard"][: len(kinds)]
                columns = list(zip(*out)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return df.mapInArrow(run, LEAVES if whole else LEAVES + ", need long, hard boolean")


def contained(rows: DataFrame, document: Column | str, filters: DataFrame, wanted: Column | str, key: str = "id", filter_key: str = "filter_id") -> DataFrame:
    """(filter_id, id) of the rows whose JSON or VARIANT ``document`` holds the filter ``wanted``; all filters in one plan.

    Texts that are no JSON hold nothing and are held by nothing. Keys are unique.
    """
    docs = rows.select(F.col(key).cast("long").alias("key"), _json(document, rows).alias("json")).filter("key is not null")
    asked = filters.select(F.col(filter_key).cast("long").alias("key"), _json(wanted, filters).alias("json")).filter("key is not null")
    have = _rows(docs, True)
    want = kept(_rows(asked, False).withColumnRenamed("key", "filter_key"), "wanted")
    # An empty filter object or array still has a row, so every filter is divided by. Rows of documents are dealt out only if filters have very many.
    hits = have.join(looked_up(want), ["path", "value"]).groupBy("filter_key", "key").agg(F.count("*").alias("got"), F.first("need").alias("need"), F.first("hard").alias("hard")).filter("got = need")
    easy = hits.filter("not hard").select("filter_key", "key")
    hard = hits.filter("hard").select("filter_key", "key").join(docs, "key").join(asked.select(F.col("key").alias("filter_key"), F.col("json").alias("wanted")), "filter_key")

    def verify(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                keep = pa.array([holds(_loaded(x)[1], _loaded(w)[1]) for x, w in zip(part.column(2).to_pylist(), part.column(3).to_pylist())], pa.bool_())
                yield part.select([0, 1]).filter(keep)

    sure = hard.select("filter_key", "key", "json", "wanted").mapInArrow(verify, "filter_key long, key long")
    return easy.unionByName(sure).select(F.col("filter_key").alias(filter_key), F.col("key").alias(key))
