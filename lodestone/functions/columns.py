"""Small Column helpers that other modules share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def blank_to_null(x: Column | str) -> Column:
    """Null where a parameter is null or only white space."""
    return F.nullif(F.trim(col(x)), F.lit(""))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null where a norm is zero or a side is null."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    n = norm(a) * norm(b)
    return F.when(n > 0, dot / n)


def merged(*maps: Column) -> Column:
    """One map of several: of a key that is there more than once, the last value counts."""
    pairs = F.flatten(F.array(*[F.coalesce(F.map_entries(m), F.array().cast("array<struct<key:string,value:string>>")) for m in maps]))
    keys = F.array_distinct(F.transform(pairs, lambda e: e["key"]))
    last = lambda k: F.element_at(F.transform(F.filter(pairs, lambda e: e["key"] == k), lambda e: e["value"]), -1)
    return F.map_from_arrays(keys, F.transform(keys, last))


def value_of(m: Column, key: str, default: str | None = None) -> Column:
    """The value of a key, or the default where it isn't there."""
    return F.coalesce(F.try_element_at(m, F.lit(key)), F.lit(default))


#: Fixed value: what a stamp looks like.
STAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?$"


def stamp(time: Column | None = None) -> Column:
    """A time, or now, as an ISO text in UTC."""
    return F.date_format(F.current_timestamp() if time is None else time, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def is_stamp(x: Column) -> Column:
    return F.coalesce(x.rlike(STAMP), F.lit(False))
