"""Procedure calls checked against a catalog of functions, parameters and enums."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Catalog type names and their checked types.
TYPES = [
    ("text", "STRING"), ("varchar", "STRING"), ("character varying", "STRING"), ("char", "STRING"),
    ("bigint", "INTEGER"), ("integer", "INTEGER"), ("int", "INTEGER"), ("uuid", "UUID"), ("boolean", "BOOLEAN"), ("bool", "BOOLEAN"),
    ("json", "JSON"), ("jsonb", "JSON"), ("timestamp", "TIMESTAMP"), ("timestamptz", "TIMESTAMP"), ("date", "DATE"),
    ("numeric", "NUMERIC"), ("decimal", "NUMERIC"), ("array", "ARRAY"),
]
UUID = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
TIMESTAMPS = [r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z?$", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z?$", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"]


def checked_type(name: Column, is_enum: Column) -> Column:
    """Type of a catalog type name; enums first, unknown names are strings."""
    lower = F.lower(name)
    out = F.lit("STRING")
    for known, kind in reversed(TYPES):
        out = F.when(lower == known, kind).otherwise(out)
    return F.when(is_enum, "ENUM").otherwise(out)


def expected_parameters(params: DataFrame, enums: DataFrame) -> DataFrame:
    """(function, name, type, required, enum_values) of catalog parameters (function, name, type, mode, position, default)."""
    e = enums.select(F.col("name").alias("enum"), F.col("values").alias("enum_values"))
    rows = params.join(F.broadcast(e), params.type == e["enum"], "left")  # a catalog's enums
    required = (F.upper("mode") == "IN") & (F.coalesce("default", F.lit("")) == "")
    return rows.select("function", "name", checked_type(F.col("type"), F.col("enum").isNotNull()).alias("type"), required.alias("required"), "enum_values")


def json_kind(value: Column) -> Column:
    """Kind of a JSON text: string, number, boolean, object, array, null; null where it isn't JSON (a variable)."""
    v = F.schema_of_variant(F.try_parse_json(value))
    return F.when(v == "STRING", "string").when(v == "BOOLEAN", "boolean").when(v.startswith("OBJECT"), "object").when(v.startswith("ARRAY"), "array").when(v == "VOID", "null").when(v.isNotNull(), "number")


def inferred_type(value: Column) -> Column:
    kind, text = json_kind(value), F.variant_get(F.try_parse_json(value), "$", "string")
    stamp = text.rlike(TIMESTAMPS[0]) | text.rlike(TIMESTAMPS[1]) | text.rlike(TIMESTAMPS[2])
    return (
        F.when(kind == "boolean", "BOOLEAN")
        .when((kind == "number") & value.rlike(r"^\s*-?\d+\s*$"), "INTEGER")
        .when((kind == "string") & text.rlike(UUID), "UUID")
        .when((kind == "string") & stamp, "TIMESTAMP")
        .when(kind.isin("object", "array"), "JSON")
        .when(kind.isNull(), "UNKNOWN")
        .otherwise("STRING")
    )


def value_fits(value: Column, kind: Column) -> Column:
    """Whether a JSON value fits a checked type; variables and unchecked types always do."""
    json, text = json_kind(value), F.variant_get(F.try_parse_json(value), "$", "string")
    whole = (json == "number") & value.rlike(r"^\s*-?\d+\s*$")
    stamp = text.rlike(TIMESTAMPS[0]) | text.rlike(TIMESTAMPS[1]) | text.rlike(TIMESTAMPS[2])
    ok = (
        F.when(kind == "UUID", (json == "string") & text.rlike(UUID))
        .when(kind == "INTEGER", whole | (json == "boolean") | ((json == "string") & text.rlike(r"^\s*[+-]?\d+\s*$")))
        .when(kind == "BOOLEAN", (json == "boolean") | ((json == "string") & F.lower(text).isin("true", "false", "0", "1")))
        .when(kind == "TIMESTAMP", (json == "string") & stamp)
        .otherwise(F.lit(True))
    )
    return json.isNull() | ok


def check_calls(calls: DataFrame, provided: DataFrame, functions: DataFrame, params: DataFrame, enums: DataFrame) -> DataFrame:
    """(call_id, name, error) of calls (call_id, function) with provided (call_id, name, value as JSON text).

    An unknown function is the only error of its call. COUNT: too few, or more than there
    are parameters; MISSING: a required one; TYPE, ENUM, JSON: a value.
    """
    expected = expected_parameters(params, enums)
    known = functions.select(F.col("name").alias("function")).distinct()
    unknown = calls.join(known, "function", "left_anti").select("call_id", F.col("function").alias("name"), F.lit("NOT_FOUND").alias("error"))
    real = calls.join(known, "function", "left_semi")
    totals = expected.groupBy("function").agg(F.count_if("required").alias("required"), F.count("*").alias("total"))
    given = provided.groupBy("call_id").agg(F.count("*").alias("given"))
    counts = real.join(totals, "function", "left").join(given, "call_id", "left").na.fill(0, ["required", "total", "given"])
    count = counts.filter((F.col("given") < F.col("required")) | (F.col("given") > F.col("total"))).select("call_id", F.col("function").alias("name"), F.lit("COUNT").alias("error"))
    wanted = real.join(expected, "function")
    missing = wanted.filter("required").join(provided.select("call_id", "name"), ["call_id", "name"], "left_anti").select("call_id", "name", F.lit("MISSING").alias("error"))
    value = wanted.join(provided, ["call_id", "name"])
    text = F.coalesce(F.variant_get(F.try_parse_json("value"), "$", "string"), F.col("value"))
    errors = F.array(
        F.when(~value_fits(F.col("value"), F.col("type")), "TYPE"),
        F.when((F.col("type") == "ENUM") & json_kind(F.col("value")).isNotNull() & ~F.array_contains("enum_values", text), "ENUM"),
        F.when((F.col("type") == "JSON") & json_kind(F.col("value")).isNotNull() & (json_kind(F.col("value")) != "object"), "JSON"),
    )
    bad = value.select("call_id", "name", F.explode(F.filter(errors, lambda e: e.isNotNull())).alias("error"))
    return unknown.unionByName(count).unionByName(missing).unionByName(bad)


def extra_parameters(calls: DataFrame, provided: DataFrame, params: DataFrame) -> DataFrame:
    """(call_id, function, name): what calls provide and their functions don't take."""
    known = params.select("function", "name").distinct()
    given = calls.join(provided.select("call_id", "name"), "call_id")
    return given.join(params.select("function").distinct(), "function", "left_semi").join(known, ["function", "name"], "left_anti").select("call_id", "function", "name")


def first_call(content: Column | str, function: str) -> Column:
    """Map of the arguments of the first ``.rpc('function', {...})`` of a text, its object ending at the first brace.

    Names stand for a nil UUID where they have id in them, else for a string; literals are
    kept without their quotes.
    """
    c = F.col(content) if isinstance(content, str) else content
    body = F.regexp_extract(c, r"(?s)\.rpc\s*\(\s*['\"]" + re.escape(function) + r"['\"],\s*\{([^}]*)\}", 1)
    names = F.regexp_extract_all(body, F.lit(r"(\w+):\s*([^,}]+)"), F.lit(1))
    values = F.transform(F.regexp_extract_all(body, F.lit(r"(\w+):\s*([^,}]+)"), F.lit(2)), lambda v: F.trim(F.regexp_replace(v, r"\s+", " ")))
    name = lambda v: v.rlike(r"^[a-zA-Z_]\w*(\.[a-zA-Z_]\w*)*$") & ~v.isin("true", "false", "null")
    stand = F.transform(values, lambda v: F.when(name(v), F.when(F.lower(v).contains("id"), "00000000-0000-0000-0000-000000000000").otherwise("string_variable")).otherwise(F.regexp_replace(v, r"^['\"]|['\"]$", "")))
    return F.map_from_arrays(F.array_distinct(names), F.slice(stand, 1, F.size(F.array_distinct(names))))
