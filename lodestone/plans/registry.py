"""The registry of queries: name, plan and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
Plan = Callable[[SparkSession, str], DataFrame]


def query(sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan under its own name, with its SQL."""

    def keep(f: Plan) -> Plan:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
