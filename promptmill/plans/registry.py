"""Registry of queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from promptmill.plans.inputs import Inputs, duckdb_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *inputs: str) -> Callable:
    """Register ``fn(Inputs) -> DataFrame`` under its own name, with its SQL over ``inputs`` if there is one."""

    def register(fn: Callable[[Inputs], DataFrame]) -> Callable:
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql is not None:
            ORACLES[fn.__name__] = duckdb_sql(sql, *inputs)
        return fn

    return register
