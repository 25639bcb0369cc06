"""Running Arrow functions of this package on the executors."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from promptmill.session import ship_package

#: What modules keep in a Python worker between tasks (dicts and lists). A worker that goes over to
#: another operator lets go of all of it.
CACHES: list = []
_owner: list[str] = []


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, most: str = "4m") -> None:
    """Let Arrow batches of this session hold about ``most`` bytes, for rows of whole texts.

    Batches of Spark's 10,000 rows are tens of MB of text, held by the JVM and the worker of every task at once.
    A session that has set a bound of its own keeps it. Results never depend on it.
    """
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, most)


def arrow_map(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow`` for functions that use this package's modules."""
    ship_package(df.sparkSession)
    module = fn.__module__

    def run(batches):
        tidy(module)
        yield from fn(batches)
        tidy(module)

    return df.mapInArrow(run, schema)


def tidy(module: str) -> None:
    """Empty the caches when the worker last served another module; give free memory back to the system."""
    if _owner != [module]:
        _owner[:] = [module]
        for kept in CACHES:
            kept.clear()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def ddl(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
