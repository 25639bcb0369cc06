"""Joins of a table with hot keys against a list of distinct keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
SALTS = 32


def join_hot(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", broadcast_rows: int = BROADCAST_ROWS, salts: int = SALTS) -> DataFrame:
    """Join ``big``, where one key may hold a large share of the rows, with ``small``, one row per key.

    ``small`` is counted first (it should be a written table, so that this is cheap). A short list is
    broadcast. A longer one is repeated for every salt and the rows of ``big`` are spread over the
    salts by a hash of their contents, so no key stays in one task. Meant for micro-batches, where
    the run-time skew handling of batch queries may be off. ``how``: inner, left, left_semi, left_anti.
    """
    keys = list(on)
    n = small.count()
    if n == 0 and how in ("inner", "left_semi"):
        big = big.where(F.lit(False))  # nothing can match, so the big side is not even read
    if n <= broadcast_rows:
        return big.join(F.broadcast(small), keys, how)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")
