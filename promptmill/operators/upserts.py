"""Table changes as snapshot in, snapshot out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_if_absent(target: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add incoming rows whose key is new; of equal incoming keys one row is kept."""
    fresh = incoming.dropDuplicates(list(keys)).join(target.select(*keys), list(keys), "left_anti")
    return target.unionByName(fresh)


def upsert(target: DataFrame, incoming: DataFrame, keys: Sequence[str], values: Sequence[str], order: Sequence[str], defaults: dict[str, Column] | None = None) -> DataFrame:
    """Insert or overwrite ``values``; other columns of present rows stay (creation times).

    Of incoming rows with one key the last in ``order`` wins, found by a map-side combined
    aggregate. ``defaults`` fill the remaining columns of inserted rows.
    """
    last = incoming.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_new"))
    merged = target.withColumn("_old", F.lit(True)).join(last.withColumn("_hit", F.lit(True)), list(keys), "full_outer")
    defaults = defaults or {}

    def pick(c: str) -> Column:
        if c in keys:
            return F.col(c)
        if c in values:
            return F.when(F.col("_hit"), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)
        return F.when(F.col("_old"), F.col(c)).otherwise(defaults.get(c, F.lit(None))).alias(c)

    return merged.select(*[pick(c) for c in target.columns])


def append(target: DataFrame, rows: DataFrame) -> DataFrame:
    return target.unionByName(rows, allowMissingColumns=True)


def update_where(target: DataFrame, changes: DataFrame, keys: Sequence[str], guard: Column, sets: dict[str, Column]) -> DataFrame:
    """Set columns of the rows that match ``changes`` on ``keys`` and satisfy ``guard``."""
    marked = target.join(changes.withColumn("_hit", F.lit(True)), list(keys), "left")
    hit = F.coalesce(F.col("_hit") & guard, F.lit(False))
    return marked.select(*[F.when(hit, sets[c]).otherwise(F.col(c)).alias(c) if c in sets else F.col(c) for c in target.columns])


def delete_where(target: DataFrame, keys_to_delete: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not listed (a token in ``keys`` makes the delete a guarded one)."""
    return target.join(keys_to_delete.select(*keys).distinct(), list(keys), "left_anti")


def set_if_null(target: DataFrame, changes: DataFrame, key: str, column: str, new: str, guard: Column, order: Sequence[str] = ()) -> DataFrame:
    """Fill ``column`` where it is null. Of several new values of one key the first in ``order`` counts, then the smallest; nulls never do."""
    first = changes.where(F.col(new).isNotNull()).groupBy(key).agg(F.min_by(new, F.struct(*order, new)).alias(new))
    return update_where(target, first, [key], guard, {column: F.coalesce(F.col(column), F.col(new))})
