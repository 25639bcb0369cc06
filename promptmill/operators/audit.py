"""Constraint audits and cascading deletes over the pipeline's tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptmill.schemas import REQUEST_STATES
from promptmill.session import cut_lineage

HASHES = 1 << 16
TASK_ROWS = 250_000  # keys that one task holds at a time


def _union(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _per_key(keys: DataFrame, task_rows: int) -> DataFrame:
    """Rows per key, ``n``, in tasks that hold about ``task_rows`` keys however many there are.

    Counted over hashes first. Rows whose hash is rare are dealt by key over as many tasks as their number asks for;
    a hash with as many rows as a task holds has few other keys, so its rows are counted where they are read.
    """
    hashed = F.pmod(F.xxhash64(*keys.columns), F.lit(HASHES))
    sizes = keys.groupBy(hashed.alias("h")).agg(F.count(F.lit(1)).alias("n"))
    rare = F.col("n") <= task_rows
    found = sizes.agg(F.sum(F.when(rare, F.col("n"))).alias("n"), F.collect_list(F.when(~rare, F.col("h"))).alias("hot")).first()
    hot = hashed.isin(found["hot"])
    dealt = keys.where(~hot).repartition(-(-(found["n"] or 0) // task_rows) or 1, *keys.columns)
    counted = [x.groupBy(*keys.columns).agg(F.count(F.lit(1)).alias("n")) for x in ([dealt, keys.where(hot)] if found["hot"] else [dealt])]
    return _union(counted)


def uniqueness_audit(tables: dict[str, DataFrame], keys: dict[str, list[tuple[str, ...]]], task_rows: int = TASK_ROWS) -> DataFrame:
    """One row per key constraint: rows, distinct keys, keys that repeat."""
    def one(name: str, cols: tuple[str, ...]) -> DataFrame:
        per_key = _per_key(cut_lineage(tables[name].select(*cols), "keys"), task_rows)
        return per_key.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_keys"),
            F.count_if(F.col("n") > 1).alias("n_repeated"),
        ).select(F.lit(name).alias("table_name"), F.lit(",".join(cols)).alias("key_columns"), "n_rows", "n_keys", "n_repeated")

    return _union(one(t, k) for t, ks in keys.items() if t in tables for k in ks)


def fk_audit(tables: dict[str, DataFrame], foreign_keys: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """Missing parents: (child_table, child_column, missing_key, n_rows).

    References are counted per key first, so a parent with very many children meets its
    table as one row.
    """
    def one(child: str, column: str, parent: str, parent_key: str) -> DataFrame:
        counted = tables[child].where(F.col(column).isNotNull()).groupBy(F.col(column).alias("missing_key")).agg(F.count(F.lit(1)).alias("n_rows"))
        return counted.join(tables[parent].select(F.col(parent_key).alias("missing_key")), "missing_key", "left_anti").select(
            F.lit(child).alias("child_table"), F.lit(column).alias("child_column"), "missing_key", "n_rows")

    return _union(one(*fk) for fk in foreign_keys if fk[0] in tables and fk[2] in tables)


def state_domain_check(df: DataFrame, column: str, domain: Sequence[str] = REQUEST_STATES) -> DataFrame:
    """Values outside the domain (NULL included) and how often they occur."""
    return df.where(~F.coalesce(F.col(column).isin(*domain), F.lit(False))).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def cascade_delete(tables: dict[str, DataFrame], productions: DataFrame | None = None, batches: DataFrame | None = None) -> dict[str, DataFrame]:
    """Delete productions and/or batches with everything that hangs on them."""
    out = dict(tables)

    def drop(name: str, column: str, keys: DataFrame, key: str) -> None:
        if name in out:
            out[name] = out[name].join(keys.select(F.col(key).alias(column)).distinct(), column, "left_anti")

    if productions is not None:
        gone = tables["requests"].join(productions.select("production_id").distinct(), "production_id", "left_semi")
        drop("productions", "production_id", productions, "production_id")
        drop("requests", "production_id", productions, "production_id")
        drop("request_events", "request_id", gone, "request_id")
        for name in ("batch_requests", "request_results"):
            drop(name, "request_fk", gone, "request_id")
    if batches is not None:
        drop("batches", "uid", batches, "uid")
        for name in ("batch_events", "batch_requests", "request_results", "fetch_outbox"):
            drop(name, "batch_fk", batches, "uid")
    return out
