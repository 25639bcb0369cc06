"""Registered queries of versioned tables: changes go through commits, the newest version is the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptmill.functions.text import as_time
from promptmill.operators import claims, results
from promptmill.plans import lifecycle  # noqa: F401  (its SQL is used below)
from promptmill.plans.inputs import AS_OF, Inputs
from promptmill.plans.registry import ORACLES, query
from promptmill.session import shared_dir
from promptmill.sources.versions import EMPTY, VersionedTable


def _table(t: Inputs, rows: DataFrame, label: str, keys: list[str]) -> VersionedTable:
    buckets = int(t.spark.conf.get("spark.sql.shuffle.partitions"))  # with fewer, Spark would rather shuffle the target, too
    table = VersionedTable(t.spark, shared_dir(t.spark, label), rows.schema, keys, buckets)
    table.replace(rows, EMPTY)
    return table


@query()
def versioned_results(t: Inputs) -> DataFrame:
    """Answers put into a bucketed table of results, of which nothing is shuffled."""
    table = _table(t, t.request_results, "versioned-results", ["batch_fk", "request_fk"])
    table.change(lambda old: results.upsert_results(old, t.answers, ["line_no", "part_no"], as_time(AS_OF)))
    return table.read().select("batch_fk", "request_fk", "created_at", "metadata", "content")


@query()
def versioned_requests(t: Inputs) -> DataFrame:
    """Requests of cancelled batches change their state in a bucketed table."""
    table = _table(t, t.requests, "versioned-requests", ["request_id"])
    table.change(lambda old: claims.cancel_batch_requests(old, t.batch_requests, t.batches, t.poll_tokens, AS_OF))
    return table.read().select("request_id", "state", "updated_at")


@query("select batch_fk, request_fk, line_no, part_no, content from answers", "answers")
def appended_answers(t: Inputs) -> DataFrame:
    """Answers appended line number by line number, every step delivered twice, with compaction and cleanup in between."""
    rows = t.answers.select("batch_fk", "request_fk", "line_no", "part_no", "content")
    table = VersionedTable(t.spark, shared_dir(t.spark, "appended-answers"), rows.schema)
    for step in (1, 2, 3, 4, 5, 6, 7, 7, 3):  # line numbers of an order
        table.append(rows.where(F.col("line_no") == step), "lines", step)
        table.compact(3)
        table.vacuum(2)
    return table.read()


ORACLES["versioned_results"] = ORACLES["upsert_results"]
ORACLES["versioned_requests"] = ORACLES["cancel_batch_requests"]
