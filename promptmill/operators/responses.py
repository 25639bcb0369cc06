"""Responses to invocations: resolution, status, connections, executions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptmill.functions.text import as_time, stable_uuid
from promptmill.schemas import EXECUTION_FAILED, EXECUTION_OK, TEXT_RESPONSE_KINDS


def response_resolution(responses: DataFrame, invocations: DataFrame, links: DataFrame, assets: DataFrame) -> DataFrame:
    """Responses with the public id of their invocation and, where linked, their asset."""
    r = responses.select("uid", "crequest_fk", "kind", "content")
    inv = invocations.select(F.col("uid").alias("crequest_fk"), F.col("eid").alias("request_eid"))
    asset = links.join(assets.select(F.col("uid").alias("asset_fk"), F.col("eid").alias("asset_eid"), F.col("size").alias("asset_size")), "asset_fk", "left")
    return (
        r.join(inv, "crequest_fk")
        .join(asset.select(F.col("response_fk").alias("uid"), "asset_eid", "asset_size"), "uid", "left")
        .select(F.col("crequest_fk").alias("request_uid"), "request_eid", F.col("uid").alias("response_uid"), "kind", "content", "asset_eid", "asset_size"))


def failed_executions(invocations: DataFrame, executions: DataFrame) -> DataFrame:
    failed = executions.where(F.col("kind") != EXECUTION_OK)
    return failed.join(invocations.select(F.col("uid").alias("crequest_fk"), F.col("eid").alias("request_eid")), "crequest_fk").select(
        F.col("crequest_fk").alias("request_uid"), "request_eid", "created_at", "kind", "notes")


def outcomes(invocations: DataFrame, responses: DataFrame, links: DataFrame, assets: DataFrame, executions: DataFrame) -> DataFrame:
    """``response_kind`` straight from the tables: one join per table, none only to look up an id."""
    asset = links.join(assets.select(F.col("uid").alias("asset_fk"), F.col("eid").alias("asset_eid"), F.col("size").alias("asset_size")), "asset_fk", "left")
    resolved = responses.select("uid", F.col("crequest_fk").alias("request_uid"), "kind", "content").join(
        asset.select(F.col("response_fk").alias("uid"), "asset_eid", "asset_size"), "uid", "left").drop("uid")
    failed = executions.where(F.col("kind") != EXECUTION_OK).select(F.col("crequest_fk").alias("request_uid"), "created_at", "notes")
    return response_kind(invocations, resolved, failed)


def response_kind(invocations: DataFrame, resolved: DataFrame, failed: DataFrame) -> DataFrame:
    """Outcome per invocation: text_block, asset, no_response_yet or aborted.

    Failed executions are counted per invocation before the join. All joins are on the internal
    key, which the inputs are already shuffled by.
    """
    fails = failed.groupBy("request_uid").agg(F.count(F.lit(1)).alias("n_failed"), F.min_by("notes", F.struct("created_at", "notes")).alias("first_note"))
    rows = (
        invocations.select(F.col("uid").alias("request_uid"), F.col("eid").alias("request_eid"))
        .join(resolved.drop("request_eid").withColumn("_has", F.lit(True)), "request_uid", "left").join(fails, "request_uid", "left"))
    is_text = F.col("kind").isin(*TEXT_RESPONSE_KINDS)
    outcome = (
        F.when(F.col("_has") & is_text & F.col("content").isNotNull(), "text_block")
        .when(F.col("_has") & ~is_text & F.col("asset_eid").isNotNull(), "asset")
        .when(F.col("_has"), "no_response_yet")
        .when(F.col("n_failed") > 0, "aborted").otherwise("no_response_yet"))
    return rows.withColumn("outcome", outcome).select(
        "request_eid", "outcome", F.when(F.col("outcome").isin("text_block", "asset"), F.col("content")).alias("content"),
        F.when(F.col("outcome") == "asset", F.col("asset_eid")).alias("asset_eid"),
        F.when(F.col("outcome") == "asset", F.col("asset_size")).alias("asset_size"),
        F.when(F.col("outcome") == "aborted", F.col("first_note")).alias("note"))


def invocation_status(outcome: Column) -> Column:
    return F.when(outcome == "aborted", "ABORT").otherwise("OK")


def response_json() -> Column:
    """Response record as JSON."""
    return F.to_json(F.struct(
        F.col("request_eid").alias("responseEId"),
        F.struct(F.col("outcome").alias("kind"), "content", "asset_eid", "asset_size", "note").alias("result"),
        invocation_status(F.col("outcome")).alias("status")))


def valid_connections(connections: DataFrame, cancellations: DataFrame) -> DataFrame:
    """Known connections with ``is_valid``: no cancellation with a reason. Unknown ones are absent, hence invalid."""
    cancelled = cancellations.groupBy(F.col("connection_fk").alias("uid")).agg(F.count("reason").alias("_n"))
    return connections.select("uid").join(cancelled, "uid", "left").select(
        "uid", (F.coalesce("_n", F.lit(0)) == 0).alias("is_valid"))


def record_invocations(calls: DataFrame, keys: list[str], created_at) -> DataFrame:
    """New invocation rows with a derived public id."""
    return calls.withColumn("eid", stable_uuid(*keys)).withColumn("created_at", as_time(created_at))


def end_transactions(ended: DataFrame) -> DataFrame:
    """Execution rows: kind 1 for success, 5 with a note for failure (``error`` not NULL)."""
    return ended.select(
        F.col("uid").alias("crequest_fk"),
        F.when(F.col("error").isNull(), EXECUTION_OK).otherwise(EXECUTION_FAILED).alias("kind"), F.col("error").alias("notes"))
