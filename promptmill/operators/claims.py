"""Leases and guarded state changes over requests, batches and the outbox."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptmill.functions.text import as_time, lease_free, lease_until
from promptmill.operators.upserts import delete_where, update_where
from promptmill.schemas import BATCHES_PER_TICK, CLAIM_TTL_SECONDS, ERROR_BACKOFF_SECONDS, TERMINAL_EVENTS


def claimable_requests(requests: DataFrame, as_of) -> DataFrame:
    return requests.where((F.col("state") == "entered") & lease_free("submit_claimed_until", as_of))


def is_terminal_event(event_type: Column | str = "event_type") -> Column:
    return (F.col(event_type) if isinstance(event_type, str) else event_type).isin(*TERMINAL_EVENTS)


def oldest(df: DataFrame, n: int, key: str, created: str = "created_at") -> DataFrame:
    """The ``n`` oldest rows, ties broken by key, as a distributed top-n."""
    return df.orderBy(created, key).limit(n)


def outbox_with_batches(outbox: DataFrame, batches: DataFrame, as_of) -> DataFrame:
    """Outbox rows free to fetch, with their provider batch id."""
    free = outbox.where(lease_free("fetch_claimed_until", as_of))
    return free.join(batches.select(F.col("uid").alias("batch_fk"), "provider_batch_id"), "batch_fk")


def open_batch_keys(batch_requests: DataFrame, requests: DataFrame) -> DataFrame:
    """Keys of batches holding a submitted request.

    Reduced to distinct keys before it meets the batches, so a batch with very many
    members is combined on the map side and costs one row.
    """
    submitted = requests.where(F.col("state") == "submitted").select(F.col("request_id").alias("request_fk"))
    return batch_requests.join(submitted, "request_fk", "left_semi").select(F.col("batch_fk").alias("uid")).distinct()


def terminal_batch_keys(batch_events: DataFrame) -> DataFrame:
    return batch_events.where(is_terminal_event()).select(F.col("batch_fk").alias("uid")).distinct()


def batches_with_open_requests(batches: DataFrame, batch_requests: DataFrame, requests: DataFrame) -> DataFrame:
    return batches.join(open_batch_keys(batch_requests, requests), "uid", "left_semi")


def batches_without_terminal(batches: DataFrame, batch_events: DataFrame) -> DataFrame:
    return batches.join(terminal_batch_keys(batch_events), "uid", "left_anti")


def pollable_batches(
    batches: DataFrame, batch_requests: DataFrame, requests: DataFrame, batch_events: DataFrame, as_of, n: int | None = BATCHES_PER_TICK,
) -> DataFrame:
    """Lease-free batches with open requests and no terminal event, oldest ``n`` (all for None)."""
    free = batches.where(lease_free("poll_claimed_until", as_of))
    ready = batches_with_open_requests(batches_without_terminal(free, batch_events), batch_requests, requests)
    return ready if n is None else oldest(ready, n, "uid")


def oldest_request_per_batch(requests: DataFrame, batch_requests: DataFrame, as_of) -> DataFrame:
    """Per batch, its submitted, lease-free request updated longest ago (ties by id)."""
    open_requests = requests.where((F.col("state") == "submitted") & lease_free("submit_claimed_until", as_of))
    linked = batch_requests.join(open_requests.select(F.col("request_id").alias("request_fk"), "updated_at"), "request_fk")
    return linked.groupBy("batch_fk").agg(F.min(F.struct("updated_at", "request_fk")).alias("_r")).select(
        "batch_fk", F.col("_r.request_fk").alias("request_id"), F.col("_r.updated_at").alias("updated_at"))


def _lease(prefix: str, worker: str, token: Column, as_of, ttl: int) -> dict[str, Column]:
    return {
        f"{prefix}_claimed_by": F.lit(worker), f"{prefix}_claim_token": token,
        f"{prefix}_claimed_until": lease_until(as_of, ttl)}


def _no_lease(prefix: str) -> dict[str, Column]:
    return {f"{prefix}_{c}": F.lit(None) for c in ("claimed_by", "claim_token", "claimed_until")}


def _touched(df: DataFrame, as_of) -> dict[str, Column]:
    return {"updated_at": as_time(as_of)} if "updated_at" in df.columns else {}


def claim(df: DataFrame, picked: DataFrame, key: str, prefix: str, worker: str, token: str, as_of, ttl: int = CLAIM_TTL_SECONDS) -> DataFrame:
    """Put a lease on the picked rows."""
    keys = picked.select(key).distinct()
    return update_where(df, keys, [key], F.lit(True), {**_lease(prefix, worker, F.lit(token), as_of, ttl), **_touched(df, as_of)})


def claim_one(df: DataFrame, wanted: DataFrame, key: str, prefix: str, worker: str, token: str, as_of, ttl: int = CLAIM_TTL_SECONDS) -> DataFrame:
    """Claim specific rows where their lease is free; the others stay as they are."""
    return update_where(
        df, wanted.select(key).distinct(), [key], lease_free(f"{prefix}_claimed_until", as_of), _lease(prefix, worker, F.lit(token), as_of, ttl))


def transition(requests: DataFrame, changes: DataFrame, to_state: str, as_of, from_state: str | None = None, token: str | None = "submit_claim_token",
               also: dict[str, Column] | None = None) -> DataFrame:
    """Guarded state change: id (and token, if named) must match and the state must be the expected one.

    Submitting clears the submit lease. A stale token matches nothing, so a late worker changes nothing.
    ``also`` sets further columns of the changed rows, such as the provider's ids.
    """
    keys = ["request_id"] + ([token] if token else [])
    sets = {"state": F.lit(to_state), **_touched(requests, as_of), **(also or {})}
    if to_state == "submitted":
        sets.update(_no_lease("submit"))
    guard = F.lit(True) if from_state is None else F.col("state") == from_state
    return update_where(requests, changes.select(*keys).distinct(), keys, guard, sets)


def release(df: DataFrame, holders: DataFrame, key: str, prefix: str, as_of) -> DataFrame:
    """Give leases back at once (token guarded)."""
    keys = [key, f"{prefix}_claim_token"]
    return update_where(df, holders.select(*keys).distinct(), keys, F.lit(True), {**_no_lease(prefix), **_touched(df, as_of)})


def release_with_backoff(df: DataFrame, holders: DataFrame, key: str, prefix: str, as_of, seconds: int = ERROR_BACKOFF_SECONDS) -> DataFrame:
    """Drop the token but keep the row closed until the backoff is over (token guarded)."""
    keys = [key, f"{prefix}_claim_token"]
    sets = {**_no_lease(prefix), f"{prefix}_claimed_until": lease_until(as_of, seconds)}
    return update_where(df, holders.select(*keys).distinct(), keys, F.lit(True), sets)


def delete_claimed(df: DataFrame, holders: DataFrame, key: str, prefix: str) -> DataFrame:
    """Delete rows whose key and token both match."""
    return delete_where(df, holders, [key, f"{prefix}_claim_token"])


def cancelled_request_keys(requests: DataFrame, batch_requests: DataFrame, batches: DataFrame, tokens: DataFrame) -> DataFrame:
    """Submitted requests of the batches whose poll token still matches: (request_id, batch_fk)."""
    held = batches.join(tokens.select("uid", "poll_claim_token").distinct(), ["uid", "poll_claim_token"], "left_semi")
    links = batch_requests.join(held.select(F.col("uid").alias("batch_fk")), "batch_fk", "left_semi")
    submitted = requests.where(F.col("state") == "submitted").select(F.col("request_id").alias("request_fk"))
    return links.join(submitted, "request_fk", "left_semi").select(F.col("request_fk").alias("request_id"), "batch_fk")


def cancel_batch_requests(requests: DataFrame, batch_requests: DataFrame, batches: DataFrame, tokens: DataFrame, as_of) -> DataFrame:
    keys = cancelled_request_keys(requests, batch_requests, batches, tokens)
    return transition(requests, keys, "cancelled", as_of, from_state="submitted", token=None)


def batch_members(batch_requests: DataFrame, wanted: DataFrame) -> DataFrame:
    """Request keys of the wanted batches (a ``batch_fk`` column)."""
    return batch_requests.join(wanted.select("batch_fk").distinct(), "batch_fk", "left_semi").select("batch_fk", "request_fk")
