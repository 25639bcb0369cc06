"""Event logs: newest entries and states folded from events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptmill.schemas import TERMINAL_STATES


def latest_event(events: DataFrame, key: str) -> DataFrame:
    """Newest event per key, ties by event id. An aggregate with map-side combine, so a key
    with very many events costs one row per map task instead of one sorted window."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("occurred_at", "event_id")).alias("_e")).select(key, "_e.*")


def folded_state() -> tuple[Column, Column]:
    """Aggregates ``(terminal, latest)``; the state is the first terminal one, else the latest.

    Nothing leaves a terminal state, so events arriving after (or out of order around) it do not count.
    """
    at = F.struct("occurred_at", "event_id")
    done = F.col("state").isin(*TERMINAL_STATES)
    return F.min_by(F.when(done, F.col("state")), F.when(done, at)), F.max_by("state", at)


def request_states(events: DataFrame) -> DataFrame:
    terminal, latest = folded_state()
    return events.groupBy("request_id").agg(terminal.alias("_t"), latest.alias("_l")).select(
        "request_id", F.coalesce("_t", "_l").alias("state"))


def state_counts(requests: DataFrame) -> DataFrame:
    return requests.groupBy("production_id", "state").agg(F.count(F.lit(1)).alias("n"))
