"""Table schemas and vocabularies of the production pipeline."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values: vocabularies -------------------------------------------------
REQUEST_STATES = ("entered", "submitted", "cancelled", "completed")
TERMINAL_STATES = ("cancelled", "completed")
TERMINAL_EVENTS = ("completed", "cancelled", "failed")
BATCH_EVENT_TYPES = (
    "submitted", "polled", "poll_error", "completed", "cancelled", "failed",
    "raw_fetched", "answers_materialized", "fetch_failed",
)
OBJECT_KINDS = ("template", "source", "raw_result", "final_result")
RUNNING_STATUSES = ("running", "finalizing", "in_progress", "validating")
TEXT_RESPONSE_KINDS = (1, 2, 3, 4)
EXECUTION_OK, EXECUTION_FAILED = 1, 5
ASSET_ACTIVE, ASSET_DISABLED, ASSET_RETIRED = 1, 2, 3

# ---- fixed values: operating constants ------------------------------------------
BATCH_SIZE = 10
BATCHES_PER_TICK = 10
CLAIM_TTL_SECONDS = 60
ERROR_BACKOFF_SECONDS = 300
MAX_OUTPUT_TOKENS = 200000
REQUEST_METHOD = "POST"
REQUEST_URL = "/v1/responses"
COMPLETION_WINDOW = "24h"
CACHE_KEY_PREFIX = "doc-fnv1a64-"


def _table(*cols: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, nullable) for name, dtype, nullable in cols])


_S, _L, _I, _TS, _B = T.StringType(), T.LongType(), T.IntegerType(), T.TimestampType(), T.BinaryType()

TABLES: dict[str, T.StructType] = {
    "s3_objects": _table(
        ("locator", _S, False), ("kind", _S, False), ("bytes", _L, False), ("sha256", _B, True),
        ("content_type", _S, True), ("created_at", _TS, False)),
    "asset_templates": _table(
        ("template_id", _S, False), ("template_name", _S, False), ("s3_locator", _S, False), ("created_at", _TS, False)),
    "asset_sources": _table(
        ("source_id", _S, False), ("source_name", _S, False), ("s3_locator", _S, False), ("created_at", _TS, False)),
    "productions": _table(
        ("production_id", _S, False), ("production_name", _S, False), ("template_id", _S, False),
        ("source_id", _S, False), ("created_at", _TS, False)),
    "requests": _table(
        ("request_id", _S, False), ("production_id", _S, False), ("item_index", _I, False), ("item_meta", _S, False),
        ("request_text", _S, False), ("state", _S, False), ("provider_batch_id", _S, True),
        ("provider_request_id", _S, True), ("raw_result_locator", _S, True), ("final_result_locator", _S, True),
        ("submit_claimed_until", _TS, True), ("submit_claimed_by", _S, True), ("submit_claim_token", _S, True),
        ("provider_batch_uuid", _S, True), ("poll_claimed_until", _TS, True), ("poll_claimed_by", _S, True),
        ("poll_claim_token", _S, True), ("created_at", _TS, False), ("updated_at", _TS, False)),
    "request_events": _table(
        ("event_id", _L, False), ("request_id", _S, False), ("state", _S, False), ("details", _S, False),
        ("occurred_at", _TS, False)),
    "batches": _table(
        ("uid", _S, False), ("provider_batch_id", _S, False), ("poll_claimed_until", _TS, True),
        ("poll_claimed_by", _S, True), ("poll_claim_token", _S, True), ("created_at", _TS, False)),
    "batch_events": _table(
        ("event_id", _L, False), ("batch_fk", _S, False), ("event_type", _S, False), ("details", _S, False),
        ("occurred_at", _TS, False)),
    "batch_requests": _table(
        ("request_fk", _S, False), ("batch_fk", _S, False), ("provider_request_id", _S, True), ("created_at", _TS, False)),
    "request_results": _table(
        ("request_fk", _S, False), ("batch_fk", _S, False), ("created_at", _TS, False), ("metadata", _S, False),
        ("content", _S, True)),
    "fetch_outbox": _table(
        ("batch_fk", _S, False), ("metadata", _S, False), ("fetch_claimed_until", _TS, True),
        ("fetch_claimed_by", _S, True), ("fetch_claim_token", _S, True), ("created_at", _TS, False)),
    "assets": _table(
        ("uid", _I, False), ("eid", _S, False), ("created_at", _TS, False), ("status", _I, False), ("name", _S, False),
        ("description", _S, True), ("content_type", _S, True), ("size", _L, False), ("version", _I, False),
        ("notes", _S, True)),
}

# Keys and references, in the form the audit operators take.
UNIQUE_KEYS: dict[str, list[tuple[str, ...]]] = {
    "s3_objects": [("locator",)],
    "asset_templates": [("template_id",), ("template_name", "s3_locator")],
    "asset_sources": [("source_id",), ("source_name", "s3_locator")],
    "productions": [("production_id",), ("production_name",)],
    "requests": [("request_id",), ("production_id", "item_index")],
    "request_events": [("event_id",)],
    "batches": [("uid",)],
    "batch_events": [("event_id",)],
    "batch_requests": [("request_fk", "batch_fk")],
    "request_results": [("batch_fk", "request_fk")],
    "fetch_outbox": [("batch_fk",)],
}

# (child table, child column, parent table, parent column)
FOREIGN_KEYS: list[tuple[str, str, str, str]] = [
    ("asset_templates", "s3_locator", "s3_objects", "locator"),
    ("asset_sources", "s3_locator", "s3_objects", "locator"),
    ("productions", "template_id", "asset_templates", "template_id"),
    ("productions", "source_id", "asset_sources", "source_id"),
    ("requests", "production_id", "productions", "production_id"),
    ("requests", "raw_result_locator", "s3_objects", "locator"),
    ("requests", "final_result_locator", "s3_objects", "locator"),
    ("request_events", "request_id", "requests", "request_id"),
    ("batch_events", "batch_fk", "batches", "uid"),
    ("batch_requests", "request_fk", "requests", "request_id"),
    ("batch_requests", "batch_fk", "batches", "uid"),
    ("request_results", "request_fk", "requests", "request_id"),
    ("request_results", "batch_fk", "batches", "uid"),
    ("fetch_outbox", "batch_fk", "batches", "uid"),
]

# ---- JSON shapes read with from_json (DDL strings) -------------------------------
BATCH_STATUS = "id string, status string, output_file_id string, error_file_id string, request_counts string"
UPLOAD_FIELDS = ("id", "object", "bytes", "created_at", "expires_at", "filename", "purpose")
UPLOAD_RESPONSE = (
    "id string, object string, bytes bigint, created_at bigint, expires_at bigint, filename string, purpose string")
SUBMIT_RESPONSE = (
    "id string, status string, errors string, output_file_id string, error_file_id string, completed_at bigint, "
    "failed_at bigint, expired_at bigint, cancelling_at bigint, cancelled_at bigint, "
    "request_counts struct<total:bigint,completed:bigint,failed:bigint>, "
    "usage struct<input_tokens:bigint,input_tokens_details:struct<cached_tokens:bigint>,output_tokens:bigint,"
    "output_tokens_details:struct<reasoning_tokens:bigint>,total_tokens:bigint>")
MANIFEST_FIELDS = (
    "prompt_cache_key", "document_hash_fnv64", "batch_input_file_id", "batch_id", "endpoint", "completion_window", "model_used")
RUN_MANIFEST = ", ".join(f"{name} string" for name in MANIFEST_FIELDS)
