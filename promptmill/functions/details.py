"""Event details: one JSON builder per event kind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _details(event: str, keep_nulls: bool = False, **fields: Column) -> Column:
    body = F.struct(F.lit(event).alias("event"), *[c.alias(n) for n, c in fields.items()])
    return F.to_json(body, {"ignoreNullFields": "false"} if keep_nulls else {})


def entered(template_name: Column, source_name: Column, item_index: Column, header: Column) -> Column:
    return _details("entered", template_name=template_name, source_name=source_name, item_index=item_index, header_toml=header)


def batch_submitted(batch_uid: Column, provider_batch_id: Column, request_count: Column) -> Column:
    return _details("batch_submitted", batch_uid=batch_uid, provider_batch_id=provider_batch_id, request_count=request_count)


def request_submitted(batch_uid: Column, provider_batch_id: Column) -> Column:
    return _details("submitted", batch_uid=batch_uid, provider_batch_id=provider_batch_id)


def submit_failed(code: Column, message: Column) -> Column:
    return _details("submit_failed", error_code=code, error_message=message)


def polled(status_text: Column, reason: Column) -> Column:
    """The reason is present even when null."""
    return _details("polled", keep_nulls=True, provider_status=status_text, reason=reason)


def provider_terminal(kind: Column, reason: Column) -> Column:
    """The reason is left out when NULL."""
    return _details("provider_terminal", terminal_kind=kind, reason=reason)


def poll_error(code: Column, message: Column) -> Column:
    return _details("poll_error", error_code=code, error_message=message)


def batch_terminal(batch_uid: Column, kind: Column, reason: Column) -> Column:
    return _details("batch_terminal", batch_uid=batch_uid, terminal_kind=kind, reason=reason)


def raw_fetched(batch_uid: Column, locator: Column, size: Column) -> Column:
    return _details("raw_fetched", batch_uid=batch_uid, raw_result_locator=locator, bytes=size)


def answer_materialized(batch_uid: Column, metadata: Column) -> Column:
    """``metadata`` is JSON text and is embedded as JSON."""
    return _details("answer_materialized", keep_nulls=True, batch_uid=batch_uid, metadata=F.try_parse_json(metadata))


def answers_materialized(ok: Column, missing: Column, total: Column) -> Column:
    return _details("answers_materialized", ok_count=ok, missing_count=missing, batch_request_count=total)


def fetch_failed(code: Column, message: Column) -> Column:
    return _details("fetch_failed", error_code=code, error_message=message)
