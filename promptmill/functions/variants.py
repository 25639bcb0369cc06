"""Lenient JSON reading over VARIANT: result text, answers, statuses, usage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from promptmill.functions.text import is_uuid, strip_ws
from promptmill.schemas import BATCH_STATUS, SUBMIT_RESPONSE, UPLOAD_FIELDS, UPLOAD_RESPONSE

PARTS_SEPARATOR = "\n\n"


def field(v: Column, path: str, dtype: str = "variant") -> Column:
    """Value at ``path`` or NULL: missing, JSON null and wrong type all read as absent."""
    return F.try_variant_get(v, path, dtype)


def string_at(v: Column, path: str = "$") -> Column:
    """A string member. A plain string cast would turn numbers and objects into text."""
    return F.when(F.schema_of_variant(field(v, path)) == "STRING", field(v, path, "string"))


def object_at(v: Column, path: str = "$") -> Column:
    """A member that is an object (shallow check), else NULL."""
    return F.when(field(v, path, "map<string,variant>").isNotNull(), field(v, path))


def list_at(v: Column, path: str) -> Column:
    """Members of an array, each kept as a variant so one odd element spoils nothing; [] otherwise."""
    return F.coalesce(field(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _strings(members: Column, path: str = "$") -> Column:
    return F.filter(F.transform(members, lambda m: string_at(m, path)), lambda t: t.isNotNull())


def message_items(body: Column) -> Column:
    """Output items of type ``message``."""
    return F.filter(list_at(body, "$.output"), lambda item: F.coalesce(string_at(item, "$.type") == "message", F.lit(False)))


def content_texts(item: Column) -> Column:
    """Every string ``text`` among the content members, whatever their type."""
    return _strings(list_at(item, "$.content"), "$.text")


def response_body(root: Column) -> Column:
    """The body of a result line.

    With a ``response`` object its ``body`` counts, and a missing body makes the line bad;
    without one the root object itself is read as a body.
    """
    wrapped = field(root, "$.response", "map<string,variant>").isNotNull()
    return F.when(wrapped, object_at(root, "$.response.body")).otherwise(object_at(root))


def body_text(body: Column) -> Column:
    """All texts of a response body, stripped, blank ones dropped, joined by an empty line; NULL if none.

    ``output_text`` (a string, or the strings of an array) comes first, then the message contents;
    a text present in both places appears twice.
    """
    direct = F.when(string_at(body, "$.output_text").isNotNull(), F.array(string_at(body, "$.output_text"))).otherwise(
        _strings(list_at(body, "$.output_text")))
    nested = F.flatten(F.transform(message_items(body), content_texts))
    texts = F.filter(F.transform(F.concat(direct, nested), strip_ws), lambda t: t != "")
    return F.when(body.isNotNull(), F.nullif(strip_ws(F.array_join(texts, PARTS_SEPARATOR)), F.lit("")))


def usage(body: Column) -> Column:
    """Token counts of a response body; absent ones are NULL."""
    return F.struct(
        field(body, "$.usage.input_tokens", "bigint").alias("input_tokens"),
        field(body, "$.usage.input_tokens_details.cached_tokens", "bigint").alias("cached_tokens"),
        field(body, "$.usage.output_tokens", "bigint").alias("output_tokens"),
        field(body, "$.usage.output_tokens_details.reasoning_tokens", "bigint").alias("reasoning_tokens"),
        field(body, "$.usage.total_tokens", "bigint").alias("total_tokens"))


def answers(payload: Column) -> Column:
    """Answers of a whole-batch payload as ``array<struct<request_id, metadata, content>>``.

    The first of ``results`` / ``data`` / ``items`` that is an array counts. Members whose id is
    not a UUID are dropped. Metadata is ``metadata`` for results and the member itself otherwise.
    """
    arr = lambda name: field(payload, f"$.{name}", "array<variant>")

    def pick(members: Column, meta, *text_paths: str) -> Column:
        rows = F.transform(members, lambda m: F.struct(
            F.lower(string_at(m, "$.custom_id")).alias("request_id"),
            meta(m).alias("metadata"),
            F.coalesce(*[string_at(m, p) for p in text_paths], F.lit("")).alias("content")))
        return F.filter(rows, lambda r: is_uuid(r["request_id"]))

    own = lambda m: F.to_json(m)
    given = lambda m: F.coalesce(F.to_json(F.when(F.schema_of_variant(field(m, "$.metadata")) != "VOID", field(m, "$.metadata"))), F.lit("{}"))
    return (
        F.when(arr("results").isNotNull(), pick(arr("results"), given, "$.output_text", "$.content"))
        .when(arr("data").isNotNull(), pick(arr("data"), own, "$.output_text", "$.text"))
        .when(arr("items").isNotNull(), pick(arr("items"), own, "$.response.output_text", "$.response.text")))


def _required(parsed: Column, *names: str) -> Column:
    """The record if all named fields are there. A lambda binds it, so that it is parsed once."""
    def whole(record: Column) -> Column:
        ok = F.lit(True)
        for n in names:
            ok = ok & record[n].isNotNull()
        return F.when(ok, record)

    return F.get(F.transform(F.array(parsed), whole), F.lit(0))


def batch_status(payload: Column | str) -> Column:
    """Batch status record; NULL when ``id`` or ``status`` is missing."""
    return _required(F.from_json(payload, BATCH_STATUS), "id", "status")


def submit_response(payload: Column | str) -> Column:
    return _required(F.from_json(payload, SUBMIT_RESPONSE), "id", "status")


def upload_response(payload: Column | str) -> Column:
    return _required(F.from_json(payload, UPLOAD_RESPONSE), *UPLOAD_FIELDS)


def provider_status(status: Column | str, error_file_id: Column | str) -> Column:
    """``struct(status, reason, is_error)`` of a provider's batch status; unknown ones are errors."""
    s = F.col(status) if isinstance(status, str) else status
    e = F.col(error_file_id) if isinstance(error_file_id, str) else error_file_id
    known = F.coalesce(s.isin("completed", "failed", "cancelled", "finalizing", "in_progress", "validating"), F.lit(False))
    return F.struct(
        F.when(known, s).otherwise("error").alias("status"),
        F.when(s.isin("failed", "cancelled"), F.coalesce(e, F.lit(""))).alias("reason"),
        (~known).alias("is_error"))


def provider_status_text(status: Column) -> Column:
    """Status text used in events. Every status has one."""
    return (
        F.when(status.isin("completed", "cancelled", "failed", "finalizing", "in_progress", "validating"), status)
        .when(status == "error", "error").otherwise("running"))
