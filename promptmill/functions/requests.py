"""Request lines: one JSON object per request for the provider's batch input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from promptmill.functions.text import pad4
from promptmill.schemas import MAX_OUTPUT_TOKENS, REQUEST_METHOD, REQUEST_URL

# Fixed value: sentence between the document and the closing instructions.
CONTEXT_SENTENCE = "\n\n\nUse these project details as the authoritative context for your responses.\n"


def _message(role: str, text: Column) -> Column:
    part = F.struct(F.lit("input_text").alias("type"), text.alias("text"))
    return F.struct(F.lit(role).alias("role"), F.array(part).alias("content"))


def request_line(
    custom_id: Column, system_text: Column, user_text: Column, cache_key: Column, model: Column, effort: Column | None = None,
) -> Column:
    """JSON text of one request. ``reasoning`` is left out where ``effort`` is NULL."""
    fields = [
        model.alias("model"), cache_key.alias("prompt_cache_key"), F.lit(MAX_OUTPUT_TOKENS).alias("max_output_tokens"),
        F.array(_message("system", system_text), _message("user", user_text)).alias("input")]
    if effort is not None:
        fields.append(F.when(effort.isNotNull(), F.struct(effort.alias("effort"))).alias("reasoning"))
    return F.to_json(F.struct(
        custom_id.alias("custom_id"), F.lit(REQUEST_METHOD).alias("method"), F.lit(REQUEST_URL).alias("url"),
        F.struct(*fields).alias("body")))


def document_system_text(document: Column, prefix: str, postfix: str) -> Column:
    """System text that carries a whole document between two fixed instruction texts."""
    return F.concat(F.lit(prefix), document, F.lit(CONTEXT_SENTENCE), F.lit(postfix))


def numbered_id(moment: Column, index: Column) -> Column:
    return F.concat(F.lit("q_"), moment, F.lit("_"), pad4(index))
