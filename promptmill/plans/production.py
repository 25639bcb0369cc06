"""Batch plans: sources to productions and requests, requests to submitted batches."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptmill import schemas
from promptmill.functions import details, hashing, requests, template
from promptmill.functions.text import as_time, stable_uuid
from promptmill.operators import numbering, upserts
from promptmill.session import bound_batches, cut_lineage
from promptmill.sources import corpus, objects


class Production(NamedTuple):
    """New rows per table, all derived from the same corpora; ``rejects`` lists failed corpora."""

    s3_objects: DataFrame
    asset_templates: DataFrame
    asset_sources: DataFrame
    productions: DataFrame
    requests: DataFrame
    request_events: DataFrame
    rejects: DataFrame


class RepeatedProduction(ValueError):
    pass


def register_objects(target: DataFrame, rows: DataFrame) -> DataFrame:
    return upserts.insert_if_absent(target, rows, ["locator"])


def new_productions(corpora: DataFrame, template_name: str, template_text: str, as_of, existing: DataFrame | None = None) -> Production:
    """Rows for one production per corpus (columns production_name, source_name, corpus).

    The corpora are read and split once, into a written table that all results derive from with
    their own columns. Keys come from names and positions, so a repeated run yields the same
    rows. A name that occurs twice, or is taken among the ``existing`` productions, fails the whole call.
    """
    now = as_time(as_of)
    if corpora.groupBy("production_name").count().where("count > 1").limit(1).count():
        raise RepeatedProduction("two corpora have one production name")
    if existing is not None and corpora.join(existing.select("production_name"), "production_name", "left_semi").limit(1).count():
        raise RepeatedProduction("a production of that name exists")
    sources = corpora.select(
        "production_name", "source_name", "corpus", objects.content_locator("corpus").alias("locator"),
        F.sha2("corpus", 256).alias("digest"), F.octet_length(F.encode("corpus", "UTF-8")).cast("bigint").alias("bytes"))
    split = cut_lineage(corpus.split_corpora(sources), "productions")
    good = split.where(F.col("reason").isNull())
    items = good.select("production_name", "source_name", F.inline("items"))

    production_id = stable_uuid(F.lit("production"), "production_name")
    template_id = stable_uuid(F.lit("template"), F.lit(template_name))
    source_id = stable_uuid(F.lit("source"), "source_name", "locator")
    tpl = objects.index_rows(corpora.sparkSession.createDataFrame([(template_text,)], "body string"), "body", "template", None, as_of)
    src = good.select(
        "locator", F.lit("source").alias("kind"), "bytes", F.unhex("digest").alias("sha256"), F.lit(None).cast("string").alias("content_type"), now.alias("created_at"))
    keyed = items.withColumn("production_id", production_id).withColumn("request_id", stable_uuid(F.lit("request"), "production_id", "item_index"))
    look = template.item_context(F.col("production_name"), F.col("item_index"), F.col("body"), F.col("item_meta"), F.col("header_toml"))
    return Production(
        s3_objects=tpl.unionByName(src).dropDuplicates(["locator"]),
        asset_templates=tpl.select(template_id.alias("template_id"), F.lit(template_name).alias("template_name"), F.col("locator").alias("s3_locator"), now.alias("created_at")),
        asset_sources=good.select(source_id.alias("source_id"), "source_name", F.col("locator").alias("s3_locator"), now.alias("created_at")).dropDuplicates(["source_id"]),
        productions=good.select(
            production_id.alias("production_id"), "production_name", template_id.alias("template_id"), source_id.alias("source_id"), now.alias("created_at")),
        requests=corpus.with_item_meta(keyed).select(
            "request_id", "production_id", "item_index", "item_meta", template.to_column(template_text, look).alias("request_text"),
            F.lit("entered").alias("state"), now.alias("created_at"), now.alias("updated_at")),
        request_events=keyed.select(
            F.xxhash64("request_id", F.lit("entered")).alias("event_id"), "request_id", F.lit("entered").alias("state"),
            details.entered(F.lit(template_name), F.col("source_name"), F.col("item_index"), F.col("header_toml")).alias("details"), now.alias("occurred_at")),
        rejects=split.where(F.col("reason").isNotNull()).select("production_name", "source_name", "reason"))


def save_production(new: Production, path: str) -> None:
    """Write all tables into a new folder. The productions come last: where they are, the rest is whole.

    A folder that has them is an error; one that was left unfinished is written anew.
    """
    tables = new._asdict()
    try:
        new.productions.sparkSession.read.parquet(f"{path}/productions")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        raise RepeatedProduction(f"productions are saved there: {path}")
    for name in (*(n for n in tables if n != "productions"), "productions"):
        tables[name].write.mode("overwrite").parquet(f"{path}/{name}")


def cache_keys(grouped: DataFrame, batch: str, pos: str, text: str) -> DataFrame:
    """Cache key per batch over its texts in order, a newline before each. Batches are of bounded size."""
    joined = grouped.groupBy(batch).agg(numbering.join_bounded(pos, text, "\n").alias("_j"), F.count(F.lit(1)).alias("request_count"))
    return joined.select(batch, "request_count", hashing.cache_key(F.concat(F.lit("\n"), "_j")).alias("cache_key"))


def submission_lines(
    rows: DataFrame, order_by: Sequence[str], system_text: str, model: str, effort: str | None = None, size: int = schemas.BATCH_SIZE,
) -> DataFrame:
    """Requests (request_id, request_text) to numbered batches with one JSON line per request.

    A batch's lines, texts and cache key are produced from one grouped row of at most ``size``
    texts, so the texts are shuffled once after the numbering and no join follows.
    """
    bound_batches(rows.sparkSession, hashing.BATCH_BYTES)  # a micro-batch has a session of its own
    grouped = numbering.fixed_groups(rows, size, order_by)
    members = F.array_sort(F.collect_list(F.struct("pos", "request_id", "request_text")))
    batches = grouped.groupBy("batch_no").agg(members.alias("_m"))
    joined = F.concat(F.lit("\n"), F.array_join(F.transform("_m", lambda m: m["request_text"]), "\n"))
    keyed = batches.withColumn("cache_key", hashing.cache_key(joined)).select("batch_no", "cache_key", F.inline("_m"))
    line = requests.request_line(
        F.col("request_id"), F.lit(system_text), F.col("request_text"), F.col("cache_key"), F.lit(model), None if effort is None else F.lit(effort))
    return keyed.select("batch_no", "pos", "request_id", "cache_key", line.alias("line"))


def manifests(runs: DataFrame, document: str, file_id: Column, batch_id: Column, model: str, configured_key: Column | None = None) -> DataFrame:
    """Identifiers to keep after loading, one row per run."""
    hashed = runs.withColumn("_h", hashing.fnv1a64_hex(document))
    derived = F.concat(F.lit(schemas.CACHE_KEY_PREFIX), "_h")
    return hashed.select(
        (derived if configured_key is None else F.coalesce(configured_key, derived)).alias("prompt_cache_key"), F.col("_h").alias("document_hash_fnv64"),
        file_id.alias("batch_input_file_id"), batch_id.alias("batch_id"), F.lit(schemas.REQUEST_URL).alias("endpoint"),
        F.lit(schemas.COMPLETION_WINDOW).alias("completion_window"), F.lit(model).alias("model_used"))
