"""The file-based steps as jobs over many runs at once: load, fetch, extract, annotate.

A run is one document with one prompts file. Where a command line would handle one run, these
take a table of them.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptmill.functions import hashing, requests
from promptmill.functions.text import as_time, format_moment
from promptmill.operators import numbering, pages, results
from promptmill.schemas import CACHE_KEY_PREFIX
from promptmill.session import cut_lineage
from promptmill.sources import corpus, jsonl, objects


class Loaded(NamedTuple):
    lines: DataFrame      # run, index, custom_id, prompt, cache_key, line
    rejected: DataFrame   # runs without a valid prompt


def load_requests(
    runs: DataFrame, run: str, as_of, model: str, effort: str = "high", prefix: str = "", postfix: str = "", configured_key: Column | None = None,
) -> Loaded:
    """Request lines of every run (columns ``run``, document, prompts): one line per valid prompt.

    Each line carries the whole document as context, so the documents are joined in last, after
    the prompts were numbered.
    """
    prompts = numbering.number_rows(corpus.prompt_blocks(runs.select(run, "prompts")), ["block_no"], [run], "index")
    hashed = runs.select(run, "document").withColumn("_h", hashing.fnv1a64_hex("document"))
    derived = F.concat(F.lit(CACHE_KEY_PREFIX), "_h")
    documents = hashed.select(run, "document", (derived if configured_key is None else F.coalesce(configured_key, derived)).alias("cache_key"))
    custom_id = requests.numbered_id(format_moment(as_time(as_of)), F.col("index"))
    line = requests.request_line(
        custom_id, requests.document_system_text(F.col("document"), prefix, postfix), F.col("prompt"), F.col("cache_key"), F.lit(model), F.lit(effort))
    lines = prompts.join(documents, run).select(run, "index", custom_id.alias("custom_id"), "prompt", "cache_key", line.alias("line"))
    return Loaded(lines, corpus.files_without_prompts(runs.select(run, "prompts"), run))


def fetch_results(spark: SparkSession, lines: DataFrame, statuses: DataFrame, store: str, summary: str, by: str = "batch_fk") -> DataFrame:
    """Store the new results of completed batches and write one summary row per batch.

    ``lines`` has the batch, ``line_no`` and ``line``; ``statuses`` the batch, ``status`` and
    ``request_counts``. Ids already in ``store`` are skipped. Returns the summary.
    """
    completed = statuses.where(F.col("status") == "completed")
    wanted = lines.join(completed.select(by), by, "left_semi")
    known = jsonl.stored_ids(spark, store)
    classified = cut_lineage(results.classify_lines(jsonl.with_main_text(wanted), known), "classified")
    counts = results.fetch_summary(classified, completed, [by])
    new = classified.where(F.col("line_class") == "new").select("custom_id", "line_no", "line")
    jsonl.materialise_results(results.last_per_id(new, "line_no"), store)
    jsonl.write_summary(counts, summary)
    return counts


def extract_documents(lines: DataFrame, key: str, order: str, path: str, render: Column | None = None) -> DataFrame:
    """Write the extracted texts of each result file as an HTML document; returns its line counts."""
    extracted = cut_lineage(jsonl.with_main_text(lines), "extracted")
    texts = extracted.where(F.col("content").isNotNull()).select(key, order, "content")
    results.write_documents(results.extracted_document(texts, [key], [order], "content", render), [key], path)
    return results.extract_counts(extracted, [key])


def annotate_files(spark: SparkSession, folder: str, path: str) -> None:
    """Annotate HTML files and write them under their own names as a table (name, html)."""
    files = objects.read_files(spark, [folder]).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.decode("content", "UTF-8").alias("html"))
    pages.annotated_pages(files).write.parquet(path)
