"""JSONL files: request files out, result files in, manifests and summaries."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptmill.functions import variants
from promptmill.functions.text import once
from promptmill.schemas import MANIFEST_FIELDS, RUN_MANIFEST
from promptmill.sources.lines import fix_places, numbered, numbered_lines, stream_splits


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of JSONL files, split by Spark; a bad line never fails its file."""
    return spark.read.text(path, lineSep="\n").select(F.col("value").alias("line")).where(F.col("line") != "")


def _by_batch(lines: DataFrame) -> DataFrame:
    """Numbered lines of result files: batch_fk (the file's base name), line_no, line; empty lines count but are left out."""
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return lines.where(F.col("line") != "").select(name.alias("batch_fk"), "line_no", "line")


def read_result_files(spark: SparkSession, folder: str) -> DataFrame:
    """Numbered lines of result files of any size; a file is read in splits."""
    return _by_batch(numbered_lines(spark, folder))


def stream_result_files(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Result files as they arrive in a folder, as lines of splits; ``number_result_lines`` numbers them in each micro-batch."""
    return stream_splits(spark, folder, files_per_trigger)


def number_result_lines(lines: DataFrame) -> DataFrame:
    """A micro-batch of ``stream_result_files`` as numbered lines."""
    return _by_batch(numbered(fix_places(lines)))


def result_lines(df: DataFrame, line: str = "line") -> DataFrame:
    """Decode each non-empty line on its own: ``root`` is NULL on a bad one."""
    decoded = df.where(F.col(line) != "").select(*df.columns, once(F.try_parse_json(line)).alias("root"))
    return decoded.withColumn("line_ok", F.col("root").isNotNull())


def with_main_text(df: DataFrame, line: str = "line") -> DataFrame:
    """Add ``custom_id`` and ``content`` (NULL on bad lines and blank answers).

    Decoding and picking the body run once per line.
    """
    decoded = df.where(F.col(line) != "").select(*df.columns, once(F.try_parse_json(line)).alias("root"))
    bodies = decoded.select(
        *df.columns, F.col("root").isNotNull().alias("line_ok"), variants.string_at(F.col("root"), "$.custom_id").alias("custom_id"),
        once(variants.response_body(F.col("root"))).alias("_body"))
    return bodies.select(*df.columns, "line_ok", "custom_id", variants.body_text(F.col("_body")).alias("content"))


def write_request_jsonl(lines: DataFrame, path: str, batch: str = "batch_no", order: str = "pos", line: str = "line", batches_per_folder: int = 1000) -> None:
    """Request lines as JSONL, ordered by batch and position, one folder per block of batches.

    A folder per batch would mean one tiny file per ten requests; a block keeps files large while
    the lines of a batch stay together and in order.
    """
    block = F.floor(F.col(batch) / batches_per_folder).cast("bigint")
    (lines.withColumn("block", block).repartition("block").sortWithinPartitions("block", batch, order)
     .select("block", F.col(line).alias("value")).write.partitionBy("block").text(path))


def materialise_results(new_results: DataFrame, path: str, buckets: int = 64) -> None:
    """Append new results, grouped by a hash of the id: no file per row.

    The rebalance hint gathers each bucket in a few well-sized tasks, however many rows it has.
    """
    bucketed = new_results.withColumn("bucket", F.pmod(F.xxhash64("custom_id"), F.lit(buckets)).cast("int"))
    (bucketed.hint("rebalance", F.col("bucket")).write.mode("append").partitionBy("bucket").parquet(path))


def stored_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids in a results store; none when it does not exist yet."""
    try:
        return spark.read.schema("custom_id string").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "custom_id string")


def write_manifest(row: DataFrame, path: str) -> None:
    """Run manifests as JSON, one row per run."""
    row.select(*MANIFEST_FIELDS).write.json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_MANIFEST).json(path)


def write_summary(summary: DataFrame, path: str) -> None:
    summary.write.json(path)
