"""Lines of text files by place: files are read in splits, and a line's number is found in two steps.

A split knows how many lines it holds; the lines before it in its file are those of its earlier splits (a prefix
sum over one row per split), and its own are in the order in which its task read them. So no file is one task or one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promptmill.session import cut_lineage

SPLIT = ["path", "_block"]


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """(path, _block, line): lines with their file and where their split begins in it. Empty lines are lines, too."""
    return _located(spark.read.option("lineSep", "\n").text(path))


def stream_splits(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """``read_splits`` of files as they arrive in a folder; a micro-batch has whole files. Number them there, with ``fix_places``."""
    reader = spark.readStream.option("lineSep", "\n")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return _located(reader.text(folder))


def _located(lines: DataFrame) -> DataFrame:
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.col("value").alias("line"))


def fix_places(lines: DataFrame, **more: Column) -> DataFrame:
    """Lines of splits, written once with ``_seq``, which rises within a split, and with what ``more`` names."""
    return cut_lineage(lines.withColumn("_seq", F.monotonically_increasing_id()).withColumns(more), "lines")


def before_splits(per_split: DataFrame, value: str) -> DataFrame:
    """(path, _block, _before): the sum of ``value`` over the earlier splits of each file; ``per_split`` has one row per split."""
    earlier = Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return per_split.select(*SPLIT, F.coalesce(F.sum(value).over(earlier), F.lit(0)).alias("_before"))


def numbered(fixed: DataFrame) -> DataFrame:
    """Lines of ``fix_places`` with ``line_no``, from 1 in each file."""
    per_split = fixed.groupBy(*SPLIT).agg(F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_first"))
    starts = per_split.join(before_splits(per_split, "_n"), SPLIT)
    placed = fixed.join(starts.select(*SPLIT, "_first", "_before"), SPLIT)
    return placed.withColumn("line_no", F.col("_before") + F.col("_seq") - F.col("_first") + 1).drop("_before", "_first", "_seq", "_block")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, line_no) of text files of any size."""
    return numbered(fix_places(read_splits(spark, path)))
