"""Corpus files: delimited items with front matter, and numbered prompt blocks.

Every function takes one corpus per row, so a folder of files, a table of texts or a stream
of either all work. A row is split in place (no shuffle) and then exploded.
"""

from __future__ import annotations

import json
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptmill.functions.text import WS, WS_NO_NEWLINE, header_value, once, rewrite_prompt, strip_ws
from promptmill.operators.joins import join_hot
from promptmill.session import cut_lineage, ship_package
from promptmill.sources.lines import before_splits, fix_places, read_splits

# Fixed value: an item header opens and closes with this line.
DELIMITER = "-*-*-*-*-*-*-*-*-*-"
DELIMITER_LINE = rf"(?dm)^{WS_NO_NEWLINE}*-(?:\*-){{9}}{WS_NO_NEWLINE}*(?:\n|\z)"
BLANK_LINES = rf"\n{WS}*\n"  # no repeated group: Java matches those recursively and long runs overflow
PROMPT_BLOCK = rf"(?s)^([0-9]+){WS}*:(.*)$"

UNCLOSED = "header opened but never closed"
BAD_HEADER = "header line without '='"


class Corpus(NamedTuple):
    items: DataFrame
    rejects: DataFrame


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One row per file. A file is one task; for very large ones there is ``large_corpus_items``."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_name"), F.col("value").alias("corpus"))


def _lines(c: Column) -> Column:
    return F.split(c, "\n")


def _ended(c: Column) -> Column:
    return F.when((c == "") | c.endswith("\n"), c).otherwise(F.concat(c, F.lit("\n")))


def _counts(line: Column) -> Column:
    s = strip_ws(line)
    return (s != "") & ~s.startswith("#")


def _bad_header(header: Column) -> Column:
    return F.exists(_lines(header), lambda ln: _counts(ln) & ~ln.contains("="))


def _pairs(segments: Column, build) -> Column:
    """One array element per (header, body) pair: segments 1 and 2, 3 and 4, ..."""
    n = F.floor((F.size(segments) - 1) / 2).cast("int")
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), build))


def split_corpora(df: DataFrame, corpus: str = "corpus") -> DataFrame:
    """Each corpus row with ``items`` (numbered from 1) and ``reason``, why it is rejected (else NULL).

    Text before the first delimiter is dropped. The split is computed once per row.
    """
    rest = [c for c in df.columns if c != corpus]
    seg = F.col("_seg")
    split = df.select(*rest, once(F.split(F.col(corpus), DELIMITER_LINE)).alias("_seg"))
    bad = F.coalesce(F.exists(_pairs(seg, lambda i: F.get(seg, 2 * i - 1)), _bad_header), F.lit(False))
    items = _pairs(seg, lambda i: F.struct(
        i.alias("item_index"), _ended(F.get(seg, 2 * i - 1)).alias("header_toml"), _ended(F.get(seg, 2 * i)).alias("body")))
    return split.select(*rest, F.when(bad, BAD_HEADER).when(F.size(seg) % 2 == 0, UNCLOSED).alias("reason"), items.alias("items"))


def source_items(df: DataFrame, corpus: str = "corpus") -> Corpus:
    """Items of every corpus row; a row with an error yields no items and one reject."""
    rest = [c for c in df.columns if c != corpus]
    split = split_corpora(df, corpus)
    return Corpus(
        split.where(F.col("reason").isNull()).select(*rest, F.inline("items")),
        split.where(F.col("reason").isNotNull()).select(*rest, "reason"))


def large_corpus_items(spark: SparkSession, path: str) -> Corpus:
    """Items of corpus files of any size, by ``source_name``: a file is read in splits, line by line.

    A line's place is its split and its row in it, so numbering needs no sort of the file: the
    delimiters before a line are those of earlier splits (one count per split) plus those earlier
    in its own. The lines of an item are then brought together; only an item has to fit into memory.
    """
    fixed = fix_places(read_splits(spark, path), _d=(strip_ws("line") == DELIMITER).cast("int")).withColumnRenamed("path", "source_name")
    block = ["source_name", "_block"]
    counts = fixed.groupBy(*block).agg(F.sum("_d").alias("_n")).withColumnRenamed("source_name", "path")
    before = before_splits(counts, "_n").withColumnRenamed("path", "source_name")
    so_far = Window.partitionBy(*block).orderBy("_seq").rowsBetween(Window.unboundedPreceding, 0)  # a split is of bounded size
    placed = fixed.withColumn("_seen", F.sum("_d").over(so_far)).join(before, block)
    segment = F.col("_before") + F.col("_seen")  # odd: header, even: body
    content = placed.select(*block, "_seq", "line", "_d", segment.alias("_segment")).where(F.col("_segment") > 0)
    in_header, is_text = F.col("_segment") % 2 == 1, F.col("_d") == 0

    def text(wanted: Column) -> Column:
        rows = F.array_sort(F.collect_list(F.when(wanted & is_text, F.struct("_block", "_seq", "line"))))
        return F.array_join(F.transform(rows, lambda r: F.concat(r["line"], F.lit("\n"))), "")

    whole = content.groupBy("source_name", F.floor((F.col("_segment") + 1) / 2).cast("int").alias("item_index")).agg(
        text(in_header).alias("header_toml"), text(~in_header).alias("body"), F.max("_segment").alias("_last"))
    checked = cut_lineage(whole.withColumn(
        "_reason", F.when(_bad_header(F.col("header_toml")), BAD_HEADER).when(F.col("_last") % 2 == 1, UNCLOSED)), "corpus-items")
    rejects = checked.where(F.col("_reason").isNotNull()).groupBy("source_name").agg(F.min_by("_reason", "item_index").alias("reason"))
    items = join_hot(checked, rejects.select("source_name"), ["source_name"], "left_anti")
    return Corpus(items.select("source_name", "item_index", "header_toml", "body"), rejects)


def _entry(line: Column) -> Column:
    at = F.instr(line, "=")
    return F.struct(
        strip_ws(F.substr(line, F.lit(1), at - 1)).alias("key"),
        header_value(F.substr(line, at + 1)).alias("value"))


def front_matter_entries(items: DataFrame, header: str = "header_toml") -> DataFrame:
    """Long form of the headers: one row per ``key = value`` line (line_no, key, vtype, json)."""
    rest = [c for c in items.columns if c not in (header, "body")]
    lines = items.select(*rest, F.posexplode(_lines(F.col(header))).alias("line_no", "_line")).where(_counts(F.col("_line")))
    return lines.select(*rest, (F.col("line_no") + 1).alias("line_no"), _entry(F.col("_line")).alias("_e")).select(
        *rest, "line_no", "_e.key", "_e.value.vtype", "_e.value.json")


def _json(node: dict | str) -> str:
    """JSON text of nested objects whose leaves are JSON text already."""
    if isinstance(node, str):
        return node
    return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_json(v)}" for k, v in sorted(node.items())) + "}"


def _nest(keys: list[str], values: list[str]) -> str:
    """Dotted keys to nested objects; later lines win, an object replaces a scalar on its path."""
    root: dict = {}
    for key, value in zip(keys, values):
        *path, leaf = key.split(".")
        node = root
        for name in path:
            child = node.get(name)
            if not isinstance(child, dict):
                child = node[name] = {}
            node = child
        node[leaf] = value
    return _json(root)


@F.pandas_udf(T.StringType())
def nest_entries(keys: pd.Series, values: pd.Series) -> pd.Series:
    return pd.Series([_nest(list(k), list(v)) for k, v in zip(keys, values)], dtype=object)


def with_item_meta(items: DataFrame, header: str = "header_toml") -> DataFrame:
    """Add ``item_meta``, the header as a JSON object. Only keys and values go to Python, not bodies."""
    ship_package(items.sparkSession)
    entries = F.transform(F.filter(_lines(F.col(header)), _counts), _entry)
    return items.withColumn("item_meta", nest_entries(
        F.transform(entries, lambda e: e["key"]), F.transform(entries, lambda e: e["value"]["json"])))


def prompt_blocks(df: DataFrame, prompts: str = "prompts") -> DataFrame:
    """Blocks ``N: title`` separated by blank lines; anything else is dropped without an error."""
    rest = [c for c in df.columns if c != prompts]
    blocks = F.split(F.replace(F.col(prompts), F.lit("\r\n"), F.lit("\n")), BLANK_LINES)
    rows = df.select(*rest, once(blocks).alias("_bs")).select(*rest, F.posexplode("_bs").alias("block_no", "_b")).withColumn("_b", strip_ws("_b"))
    return (
        rows.where(F.col("_b").rlike(PROMPT_BLOCK))
        .select(
            *rest, "block_no", F.regexp_extract("_b", PROMPT_BLOCK, 1).try_cast("bigint").alias("number"),
            strip_ws(F.regexp_extract("_b", PROMPT_BLOCK, 2)).alias("title"))
        .where((F.col("title") != "") & F.col("number").isNotNull())
        .withColumn("prompt", rewrite_prompt("number", "title")))


def files_without_prompts(df: DataFrame, key: str, prompts: str = "prompts") -> DataFrame:
    """Prompt files holding no valid block, which is an error of the whole file."""
    return df.select(key).join(prompt_blocks(df, prompts).select(key).distinct(), key, "left_anti")
