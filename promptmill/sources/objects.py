"""Stored objects and assets: index, listing, reading, decoding, versions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promptmill.functions.text import as_time
from promptmill.session import cut_lineage, hashable, ship_package

BASE64_ALPHABET = "A-Za-z0-9+/="


def _uuid_shaped(digest: Column) -> Column:
    return F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def content_locator(content: str) -> Column:
    """Locator of a stored text, derived from its content."""
    return _uuid_shaped(F.sha2(F.col(content), 256))


def index_rows(df: DataFrame, content: str, kind: Column | str, content_type: str | None, created_at, key: Column | str | None = None) -> DataFrame:
    """Index rows for stored texts: locator, kind, bytes, sha256, content_type, created_at.

    The locator is derived from the content hash (or from ``key``), so repeating the job
    finds its own objects instead of storing them again.
    """
    digest = F.sha2(F.col(content), 256)
    locator = content_locator(content) if key is None else _uuid_shaped(F.md5(F.col(key) if isinstance(key, str) else key))
    return df.select(
        locator.alias("locator"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"),
        F.octet_length(F.encode(F.col(content), "UTF-8")).cast("bigint").alias("bytes"), F.unhex(digest).alias("sha256"),
        F.lit(content_type).cast("string").alias("content_type"), as_time(created_at).alias("created_at"))


def list_by_prefix(objects: DataFrame, prefixes: DataFrame, key: str = "key", prefix: str = "prefix") -> DataFrame:
    """Objects under each prefix, by a sweep over the sorted keys.

    In byte order the keys under a prefix are an interval that begins at the prefix, so the last prefix at or
    before a key starts with every prefix of that key. Objects and prefixes are put in one order by ranges of
    keys; each prefix brings the prefixes around it (``_nested``), and an object looks only at those of the last one.
    Ranges that begin amid a prefix get it from the ranges before them: one row per range is
    broadcast. Every object is shuffled once, however many prefixes there are, and repeated keys
    are dealt over several ranges. Null keys and null prefixes match nothing; repeated prefixes count once.
    """
    ship_package(objects.sparkSession)
    salt = [c for c in objects.columns if hashable(objects.schema[c].dataType)]
    nested = _nested(prefixes.select(F.col(prefix).alias("prefix")))
    kind = objects.select(F.struct("*").alias("_o")).schema["_o"].dataType
    rows = objects.where(F.col(key).isNotNull()).select(
        F.col(key).alias("_at"), F.lit(1).alias("_kind"), F.xxhash64(*salt).alias("_salt"),
        F.struct("*").alias("_o"), F.lit(None).cast("array<string>").alias("_chain"))
    marks = nested.select(
        F.col("prefix").alias("_at"), F.lit(0).alias("_kind"), F.lit(0).cast("bigint").alias("_salt"), F.lit(None).cast(kind).alias("_o"), "_chain")
    order = ["_at", "_kind", "_salt"]
    ranged = rows.unionByName(marks).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    swept = cut_lineage(ranged.mapInArrow(_last_chain, ranged.schema).drop("_salt"), "swept-keys")
    # the last chain of every range, and for ranges without a prefix that of an earlier one
    spans = swept.groupBy("_part").agg(F.max_by("_chain", F.when(F.col("_kind") == 0, F.col("_at"))).alias("_mine"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select("_part", F.last("_mine", ignorenulls=True).over(before).alias("_carried"))
    chain = F.coalesce("_chain", "_carried")
    found = swept.where(F.col("_kind") == 1).join(F.broadcast(carried), "_part")
    return found.select(F.explode(F.filter(chain, lambda p: F.startswith(F.col("_at"), p))).alias("prefix"), *[F.col("_o")[c].alias(c) for c in objects.columns if c != "prefix"])


def _nested(prefixes: DataFrame) -> DataFrame:
    """Each prefix with all prefixes that it starts with, itself among them: as many at most as it is long, and one."""
    wanted = prefixes.where(F.col("prefix").isNotNull()).distinct()
    cuts = wanted.select("prefix", F.explode(F.sequence(F.lit(0), F.length("prefix"))).alias("_n")).select(
        "prefix", F.substr(F.col("prefix"), F.lit(1), F.col("_n")).alias("_outer"))
    return cuts.join(wanted.select(F.col("prefix").alias("_outer")), "_outer").groupBy("prefix").agg(F.sort_array(F.collect_list("_outer")).alias("_chain"))


def _last_chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fill ``_chain`` with that of the last row that has one."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = batch.column("_chain")
        known = pa.concat_arrays([pa.nulls(1, own.type) if last is None else last, own])
        at = np.maximum.accumulate(np.where(own.is_valid().to_numpy(zero_copy_only=False), np.arange(1, len(own) + 1), 0))
        filled = known.take(pa.array(at))
        last = filled.slice(len(filled) - 1)
        yield batch.set_column(batch.schema.get_field_index("_chain"), "_chain", filled)


def list_files(spark: SparkSession, paths: list[str], pattern: str | None = None) -> DataFrame:
    """Files under several folders, recursively: path, size, time. Contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(paths).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified_at"))


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(paths).select("path", "content")


def read_objects(store: DataFrame, wanted: DataFrame, key: str = "locator") -> DataFrame:
    """Contents of the wanted locators."""
    return store.join(wanted.select(key).distinct(), key, "left_semi")


def existing_ids(paths: DataFrame, path: str = "path") -> DataFrame:
    """Base names of the ``.json`` files among the paths (summary files count as well)."""
    name = F.regexp_extract(F.col(path), r"([^/]*)\.json$", 1)
    return paths.where(F.col(path).endswith(".json")).select(name.alias("custom_id")).distinct()


def read_existing_ids(spark: SparkSession, folder: str) -> DataFrame:
    return existing_ids(list_files(spark, [folder], "*.json"))


def decode_base64(df: DataFrame, encoded: str) -> DataFrame:
    """Lenient decode: characters outside the alphabet are ignored; undecodable rows have NULL content."""
    clean = F.regexp_replace(F.col(encoded), f"[^{BASE64_ALPHABET}]+", "")
    return df.withColumn("content", F.try_to_binary(clean, F.lit("base64"))).withColumn("size", F.octet_length("content").cast("bigint")).drop(encoded)


def latest_version(assets: DataFrame, key: str = "eid", version: str = "version") -> DataFrame:
    """The highest version per asset, by a map-side combined aggregate instead of a window."""
    return assets.groupBy(key).agg(F.max_by(F.struct(*[c for c in assets.columns if c != key]), version).alias("_r")).select(key, "_r.*")
