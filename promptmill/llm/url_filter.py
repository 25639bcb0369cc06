"""URL filters as a sort-merge range join, in DataFrame operations only.

With the labels of its host reversed (``org.example.www.``) a rule's host is a prefix of the keys
of all hosts it fits, that is, an interval of the sorted keys; intervals of rules nest or are
disjoint. So is, within one host, the interval of keys that begin with a rule's path. A sweep over
the sorted keys carries the stack of rules that are open at a key: rules bring the stack of the
rules around them, and every key takes over the latest stack and drops what has ended. There are
two sweeps, one over distinct hosts, one over the urls of hosts that have rules.

Sweeps run per bucket of keys, and a bucket with many rows is dealt into several sweeps, each with
the bucket's rules; a host with a third of all urls is many sweeps.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_SWEEP = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``, also for null."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def host_key(host: Column) -> Column:
    """Labels from the last to the first, each with a dot behind it."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _bucket(key: Column) -> Column:
    """The first two labels of a key: rules of two labels or more stay within one bucket."""
    return F.substring_index(key, ".", 2)


def _dealt(rows: DataFrame, by: list[str], salt_of: Column) -> tuple[DataFrame, DataFrame]:
    """``rows`` with a ``salt``, and how many salts each bucket has: its rows, counted before any shuffle of them, over ``ROWS_PER_SWEEP``."""
    salts = rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / ROWS_PER_SWEEP).cast("int").alias("salts"))
    many = salts.where("salts > 1")  # few: each has at least ROWS_PER_SWEEP rows
    dealt = rows.join(many, by, "left").withColumn("salt", F.pmod(salt_of, F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    return dealt, salts


def _sweep(rules: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    """``keys`` with ``open``, the stack of rules around each: array of (lo, item), outermost first.

    ``rules`` (by, lo, stack) hold the stacks, each ending with the rule itself; lo is its prefix.
    """
    columns = keys.columns
    opened = rules.select(*by, F.col("lo").alias("key"), F.lit(0).alias("kind"), "stack")
    points = keys.withColumn("kind", F.lit(1))
    events = points.unionByName(opened, allowMissingColumns=True)
    order = Window.partitionBy(*by).orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = events.withColumn("stack", F.last("stack", ignorenulls=True).over(order)).where("kind = 1")
    still = F.filter(F.coalesce("stack", F.array().cast(rules.schema["stack"].dataType)), lambda r: F.col("key").startswith(r["lo"]))
    return swept.select(*columns, still.alias("open"))


def _stacks(rules: DataFrame, by: list[str], depth: Column | None = None) -> DataFrame:
    """Rules (by, lo, item) with the stack of rules around each, equal prefixes together: (by, lo, stack).

    A sweep over the rules themselves: what encloses a rule is among the rules that it is a prefix-extension of,
    found by an equi-join on its prefixes, of which there are at most as many as it has characters.
    """
    once = rules.groupBy(*by, "lo").agg(F.array_sort(F.collect_set("item")).alias("items"))
    cut = once.select(*by, F.col("lo").alias("inner"), F.explode(F.transform(F.sequence(F.lit(0), F.length("lo")), lambda i: F.substring("lo", 1, i))).alias("lo"))
    around = cut.join(once, [*by, "lo"]).groupBy(*by, "inner").agg(F.array_sort(F.collect_list(F.struct("lo", "items"))).alias("s"))
    flat = F.flatten(F.transform("s", lambda e: F.transform(e["items"], lambda x: F.struct(e["lo"].alias("lo"), x.alias("item")))))
    return around.select(*by, F.col("inner").alias("lo"), flat.alias("stack"))


def rule_table(spark, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """Rules (verdict, host, path) as a table."""
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def judge(pages: DataFrame, rules: DataFrame, id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) of every row of ``pages``.

    A rule (verdict, host, path) fits its host and all subdomains of it where the url's path begins
    with the rule's; the longest rule (host and path together, then the host) wins, and among rules
    that differ in the verdict only, block does. ``rule`` is its host and path, null where ``default``
    holds. Rules with a null verdict, host or path are left out, a null path of a url cannot occur.
    Rows that repeat are judged each.
    """
    known = rules.select("verdict", F.translate("host", UPPER, LOWER).alias("host"), "path").where("verdict is not null and host is not null and path is not null")
    known = known.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # 'block' is after 'allow'
    host, path = url_parts(F.col(url))
    parsed = pages.select(F.col(id).alias("_id"), host.alias("host"), path.alias("path"))

    # first sweep: distinct hosts against the hosts of rules
    hosts = parsed.groupBy("host").agg(F.count(F.lit(1)).alias("urls")).withColumn("key", host_key(F.col("host")))
    hosts = hosts.select("host", "urls", "key", _bucket(F.col("key")).alias("bucket"))
    dealt, salts = _dealt(hosts, ["bucket"], F.xxhash64("host"))
    bounds = known.select("host").distinct().withColumn("lo", host_key(F.col("host")))
    # a rule of one label reaches over the buckets below it, any other lies in its own
    top = F.substring_index("bucket", ".", 1)
    lies = salts.withColumn("top", F.concat(top, F.lit("."))).withColumnRenamed("bucket", "b")
    one = bounds.where(F.size(F.split("host", r"\.")) == 1)
    inside = lies.join(one, F.col("top") == F.col("lo")).select(F.col("b").alias("bucket"), "salts", "lo", F.col("host").alias("item")).unionByName(
        lies.join(bounds.where(F.size(F.split("host", r"\.")) > 1).withColumn("bucket", _bucket(F.col("lo"))), F.col("b") == F.col("bucket")).select(
            "bucket", "salts", "lo", F.col("host").alias("item")))
    stacked = _stacks(inside.select("bucket", "lo", "item"), ["bucket"]).join(salts, "bucket").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    met = _sweep(stacked.select("bucket", "salt", "lo", "stack"), dealt.select("bucket", "salt", "key", "host", "urls"), ["bucket", "salt"])

    # the rules of each host, then the second sweep: its urls against the paths of these rules
    of_host = met.select("host", "urls", F.explode("open").alias("r")).select(F.col("host").alias("at"), "urls", F.col("r.item").alias("host"))
    mine = of_host.join(known, "host").select(
        F.col("at").alias("host"), "urls", F.col("path").alias("lo"),
        F.struct(F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("labels"), F.concat("host", "path").alias("rule"), "verdict").alias("item"))
    ruled = mine.groupBy("host").agg(F.ceil(F.max("urls") / ROWS_PER_SWEEP).cast("int").alias("salts"))
    placed = parsed.join(ruled, "host", "left").withColumn("salt", F.pmod(F.xxhash64("_id", "path"), F.coalesce("salts", F.lit(1))).cast("int"))
    free, urls = placed.where("salts is null"), placed.where("salts is not null")
    paths = _stacks(mine.select("host", "lo", "item"), ["host"]).join(ruled, "host").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    judged = _sweep(paths.select("host", "salt", "lo", "stack"), urls.select("host", "salt", F.col("path").alias("key"), "_id"), ["host", "salt"])
    won = F.element_at(F.array_sort(F.transform("open", lambda r: r["item"])), -1)
    hit = judged.withColumn("won", F.when(F.size("open") > 0, won)).select(
        F.col("_id").alias(id), "host", F.col("key").alias("path"), F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"))
    return hit.unionByName(free.select(F.col("_id").alias(id), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")))
