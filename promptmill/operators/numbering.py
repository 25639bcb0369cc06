"""Row numbers, fixed-size groups and ordered text joins that hold up under skew."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptmill.session import cut_lineage, hashable


HOT_ROWS = 100_000  # a larger group is numbered in several tasks


def number_rows(
    df: DataFrame, order_by: Sequence[str], partition_by: Sequence[str] = (), name: str = "rn", size: str | None = None, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Number rows from 1 in the order of ``order_by`` per group or overall; NULL keys are a group, too.

    Every row gets one number of its own: rows with equal order keys are told apart by a hash of their
    other columns, and equal rows stand in any order. A group of up to ``hot_rows`` rows is numbered by a window. Larger
    ones, and all rows where there are no groups, are range partitioned by group and order, written once
    with a place for every row, and numbered inside their partition plus the number of rows of the same group in earlier
    ones. Both ways give the same numbers. ``size`` names a column for the number of rows of the group.
    """
    others = [c for c in df.columns if c not in (*partition_by, *order_by) and hashable(df.schema[c].dataType)]
    tie = F.xxhash64(*others) if others else F.lit(0)
    if not partition_by or hot_rows <= 0:
        return _numbered_in_ranges(df, order_by, partition_by, tie, name, size)
    group = Window.partitionBy(*partition_by)

    def by_window(rows: DataFrame) -> DataFrame:
        counted = rows.withColumn(name, F.row_number().over(group.orderBy(*order_by, tie)).cast("bigint"))
        return counted.withColumn(size, F.count(F.lit(1)).over(group)) if size else counted

    counts = df.groupBy(*partition_by).agg(F.count(F.lit(1)).alias("_rows"))
    hot = cut_lineage(counts.where(F.col("_rows") > hot_rows).select(*partition_by), "hot-groups")
    if hot.isEmpty():
        return by_window(df)
    return by_window(join_null_safe(df, hot, partition_by, "left_anti")).unionByName(
        _numbered_in_ranges(join_null_safe(df, hot, partition_by, "left_semi"), order_by, partition_by, tie, name, size))


def _numbered_in_ranges(df: DataFrame, order_by: Sequence[str], partition_by: Sequence[str], tie: Column, name: str, size: str | None) -> DataFrame:
    keys = [*dict.fromkeys([*partition_by, *order_by]), "_tie"]
    ordered = df.withColumn("_tie", tie).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    fixed = cut_lineage(
        ordered.withColumn("_part", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id()), "numbered")
    spans = [*partition_by, "_part"]
    runs = fixed.groupBy(*spans).agg(F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_first"))
    # at most one row per partition and group meets in this window, one per partition overall
    whole = Window.partitionBy(*(partition_by or [F.lit(0)]))
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(
        *spans, (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) + 1 - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("_size"))
    if not partition_by:
        starts = F.broadcast(starts)  # one row per partition of the range exchange
    extra = [F.col("_size").alias(size)] if size else []
    return join_null_safe(fixed, starts, spans).select(*df.columns, (F.col("_seq") + F.col("_shift")).alias(name), *extra)


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` in which NULL equals NULL; ``how`` is inner, left_semi or left_anti."""
    own = right.select(*[F.col(k).alias(f"_{i}_{k}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    same = [left[k].eqNullSafe(own[f"_{i}_{k}"]) for i, k in enumerate(keys)]
    return left.join(own, same, how).drop(*[f"_{i}_{k}" for i, k in enumerate(keys)])


def fixed_groups(df: DataFrame, size: int, order_by: Sequence[str]) -> DataFrame:
    """Consecutive groups of ``size`` rows in overall order: ``batch_no`` from 0, ``pos`` from 1."""
    numbered = number_rows(df, order_by, name="_rn")
    at = F.col("_rn") - 1
    return numbered.withColumn("batch_no", F.floor(at / size).cast("bigint")).withColumn("pos", (at % size + 1).cast("bigint")).drop("_rn")


def join_bounded(pos: Column | str, text: Column | str, separator: str) -> Column:
    """Aggregate: texts of a group of bounded size, joined in the order of ``pos``."""
    p = F.col(pos) if isinstance(pos, str) else pos
    t = F.col(text) if isinstance(text, str) else text
    rows = F.array_sort(F.collect_list(F.struct(p.alias("p"), t.alias("t"))))
    return F.array_join(F.transform(rows, lambda r: r["t"]), separator)


def ordered_concat(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], text: str, separator: str, chunk_rows: int = 500, chunks: str | None = None,
) -> DataFrame:
    """Ordered text join per group, as chunks: (keys, chunk_no, chunk), and their number if ``chunks`` names a column.

    Putting the chunks of a group behind one another gives exactly the joined text. A group of
    any size is never held in one row; one of up to ``chunk_rows`` rows comes out as chunk 0.
    """
    numbered = number_rows(df.select(*keys, *[c for c in order_by if c not in keys], text), order_by, keys, "_rn", "_rows")
    chunked = numbered.withColumn("chunk_no", F.floor((F.col("_rn") - 1) / chunk_rows).cast("bigint"))
    joined = chunked.groupBy(*keys, "chunk_no").agg(join_bounded("_rn", text, separator).alias("chunk"), F.max("_rows").alias("_rows"))
    lead = F.when(F.col("chunk_no") > 0, F.lit(separator)).otherwise(F.lit(""))
    count = [F.ceil(F.col("_rows") / chunk_rows).cast("bigint").alias(chunks)] if chunks else []
    return joined.select(*keys, "chunk_no", F.concat(lead, "chunk").alias("chunk"), *count)
