"""Tables in and out: parquet folders, JDBC for users who keep them in a database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


SPLITS_PER_SPLIT = 8


def load_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal a scan's rows over more tasks when it has fewer splits than the cluster has cores.

    For work that is heavy per row over files of a few large row groups. A scan of many splits, the
    normal case for a big table, is returned as it is and costs no shuffle.
    """
    splits, cores = df.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism
    return df if splits >= cores else df.repartition(min(cores, splits * SPLITS_PER_SPLIT))


def load_tables(spark: SparkSession, base: str, *names: str) -> dict[str, DataFrame]:
    return {n: load_table(spark, base, n) for n in names}


def load_jdbc(spark: SparkSession, url: str, table: str, key: str, bounds: tuple[int, int], parts: int, **options: str) -> DataFrame:
    """A database table read in ``parts`` parallel key ranges."""
    reader = spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=key, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts))
    return reader.options(**options).load()


def save_snapshot(df: DataFrame, path: str) -> DataFrame:
    """Write a table version to a new folder (never over the one being read) and read it back."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` in its order and types; missing nullable ones become NULL."""
    missing = [f.name for f in schema.fields if f.name not in df.columns and not f.nullable]
    if missing:
        raise ValueError(f"columns required but absent: {missing}")
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
