"""Shared pieces of the streaming jobs.

Every job writes per micro-batch into ``<table>/epoch=<id>`` and overwrites that folder when a
micro-batch is repeated after a failure. With the checkpointed source offsets this gives each
input row exactly one effect.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def write_epoch(df: DataFrame, path: str, epoch: int) -> DataFrame:
    """Write one micro-batch of a table and read it back as a fixed input for what follows."""
    target = f"{path}/epoch={epoch}"
    df.write.mode("overwrite").parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def together(spark: SparkSession, *writes: Callable[[], object]) -> list:
    """Results of functions that write tables apart from one another, run side by side; the first error is raised once all have ended.

    Most jobs of a micro-batch are short, and waiting for one after the other takes longer than their tasks.
    """
    with ThreadPoolExecutor(len(writes)) as pool:
        return [w.result() for w in [pool.submit(inheritable_thread_target(spark)(f)) for f in writes]]


def read_epochs(spark: SparkSession, path: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """All micro-batches of a table (those before ``before``), with their ``epoch``."""
    full = T.StructType([*schema.fields, T.StructField("epoch", T.LongType())])
    try:
        df = spark.read.schema(full).option("basePath", path).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)
    return df if before is None else df.where(F.col("epoch") < before)


def current(spark: SparkSession, table) -> DataFrame:
    """A table as it is now: given as a path, as a function of the session, or as a DataFrame (as it was when that was made)."""
    if isinstance(table, str):
        return spark.read.parquet(table)
    return table(spark) if callable(table) else table


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """Id of the stream that a checkpoint belongs to; it outlives restarts."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


MARK = "query string, micro_batch bigint, at timestamp_ntz"


def mark(spark: SparkSession, path: str, step: int, query: str | None, micro_batch: int | None, at: Column) -> None:
    """Note that a step got this far. A mark is a row of its own, so a step without rows leaves one, too."""
    write_epoch(spark.range(1).select(
        F.lit(query).cast("string").alias("query"), F.lit(micro_batch).cast("bigint").alias("micro_batch"), at.cast("timestamp_ntz").alias("at")), path, step)


def marks(spark: SparkSession, path: str) -> DataFrame:
    """Marks of a job: ``epoch`` (the step), the query and the micro-batch it worked on (null: a retry) and its point in time."""
    return read_epochs(spark, path, spark.createDataFrame([], MARK).schema)


def run(stream: DataFrame, step: Callable[[DataFrame, int], object], checkpoint: str, mode: str = "append", every: str | None = None) -> StreamingQuery:
    """Hand each micro-batch to ``step``.

    Without ``every`` the job works off what the source holds now, in as many micro-batches as its
    limits ask for, and ends. With it (say ``"10 seconds"``) it stays up; the query handle is returned.
    """
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(step)
    if every:
        return writer.trigger(processingTime=every).start()
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def read_stream(spark: SparkSession, path: str, schema: T.StructType | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """A parquet table as a stream. The path is given as a pattern, so that a table kept in one file works too."""
    reader = spark.readStream.schema(schema or spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")
