"""Session helpers: local defaults for tests and benches, shared scratch space."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def local_session(app: str = "promptmill", cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings used by the tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors (once per application), for the few jobs with Python workers.

    Not needed where the package is installed on every node or passed with ``--py-files``.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    stage = tempfile.mkdtemp(prefix="promptmill-")  # on the driver; Spark copies the archive from there
    sc.addPyFile(shutil.make_archive(f"{stage}/promptmill", "zip", os.path.dirname(package), os.path.basename(package)))
    _shipped.add(sc.applicationId)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, most: str = "4m") -> None:
    """Let Arrow batches of this session hold about ``most`` bytes, for rows of whole texts.

    Batches of Spark's 10,000 rows are tens of MB of text, held by the JVM and the worker of every task at once.
    A session that has set a bound of its own keeps it. Results never depend on it.
    """
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, most)


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder every executor can reach (``spark.checkpoint.dir``).

    A local session without that setting gets a temporary folder; a cluster session
    without it is an error, because a machine-local folder would lose data with its node.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = sc.getCheckpointDir() or tempfile.mkdtemp(prefix="promptmill-")
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/promptmill/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where later steps must see one fixed evaluation of ``df`` (partition numbers,
    two readers of one result) and must survive the loss of executors. Parquet keeps
    column pruning for readers that need a few columns only.
    """
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hashable(kind: T.DataType) -> bool:
    """Whether ``xxhash64`` takes a column of this type."""
    if isinstance(kind, T.ArrayType):
        return hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(hashable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))
