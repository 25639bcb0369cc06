import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from promptmill.session import local_session

    s = local_session("tests", cores=4, shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def each(spark):
    """Evaluate a Column for many texts in one job: ``each(texts, fn)``."""
    from pyspark.sql import functions as F

    def run(texts, fn):
        df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
        return [r["v"] for r in df.select("i", fn(F.col("t")).alias("v")).orderBy("i").collect()]

    return run


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate a Column built from a text: ``one(text, fn)``."""
    from pyspark.sql import functions as F

    def run(text, fn):
        return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("v")).first()["v"]

    return run
