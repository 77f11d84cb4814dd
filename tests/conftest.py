import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def run(spark):
    """run(expression): the value of one column expression over a one-row frame of the given values."""
    from pyspark.sql import functions as F

    def value(make, *values):
        df = spark.range(1).select(*[F.lit(v).alias(f"c{i}") for i, v in enumerate(values)])
        return df.select(make(*[F.col(f"c{i}") for i in range(len(values))]).alias("r")).first()["r"]

    return value
