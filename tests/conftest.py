import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("equivcheck-tests")
        .config("spark.sql.shuffle.partitions", "3")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "America/New_York")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def mixed(spark):
    """A source with NULLs, extreme integers, every numeric type and hot keys; ts may be negative."""
    from pyspark.sql import functions as F

    from equivcheck.sources.generate import full_range, noise

    i = F.col("id")
    null = F.lit(None)
    return spark.range(0, 600, 1, 4).select(
        (i * 37 - 5000).alias("ts"),
        F.when(i % 3 == 0, 1).otherwise(i % 5).cast("bigint").alias("key"),
        F.when(i % 7 == 0, null).otherwise((i * 31 % 1000) / 100).alias("value"),
        F.when(i % 11 == 0, null).otherwise(full_range(noise(1, "w", i), "INT64")).alias("wide"),
        full_range(noise(1, "s", i), "INT8").alias("small"),
        full_range(noise(1, "m", i), "INT16").alias("medium"),
        full_range(noise(1, "n", i), "INT32").alias("normal"),
        full_range(noise(1, "u", i), "UINT64").alias("unsigned"),
        full_range(noise(1, "f", i), "FLOAT32").alias("single"),
        F.when(i % 13 == 0, null).otherwise(full_range(noise(1, "d", i), "FLOAT64")).alias("real"),
    ).persist()
