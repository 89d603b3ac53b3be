import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession
    shared = str(tmp_path_factory.mktemp("shared"))
    session = (SparkSession.builder.master("local[8]").appName("tests")
               .config("spark.sql.shuffle.partitions", "4")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "4g")
               .config("spark.checkpoint.dir", shared)
               .config("spark.python.sql.dataFrameDebugging.enabled", "false")
               .config("spark.sql.streaming.stateStore.providerClass",
                       "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
               .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture
def small_slices(spark):
    """Cut every timeline into slices of a few rows, as a heavy account's would be."""
    spark.conf.set("ledgerlens.rowsPerSlice", "7")
    yield
    spark.conf.unset("ledgerlens.rowsPerSlice")
