"""The local session of tests and tools."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def make_session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ledgerloom-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="ledgerloom-"))
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="ledgerloom-warehouse-"))
        .config("spark.driver.host", os.environ.get("SPARK_LOCAL_IP", "127.0.0.1"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
