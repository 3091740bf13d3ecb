"""Session helpers for tests, benches and scripts; a cluster brings its own session."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(name: str = "larkgraph", cores: str | int = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with UTC timestamps and adaptive execution."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", os.environ.get("LARKGRAPH_DRIVER_MEMORY", memory))
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the star-schema or text tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
