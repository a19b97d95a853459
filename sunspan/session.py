"""Session builder for local runs and tests; on a cluster the caller's session is used as it is."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str | None = None, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session; cores defaults to BENCH_CPUS or all."""
    cores = cores or os.environ.get("BENCH_CPUS", "*")
    builder = SparkSession.builder.master(f"local[{cores}]").appName("sunspan").config("spark.driver.memory", memory)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.config("spark.sql.shuffle.partitions", partitions).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
