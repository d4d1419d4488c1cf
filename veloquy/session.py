"""Session helper for tests, the bench and the command line."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = 1000


def local_session(app: str = "veloquy", cores: int | None = None) -> SparkSession:
    """A local session; on a cluster the caller brings a session of its own."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("VELOQUY_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def small_batches(docs: DataFrame) -> DataFrame:
    """`docs`; texts go to Python in Arrow batches of at most BATCH_ROWS rows from now on, as both
    sides hold a batch of whole texts in memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return docs
