"""Session settings for local runs; on a cluster the given session is used as it is."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int = 8, driver_memory: str = "8g", app: str = "pairlens") -> SparkSession:
    """A local session with adaptive execution, UTC, shuffle partitions near the core count, and a folder for work tables."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(max(cpus, 8)))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="spark-pairlens-"))  # one machine: all tasks share it
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
