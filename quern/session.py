"""A SparkSession with the settings that the queries expect."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "quern", cores: str | int = "*", shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """UTC, adaptive execution, and one shuffle partition per local core by default."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QUERN_DRIVER_MEMORY", memory))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
