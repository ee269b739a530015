"""A session with the settings that the engine's plans expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(master: str = "local[*]", partitions: int = 8, memory: str = "8g", name: str = "ragloom") -> SparkSession:
    """Adaptive execution splits skewed joins and merges small partitions; UTC keeps times equal everywhere."""
    return (
        SparkSession.builder.master(master).appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
