"""A Spark session with the settings that the library expects; it also works with any session given to it."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[8]", partitions: int = 8, **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName("litgraph")
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    for k, v in (settings | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
