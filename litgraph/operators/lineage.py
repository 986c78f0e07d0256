"""Cutting the lineage of iterative plans through the shared checkpoint folder, and ranks without a single task."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for what driver and executors share; a local session may have one of its own, a cluster may not."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"{tempfile.gettempdir()}/litgraph-checkpoints"
    return folder.rstrip("/")


def saver(spark: SparkSession):
    """A function that checkpoints to the shared folder."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(spark))
    return lambda df: df.checkpoint(eager=True)


#: Spark then deletes the shuffle files of a query when it ends, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, folder: str) -> DataFrame:
    """Written as Parquet in a shared folder and read back; the shuffle files that this took are deleted."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP)
    conf.set(_CLEANUP, "true")
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(folder)
    finally:
        conf.set(_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def ranked(rows: DataFrame, order: list[Column | str], name: str, weight: Column | None = None) -> DataFrame:
    """The rows with the sum of ``weight`` (one for each, by default) over all rows up to and with their own, in a total order.

    Rows are dealt by ranges of the order; sums within a range are added to those of the ranges before it (one row a range).
    """
    dealt = rows.withColumn("_w", weight if weight is not None else F.lit(1)).repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    dealt = saver(rows.sparkSession)(dealt)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("_range").agg(F.sum("_w").alias("_s")).withColumn("_before", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(F.broadcast(sums), "_range").withColumn(name, F.col("_before") + F.sum("_w").over(within)).drop("_w", "_range", "_before")
