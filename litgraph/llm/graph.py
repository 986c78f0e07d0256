"""Connected components of an edge table, by least-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, small, stored


def components(edges: DataFrame) -> DataFrame:
    """(a, b) to (node, label): the least node of each node's component. Each round's labels are a written table.

    A round takes the least label among a node and its neighbours (aggregated with map-side partial minima, so a hub
    gathers nothing), then the label of that label; labels so run down chains in logarithmically many rounds. Labels are
    broadcast while their counted rows are few, and joined by a shuffle beyond.
    """
    spark = edges.sparkSession
    folder = shared_dir(spark)
    both = edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both, f"{folder}/edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), f"{folder}/labels0")
    at = 0
    while True:
        at += 1
        near = both.join(small(labels.select(F.col("node").alias("b"), "label")), "b").select(F.col("a").alias("node"), "label", F.lit(True).alias("far"))
        seen = near.union(labels.select("node", "label", F.lit(False))).groupBy("node").agg(F.min("label").alias("label"), F.min(F.when(~F.col("far"), F.col("label"))).alias("own"))
        least = stored(seen.select("node", "label", (F.col("label") < F.col("own")).alias("moved")), f"{folder}/least{at}")
        if not least.where("moved").limit(1).count():
            return least.select("node", "label")
        jump = least.select(F.col("node").alias("label"), F.col("label").alias("root"))
        labels = stored(least.join(small(jump), "label").select("node", F.col("root").alias("label")), f"{folder}/labels{at}")
