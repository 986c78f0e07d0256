"""Reachability over an edge table, one frontier a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import saver


def reachable(edges: DataFrame, seed: object, source: str = "citing", target: str = "cited") -> DataFrame:
    """Ids that the seed reaches in one step or more. Cycles end, as a round takes new ids only."""
    save = saver(edges.sparkSession)
    steps = edges.select(F.col(source).alias("a"), F.col(target).alias("b"))
    front = save(steps.where(F.col("a") == seed).select(F.col("b").alias("id")).distinct())
    seen = front
    while front.limit(1).count():
        near = steps.join(front.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        front = save(near.join(seen, "id", "left_anti"))
        seen = save(seen.union(front))
    return seen
