"""Queries of progress events: T01, T02, H11."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import view
from ..registry import register
from ..streaming import progress as op


@register("T01", "SELECT user_id AS run, event_type AS stage, count(*) AS events, CAST(floor((count(*) + 24) / 25) AS BIGINT) AS emitted FROM events GROUP BY 1, 2")
def t01(spark, sf):
    return view(spark, sf, "events").groupBy(F.col("user_id").alias("run"), F.col("event_type").alias("stage")).agg(F.count("*").alias("events")).withColumn("emitted", F.floor((F.col("events") + 24) / 25).cast("long"))


@register("T02")
def t02(spark, sf):
    e = view(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("at"))
    return op.throttle_batch(e.withColumn("at", F.col("at") / 1e6), 86400.0)


@register("H11", "SELECT user_id AS run, arg_max(event_type, event_id) AS status, max(event_id) AS seq FROM events GROUP BY user_id")
def h11(spark, sf):
    return op.last_status(view(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), F.col("event_type").alias("status")))
