"""Queries of the validation rules: V01-V10."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import view, views
from ..operators import validation as op
from ..registry import register


@register("V01", "SELECT o_orderkey AS id, 'title' AS rule FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey, 'doi|arxiv' FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F'")
def v01(spark, sf):
    o = view(spark, sf, "orders")
    rows = o.select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("title"),
        F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_custkey")).alias("doi"), F.when(F.col("o_orderstatus") == "F", F.lit("x")).alias("arxiv"),
    )
    return op.missing(rows, "o_orderkey", ["title"], ["doi", "arxiv"])


@register("V02", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def v02(spark, sf):
    o, c = views(spark, sf, "orders", "customer")
    return op.without(o, c.where("c_mktsegment = 'BUILDING'").withColumnRenamed("c_custkey", "o_custkey"), ["o_custkey"]).select("o_orderkey")


@register("V03", "SELECT DISTINCT work_id, method FROM contributions c WHERE NOT EXISTS (SELECT 1 FROM contributions e WHERE e.metric = 'R' AND e.work_id = c.work_id AND e.method = c.method)")
def v03(spark, sf):
    c = view(spark, sf, "contributions")
    return op.without(c.select("work_id", "method").distinct(), c.where("metric = 'R'"), ["work_id", "method"])


@register("V04", "SELECT work_id AS id, count(DISTINCT metric) AS n FROM contributions GROUP BY work_id HAVING count(DISTINCT metric) <> 1")
def v04(spark, sf):
    return op.cardinality(view(spark, sf, "contributions"), "work_id", "metric", 1, 1)


@register("V05", "SELECT work_id AS id, 'score outside' AS rule FROM inclusions WHERE score NOT BETWEEN 0 AND 0.4")
def v05(spark, sf):
    return op.outside(view(spark, sf, "inclusions"), "work_id", "score", 0, 0.4)


@register("V06", "SELECT p_partkey AS id, 'p_size outside' AS rule FROM part WHERE p_size NOT BETWEEN 1 AND 40")
def v06(spark, sf):
    return op.outside(view(spark, sf, "part"), "p_partkey", "p_size", 1, 40)


@register("V07", "SELECT event_id AS id, event_type AS value FROM events WHERE event_type NOT IN ('view', 'click', 'purchase')")
def v07(spark, sf):
    return op.not_in(view(spark, sf, "events"), "event_id", "event_type", ["view", "click", "purchase"])


@register("V08", "SELECT p_partkey AS id, 'direction' AS rule FROM part WHERE p_size % 7 = 0")
def v08(spark, sf):
    return op.missing(view(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 7 != 0, F.lit("up")).alias("direction")), "p_partkey", ["direction"])


@register("V09_V10", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def v09(spark, sf):
    return op.repeated(view(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])
