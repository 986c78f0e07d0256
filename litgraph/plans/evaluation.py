"""Queries of evaluation and identity resolution: E01-E15, H01, H02, H04-H07, H09."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..bindings import view, views
from ..operators import evaluation as op
from ..registry import register

# records of one day and group of customers, and of one customer and priority: chains run through many customers
KEYS = """SELECT o_orderkey AS record, concat('c', o_custkey, o_orderpriority) AS key FROM orders UNION ALL SELECT o_orderkey, concat('d', CAST(CAST(o_orderdate AS DATE) AS VARCHAR), '-', o_custkey % 40) FROM orders"""
LABELS = f"""WITH RECURSIVE k AS MATERIALIZED (SELECT DISTINCT record, key FROM ({KEYS}) t), r(step, record, g, moved) AS (SELECT 0, record, record, true FROM (SELECT DISTINCT record FROM k) z UNION ALL
    SELECT step, record, g, bool_or(g < old) OVER () FROM (SELECT r.step + 1 AS step, r.record, min(least(r.g, m.g)) AS g, r.g AS old FROM r JOIN k ON k.record = r.record JOIN (SELECT k.key, min(q.g) AS g FROM r q JOIN k ON k.record = q.record GROUP BY 1) m ON m.key = k.key WHERE r.moved GROUP BY r.step, r.record, r.g) z),
    l AS MATERIALIZED (SELECT record, g FROM r WHERE step = (SELECT max(step) FROM r))"""
GROUPS = LABELS + ' SELECT record, g AS "group" FROM l'


def _keys(spark, sf):
    o = view(spark, sf, "orders")
    one = o.select(F.col("o_orderkey").alias("record"), F.concat(F.lit("c"), F.col("o_custkey").cast("string"), "o_orderpriority").alias("key"))
    return one.union(o.select("o_orderkey", F.concat(F.lit("d"), F.col("o_orderdate").cast("date").cast("string"), F.lit("-"), (F.col("o_custkey") % 40).cast("string"))))


@register("E01_H01", GROUPS)
def e01(spark, sf):
    return op.identity_groups(_keys(spark, sf))


@register("H01_merge", LABELS + " SELECT g AS candidate, count(*) AS records, min(o_orderdate) AS first, max(o_totalprice) AS best FROM l JOIN orders ON o_orderkey = record GROUP BY g")
def h01(spark, sf):
    orders = view(spark, sf, "orders").withColumnRenamed("o_orderkey", "record")
    return orders.join(op.identity_groups(_keys(spark, sf)), "record").groupBy(F.col("group").alias("candidate")).agg(F.count("*").alias("records"), F.min("o_orderdate").alias("first"), F.max("o_totalprice").alias("best"))


@register("H02", f"SELECT DISTINCT record FROM ({KEYS}) t WHERE record NOT IN (SELECT record FROM ({KEYS}) u WHERE key IN (SELECT key FROM ({KEYS}) v WHERE record < 100))")
def h02(spark, sf):
    keys = _keys(spark, sf)
    out = keys.join(keys.where("record < 100").select("key"), "key", "left_semi").select("record").distinct()
    return keys.select("record").distinct().join(out, "record", "left_anti")


@register("H04", "SELECT project_id, work_id, place FROM (SELECT project_id, work_id, row_number() OVER (PARTITION BY project_id ORDER BY score DESC, work_id) AS place FROM inclusions WHERE discovered_via <> '1-URGENT') t WHERE place <= 10")
def h04(spark, sf):
    place = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("score"), "work_id"))
    return view(spark, sf, "inclusions").where("discovered_via <> '1-URGENT'").withColumn("place", place).where("place <= 10").select("project_id", "work_id", "place")


CORE = "SELECT work_id FROM inclusions WHERE score > 0.45"


@register("H05_H06", f"""SELECT DISTINCT id, via FROM (SELECT cited AS id, 'backward' AS via FROM citations WHERE citing IN ({CORE}) UNION ALL SELECT citing, 'forward' FROM citations WHERE cited IN ({CORE})) t WHERE id NOT IN ({CORE})""")
def h05(spark, sf):
    citations, inc = views(spark, sf, "citations", "inclusions")
    core = inc.where("score > 0.45").select("work_id")
    back = citations.join(core.withColumnRenamed("work_id", "citing"), "citing", "left_semi").select(F.col("cited").alias("id"), F.lit("backward").alias("via"))
    ahead = citations.join(core.withColumnRenamed("work_id", "cited"), "cited", "left_semi").select(F.col("citing").alias("id"), F.lit("forward").alias("via"))
    return back.union(ahead).distinct().join(core.withColumnRenamed("work_id", "id"), "id", "left_anti")


@register("H07", "SELECT w.id, coalesce(CASE WHEN w.year > 1998 THEN w.venue END, c_mktsegment) AS venue FROM works w JOIN orders ON o_orderkey = w.id LEFT JOIN customer ON c_custkey = o_custkey")
def h07(spark, sf):
    works, orders, customer = views(spark, sf, "works", "orders", "customer")
    second = orders.join(customer, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("o_orderkey").alias("id"), "c_mktsegment")
    return works.select("id", F.when(F.col("year") > 1998, F.col("venue")).alias("venue")).join(second, "id").select("id", F.coalesce("venue", "c_mktsegment").alias("venue"))


@register("H09", """SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN depth = 1 THEN 'skipped' WHEN row_number() OVER (PARTITION BY project_id ORDER BY CASE WHEN depth = 0 THEN 0 ELSE 1 END, score DESC, work_id) > 20 THEN 'over' ELSE 'acquired' END AS outcome FROM inclusions) t GROUP BY outcome""")
def h09(spark, sf):
    order = Window.partitionBy("project_id").orderBy(F.when(F.col("depth") == 0, 0).otherwise(1), F.desc("score"), "work_id")
    outcome = F.when(F.col("depth") == 1, "skipped").when(F.row_number().over(order) > 20, "over").otherwise("acquired")
    return view(spark, sf, "inclusions").select(outcome.alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))


@register("E02", """WITH t AS (SELECT DISTINCT o_custkey AS g FROM orders WHERE o_totalprice > 300000), c AS (SELECT DISTINCT o_custkey AS g FROM orders WHERE o_orderstatus <> 'P'), i AS (SELECT DISTINCT o_custkey AS g FROM orders WHERE o_orderpriority = '1-URGENT')
    SELECT round((SELECT count(*) FROM c WHERE g IN (SELECT g FROM t)) / (SELECT count(*) FROM t), 6) AS candidate_recall, round((SELECT count(*) FROM i WHERE g IN (SELECT g FROM t)) / (SELECT count(*) FROM t), 6) AS included_recall,
    round((SELECT count(*) FROM i WHERE g IN (SELECT g FROM t)) / (SELECT count(*) FROM i), 6) AS "precision" """)
def e02(spark, sf):
    o = view(spark, sf, "orders").withColumnRenamed("o_custkey", "group")
    return op.recall_precision(o.where("o_totalprice > 300000"), o.where("o_orderstatus <> 'P'"), o.where("o_orderpriority = '1-URGENT'"))


@register("E03", "SELECT round(avg(s), 6) AS macro, count(*) AS pools FROM (SELECT o_orderpriority, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS s FROM orders GROUP BY 1) t")
def e03(spark, sf):
    per = view(spark, sf, "orders").groupBy("o_orderpriority").agg(F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("s"))
    return per.agg(F.round(F.avg("s"), 6).alias("macro"), F.count("*").alias("pools"))


@register("E04", """WITH v AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS w) SELECT DISTINCT round(a.w / s, 9) AS w0, round(b.w / s, 9) AS w1, round(c.w / s, 9) AS w2, round(d.w / s, 9) AS w3, round(e.w / s, 9) AS w4
    FROM v a, v b, v c, v d, v e, LATERAL (SELECT a.w + b.w + c.w + d.w + e.w AS s) t WHERE s > 0""")
def e04(spark, sf):
    return op.weight_grid(spark)


_SCORES = "SELECT n_regionkey AS fold, o_orderpriority AS choice, avg(o_totalprice) AS score FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2"


@register("E05", f"""SELECT fold, choice, round(score, 0) AS score FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY m DESC, choice) AS place FROM (SELECT s.fold, s.choice, s.score, round((t - s.score) / (n - 1), 9) AS m FROM ({_SCORES}) s
    JOIN (SELECT choice, sum(score) AS t, count(*) AS n FROM ({_SCORES}) q GROUP BY choice) z USING (choice)) u) w WHERE place = 1""")
def e05(spark, sf):
    o, c, n = views(spark, sf, "orders", "customer", "nation")
    s = o.join(c, F.col("c_custkey") == F.col("o_custkey")).join(n, F.col("n_nationkey") == F.col("c_nationkey")).groupBy(F.col("n_regionkey").alias("fold"), F.col("o_orderpriority").alias("choice")).agg(F.avg("o_totalprice").alias("score"))
    return op.leave_one_out(s).withColumn("score", F.round("score", 0))


@register("E06", "SELECT citing, cited FROM citations JOIN works a ON a.id = citing JOIN works b ON b.id = cited WHERE a.year <= 1999 AND b.year <= 1999")
def e06(spark, sf):
    return op.time_slice(*views(spark, sf, "works", "citations"), 1999)[1]


UPTAKE = "SELECT w.id, coalesce(n, 0) AS uptake FROM works w LEFT JOIN (SELECT cited AS id, count(*) AS n FROM citations JOIN works f ON f.id = citing WHERE f.year > 1999 AND f.year <= 2001 GROUP BY cited) t USING (id) WHERE w.year <= 1999"


@register("E07", UPTAKE)
def e07(spark, sf):
    return op.future_uptake(*views(spark, sf, "works", "citations"), 1999, 2)


RANKS = "SELECT rank() OVER (ORDER BY cited_by_count) + (count(*) OVER (PARTITION BY cited_by_count) - 1) / 2.0 AS ra, rank() OVER (ORDER BY uptake) + (count(*) OVER (PARTITION BY uptake) - 1) / 2.0 AS rb"


@register("E08", f"SELECT count(*) AS n, round(corr(ra, rb), 6) AS spearman FROM ({RANKS} FROM works JOIN ({UPTAKE}) u USING (id)) t")
def e08(spark, sf):
    works, citations = views(spark, sf, "works", "citations")
    return op.spearman(op.future_uptake(works, citations, 1999, 2).join(works, "id"), "cited_by_count", "uptake")


REL = f"SELECT id FROM ({UPTAKE}) u WHERE uptake > 0 AND uptake >= (SELECT min(uptake) FROM (SELECT uptake FROM ({UPTAKE}) v ORDER BY uptake DESC LIMIT (SELECT CAST(ceil(count(*) / 4.0) AS BIGINT) FROM ({UPTAKE}) x)) y)"


@register("E09", REL)
def e09(spark, sf):
    return op.relevant(op.future_uptake(*views(spark, sf, "works", "citations"), 1999, 2))


@register("E10", f"SELECT round(avg(CASE WHEN id IN ({REL}) THEN 1.0 ELSE 0.0 END), 6) AS \"precision\" FROM (SELECT id FROM works WHERE year <= 1999 ORDER BY cited_by_count DESC, id LIMIT 10) t")
def e10(spark, sf):
    works, citations = views(spark, sf, "works", "citations")
    hits = op.relevant(op.future_uptake(works, citations, 1999, 2))
    return op.precision_at(works.where("year <= 1999").select("id", F.col("cited_by_count").alias("score")), hits, 10)


@register("E13", """SELECT avg(rate) AS rate FROM (SELECT draw, avg(CASE WHEN year > 1999 THEN 1.0::DOUBLE ELSE 0.0 END) AS rate FROM (SELECT *, row_number() OVER (PARTITION BY draw ORDER BY md5(concat_ws('-', 7, draw, id)), id) AS place FROM works, range(1, 21) t(draw)) z WHERE place <= 50 GROUP BY draw) q""")
def e13(spark, sf):
    return op.random_rate(view(spark, sf, "works").select("id", "year"), F.col("year") > 1999, 50)


@register("E14", "SELECT max(year) - 2 AS cutoff FROM works")
def e14(spark, sf):
    return view(spark, sf, "works").agg((F.max("year") - 2).alias("cutoff"))


@register("E15", """WITH a AS (SELECT DISTINCT c_nationkey AS n, o_orderpriority AS p FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 490000), b AS (SELECT DISTINCT c_nationkey AS n, o_orderpriority AS p FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice < 12000)
    SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) z) AS only_left, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a) z) AS only_right, NOT EXISTS (SELECT * FROM a EXCEPT SELECT * FROM b) AND NOT EXISTS (SELECT * FROM b EXCEPT SELECT * FROM a) AS equal""")
def e15(spark, sf):
    o, c = views(spark, sf, "orders", "customer")
    rows = o.join(c, F.col("c_custkey") == F.col("o_custkey"))
    pair = lambda x: x.select(F.col("c_nationkey").alias("n"), F.col("o_orderpriority").alias("p"))
    return op.same_rows(pair(rows.where("o_totalprice > 490000")), pair(rows.where("o_totalprice < 12000")))


PAST = "SELECT * FROM works WHERE year BETWEEN 1997 AND 1999"


@register("E11", f"""WITH u AS ({UPTAKE}), p AS (SELECT id, cited_by_count AS score FROM ({PAST}) z), i AS (SELECT p.id, p.score, coalesce(n, 0) AS local, uptake FROM p JOIN u USING (id) LEFT JOIN (SELECT cited AS id, count(*) AS n FROM citations JOIN works a ON a.id = citing JOIN works b ON b.id = cited WHERE a.year <= 1999 AND b.year <= 1999 GROUP BY 1) l USING (id)),
    r AS (SELECT id FROM i WHERE uptake > 0 AND uptake >= (SELECT min(uptake) FROM (SELECT uptake FROM i ORDER BY uptake DESC LIMIT (SELECT CAST(ceil(count(*) / 4.0) AS BIGINT) FROM i)) z)),
    f AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS a, row_number() OVER (ORDER BY local DESC, id) AS b FROM i)
    SELECT (SELECT count(*) FROM i) AS windowed, (SELECT count(*) FROM r) AS relevant, (SELECT avg(CASE WHEN id IN (SELECT id FROM r) THEN 1.0 ELSE 0.0 END) FROM f WHERE a <= 5) AS p5, (SELECT avg(CASE WHEN id IN (SELECT id FROM r) THEN 1.0 ELSE 0.0 END) FROM f WHERE a <= 10) AS p10,
    (SELECT avg(CASE WHEN id IN (SELECT id FROM r) THEN 1.0 ELSE 0.0 END) FROM f WHERE b <= 5) AS base5, (SELECT avg(CASE WHEN id IN (SELECT id FROM r) THEN 1.0 ELSE 0.0 END) FROM f WHERE b <= 10) AS base10""")
def e11(spark, sf):
    works, citations = views(spark, sf, "works", "citations")
    return op.frontier_evaluation(works, citations, works.where(F.col("year").between(1997, 1999)).select("id", F.col("cited_by_count").alias("score")), 1999, 2)


@register("E12", """WITH fu AS (SELECT id FROM works WHERE year > 1999 AND year <= 2001), rf AS (SELECT DISTINCT citing, cluster_id AS c FROM citations JOIN eras ON work_id = cited WHERE citing IN (SELECT id FROM fu)), k AS (SELECT DISTINCT cluster_id AS c FROM eras JOIN works ON id = work_id WHERE year <= 1999),
    b AS (SELECT x.c AS a, y.c AS b FROM k x JOIN k y ON x.c < y.c), h AS (SELECT DISTINCT x.c AS a, y.c AS b FROM rf x JOIN rf y ON x.citing = y.citing AND x.c < y.c), s AS (SELECT c, (SELECT count(DISTINCT citing) FROM rf WHERE rf.c = k.c) AS n FROM k)
    SELECT 'bridging' AS kind, count(*) AS hypotheses, count(h.a) AS hits FROM b LEFT JOIN h ON h.a = b.a AND h.b = b.b UNION ALL SELECT 'stagnation', count(*), count(*) FILTER (n <= 1) FROM s
    UNION ALL SELECT 'matrix_void', count(*), count(*) FILTER (EXISTS (SELECT 1 FROM work_concepts x JOIN work_concepts y ON x.work_id = y.work_id WHERE x.concept_id = v.a AND y.concept_id = v.b AND x.work_id IN (SELECT id FROM fu))) FROM (SELECT x.id AS a, y.id AS b FROM concepts x JOIN concepts y ON x.id < y.id) v""")
def e12(spark, sf):
    works, citations, eras, wc, concepts = views(spark, sf, "works", "citations", "eras", "work_concepts", "concepts")
    known = eras.join(works.where("year <= 1999").select(F.col("id").alias("work_id")), "work_id", "left_semi").select("cluster_id").distinct()
    pairs = known.select(F.col("cluster_id").alias("a")).join(known.select(F.col("cluster_id").alias("b")), F.col("a") < F.col("b"))  # clusters are few
    voids = concepts.select(F.col("id").alias("a")).join(concepts.select(F.col("id").alias("b")), F.col("a") < F.col("b"))
    return op.gap_evaluation(works, citations, eras, wc, pairs, voids, known, 1999, 2)
