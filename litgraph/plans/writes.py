"""Queries that write and read back, and event framing: S17, W10, W11, W14, W15, W17, T03, T04."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..bindings import view, views
from ..operators import analysis
from ..operators import writes as op
from ..registry import register


@register("W10", """SELECT '<urn:work/' || id || '> <urn:title> "' || title || '" .' AS line FROM works UNION ALL SELECT '<urn:work/' || citing || '> <urn:cites> <urn:work/' || cited || '> .' FROM citations""")
def w10(spark, sf):
    works, citations = views(spark, sf, "works", "citations")
    iri = lambda c: F.concat(F.lit("urn:work/"), F.col(c).cast("string"))
    titles = works.select(iri("id").alias("subject"), F.lit("urn:title").alias("predicate"), F.col("title").alias("object"), F.lit(False).alias("is_iri"))
    return op.turtle(titles.union(citations.select(iri("citing"), F.lit("urn:cites"), iri("cited"), F.lit(True))), op.new_folder(spark))


@register("W11", """SELECT coalesce(f.id, s.id) AS id, coalesce(f.kind, s.kind) AS kind, coalesce(f.c, s.c) AS confidence, coalesce(s.status, 'open') AS status, s.note, f.id IS NULL AS stale FROM
    (SELECT p_partkey AS id, p_brand AS kind, p_retailprice AS c FROM part WHERE p_size > 10) f FULL OUTER JOIN (SELECT p_partkey AS id, p_brand AS kind, 1.0 AS c, 'rejected' AS status, p_type AS note FROM part WHERE p_size < 20) s ON f.id = s.id""")
def w11(spark, sf):
    part = view(spark, sf, "part")
    store = op.new_folder(spark)
    noted = part.where("p_size < 20").select(F.col("p_partkey").alias("id"), F.lit(1.0).alias("confidence"), F.lit("rejected").alias("status"), F.col("p_type").alias("note"), F.col("p_brand").alias("kind"))
    stored = op.replaced(noted, store, "kind")
    fresh = part.where("p_size > 10").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("confidence"))
    merged = analysis.merge_gaps(fresh, stored).join(part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("kind")), "id")
    return op.replaced(merged, store, "kind").select("id", "kind", "confidence", "status", "note", "stale")


@register("W14", """SELECT coalesce(n.id, o.id) AS id, coalesce(n.label, o.label) AS label, coalesce(n.weight, o.weight) AS weight FROM (SELECT c_custkey AS id, c_name AS label, c_acctbal AS weight FROM customer WHERE c_nationkey < 15) o
    FULL OUTER JOIN (SELECT c_custkey AS id, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS label, NULL::DOUBLE AS weight FROM customer WHERE c_nationkey > 10) n ON n.id = o.id""")
def w14(spark, sf):
    c = view(spark, sf, "customer")
    old = c.where("c_nationkey < 15").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label"), F.col("c_acctbal").alias("weight"))
    new = c.where("c_nationkey > 10").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("label"), F.lit(None).cast("double").alias("weight"))
    return op.upsert(old, new, "id")


@register("W15", "SELECT '| ' || c_mktsegment || ' | ' || count(*) || ' |' AS line FROM customer GROUP BY c_mktsegment")
def w15(spark, sf):
    return op.summary(view(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n")), op.new_folder(spark))


@register("W17", """SELECT 'statement' AS kind, count(*) AS n, count(DISTINCT l_orderkey) AS works FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) s UNION ALL SELECT 'evidence', count(*), count(DISTINCT l_orderkey) FROM (SELECT DISTINCT l_orderkey, l_partkey, l_returnflag FROM lineitem) e""")
def w17(spark, sf):
    line = view(spark, sf, "lineitem")
    name = F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"))
    statements = line.select(name.alias("id"), F.col("l_orderkey").alias("work_id")).distinct()
    evidence = line.select(name.alias("statement"), F.col("l_orderkey").alias("work_id"), F.col("l_returnflag").alias("quote"))
    s, e = op.write_extraction(statements, evidence, "run-1", op.new_folder(spark))
    count = lambda kind, df: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.count_distinct("work_id").alias("works"))
    return count("statement", s).union(count("evidence", e))


@register("S17", "SELECT o_orderkey AS key, o_orderpriority AS discovered_via, c_nationkey AS depth, o_totalprice AS score FROM orders JOIN customer ON c_custkey = o_custkey")
def s17(spark, sf):
    """A pool's dump to JSON and its load."""
    o, c = views(spark, sf, "orders", "customer")
    pool = o.join(c, F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("discovered_via"), F.col("c_nationkey").alias("depth"), F.col("o_totalprice").alias("score"))
    return op.replaced(pool.withColumn("version", F.lit(1)), op.new_folder(spark), "version").drop("version")


@register("T03", "SELECT conv_id, turn, md5('event: ' || CASE role WHEN 'user' THEN 'plan' ELSE 'answer' END || chr(10) || 'data: ' || replace(text, chr(10), chr(10) || 'data: ') || chr(10) || chr(10)) AS frame FROM conversations")
def t03(spark, sf):
    c = view(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.md5(op.frame(F.when(F.col("role") == "user", "plan").otherwise("answer"), F.col("text"))).alias("frame"))


@register("T04", """SELECT conv_id, turn, CASE WHEN role <> 'user' THEN 'answer' WHEN coalesce(before, 'assistant') = 'user' THEN 'refused' ELSE 'accepted' END AS verdict FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) t""")
def t04(spark, sf):
    """A thread has one open answer: a message that follows another before its answer is refused."""
    c = view(spark, sf, "conversations").withColumn("before", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")))
    return c.select("conv_id", "turn", F.when(F.col("role") != "user", "answer").when(F.coalesce("before", F.lit("assistant")) == "user", "refused").otherwise("accepted").alias("verdict"))
