"""Queries of the harvest: S01, S03, S08-S10, S15, S28, S30, F11, F13, F31, F35, H03, H08, H12."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..bindings import view, views
from ..operators import harvest as op
from ..registry import register

SPELT = """SELECT id, CASE id % 4 WHEN 0 THEN concat('https://openalex.org/w', id) WHEN 1 THEN concat('https://doi.org/10.1000/A', id) WHEN 2 THEN concat('arXiv:2101.', 10000 + id % 80000, 'v2') ELSE concat('hash', id) END AS raw FROM papers"""
CANON = "CASE id % 4 WHEN 0 THEN 'openalex:W' || id WHEN 1 THEN 'doi:10.1000/a' || id WHEN 2 THEN 'arxiv:2101.' || (10000 + id % 80000) ELSE 's2:hash' || id END"


def _spelt(spark, sf):
    return spark.sql(SPELT.replace("papers", "{papers}"), papers=view(spark, sf, "papers"))


@register("S01_S31", f"SELECT id, {CANON} AS identity FROM papers")
def s01(spark, sf):
    return _spelt(spark, sf).select("id", op.canonical(F.col("raw")).alias("identity"))


@register("S03", "SELECT id, place, (place - 1) // 200 AS page FROM (SELECT id, row_number() OVER (ORDER BY cited_by_count DESC, id) AS place FROM works WHERE year BETWEEN 1996 AND 1999) t")
def s03(spark, sf):
    from ..operators.insights import paged

    found = view(spark, sf, "works").where(F.col("year").between(1996, 1999)).select("id", "cited_by_count")
    return paged(found, [F.desc("cited_by_count"), F.col("id")], 200).select("id", "place", "page")


@register("S08", f"SELECT key, place, (place - 1) // 500 AS chunk FROM (SELECT key, row_number() OVER (ORDER BY key) AS place FROM (SELECT DISTINCT {CANON} AS key FROM papers) k) t")
def s08(spark, sf):
    return op.chunked(_spelt(spark, sf).select(op.canonical(F.col("raw")).alias("key")), "key", 500)


@register("S09", "SELECT citing, cited, place, (place - 1) // 2 AS page FROM (SELECT *, row_number() OVER (PARTITION BY citing ORDER BY cited) AS place FROM citations) t")
def s09(spark, sf):
    return op.pages_within(view(spark, sf, "citations"), "citing", [F.col("cited")], 2)


@register("S10", "SELECT citing, cited, intents, influential FROM citations LEFT JOIN (SELECT work_id AS citing, string_agg(DISTINCT kind, ',' ORDER BY kind) AS intents, bool_or(kind = 'purchase') AS influential FROM topics GROUP BY 1) t USING (citing)")
def s10(spark, sf):
    citations, topics = views(spark, sf, "citations", "topics")
    per = topics.groupBy(F.col("work_id").alias("citing")).agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("intents"), F.max(F.col("kind") == "purchase").alias("influential"))
    return citations.join(per, "citing", "left").select("citing", "cited", "intents", "influential")


@register("S15", """SELECT source, id, round(max(t.at - 5.0 * place) OVER (PARTITION BY source ORDER BY t.at, id) + 5.0 * place, 3) AS start FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY e.at, id) AS place
    FROM (SELECT event_type || '-' || (user_id % 50) AS source, event_id AS id, CAST(epoch(date_trunc('second', ts)) AS DOUBLE) AS "at" FROM events) e) t""")
def s15(spark, sf):
    events = view(spark, sf, "events")
    rows = events.select(F.concat_ws("-", "event_type", (F.col("user_id") % 50).cast("string")).alias("source"), F.col("event_id").alias("id"), F.unix_timestamp(F.date_trunc("second", "ts")).cast("double").alias("at"))
    return op.schedule(rows, 5.0).withColumn("start", F.round("start", 3))


@register("S28", "SELECT DISTINCT k1.id AS citing, k2.id AS cited FROM citations c JOIN (SELECT o_orderkey AS rec, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderdate) AS id FROM orders) k1 ON k1.rec = citing JOIN (SELECT o_orderkey AS rec, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderdate) AS id FROM orders) k2 ON k2.rec = cited WHERE k1.id <> k2.id")
def s28(spark, sf):
    orders, citations = views(spark, sf, "orders", "citations")
    first = orders.groupBy("o_custkey", "o_orderdate").agg(F.min("o_orderkey").alias("id"))
    index = orders.join(first, ["o_custkey", "o_orderdate"]).select(F.col("o_orderkey").alias("rec"), "id")
    a, b = index.select(F.col("rec").alias("citing"), F.col("id").alias("x")), index.select(F.col("rec").alias("cited"), F.col("id").alias("y"))
    return citations.join(a, "citing").join(b, "cited").where("x <> y").select(F.col("x").alias("citing"), F.col("y").alias("cited")).distinct()


@register("S30", """SELECT p_partkey AS id, coalesce(s.n, t.n) AS matches, CASE WHEN s.n IS NOT NULL THEN 'identifier' WHEN t.n IS NOT NULL THEN 'title' END AS via FROM part LEFT JOIN (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_quantity > 49 GROUP BY 1) s ON s.k = p_partkey
    LEFT JOIN (SELECT regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]', '', 'g') AS t, count(*) AS n FROM part WHERE p_size = 1 GROUP BY 1) t ON t.t = regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]', '', 'g')""")
def s30(spark, sf):
    part, lineitem = views(spark, sf, "part", "lineitem")
    by_id = lineitem.where("l_quantity > 49").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("a"))
    by_title = part.where("p_size = 1").groupBy(op.plain_title(F.col("p_name")).alias("t")).agg(F.count("*").alias("b"))
    rows = part.withColumn("t", op.plain_title(F.col("p_name"))).join(by_id, "p_partkey", "left").join(by_title, "t", "left")
    return rows.select(F.col("p_partkey").alias("id"), F.coalesce("a", "b").alias("matches"), F.when(F.col("a").isNotNull(), "identifier").when(F.col("b").isNotNull(), "title").alias("via"))


def _title_pairs(spark, sf):
    """Each part's name next to that of the next part of its brand and size."""
    w = Window.partitionBy("p_brand", "p_size").orderBy("p_partkey")
    return view(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("a"), F.lead("p_name").over(w).alias("b")).where("b IS NOT NULL")


@register("F11_F35")
def f11(spark, sf):
    return op.similarity(_title_pairs(spark, sf)).select("id", F.round("similarity", 6).alias("similarity"), (F.col("similarity") >= 0.92).alias("accepted"))


TITLED = """SELECT o_orderkey AS id, concat(p_name, CASE WHEN o_orderkey % 2 = 0 THEN ' - ' ELSE ': ' END, p_type, ' ', o_custkey % 40) AS title, year(o_orderdate) AS year, CASE WHEN o_orderkey % 3 = 0 THEN concat('10.1/', o_custkey % 9) END AS doi,
    CASE WHEN o_orderkey % 4 > 0 THEN concat('2101.', o_orderkey) END AS arxiv_id, c_mktsegment AS surname FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1 JOIN part ON p_partkey = l_partkey"""


def _titled(spark, sf):
    names = ("orders", "customer", "lineitem", "part")
    sql = TITLED
    for n in names:
        sql = sql.replace(f"FROM {n} ", f"FROM {{{n}}} ").replace(f"JOIN {n} ", f"JOIN {{{n}}} ")
    return spark.sql(sql, **dict(zip(names, views(spark, sf, *names), strict=True)))


@register("F13", f"""WITH t AS MATERIALIZED (SELECT *, array_to_string(list_filter(string_split_regex(lower(title), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> ''), ' ') AS w FROM ({TITLED}) z)
    SELECT id, min(a) AS arxiv_id FROM (SELECT DISTINCT r.id, h.arxiv_id AS a FROM t r JOIN t h ON h.w = r.w AND h.arxiv_id IS NOT NULL AND abs(r.year - h.year) <= 2 AND (r.doi IS NULL OR h.doi IS NULL OR r.doi = h.doi) AND r.surname = h.surname) z GROUP BY id HAVING count(*) = 1""")
def f13(spark, sf):
    rows = _titled(spark, sf).withColumn("surnames", F.array("surname"))
    return op.title_matches(rows, rows)


@register("F31", """SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 OR p_size % 7 = 0 THEN 'preprint' WHEN p_size % 3 = 0 OR p_type IN ('PROMO', 'ECONOMY') THEN 'peerReviewed' ELSE 'preprint' END AS tier, regexp_matches(p_name, '(?i)\\b(bolt)\\b') AND p_size % 2 = 0 OR p_type = 'PROMO' AS survey FROM part""")
def f31(spark, sf):
    part = view(spark, sf, "part")
    kinds = F.when(F.col("p_type") == "PROMO", F.array(F.lit("Review"))).when(F.col("p_type") == "ECONOMY", F.array(F.lit("JournalArticle"))).otherwise(F.array().cast("array<string>"))
    arxiv, doi = F.when(F.col("p_size") % 5 == 0, F.lit("2101.1")), F.when(F.col("p_size") % 7 == 0, F.lit("10.48550/arXiv.1")).when(F.col("p_size") % 3 == 0, F.lit("10.1/x"))
    title = F.when(F.col("p_size") % 2 == 0, F.regexp_replace("p_name", "bolt", "survey")).otherwise(F.col("p_name"))
    return part.select(F.col("p_partkey").alias("id"), op.tier(F.lit("openalex"), arxiv, doi, kinds).alias("tier"), op.is_survey(title, kinds).alias("survey"))


@register("H03", """SELECT id, coalesce(a, b, c) AS found, CASE WHEN a IS NOT NULL THEN 0 WHEN b IS NOT NULL THEN 1 WHEN c IS NOT NULL THEN 2 END AS route FROM (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey END AS a, b, c FROM orders
    LEFT JOIN (SELECT citing, min(cited) AS b FROM citations GROUP BY 1) x ON citing = o_orderkey LEFT JOIN (SELECT cited, min(citing) AS c FROM citations GROUP BY 1) y ON cited = o_orderkey) z""")
def h03(spark, sf):
    orders, citations = views(spark, sf, "orders", "citations")
    wanted = orders.select(F.col("o_orderkey").alias("id"))
    direct = wanted.where("id % 5 = 0").withColumn("found", F.col("id"))
    back = citations.groupBy(F.col("citing").alias("id")).agg(F.min("cited").alias("found"))
    ahead = citations.groupBy(F.col("cited").alias("id")).agg(F.min("citing").alias("found"))
    return op.first_route(wanted, direct, back, ahead)


@register("H08", f"SELECT id FROM (SELECT id, title FROM ({TITLED}) z WHERE arxiv_id IS NULL AND len(list_filter(string_split_regex(lower(title), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) >= 4 ORDER BY id LIMIT 20) q")
def h08(spark, sf):
    rows = _titled(spark, sf).where("arxiv_id IS NULL").where(F.size(F.filter(F.split(F.lower("title"), r"[^\p{L}\p{N}]+"), lambda w: w != "")) >= 4)
    return rows.orderBy("id").limit(20).select("id")  # a run asks for so many


@register("H12", f"""WITH t AS MATERIALIZED (SELECT id, title, year, p, regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS k, list_distinct(list_filter(string_split_regex(lower(title), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS w FROM (SELECT *, split_part(title, ' ', 1) || year AS p FROM ({TITLED}) z) y),
    h AS MATERIALIZED (SELECT p, id AS hit, title, year, k, w, row_number() OVER (PARTITION BY p ORDER BY id) AS place FROM t), s AS (SELECT t.id, hit, place, CASE WHEN t.k = h.k THEN 1.0::DOUBLE ELSE len(list_intersect(t.w, h.w))::DOUBLE / len(list_distinct(list_concat(t.w, h.w))) END AS score FROM t JOIN h USING (p) WHERE place <= 5 AND abs(t.year - h.year) <= 1)
    SELECT id, hit, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, place) AS r FROM s WHERE score >= 0.9) z WHERE r = 1""")
def h12(spark, sf):
    rows = _titled(spark, sf).withColumn("p", F.concat(F.split("title", " ")[0], F.col("year").cast("string")))
    place = F.row_number().over(Window.partitionBy("p").orderBy("id"))
    hits = rows.withColumn("place", place).where("place <= 5").select("p", "place", F.col("id").alias("hit"), "title", "year")
    return op.fallback(rows.select("id", "p", "title", "year"), hits, search="p")


@register("S11", "SELECT id, (2101 + id // 100000) || '.' || lpad(CAST(id % 100000 AS VARCHAR), 5, '0') AS arxiv, 'Title of ' || id AS title, year FROM papers WHERE arxiv_id IS NOT NULL")
def s11(spark, sf):
    """Atom entries of all papers on arXiv, read and looked up by the ids asked for, each once."""
    from ..sources.records import arxiv_atom

    number = F.concat((F.lit(2101) + F.floor(F.col("id") / 100000)).cast("string"), F.lit("."), F.lpad((F.col("id") % 100000).cast("string"), 5, "0"))
    papers = view(spark, sf, "papers").where("arxiv_id IS NOT NULL").withColumn("arxiv_id", number)
    text = lambda s: F.lit(s)
    entry = F.concat(text("<entry><id>http://arxiv.org/abs/"), "arxiv_id", text("v2</id><title>Title  of\n "), F.col("id").cast("string"), text("</title><summary>s</summary><published>"), F.col("year").cast("string"), text("-01-01T00:00:00Z</published><author><name>A B</name></author></entry>"))
    asked = papers.select("id", F.regexp_replace("arxiv_id", r"v\d+$", "").alias("arxiv")).union(papers.select("id", "arxiv_id")).distinct()
    return asked.join(arxiv_atom(papers.select(entry.alias("raw"))).dropDuplicates(["arxiv"]), "arxiv").select("id", "arxiv", "title", "year")


STAGES = """WITH s AS (SELECT project_id AS p, work_id FROM inclusions WHERE depth = 0 AND score > 0.45), e AS (SELECT DISTINCT s.p, cited AS work_id FROM citations JOIN s ON s.work_id = citing UNION SELECT s.p, citing FROM citations JOIN s ON s.work_id = cited),
    c AS (SELECT p, work_id FROM s UNION SELECT p, work_id FROM e), r AS (SELECT c.p, c.work_id, score, row_number() OVER (PARTITION BY c.p ORDER BY coalesce(score, 0) DESC, c.work_id) AS place FROM c LEFT JOIN inclusions i ON i.project_id = c.p AND i.work_id = c.work_id)"""


@register("H10", STAGES + """ SELECT 'seeds' AS stage, p AS project, count(*) AS n FROM s GROUP BY p UNION ALL SELECT 'candidates', p, count(*) FROM c GROUP BY p UNION ALL SELECT 'included', p, count(*) FROM r WHERE place <= 150 GROUP BY p
    UNION ALL SELECT 'citations', p, count(*) FROM (SELECT x.p FROM citations JOIN r x ON x.work_id = citing AND x.place <= 150 JOIN r y ON y.work_id = cited AND y.p = x.p AND y.place <= 150) z GROUP BY p""")
def h10(spark, sf):
    """A whole run for every project: seeds, expansion both ways, the best 150, their citations; the report of each stage."""
    from ..operators.lineage import saver

    inc, citations = views(spark, sf, "inclusions", "citations")
    save = saver(spark)
    own = inc.select(F.col("project_id").alias("project"), "work_id", "score")
    seeds = inc.where("depth = 0 AND score > 0.45").select(F.col("project_id").alias("project"), "work_id").distinct()
    ahead = citations.join(seeds.withColumnRenamed("work_id", "citing"), "citing").select("project", F.col("cited").alias("work_id"))
    back = citations.join(seeds.withColumnRenamed("work_id", "cited"), "cited").select("project", F.col("citing").alias("work_id"))
    candidates = save(seeds.union(ahead).union(back).distinct())
    # a project's first 150 from the first 150 of each of its parts, so that no project gathers in one task
    rows = candidates.join(own, ["project", "work_id"], "left").withColumn("part", F.pmod(F.xxhash64("work_id"), F.lit(64)))
    first = lambda df, *by: df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.coalesce("score", F.lit(0.0))), "work_id"))).where("place <= 150")
    included = save(first(first(rows, "project", "part"), "project").select("project", "work_id"))
    edges = citations.join(included.withColumnRenamed("work_id", "citing"), "citing").join(included.withColumnRenamed("work_id", "cited"), ["project", "cited"])
    report = [df.groupBy("project").agg(F.count("*").alias("n")).select(F.lit(name).alias("stage"), "project", "n") for name, df in (("seeds", seeds), ("candidates", candidates), ("included", included), ("citations", edges))]
    return report[0].union(report[1]).union(report[2]).union(report[3])
