"""Queries over the graph store: G01-G27, W01-W18."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import view, views
from ..operators import store as op
from ..registry import register

P = "ASIA"
IN = f"SELECT work_id FROM inclusions WHERE project_id = '{P}'"


@register("G01", "SELECT id, name, created_at FROM projects")
def g01(spark, sf):
    return op.newest_first(view(spark, sf, "projects"))


@register("G02", "SELECT id, title, year FROM works WHERE id = 7")
def g02(spark, sf):
    return view(spark, sf, "works").where("id = 7").select("id", "title", "year")


@register("G03", f"SELECT id, title FROM works WHERE id IN ({IN})")
def g03(spark, sf):
    works, inc = views(spark, sf, "works", "inclusions")
    return op.in_project(works, inc, P).select("id", "title").orderBy("id")


@register("G04", f"SELECT DISTINCT concept_id AS id FROM work_concepts WHERE work_id IN ({IN})")
def g04(spark, sf):
    wc, inc = views(spark, sf, "work_concepts", "inclusions")
    return op.attached(wc, inc, P).select(F.col("concept_id").alias("id")).distinct().orderBy("id")


@register("G05", """SELECT id, score FROM (SELECT doc_id AS id, CAST(len(list_filter(string_split_regex(lower(text), '[^a-z0-9à-ÿßœ]+'), lambda x: x IN ('the', 'token', 'license'))) AS BIGINT) AS score
    FROM documents) t WHERE score > 0 ORDER BY score DESC, id LIMIT 20""")
def g05(spark, sf):
    docs = view(spark, sf, "documents").withColumnRenamed("doc_id", "id")
    return op.search(docs, "The token, license", F.col("text"))


@register("G07", """SELECT w.id, coalesce(a.x, []) AS cites, coalesce(b.x, []) AS cited_by, coalesce(c.x, []) AS authors, coalesce(d.x, []) AS concepts FROM works w
    LEFT JOIN (SELECT citing AS id, list(cited ORDER BY cited) AS x FROM citations GROUP BY citing) a USING (id)
    LEFT JOIN (SELECT cited AS id, list(citing ORDER BY citing) AS x FROM citations GROUP BY cited) b USING (id)
    LEFT JOIN (SELECT work_id AS id, list(author_id ORDER BY position) AS x FROM authorships GROUP BY work_id) c USING (id)
    LEFT JOIN (SELECT work_id AS id, list(concept_id ORDER BY score DESC, concept_id) AS x FROM work_concepts GROUP BY work_id) d USING (id)""")
def g07(spark, sf):
    return op.neighbourhood(*views(spark, sf, "works", "citations", "authorships", "work_concepts"))


@register("G08", f"SELECT DISTINCT work_id AS id FROM authorships WHERE author_id = 3 AND work_id IN ({IN})")
def g08(spark, sf):
    au, inc = views(spark, sf, "authorships", "inclusions")
    return op.attached(au.where("author_id = 3"), inc, P).select(F.col("work_id").alias("id")).distinct().orderBy("id")


@register("G09", f"SELECT DISTINCT work_id AS id FROM work_concepts WHERE concept_id = 'Brand#13' AND work_id IN ({IN})")
def g09(spark, sf):
    wc, inc = views(spark, sf, "work_concepts", "inclusions")
    return op.attached(wc.where("concept_id = 'Brand#13'"), inc, P).select(F.col("work_id").alias("id")).distinct().orderBy("id")


@register("G10", """SELECT id, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree FROM works LEFT JOIN (SELECT cited, count(*) AS i FROM citations GROUP BY cited) a ON cited = id
    LEFT JOIN (SELECT citing, count(*) AS o FROM citations GROUP BY citing) b ON citing = id""")
def g10(spark, sf):
    return op.degrees(*views(spark, sf, "works", "citations"))


@register("G11", """SELECT p.project_id, count(*) AS works,
    coalesce((SELECT count(*) FROM citations c JOIN inclusions a ON a.work_id = citing JOIN inclusions b ON b.work_id = cited WHERE a.project_id = p.project_id AND b.project_id = p.project_id), 0) AS citations,
    (SELECT count(DISTINCT author_id) FROM authorships x JOIN inclusions i USING (work_id) WHERE i.project_id = p.project_id) AS authors,
    (SELECT count(DISTINCT concept_id) FROM work_concepts x JOIN inclusions i USING (work_id) WHERE i.project_id = p.project_id) AS concepts
    FROM inclusions p GROUP BY p.project_id""")
def g11(spark, sf):
    return op.stats(*views(spark, sf, "inclusions", "citations", "authorships", "work_concepts"))


_VIEW = ("works", "citations", "authors", "authorships", "concepts", "work_concepts")


@register("G12_nodes", """SELECT 'work:' || id AS id, 'work' AS kind, title AS label FROM works UNION ALL
    SELECT 'author:' || id, 'author', name FROM authors WHERE id IN (SELECT author_id FROM authorships) UNION ALL
    SELECT 'concept:' || id, 'concept', label FROM concepts WHERE id IN (SELECT concept_id FROM work_concepts)""")
def g12_nodes(spark, sf):
    return op.graph_view(*views(spark, sf, *_VIEW))[0]


@register("G12_edges", """SELECT 'work:' || citing AS source, 'work:' || cited AS target, 'cites' AS kind FROM citations UNION ALL
    SELECT 'work:' || work_id, 'author:' || author_id, 'authored_by' FROM authorships UNION ALL SELECT 'work:' || work_id, 'concept:' || concept_id, 'has_concept' FROM work_concepts""")
def g12_edges(spark, sf):
    return op.graph_view(*views(spark, sf, *_VIEW))[1]


@register("G13", "SELECT citing, cited FROM citations WHERE citing IN (SELECT id FROM works WHERE year = 1996 AND work_type = 'O') OR cited IN (SELECT id FROM works WHERE year = 1996 AND work_type = 'O')")
def g13(spark, sf):
    return op.lens(*views(spark, sf, "works", "citations"), {"year": 1996, "work_type": "O"})


@register("G15", "SELECT id, label FROM concepts WHERE contains(lower(label), 'brand#1')")
def g15(spark, sf):
    return op.resolve(view(spark, sf, "concepts"), "BRAND#1")


@register("G16", "SELECT DISTINCT work_id AS id FROM work_concepts WHERE concept_id IN (SELECT id FROM concepts WHERE contains(lower(label), 'brand#1'))")
def g16(spark, sf):
    concepts, wc = views(spark, sf, "concepts", "work_concepts")
    return wc.join(op.resolve(concepts, "BRAND#1").select(F.col("id").alias("concept_id")), "concept_id", "left_semi").select(F.col("work_id").alias("id")).distinct()


@register("G17", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, kind ORDER BY n DESC, item) AS place FROM (
    SELECT project_id, 'concept' AS kind, concept_id AS item, count(*) AS n FROM work_concepts JOIN inclusions USING (work_id) GROUP BY project_id, concept_id UNION ALL
    SELECT project_id, 'work', CAST(id AS VARCHAR), CAST(cited_by_count AS BIGINT) FROM works JOIN inclusions ON work_id = id) t) u WHERE place <= 10""")
def g17(spark, sf):
    return op.overview(*views(spark, sf, "inclusions", "works", "work_concepts"))


@register("G18", "SELECT doc_id AS id, CASE WHEN length(text) > 1600 THEN rtrim(substring(text, 1, 1600), ' ') || '…' ELSE text END AS abstract FROM documents")
def g18(spark, sf):
    return op.paper_info(view(spark, sf, "documents").withColumnRenamed("doc_id", "id"), F.col("text"))


@register("G20", "SELECT id, year, cited_by_count, venue, work_type FROM works")
def g20(spark, sf):
    works = view(spark, sf, "works")
    return works.select("id").join(works.select("id", "year", "cited_by_count", "venue", "work_type"), "id", "left")


@register("G21", """SELECT 'work' AS kind, CAST(id AS VARCHAR) AS id FROM works WHERE year BETWEEN 1996 AND 1997 UNION ALL
    SELECT DISTINCT 'concept', concept_id FROM work_concepts JOIN works ON id = work_id WHERE year BETWEEN 1996 AND 1997""")
def g21(spark, sf):
    return op.year_view(*views(spark, sf, "works", "work_concepts"), 1996, 1997)


@register("G22", "SELECT year, count(*) AS works FROM works GROUP BY year")
def g22(spark, sf):
    return view(spark, sf, "works").groupBy("year").agg(F.count("*").alias("works")).orderBy("year")


@register("G23", "SELECT id, round(least(18.0, 5 + 2.2 * ln(1 + greatest(0, cited_by_count))), 6) AS size FROM works")
def g23(spark, sf):
    return op.node_sizes(view(spark, sf, "works"))


@register("G25", "SELECT id FROM works WHERE year > 1997 ORDER BY id LIMIT 200")
def g25(spark, sf):
    works = view(spark, sf, "works")
    return op.increment(works, works.where("year <= 1997"))


@register("G27", "SELECT DISTINCT concept_id, CASE WHEN concept_id LIKE '%1' THEN replace(concept_id, '#', ' ') ELSE concept_id END AS label FROM work_concepts")
def g27(spark, sf):
    wc, concepts = views(spark, sf, "work_concepts", "concepts")
    return op.labels_of(wc, concepts.where("id NOT LIKE '%1'"))


@register("W01", "SELECT id, CASE WHEN year >= 1997 THEN 'new ' || title ELSE title END AS title, year, venue FROM works")
def w01(spark, sf):
    works = view(spark, sf, "works").select("id", "title", "year", "venue")
    new = works.where("year >= 1997").select("id", F.concat(F.lit("new "), "title").alias("title"), F.lit(None).cast("int").alias("year"), F.lit(None).cast("string").alias("venue"))
    return op.upsert(works, new)


@register("W02", "SELECT id, CASE WHEN id % 2 = 0 THEN upper(name) ELSE name END AS name FROM authors")
def w02(spark, sf):
    authors = view(spark, sf, "authors")
    return op.upsert(authors, authors.where("id % 2 = 0").select("id", F.upper("name").alias("name")))


@register("W03", "SELECT id, upper(label) AS label, list_sort(list_distinct([label, lower(label), 'x'])) AS aliases, true AS linkable FROM concepts")
def w03(spark, sf):
    concepts = view(spark, sf, "concepts")
    old = concepts.select("id", "label", F.array("label", F.lit("x")).alias("aliases"), F.lit(True).alias("linkable"))
    new = concepts.select("id", F.upper("label").alias("label"), F.array(F.lower("label"), F.lit("x")).alias("aliases"), F.lit(None).cast("boolean").alias("linkable"))
    return op.upsert_concepts(old, new)


@register("W04", """SELECT c_mktsegment AS project_id, o_custkey AS work_id, arg_min(o_orderpriority, o_orderkey) AS discovered_via, min(CAST(o_orderkey % 4 AS INT)) AS depth,
    arg_min(o_totalprice, o_orderkey) FILTER (o_orderstatus <> 'O') AS score FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment, o_custkey""")
def w04(spark, sf):
    orders, customer = views(spark, sf, "orders", "customer")
    events = orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("c_mktsegment").alias("project_id"), F.col("o_custkey").alias("work_id"), F.col("o_orderpriority").alias("discovered_via"),
        (F.col("o_orderkey") % 4).cast("int").alias("depth"), F.when(F.col("o_orderstatus") != "O", F.col("o_totalprice")).alias("score"), F.col("o_orderkey").alias("seq"),
    )
    return op.include(events)


@register("W05", "SELECT DISTINCT l_partkey AS citing, l_suppkey AS cited FROM lineitem WHERE l_partkey <> l_suppkey AND l_partkey IN (SELECT p_partkey FROM part) AND l_suppkey IN (SELECT p_partkey FROM part)")
def w05(spark, sf):
    lineitem, part = views(spark, sf, "lineitem", "part")
    return op.valid_citations(lineitem.select(F.col("l_partkey").alias("citing"), F.col("l_suppkey").alias("cited")), part.select(F.col("p_partkey").alias("id")))


@register("W06", "SELECT work_id, concept_id, score FROM work_concepts WHERE work_id NOT IN (SELECT id FROM works WHERE year = 1995) UNION ALL SELECT id, 'fresh', 1.0 FROM works WHERE year = 1995")
def w06(spark, sf):
    wc, works = views(spark, sf, "work_concepts", "works")
    return op.replace_attached(wc, works.where("year = 1995").select(F.col("id").alias("work_id"), F.lit("fresh").alias("concept_id"), F.lit(1.0).alias("score")))


@register("W07", "SELECT id, label, CASE WHEN id LIKE '%3' THEN true END AS linkable FROM concepts")
def w07(spark, sf):
    concepts = view(spark, sf, "concepts").withColumn("linkable", F.lit(None).cast("boolean"))
    return op.upsert(concepts, concepts.where("id LIKE '%3'").withColumn("linkable", F.lit(True)))


@register("W08", "SELECT id, name FROM projects WHERE id <> 'ASIA'")
def w08(spark, sf):
    return op.delete(view(spark, sf, "projects"), "id", P).select("id", "name")


@register("W09", "SELECT DISTINCT o.o_orderkey AS citing, m.k AS cited FROM orders o JOIN (SELECT o_custkey, min(o_orderkey) AS k FROM orders GROUP BY o_custkey) m ON m.o_custkey = o.o_custkey WHERE o.o_orderkey <> m.k")
def w09(spark, sf):
    orders = view(spark, sf, "orders")
    return op.edges_from_references(orders.select(F.col("o_orderkey").alias("citing"), F.col("o_custkey").alias("key")), orders.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("work_id")))


@register("W12", """SELECT project_id, id, created_at, active FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id DESC) AS place FROM
    (SELECT o_custkey AS project_id, o_orderkey AS id, o_orderdate AS created_at, o_orderstatus = 'P' AS active FROM orders) t) u WHERE place <= 3 OR active""")
def w12(spark, sf):
    runs = view(spark, sf, "orders").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderstatus") == "P").alias("active"))
    return op.newest_runs(runs, 3)


@register("W13", "SELECT conv_id, count(*) AS messages, max(turn) AS last_turn, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id")
def w13(spark, sf):
    return view(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("last_role"))


@register("W16", """SELECT 'https://example.org/id/work/' || id AS s, p, o, 'live' AS g FROM (SELECT id, 'title' AS p, title AS o FROM works UNION ALL SELECT id, 'year', CAST(year AS VARCHAR) FROM works UNION ALL SELECT id, 'venue', venue FROM works) t WHERE o IS NOT NULL""")
def w16(spark, sf):
    return op.quads(view(spark, sf, "works"), F.concat(F.lit("https://example.org/id/work/"), F.col("id").cast("string")), "live", ["title", "year", "venue"])


@register("W18", "SELECT (SELECT count(*) FROM orders) AS had, (SELECT count(*) FROM customer) AS has, (SELECT count(*) FROM customer) >= (SELECT count(*) FROM orders) AS ok")
def w18(spark, sf):
    return op.may_overwrite(view(spark, sf, "orders"), view(spark, sf, "customer"))
