"""Queries of the graph analytics: A01-A31."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..bindings import view, views
from ..operators import analysis as op
from ..operators import sequential, store
from ..operators.communities import communities_within
from ..operators.lineage import shared_folder
from ..registry import register

CITES = "SELECT DISTINCT least(citing, cited) AS a, greatest(citing, cited) AS b, 1.0 AS weight FROM citations WHERE citing <> cited"
COUPLED = "SELECT x.citing AS a, y.citing AS b, least(2.0, 0.5 * count(*)) AS weight FROM citations x JOIN citations y ON x.cited = y.cited AND x.citing < y.citing GROUP BY 1, 2"
SHARED = """SELECT a, b, 0.5 * m / (na + nb - m) AS weight FROM (SELECT x.work_id AS a, y.work_id AS b, count(*) AS m FROM work_parts x JOIN work_parts y ON x.concept_id = y.concept_id AND x.work_id < y.work_id GROUP BY 1, 2) t
    JOIN (SELECT work_id AS a, count(*) AS na FROM work_parts GROUP BY 1) u USING (a) JOIN (SELECT work_id AS b, count(*) AS nb FROM work_parts GROUP BY 1) v USING (b) WHERE m / (na + nb - m) >= 0.2"""


@register("A01", CITES)
def a01(spark, sf):
    return op.citation_weights(view(spark, sf, "citations"))


@register("A02", COUPLED)
def a02(spark, sf):
    return op.coupling_weights(view(spark, sf, "citations"))


@register("A03", SHARED.replace("0.5 * m / (na + nb - m) AS weight", "round(0.5 * m / (na + nb - m), 6) AS weight"))
def a03(spark, sf):
    return op.concept_weights(view(spark, sf, "work_parts")).withColumn("weight", F.round("weight", 6))


@register("A04", f"SELECT a, b, round(sum(weight), 6) AS weight FROM ({CITES} UNION ALL {COUPLED} UNION ALL {SHARED}) t GROUP BY a, b")
def a04(spark, sf):
    citations = view(spark, sf, "citations")
    return op.similarity_graph(op.citation_weights(citations), op.coupling_weights(citations), op.concept_weights(view(spark, sf, "work_parts")))


@register("A05")
def a05(spark, sf):
    return communities_within(*views(spark, sf, "project_works", "citations", "work_parts"), f"{shared_folder(spark)}/{uuid.uuid4().hex}")


@register("A06", """SELECT cluster_id, concept_id, support, round(support / size * ln(1 + (SELECT count(*) FROM clusters) / df), 6) AS score FROM
    (SELECT cluster_id, concept_id, count(*) AS support FROM clusters JOIN work_concepts USING (work_id) GROUP BY 1, 2) s JOIN (SELECT cluster_id, count(*) AS size FROM clusters GROUP BY 1) z USING (cluster_id)
    JOIN (SELECT concept_id, count(DISTINCT work_id) AS df FROM work_concepts GROUP BY 1) d USING (concept_id) WHERE support >= 2 AND support / size >= CASE WHEN size >= 8 THEN 0.20 ELSE 0.25 END""")
def a06(spark, sf):
    return op.concept_scores(*views(spark, sf, "clusters", "work_concepts"))


_TITLES = """WITH t AS (SELECT id, list_filter(string_split_regex(lower(title), '[^a-z0-9]+'), lambda x: length(x) > 1 AND NOT regexp_matches(x, '[0-9]') AND x NOT IN ('a','an','and','are','as','at','be','by','for','from','in','is','it','of','on','or','that','the','this','to','was','with')) AS w FROM works),
    ph AS (SELECT DISTINCT id, p FROM (SELECT id, unnest(w) AS p FROM t UNION ALL SELECT id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM t) q),"""


@register("A07", _TITLES + """ own AS (SELECT cluster_id, id, p FROM ph JOIN clusters ON work_id = id), per AS (SELECT cluster_id, p, count(*) AS support FROM own GROUP BY 1, 2 HAVING count(*) >= 2),
    parts AS (SELECT DISTINCT cluster_id, unnest(string_split(p, ' ')) AS p FROM per WHERE contains(p, ' '))
    SELECT cluster_id, p AS phrase, support, round(support / size * ln(1 + (SELECT count(*) FROM clusters) / df), 6) AS score FROM per JOIN (SELECT cluster_id, count(*) AS size FROM clusters GROUP BY 1) z USING (cluster_id)
    JOIN (SELECT p, count(DISTINCT id) AS df FROM own GROUP BY 1) d USING (p) WHERE NOT EXISTS (SELECT 1 FROM parts WHERE parts.cluster_id = per.cluster_id AND parts.p = per.p)""")
def a07(spark, sf):
    return op.title_scores(*views(spark, sf, "clusters", "works"))


PAGERANK = """o AS MATERIALIZED (SELECT p, a AS id, count(*) AS out FROM e GROUP BY 1, 2), nn AS MATERIALIZED (SELECT p, count(*) AS n FROM m GROUP BY 1), r(k, p, id, rank, err) AS (
    SELECT 0, p, id, 1.0::DOUBLE / n, 1e9::DOUBLE FROM m JOIN nn USING (p) UNION ALL
    SELECT k, p, id, rank, sum(abs(rank - old)) OVER (PARTITION BY p) / n FROM (SELECT r.k + 1 AS k, r.p, r.id, nn.n, r.rank AS old, 0.15 / nn.n + 0.85 * (coalesce(g.s, 0) + d.lost / nn.n) AS rank
        FROM r JOIN nn ON nn.p = r.p LEFT JOIN (SELECT e.p, e.b AS id, sum(q.rank / o.out) AS s FROM e JOIN r q ON q.p = e.p AND q.id = e.a JOIN o ON o.p = e.p AND o.id = e.a GROUP BY 1, 2) g ON g.p = r.p AND g.id = r.id
        JOIN (SELECT q.p, sum(CASE WHEN o.id IS NULL THEN q.rank ELSE 0 END) AS lost FROM r q LEFT JOIN o ON o.p = q.p AND o.id = q.id GROUP BY 1) d ON d.p = r.p WHERE r.err >= 1e-6 AND r.k < 100) z),
    pr AS MATERIALIZED (SELECT p, id, rank FROM (SELECT *, max(k) OVER (PARTITION BY p) AS last FROM r) z WHERE k = last)"""


def _rank(spark, sf):
    from ..operators.lineage import saver

    return op.pagerank(*views(spark, sf, "works", "citations"), save=saver(spark))


@register("A09", f"WITH RECURSIVE m AS MATERIALIZED (SELECT 1 AS p, id FROM works), e AS MATERIALIZED (SELECT 1 AS p, citing AS a, cited AS b FROM citations), {PAGERANK} SELECT id, round(rank * 1000, 6) AS rank FROM pr")
def a09(spark, sf):
    return _rank(spark, sf).select("id", F.round(F.col("rank") * 1000, 6).alias("rank"))


# Every pair's shortest paths level by level, and each node's share of those it lies on: an independent way to the same numbers.
BETWEEN = """u AS MATERIALIZED (SELECT DISTINCT p, least(a, b) AS x, greatest(a, b) AS y FROM e), h AS MATERIALIZED (SELECT p, x, y FROM u UNION ALL SELECT p, y, x FROM u),
    f(step, p, s, v, d, n) AS (SELECT 0, p, x, x, 0, 1.0::DOUBLE FROM (SELECT DISTINCT p, x FROM h) z UNION ALL
    SELECT step + 1, p, s, v, d, n FROM ((SELECT f.step, f.p, f.s, h.y AS v, f.d + 1 AS d, sum(f.n) AS n FROM f JOIN h ON h.p = f.p AND h.x = f.v WHERE f.d = f.step
        AND NOT EXISTS (SELECT 1 FROM f q WHERE q.p = f.p AND q.s = f.s AND q.v = h.y) GROUP BY ALL) UNION ALL (SELECT step, p, s, v, d, n FROM f WHERE d = step)) z),
    sp AS MATERIALIZED (SELECT DISTINCT p, s, v, d, n FROM f),
    bt AS MATERIALIZED (SELECT x.p, x.v AS id, sum(x.n * y.n / z.n) AS paths FROM sp x JOIN sp y ON y.p = x.p AND y.s = x.v JOIN sp z ON z.p = x.p AND z.s = x.s AND z.v = y.v AND z.d = x.d + y.d
        WHERE x.s <> x.v AND y.s <> y.v AND x.s <> y.v GROUP BY 1, 2)"""
CENTRAL = f"""WITH RECURSIVE m AS MATERIALIZED (SELECT project_id AS p, work_id AS id FROM project_works), e AS MATERIALIZED (SELECT project_id AS p, citing AS a, cited AS b FROM project_citations), {PAGERANK}, {BETWEEN},
    ce AS MATERIALIZED (SELECT m.p, m.id, round(rank, 12) AS rank, round(CASE WHEN n > 2 THEN coalesce(paths, 0) / ((n - 1) * (n - 2)) ELSE 0 END, 12) AS betweenness, coalesce(i, 0) AS in_degree, coalesce(out, 0) AS out_degree FROM m JOIN nn USING (p) JOIN pr ON pr.p = m.p AND pr.id = m.id
        LEFT JOIN bt ON bt.p = m.p AND bt.id = m.id LEFT JOIN o ON o.p = m.p AND o.id = m.id LEFT JOIN (SELECT p, b AS id, count(*) AS i FROM e GROUP BY 1, 2) w ON w.p = m.p AND w.id = m.id)"""


def _central(spark, sf):
    return sequential.centrality(*views(spark, sf, "project_works", "project_citations"))


@register("A10", f"{CENTRAL} SELECT p AS project_id, id, round(betweenness, 6) AS betweenness FROM ce")
def a10(spark, sf):
    return _central(spark, sf).select("project_id", "id", F.round("betweenness", 6).alias("betweenness"))


DEGREES = """SELECT id, year, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree FROM works LEFT JOIN (SELECT cited, count(*) AS i FROM citations GROUP BY cited) a ON cited = id
    LEFT JOIN (SELECT citing, count(*) AS o FROM citations GROUP BY citing) b ON citing = id"""


@register("A11", f"SELECT id, in_degree, out_degree FROM ({DEGREES}) t")
def a11(spark, sf):
    return store.degrees(*views(spark, sf, "works", "citations"))


@register("A12", f"SELECT id FROM ({DEGREES}) t ORDER BY out_degree DESC, id LIMIT (SELECT CAST(ceil(count(*) * 0.1) AS BIGINT) FROM works)")
def a12(spark, sf):
    return op.top_share(store.degrees(*views(spark, sf, "works", "citations")), "out_degree")


TOP = "row_number() OVER (PARTITION BY p ORDER BY {} DESC, id) <= CASE WHEN count(*) OVER (PARTITION BY p) < 10 THEN 1 ELSE ceil(count(*) OVER (PARTITION BY p) * 0.1) END AS top_{}"
ROLES = f"""{CENTRAL}, nb AS (SELECT p, id, count(DISTINCT cluster_id) AS clusters FROM (SELECT p, a AS id, b AS work_id FROM e UNION ALL SELECT p, b, a FROM e) t JOIN clusters USING (work_id) GROUP BY 1, 2),
    ro AS (SELECT t.p AS project_id, t.id, in_degree, out_degree, rank, concat_ws(',', CASE WHEN top_rank AND in_degree >= 3 THEN 'foundational' END, CASE WHEN top_betweenness AND betweenness > 0 AND coalesce(clusters, 0) >= 2 THEN 'bridge' END,
    CASE WHEN top_out_degree AND out_degree >= 5 THEN 'hub' END, CASE WHEN year >= max(year) OVER (PARTITION BY t.p) - 1 AND in_degree <= 1 AND out_degree >= 2 THEN 'emerging' END, CASE WHEN in_degree + out_degree = 0 THEN 'peripheral' END) AS roles
    FROM (SELECT *, {', '.join(TOP.format(c, c) for c in ('rank', 'betweenness', 'out_degree'))} FROM ce) t JOIN works ON works.id = t.id LEFT JOIN nb ON nb.p = t.p AND nb.id = t.id)"""


def _roles(spark, sf):
    works, edges, clusters = views(spark, sf, "works", "project_citations", "clusters")
    both = edges.select("project_id", F.col("citing").alias("id"), F.col("cited").alias("work_id")).union(edges.select("project_id", F.col("cited"), F.col("citing")))
    near = both.join(clusters, "work_id").groupBy("project_id", "id").agg(F.count_distinct("cluster_id").alias("clusters"))
    return op.project_roles(works, _central(spark, sf), near)


@register("A13", f"{ROLES} SELECT project_id, id, in_degree, out_degree, roles FROM ro")
def a13(spark, sf):
    return _roles(spark, sf)


@register("A13_clusters", """SELECT id, count(DISTINCT cluster_id) AS clusters FROM (SELECT citing AS id, cited AS work_id FROM citations UNION ALL SELECT cited, citing FROM citations) t JOIN clusters USING (work_id) GROUP BY id""")
def a13_clusters(spark, sf):
    return op.neighbour_clusters(*views(spark, sf, "citations", "clusters"))


@register("A14")
def a14(spark, sf):
    works, edges = views(spark, sf, "works", "project_citations")
    return sequential.main_path(sequential.dated(edges.select("project_id", F.col("citing").alias("a"), F.col("cited").alias("b")), works))


@register("A15", """SELECT coalesce(f.id, s.id) AS id, coalesce(f.c, s.c) AS confidence, coalesce(s.status, 'open') AS status, s.note, f.id IS NULL AS stale FROM
    (SELECT p_partkey AS id, p_retailprice AS c FROM part WHERE p_size > 10) f FULL OUTER JOIN (SELECT p_partkey AS id, 1.0 AS c, 'rejected' AS status, p_brand AS note FROM part WHERE p_size < 20) s ON f.id = s.id""")
def a15(spark, sf):
    part = view(spark, sf, "part")
    fresh = part.where("p_size > 10").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("confidence"))
    stored = part.where("p_size < 20").select(F.col("p_partkey").alias("id"), F.lit(1.0).alias("confidence"), F.lit("rejected").alias("status"), F.col("p_brand").alias("note"))
    return op.merge_gaps(fresh, stored)


RECENT = "SELECT * FROM works WHERE year BETWEEN 1999 AND 2001"


@register("A16", f"SELECT id, year FROM ({RECENT}) t")
def a16(spark, sf):
    return view(spark, sf, "works").where(F.col("year").between(1999, 2001)).select("id", "year")


VELOCITY = f"""SELECT id, CASE WHEN n > 1 THEN (r - 1 + (ties - 1) / 2.0) / (n - 1) ELSE 1.0 END AS velocity FROM (SELECT id, rank() OVER (ORDER BY v) AS r, count(*) OVER (PARTITION BY v) AS ties, count(*) OVER () AS n
    FROM (SELECT id, greatest(0, cited_by_count)::DOUBLE / greatest(1, 2001 - year + 1) AS v FROM ({RECENT}) t) u) w"""


@register("A17", f"SELECT id, round(velocity, 6) AS velocity FROM ({VELOCITY}) t")
def a17(spark, sf):
    recent = view(spark, sf, "works").where(F.col("year").between(1999, 2001))
    rows = op.tied_percentiles(recent, F.greatest(F.lit(0), "cited_by_count").cast("double") / F.greatest(F.lit(1), 2001 - F.col("year") + 1), "velocity")
    return rows.select("id", F.round("velocity", 6).alias("velocity"))


PATH = "SELECT id, year >= 2001 AS last FROM works WHERE cited_by_count > 450"
PREPRINT = """(regexp_matches(trim(regexp_replace(lower(coalesce(work_type, '')), '[^a-z0-9]+', ' ', 'g')), 'preprint|working ?paper|posted content') OR (coalesce(arxiv_id, '') <> '' AND (coalesce(venue, '') = '' OR starts_with(lower(venue), 'arxiv'))
    AND (coalesce(doi, '') = '' OR starts_with(regexp_replace(lower(doi), '^https?://(dx\\.)?doi\\.org/', ''), '10.48550/'))))"""
PARTS = f"""SELECT t.id, t.year, velocity, coalesce(i.n, 0)::DOUBLE / (SELECT max(coalesce(n, 0)) FROM ({RECENT}) z LEFT JOIN (SELECT cited, count(*) AS n FROM citations GROUP BY cited) y ON cited = id) AS uptake,
    CASE WHEN t.id IN (SELECT id FROM ({PATH}) p WHERE last) THEN 1.0 WHEN t.id IN (SELECT citing FROM citations WHERE cited IN (SELECT id FROM ({PATH}) p)) THEN 0.5 ELSE 0.0 END AS leaf,
    coalesce(g.growth, 0) AS growth, CASE WHEN (SELECT count(*) FROM papers x WHERE x.id = t.id AND {PREPRINT}) > 0 THEN 1.0 ELSE 0.0 END AS preprint, CASE WHEN t.id IN (SELECT work_id FROM work_concepts WHERE concept_id IN (SELECT concept_id FROM work_concepts JOIN works ON id = work_id GROUP BY concept_id HAVING min(year) BETWEEN 1999 AND 2001 AND count(*) FILTER (year BETWEEN 1999 AND 2001) >= 2)) THEN 1.0 ELSE 0.0 END AS novelty
    FROM ({RECENT}) t JOIN ({VELOCITY}) v USING (id) LEFT JOIN (SELECT cited AS id, count(*) AS n FROM citations GROUP BY cited) i USING (id)
    LEFT JOIN (SELECT work_id AS id, least(2.0, share / (SELECT avg(CASE WHEN year BETWEEN 1999 AND 2001 THEN 1 ELSE 0 END) FROM works)) / 2 AS growth FROM clusters JOIN
        (SELECT cluster_id, avg(CASE WHEN year BETWEEN 1999 AND 2001 THEN 1 ELSE 0 END) AS share FROM clusters JOIN works ON id = work_id GROUP BY cluster_id) s USING (cluster_id)) g USING (id)"""


def _parts(spark, sf):
    works, citations, clusters, wc, papers = views(spark, sf, "works", "citations", "clusters", "work_concepts", "papers")
    path = works.where("cited_by_count > 450").select("id", (F.col("year") >= 2001).alias("last"))
    early = papers.select("id", op.preprint(F.col("work_type"), F.col("arxiv_id"), F.col("venue"), F.col("doi")).cast("double").alias("preprint"))
    return op.frontier_parts(works, citations, clusters, wc, path, 2001).join(early, "id", "left").na.fill(0.0, ["preprint"])


_ROUNDED = ("velocity", "uptake", "leaf", "growth", "novelty", "preprint")


@register("A18_A21", f"SELECT id, year, {', '.join(f'round({c}, 6) AS {c}' for c in _ROUNDED)} FROM ({PARTS}) q")
def a18(spark, sf):
    return _parts(spark, sf).select("id", "year", *[F.round(c, 6).alias(c) for c in _ROUNDED])


@register("F27", f"SELECT id, {PREPRINT} AS preprint FROM papers")
def f27(spark, sf):
    return view(spark, sf, "papers").select("id", op.preprint(F.col("work_type"), F.col("arxiv_id"), F.col("venue"), F.col("doi")).alias("preprint"))


@register("A22", f"SELECT id, round(0.30::DOUBLE * velocity + 0.15::DOUBLE * uptake + 0.15::DOUBLE * leaf + 0.15::DOUBLE * growth + 0.15::DOUBLE * novelty + 0.10::DOUBLE * preprint, 6) AS score FROM ({PARTS}) q")
def a22(spark, sf):
    return op.frontier_score(_parts(spark, sf))


@register("A20", """SELECT id, round(least(2.0, share / (SELECT avg(CASE WHEN year BETWEEN 1999 AND 2001 THEN 1 ELSE 0 END) FROM works)) / 2, 6) AS growth FROM (SELECT work_id AS id, cluster_id FROM clusters WHERE work_id IN (SELECT id FROM works)) c
    JOIN (SELECT cluster_id, avg(CASE WHEN year BETWEEN 1999 AND 2001 THEN 1 ELSE 0 END) AS share FROM clusters JOIN works ON id = work_id GROUP BY cluster_id) s USING (cluster_id)""")
def a20(spark, sf):
    works, clusters = views(spark, sf, "works", "clusters")
    return op.growth(works, clusters, 2001, 2).select("id", F.round("growth", 6).alias("growth"))


@register("A23", """SELECT concept_id, min(year) AS first_year, string_agg(year || ':' || n, ',' ORDER BY year) AS by_year FROM (SELECT concept_id, year, count(*) AS n FROM work_concepts JOIN works ON id = work_id GROUP BY 1, 2) t GROUP BY concept_id""")
def a23(spark, sf):
    return op.adoption(*views(spark, sf, "works", "work_concepts"))


@register("A24_A25", """WITH f AS (SELECT cluster_id, concept_id, count(*) AS f FROM eras JOIN work_concepts USING (work_id) GROUP BY 1, 2), nm AS (SELECT cluster_id, sqrt(sum(f * f)) AS n FROM f GROUP BY 1),
    j AS (SELECT x.cluster_id AS a, y.cluster_id AS b, x.concept_id AS c, x.f AS fa, y.f AS fb FROM f x JOIN f y ON x.concept_id = y.concept_id AND x.cluster_id < y.cluster_id),
    g AS (SELECT a, b, sum(fa * fb) AS dot, array_to_string(list(c ORDER BY -(fa + fb), lower(c), c)[1:3], ',') AS shared, list(c ORDER BY -fa, lower(c), c)[1] AS t, list(c ORDER BY -fb, lower(c), c) AS seconds FROM j GROUP BY 1, 2),
    l AS (SELECT least(x.cluster_id, y.cluster_id) AS a, greatest(x.cluster_id, y.cluster_id) AS b, count(*) AS links FROM citations JOIN eras x ON x.work_id = citing JOIN eras y ON y.work_id = cited WHERE x.cluster_id <> y.cluster_id GROUP BY 1, 2),
    z AS (SELECT cluster_id, count(*) AS n FROM eras GROUP BY 1), al AS (SELECT 0.25 * (SELECT count(*) FROM citations) / ((SELECT count(*) FROM eras) * ((SELECT count(*) FROM eras) - 1)) AS d),
    w AS (SELECT cluster_id, work_id FROM (SELECT cluster_id, work_id, row_number() OVER (PARTITION BY cluster_id ORDER BY coalesce(i, 0) DESC, cited_by_count DESC, lower(title), work_id) AS r FROM eras JOIN works ON id = work_id LEFT JOIN (SELECT cited, count(*) AS i FROM citations GROUP BY 1) c ON cited = work_id) q WHERE r = 1)
    SELECT a, b, coalesce(links, 0) AS links, round(dot / p.n / q.n, 6) AS similarity, round(0.5 * dot / p.n / q.n + 0.5 * greatest(0.0, 1 - coalesce(links, 0) / (u.n * v.n) / greatest((SELECT d FROM al), 1e-12)), 6) AS confidence, shared, s.work_id AS work_a, o.work_id AS work_b,
    concat_ws(',', t, list_filter(seconds, lambda x: x <> t)[1]) AS terms FROM g LEFT JOIN l USING (a, b) JOIN nm p ON p.cluster_id = a JOIN nm q ON q.cluster_id = b JOIN z u ON u.cluster_id = a JOIN z v ON v.cluster_id = b JOIN w s ON s.cluster_id = a JOIN w o ON o.cluster_id = b
    WHERE dot / p.n / q.n >= 0.30 AND coalesce(links, 0) / (u.n * v.n) <= (SELECT d FROM al) + 1e-12""")
def a24(spark, sf):
    eras, wc, citations, works = views(spark, sf, "eras", "work_concepts", "citations", "works")
    return op.bridging(eras, wc, citations, works)


@register("A26", """WITH wc AS (SELECT DISTINCT l_suppkey AS w, p_size || '/' || p_brand AS c FROM lineitem JOIN part ON p_partkey = l_partkey), ok AS (SELECT c FROM wc GROUP BY c HAVING count(*) >= 3 AND count(*) <= 0.40 * (SELECT count(DISTINCT w) FROM wc)),
    own AS (SELECT * FROM wc WHERE c IN (SELECT c FROM ok)), t AS (SELECT DISTINCT x.c AS a, y.c AS b FROM own x JOIN own y ON x.w = y.w AND x.c <> y.c), dg AS (SELECT a, count(*) AS d FROM t GROUP BY a HAVING count(*) > 1)
    SELECT t.a, u.b, round(sum(1 / ln(d)), 6) AS score FROM t JOIN dg ON dg.a = t.b JOIN t u ON u.a = t.b WHERE t.a < u.b AND NOT EXISTS (SELECT 1 FROM t z WHERE z.a = t.a AND z.b = u.b) GROUP BY 1, 2 HAVING sum(1 / ln(d)) > 0.5 ORDER BY score DESC, 1, 2 LIMIT 10""")
def a26(spark, sf):
    lineitem, part = views(spark, sf, "lineitem", "part")
    wc = lineitem.join(part, F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_suppkey").alias("work_id"), F.concat(F.col("p_size").cast("string"), F.lit("/"), "p_brand").alias("concept_id"))
    return op.matrix_voids(wc)


@register("A27", """WITH e AS (SELECT cluster_id, year, CASE WHEN year > (SELECT max(year) FROM works) - 2 THEN 1 ELSE 0 END AS r FROM eras JOIN works ON id = work_id), p AS (SELECT avg(r) AS p FROM e), y AS (SELECT max(year) AS y FROM works),
    c AS (SELECT cluster_id, count(*) AS size, max(year) AS last, avg(r) AS share FROM e GROUP BY cluster_id)
    SELECT cluster_id, size, last, round(share, 6) AS share, round(0.5 * greatest(0.0, least(1.0, 1 - share / (0.5 * p))) + 0.5 * least(1.0, (y - last) / 4.0), 6) AS confidence FROM c, p, y WHERE size >= 5 AND last <= y - 2 AND share < 0.5 * p""")
def a27(spark, sf):
    return op.stagnation(*views(spark, sf, "works", "eras"))


@register("A28", """SELECT * FROM (SELECT p_brand AS kind, p_partkey AS id, p_retailprice AS confidence, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS place FROM part) t WHERE place <= 20""")
def a28(spark, sf):
    return op.top_per_kind(view(spark, sf, "part").select(F.col("p_brand").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("confidence")))
