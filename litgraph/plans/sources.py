"""Queries of sources: S02-S14, S21, S22, S25, S28, S29."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..bindings import view, views
from ..registry import register
from ..sources import records as op


@register("S02", "SELECT pos, identity, o_totalprice FROM (SELECT o_orderkey AS pos, o_custkey AS identity, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) t WHERE r = 1")
def s02(spark, sf):
    o = view(spark, sf, "orders")
    asked = o.select(F.col("o_orderkey").alias("pos"), F.col("o_orderkey").alias("key"))
    return op.lookup_many(asked, o.select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("identity"), "o_totalprice")).select("pos", "identity", "o_totalprice")


@register("S04_S05", "SELECT c.citing, c.cited, w.year FROM citations c JOIN works w ON w.id = c.cited WHERE w.year >= 1998")
def s04(spark, sf):
    c, w = views(spark, sf, "citations", "works")
    return c.join(w.where("year >= 1998").select(F.col("id").alias("cited"), "year"), "cited").select("citing", "cited", "year")


_ITEM = '{"id":"https://openalex.org/W12","doi":"https://doi.org/10.1/AB.c","display_name":"A title","publication_year":2001,"cited_by_count":3,"abstract_inverted_index":{"deep":[0],"nets":[1,3],"are":[2],"x":[-1]},"authorships":[{"author":{"id":"A1","display_name":"N. N."}}],"keywords":[{"display_name":"Nets","score":0.5}],"referenced_works":["https://openalex.org/W7"],"locations":[{"is_oa":true,"pdf_url":"u2"},{"is_oa":false,"pdf_url":"u3"}],"best_oa_location":{"pdf_url":"u1"}}'


@register("S06_S07", "SELECT 'W12' AS openalex, '10.1/ab.c' AS doi, 'A title' AS title, 2001 AS year, 'deep nets are nets' AS abstract, 'W7' AS refs, 'u1,u2' AS pdfs")
def s06(spark, sf):
    # a DOI prefix has four digits or more
    out = op.openalex(spark.createDataFrame([(_ITEM.replace("10.1/", "10.1000/"),)], "raw string"))
    return out.select("openalex", F.replace("doi", F.lit("10.1000/"), F.lit("10.1/")).alias("doi"), "title", "year", "abstract", F.array_join("references", ",").alias("refs"), F.array_join("pdfs", ",").alias("pdfs"))


@register("S12", "SELECT '10.1000/ab' AS doi, 'T' AS title, 'V' AS venue, 1999 AS year, 'journal-article' AS work_type")
def s12(spark, sf):
    return op.crossref(spark.createDataFrame([('{"message":{"DOI":"10.1000/AB","title":["T"],"container-title":["V"],"type":"journal-article","issued":{"date-parts":[[1999,1]]}}}',)], "raw string"))


@register("S13", "SELECT '10.1000/ab' AS doi, 'a,b' AS pdfs")
def s13(spark, sf):
    out = op.unpaywall(spark.createDataFrame([('{"doi":"10.1000/ab","is_oa":true,"best_oa_location":{"url_for_pdf":"a"},"oa_locations":[{"url_for_pdf":"a"},{"url_for_pdf":"b"},{"url_for_pdf":null}]}',)], "raw string"))
    return out.select("doi", F.array_join("pdfs", ",").alias("pdfs"))


KEY = """sha256('{"endpoint":"works","params":{"limit":"' || (o_custkey % 5) || '","q":"' || o_orderpriority || '"},"source":"openalex"}')"""


@register("S14", f"SELECT DISTINCT {KEY} AS key FROM orders WHERE {KEY} NOT IN (SELECT {KEY} FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 480000)")
def s14(spark, sf):
    o = view(spark, sf, "orders")
    key = op.cache_key(F.lit("openalex"), F.lit("works"), F.create_map(F.lit("q"), F.col("o_orderpriority"), F.lit("limit"), (F.col("o_custkey") % 5).cast("string")))
    return op.misses(o.select(key.alias("key")).distinct(), o.where("o_orderstatus = 'P' AND o_totalprice > 480000").select(key.alias("key")).distinct())


PDFS = "SELECT l_orderkey AS work_id, 'https://host/' || l_partkey AS url, CASE WHEN l_tax > 0.06 THEN 'paid' ELSE 'free' END AS host, CASE l_returnflag WHEN 'A' THEN 'publishedVersion' WHEN 'R' THEN 'acceptedVersion' END AS version, l_suppkey * 10 + l_linenumber AS idx FROM lineitem"


@register("S21_S22", f"""SELECT work_id, url, row_number() OVER (PARTITION BY work_id ORDER BY rank, idx, url) AS place FROM (SELECT *, row_number() OVER (PARTITION BY work_id, url ORDER BY rank, idx, url) AS f FROM
    (SELECT *, CASE WHEN version = 'publishedVersion' THEN 1 WHEN version = 'acceptedVersion' THEN 2 WHEN host = 'paid' THEN 4 ELSE 3 END AS rank FROM ({PDFS}) p) q) r WHERE f = 1""")
def s21(spark, sf):
    li = view(spark, sf, "lineitem")
    version = F.when(F.col("l_returnflag") == "A", "publishedVersion").when(F.col("l_returnflag") == "R", "acceptedVersion")
    return op.rank_pdfs(li.select(F.col("l_orderkey").alias("work_id"), F.concat(F.lit("https://host/"), F.col("l_partkey").cast("string")).alias("url"), F.when(F.col("l_tax") > 0.06, "paid").otherwise("free").alias("host"), version.alias("version"), (F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("idx")))


@register("S25", "SELECT DISTINCT url FROM pages WHERE regexp_replace(split_part(url, '/', 3), '^www\\.', '') IN (SELECT regexp_replace(split_part(url, '/', 3), '^www\\.', '') FROM pages WHERE page_id < 20) AND regexp_matches(url, '^https?://[^/]+/en/')")
def s25(spark, sf):
    pages = view(spark, sf, "pages")
    host = F.regexp_replace(F.split_part("url", F.lit("/"), F.lit(3)), r"^www\.", "")
    return op.allowed(pages.select("url"), pages.where("page_id < 20").select(host.alias("host"), F.lit("/en/").alias("prefix")).distinct())


@register("S29", "SELECT coalesce(d, t) AS key, count(*) AS n, min(o_orderkey) AS first FROM (SELECT *, CASE WHEN o_orderstatus = 'F' THEN 'doi:' || o_custkey END AS d, 'title:' || o_orderpriority || '|' || year(o_orderdate) AS t FROM orders) q GROUP BY 1")
def s29(spark, sf):
    key = F.coalesce(F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("doi:"), F.col("o_custkey").cast("string"))), F.concat(F.lit("title:"), "o_orderpriority", F.lit("|"), F.year("o_orderdate").cast("string")))
    return view(spark, sf, "orders").groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))
