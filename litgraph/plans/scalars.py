"""Queries of the scalar functions: F01-F34."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import view
from ..functions import identity as i
from ..functions import text as t
from ..registry import register

#: Identifiers in the spellings that sources use.
IDS = [
    (1, "https://doi.org/10.1145/3292500.3330701", "arXiv:1905.12345v2", "https://openalex.org/W29384756", "1999-05-02", "Graphs & Trees: a <b>Survey</b> (biology)"),
    (2, "doi:10.48550/arXiv.2001.00001", "http://arxiv.org/abs/math.GT/0309136v1", "W12", "in press", "The neural_network-policies."),
    (3, "10.1000/ABC.D;", "2001.00001", "w7", "2021", "Gas"),
    (4, None, None, None, None, None),
]


def _ids(spark):
    return spark.createDataFrame(IDS, "id int, doi string, arxiv string, openalex string, year string, title string")


VALUES = "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else repr(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in IDS) + ") t(id, doi, arxiv, openalex, year, title)"


@register("F01", "SELECT doc_id, trim(regexp_replace(lower(text), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS folded FROM documents WHERE lang = 'en'")
def f01(spark, sf):
    return view(spark, sf, "documents").where("lang = 'en'").select("doc_id", i.fold_title(F.col("text")).alias("folded"))


@register("F02", f"SELECT id, regexp_replace(arxiv, 'v[0-9]+$', '') AS base FROM ({VALUES})")
def f02(spark, sf):
    return _ids(spark).select("id", i.arxiv_base(F.col("arxiv")).alias("base"))


@register("F03", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'W' || o_orderkey WHEN o_orderkey % 3 = 1 THEN 'doi:10.1/x' || o_custkey ELSE 'title:' || substring(sha1(lower(o_orderpriority) || '|' || year(o_orderdate)), 1, 16) END AS work FROM orders""")
def f03(spark, sf):
    k, none = F.col("o_orderkey"), F.lit(None).cast("string")
    return view(spark, sf, "orders").select(
        k.alias("id"),
        i.work_id(none, F.when(k % 3 == 0, F.concat(F.lit("W"), k.cast("string"))), F.when(k % 3 == 1, F.concat(F.lit("10.1/X"), F.col("o_custkey").cast("string"))), none, none, F.col("o_orderpriority"), F.year("o_orderdate")).alias("work"),
    )


@register("F04", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'orcid:' || s_suppkey ELSE 'name:' || lower(s_name) END AS author FROM supplier")
def f04(spark, sf):
    k, none = F.col("s_suppkey"), F.lit(None).cast("string")
    return view(spark, sf, "supplier").select(k.alias("id"), i.author_id(none, F.when(k % 2 == 0, k.cast("string")), none, none, F.col("s_name")).alias("author"))


@register("F05_F18", "SELECT p_partkey AS id, regexp_replace(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def f05(spark, sf):
    return view(spark, sf, "part").select(F.col("p_partkey").alias("id"), i.slug(F.concat_ws(" / ", "p_name", "p_brand")).alias("slug"))


@register("F06", r"""SELECT doc_id, regexp_replace(text, '([+\-&|!(){}\[\]^"~*?:\\/])', '\\\1', 'g') AS escaped FROM documents""")
def f06(spark, sf):
    return view(spark, sf, "documents").select("doc_id", i.escape_query(F.col("text")).alias("escaped"))


@register("F07", """SELECT * FROM (VALUES (1, '10.1145/3292500.3330701', '1905.12345', 'W29384756'), (2, '10.48550/arxiv.2001.00001', 'math.gt/0309136', 'W12'), (3, '10.1000/abc.d', '2001.00001', 'W7'), (4, NULL, NULL, NULL)) t(id, doi, arxiv, openalex)""")
def f07(spark, sf):
    c = F.col
    return _ids(spark).select("id", i.doi_of(c("doi")).alias("doi"), i.arxiv_of(c("arxiv")).alias("arxiv"), i.openalex_of(c("openalex")).alias("openalex"))


@register("F08", """SELECT * FROM (VALUES (1, 'openalex:W29384756,doi:10.1145/3292500.3330701,arxiv:1905.12345'), (2, 'openalex:W12,doi:10.48550/arxiv.2001.00001,arxiv:math.gt/0309136'), (3, 'openalex:W7,doi:10.1000/abc.d,arxiv:2001.00001'), (4, '')) t(id, keys)""")
def f08(spark, sf):
    c = F.col
    return _ids(spark).select("id", F.array_join(i.identity_keys(c("openalex"), c("doi"), c("arxiv"), F.lit(None).cast("string"), c("title"), i.year_of(c("year"))), ",").alias("keys"))


@register("F09", """SELECT page_id, nullif(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), '') AS text FROM pages""")
def f09(spark, sf):
    return view(spark, sf, "pages").select("page_id", t.clean(F.col("html")).alias("text"))


@register("F10", "SELECT * FROM (VALUES (1, '1999'), (2, NULL), (3, '2021'), (4, NULL)) v(id, year)")
def f10(spark, sf):
    return _ids(spark).select("id", i.year_of(F.col("year")).cast("string").alias("year"))


@register("F12", """SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey WHERE lower(a.p_name) = lower(b.p_name)
    OR len(list_intersect(string_split(lower(a.p_name), ' '), string_split(lower(b.p_name), ' '))) >= 0.9 * len(list_distinct(string_split(lower(a.p_name || ' ' || b.p_name), ' ')))""")
def f12(spark, sf):
    p = view(spark, sf, "part").select("p_partkey", "p_brand", "p_size", "p_name")
    own = ["p_brand", "p_size"]
    # names that match, each pair once; then the parts that bear them
    names = p.select(*own, "p_name").where("p_name IS NOT NULL").distinct().select(*own, "p_name", F.explode(i.match_keys(F.col("p_name"))).alias("key"))
    x, y = names.withColumnRenamed("p_name", "na"), names.withColumnRenamed("p_name", "nb")
    same = x.join(y, [*own, "key"]).where(i.titles_match(F.col("na"), F.col("nb"))).select(*own, "na", "nb").distinct()
    a, b = (p.select(F.col("p_partkey").alias(n), *own, F.col("p_name").alias(f"n{n}")) for n in "ab")
    return a.join(same, [*own, "na"]).join(b, [*own, "nb"]).where("a < b").select("a", "b")


@register("F14", "SELECT id FROM works WHERE year IS NULL OR year BETWEEN 1996 AND 1998")
def f14(spark, sf):
    return view(spark, sf, "works").where(i.year_allowed(F.col("year"), 1996, 1998)).select("id")


@register("F15", "SELECT id, coalesce(CASE WHEN year < 1998 THEN title END, venue) AS title, list_sort(list_distinct([venue, work_type, 'x'])) AS tags FROM works")
def f15(spark, sf):
    return view(spark, sf, "works").select("id", F.coalesce(F.when(F.col("year") < 1998, F.col("title")), "venue").alias("title"), F.array_sort(F.array_union(F.array("venue", "work_type"), F.array(F.lit("x"), "venue"))).alias("tags"))


@register("F16", "SELECT * FROM (VALUES ('Neural-Networks', 'neural network'), ('  policies!', 'policy'), ('Bus', 'bus'), ('***', NULL), ('Glass boxes', 'glass box')) v(term, keyword)")
def f16(spark, sf):
    return spark.createDataFrame([("Neural-Networks",), ("  policies!",), ("Bus",), ("***",), ("Glass boxes",)], "term string").select("term", t.keyword(F.col("term")).alias("keyword"))


@register("F17", "SELECT p_partkey AS id, list_aggregate(list_transform(string_split(lower(p_name), ' '), lambda w: w[1:1]), 'string_agg', '') AS acronym FROM part")
def f17(spark, sf):
    return view(spark, sf, "part").select(F.col("p_partkey").alias("id"), t.acronym(F.col("p_name")).alias("acronym"))


@register("F19", "SELECT * FROM (VALUES (1, 'Graphs & Trees: a <b>Survey</b>', 'biology'), (2, 'The neural_network-policies.', NULL), (3, 'Gas', NULL), (4, NULL, NULL)) v(id, core, extra)")
def f19(spark, sf):
    return _ids(spark).select("id", t.strip_disambiguator(F.col("title")).alias("core"), t.disambiguator(F.col("title")).alias("extra"))


@register("F21", r"SELECT doc_id, regexp_replace(text, 'https?://[^ \t\n\r\f\v]+|[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.]+|10\.[0-9]{4,9}/[^ \t\n\r\f\v]+', ' ; ', 'g') AS text FROM documents")
def f21(spark, sf):
    return view(spark, sf, "documents").select("doc_id", t.strip_links(F.col("text")).alias("text"))


@register("F25", "SELECT * FROM (VALUES ('walking', 'walk'), ('jumped', 'jump'), ('boxes', 'boxe'), ('cats', 'cats'), ('trees', 'tree'), ('exceedingly', 'exceed'), ('sing', 'sing')) v(word, stem)")
def f25(spark, sf):
    return spark.createDataFrame([(w,) for w in ("walking", "jumped", "boxes", "cats", "trees", "exceedingly", "sing")], "word string").select("word", t.stem(F.col("word")).alias("stem"))


@register("F26", """SELECT term, count(*) AS n FROM (SELECT unnest(list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda x: x <> '' AND x NOT IN ('a', 'the', 'of'))) AS term FROM part) q GROUP BY term""")
def f26(spark, sf):
    return view(spark, sf, "part").select(F.explode(t.content_tokens(F.col("p_name"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@register("F29", "SELECT p_partkey AS id, contains(' ' || p_name || ' ', ' ' || string_split(p_name, ' ')[2] || ' ') AS inside FROM part")
def f29(spark, sf):
    return view(spark, sf, "part").select(F.col("p_partkey").alias("id"), t.phrase_contains(F.col("p_name"), F.split("p_name", " ")[1]).alias("inside"))


@register("F30", "SELECT p_partkey AS id, 'https://example.org/id/concept/' || replace(p_brand, '#', '%23') AS iri FROM part")
def f30(spark, sf):
    return view(spark, sf, "part").select(F.col("p_partkey").alias("id"), i.iri("concept", F.col("p_brand")).alias("iri"))


@register("F32", """SELECT p_partkey AS id, sha256('["bridging",["' || least(p_brand, p_type) || '","' || greatest(p_brand, p_type) || '"]]') AS gap FROM part""")
def f32(spark, sf):
    return view(spark, sf, "part").select(F.col("p_partkey").alias("id"), i.gap_id(F.lit("bridging"), F.array("p_brand", "p_type")).alias("gap"))


@register("F33", "SELECT o_custkey AS id, string_agg(DISTINCT o_orderstatus, ' | ' ORDER BY o_orderstatus) AS statuses, CAST(round(sum(CAST(o_totalprice AS DECIMAL(18, 2))), 2) AS DOUBLE) AS total FROM orders GROUP BY o_custkey")
def f33(spark, sf):
    return view(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("o_orderstatus")), " | ").alias("statuses"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))
