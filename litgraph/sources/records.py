"""Source records: JSON and XML of bibliographic services to one shape, cache keys, candidate ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import arxiv_of, doi_of, openalex_of

OPENALEX = (
    "id string, doi string, display_name string, publication_year int, cited_by_count int, abstract_inverted_index map<string,array<int>>, "
    "authorships array<struct<author:struct<id:string,display_name:string>>>, keywords array<struct<display_name:string,score:double>>, referenced_works array<string>, "
    "locations array<struct<is_oa:boolean,pdf_url:string>>, best_oa_location struct<pdf_url:string>"
)
CROSSREF = "message struct<DOI:string,title:array<string>,`container-title`:array<string>,type:string,issued:struct<`date-parts`:array<array<int>>>>"
UNPAYWALL = "doi string, is_oa boolean, best_oa_location struct<url_for_pdf:string>, oa_locations array<struct<url_for_pdf:string>>"


def abstract(index: Column) -> Column:
    """An inverted index {word: [places]} as text; the first word wins a place, negative places are ignored."""
    entries = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(F.filter(e["value"], lambda p: p >= 0), lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    ordered = F.array_sort(entries)
    first = F.filter(ordered, lambda x, i: (i == 0) | (F.get(ordered, i - 1)["p"] != x["p"]))
    return F.array_join(F.transform(first, lambda x: x["w"]), " ")


def openalex(raw: DataFrame, column: str = "raw") -> DataFrame:
    r = raw.select(F.from_json(column, OPENALEX).alias("r"))
    best, others = F.array(F.col("r.best_oa_location.pdf_url")), F.transform(F.filter("r.locations", lambda x: x["is_oa"]), lambda x: x["pdf_url"])
    return r.select(
        openalex_of(F.col("r.id")).alias("openalex"), doi_of(F.col("r.doi")).alias("doi"), F.col("r.display_name").alias("title"), F.col("r.publication_year").alias("year"),
        abstract(F.col("r.abstract_inverted_index")).alias("abstract"), F.transform("r.authorships", lambda a, i: F.struct(i.alias("position"), a["author"]["display_name"].alias("name"))).alias("authors"),
        F.transform("r.keywords", lambda k: F.struct(F.lower(k["display_name"]).alias("term"), k["score"].alias("score"))).alias("keywords"),
        F.transform("r.referenced_works", lambda x: openalex_of(x)).alias("references"), F.col("r.cited_by_count").alias("cited_by_count"), F.array_distinct(F.array_compact(F.concat(best, F.coalesce(others, F.array().cast("array<string>"))))).alias("pdfs"),
    )


def crossref(raw: DataFrame, column: str = "raw") -> DataFrame:
    m = raw.select(F.from_json(column, CROSSREF).alias("r")).select("r.message.*")
    return m.select(doi_of(F.col("DOI")).alias("doi"), F.get("title", F.lit(0)).alias("title"), F.get("container-title", F.lit(0)).alias("venue"), F.get(F.get("issued.date-parts", F.lit(0)), F.lit(0)).alias("year"), F.col("type").alias("work_type"))


def unpaywall(raw: DataFrame, column: str = "raw") -> DataFrame:
    r = raw.select(F.from_json(column, UNPAYWALL).alias("r"))
    urls = F.concat(F.array("r.best_oa_location.url_for_pdf"), F.transform("r.oa_locations", lambda x: x["url_for_pdf"]))
    return r.select(doi_of(F.col("r.doi")).alias("doi"), F.array_distinct(F.array_compact(urls)).alias("pdfs"))


ENTRY = "id string, title string, summary string, published string, author array<struct<name:string>>"


def arxiv_atom(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Entries of Atom feeds, one a row; an entry that cannot be read gives nulls."""
    e = raw.select(F.from_xml(column, ENTRY).alias("e")).select("e.*")
    return e.select(arxiv_of(F.col("id")).alias("arxiv"), F.trim(F.regexp_replace("title", r"\s+", " ")).alias("title"), F.trim("summary").alias("abstract"), F.substring("published", 1, 4).cast("int").alias("year"), F.transform("author", lambda a: a["name"]).alias("authors"))


def cache_key(source: Column, endpoint: Column, params: Column) -> Column:
    """The digest of a request: source, endpoint and its parameters (a map) in order."""
    pairs = F.array_sort(F.map_entries(params))
    body = F.array_join(F.transform(pairs, lambda e: F.concat(F.lit('"'), e["key"], F.lit('":"'), e["value"], F.lit('"'))), ",")
    return F.sha2(F.concat(F.lit('{"endpoint":"'), endpoint, F.lit('","params":{'), body, F.lit('},"source":"'), source, F.lit('"}')), 256)


def misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    return requests.join(cache.select("key"), "key", "left_anti")


def lookup_many(requested: DataFrame, records: DataFrame) -> DataFrame:
    """(pos, key) against (key, identity, ...): found records in the order asked for, each identity once."""
    place = F.row_number().over(Window.partitionBy("identity").orderBy("pos"))
    return requested.join(records, "key").withColumn("place", place).where("place = 1").drop("place").orderBy("pos")


def rank_pdfs(candidates: DataFrame) -> DataFrame:
    """(work_id, url, host, version, idx): each normalised URL once, repositories before publishers before paid hosts."""
    normal = F.regexp_replace(F.lower(F.regexp_replace("url", "#.*$", "")), "/+$", "")
    rank = F.when(F.contains("url", F.lit("arxiv.org")), 0).when(F.col("version") == "publishedVersion", 1).when(F.col("version") == "acceptedVersion", 2).when(F.col("host") == "paid", 4).otherwise(3)
    ranked = candidates.withColumn("normal", normal).withColumn("rank", rank)
    first = F.row_number().over(Window.partitionBy("work_id", "normal").orderBy("rank", "idx", "url"))
    kept = ranked.withColumn("first", first).where("first = 1")
    return kept.select("work_id", "url", F.row_number().over(Window.partitionBy("work_id").orderBy("rank", "idx", "url")).alias("place"))


def allowed(urls: DataFrame, hosts: DataFrame) -> DataFrame:
    """URLs whose host and path prefix are on a list (host, prefix)."""
    parsed = urls.withColumn("host", F.regexp_replace(F.parse_url("url", F.lit("HOST")), "^www\\.", "")).withColumn("path", F.coalesce(F.parse_url("url", F.lit("PATH")), F.lit("/")))
    return parsed.join(hosts, "host").where(F.startswith("path", "prefix")).select("url").distinct()
