"""The literature model over the test tables: one definition of each view, for Spark and for the oracle.

Works are orders; a work cites, for each of its parts, the order that took that part before it, so citations form a DAG
in time. Concepts are the brands of the parts, authors the suppliers, projects the regions of the customers.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "works": """SELECT o_orderkey AS id, min(p_name) AS title, year(min(o_orderdate)) AS year,
        CAST(floor(min(o_totalprice) / 1000) AS INT) AS cited_by_count, min(o_orderpriority) AS venue, min(o_orderstatus) AS work_type
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY o_orderkey""",
    "citations": """SELECT DISTINCT citing, cited FROM (SELECT o AS citing, lag(o) OVER (PARTITION BY p ORDER BY d, o) AS cited
        FROM (SELECT DISTINCT l_orderkey AS o, l_partkey AS p, o_orderdate AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey) t) u
        WHERE cited IS NOT NULL""",
    "inclusions": """SELECT r_name AS project_id, o_orderkey AS work_id, o_orderpriority AS discovered_via, CAST(c_nationkey % 3 AS INT) AS depth,
        round(o_totalprice / 1000000, 6) AS score
        FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""",
    "work_concepts": """SELECT l_orderkey AS work_id, p_brand AS concept_id, round(max(l_discount) + 0.5, 6) AS score
        FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey, p_brand""",
    "concepts": "SELECT DISTINCT p_brand AS id, p_brand AS label FROM part",
    "authors": "SELECT s_suppkey AS id, s_name AS name FROM supplier",
    "authorships": """SELECT work_id, author_id, row_number() OVER (PARTITION BY work_id ORDER BY author_id) AS position
        FROM (SELECT DISTINCT l_orderkey AS work_id, l_suppkey AS author_id FROM lineitem) t""",
    "projects": "SELECT r_name AS id, r_name AS name, r_regionkey AS created_at FROM region",
    "contributions": """SELECT l_orderkey AS work_id, p_size AS problem, p_brand AS method, s_nationkey AS dataset, l_returnflag AS metric, l_extendedprice AS value
        FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey""",
    "reviews": """SELECT r_name AS review_id, o_orderkey AS work_id, CASE WHEN o_totalprice <= 400000 THEN 'include' ELSE 'exclude' END AS decision,
        CASE o_orderstatus WHEN 'O' THEN 'title' WHEN 'F' THEN 'abstract' ELSE 'full text' END AS stage, o_orderpriority AS reason, c_nationkey AS cluster_id
        FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""",
    "claims": """SELECT o_orderkey AS claim, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS other, o_orderstatus AS stance,
        lead(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS other_stance FROM orders""",
    "topics": """SELECT user_id AS work_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS topic, event_type AS kind, ts AS issued FROM events""",
    # one review for each brand and size: a few dozen to a few hundred works, at any scale
    "project_works": "SELECT DISTINCT concat(p_brand, '/', p_size) AS project_id, l_orderkey AS work_id FROM lineitem JOIN part ON p_partkey = l_partkey",
    "project_citations": """SELECT DISTINCT x.project_id, citing, cited FROM citations JOIN project_works x ON x.work_id = citing
        JOIN project_works y ON y.work_id = cited AND y.project_id = x.project_id WHERE citing <> cited""",
    # parts as concepts: the works that share one are as many at any scale
    "work_parts": "SELECT DISTINCT l_orderkey AS work_id, l_partkey AS concept_id FROM lineitem",
    # works of a period and a group of countries
    "eras": """SELECT o_orderkey AS work_id, concat(year(o_orderdate), '-', c_nationkey % 5) AS cluster_id FROM orders JOIN customer ON c_custkey = o_custkey
        WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""",
    "papers": """SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'P' THEN 'Posted-Content' WHEN 'F' THEN 'article' END AS work_type, CASE WHEN o_orderkey % 3 = 0 THEN concat('2101.', o_orderkey) END AS arxiv_id,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'arXiv (Cornell University)' WHEN '2-HIGH' THEN 'Journal' END AS venue, CASE o_orderkey % 5 WHEN 0 THEN concat('https://doi.org/10.48550/arxiv.', o_orderkey) WHEN 1 THEN concat('10.1000/', o_orderkey) END AS doi,
        concat('https://openalex.org/W', o_orderkey) AS openalex_id, year(o_orderdate) AS year FROM orders""",
    "articles": "SELECT doc_id AS id, split_part(text, '.', 1) AS title, substr(text, length(split_part(text, '.', 1)) + 2) AS body FROM documents",
    "clusters": """SELECT o_orderkey AS work_id, c_nationkey AS cluster_id FROM orders JOIN customer ON c_custkey = o_custkey""",
}


def names(sql: str) -> list[str]:
    """Views that a text needs, those they need first."""
    found: list[str] = []

    def visit(text: str) -> None:
        for v in VIEWS:
            if v not in found and re.search(rf"\b{v}\b", text):
                visit(VIEWS[v]) if text is not VIEWS[v] else None
                found.append(v)

    visit(sql)
    return found


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    used = [t for t in (*TABLES, *VIEWS) if t != name and re.search(rf"\b{t}\b", text)]
    marked = re.sub(rf"\b({'|'.join(used)})\b", r"{\1}", text)
    return spark.sql(marked, **{t: view(spark, sf_dir, t) for t in used})


def views(spark: SparkSession, sf_dir: str, *wanted: str) -> tuple[DataFrame, ...]:
    return tuple(view(spark, sf_dir, n) for n in wanted)


def oracle(sql: str) -> str:
    """The oracle's text, with the views that it needs before it."""
    need = names(sql)
    if not need:
        return sql
    heads = ", ".join(f"{n} AS ({VIEWS[n]})" for n in need)
    sql = sql.strip()
    if sql.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {heads}, {sql[14:]}"
    if sql.upper().startswith("WITH"):
        return f"WITH {heads}, {sql[4:]}"
    return f"WITH {heads} {sql}"
