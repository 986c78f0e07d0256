"""Reads and writes of the property graph, scoped by project inclusions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import shorten, tokens


def newest_first(projects: DataFrame) -> DataFrame:
    return projects.orderBy(F.desc("created_at"), "id")


def in_project(works: DataFrame, inclusions: DataFrame, project: str | None = None) -> DataFrame:
    """Works of one project, or of any."""
    own = inclusions if project is None else inclusions.where(F.col("project_id") == project)
    return works.join(own.select(F.col("work_id").alias("id")), "id", "left_semi")


def project_edges(citations: DataFrame, inclusions: DataFrame, project: str) -> DataFrame:
    """Citations with both ends in the project."""
    own = inclusions.where(F.col("project_id") == project).select("work_id").distinct()
    return citations.join(own.withColumnRenamed("work_id", "citing"), "citing", "left_semi").join(own.withColumnRenamed("work_id", "cited"), "cited", "left_semi").select("citing", "cited")


def attached(edges: DataFrame, inclusions: DataFrame, project: str) -> DataFrame:
    """Edges (work_id, ...) of a project's works."""
    own = inclusions.where(F.col("project_id") == project).select("work_id")
    return edges.join(own, "work_id", "left_semi")


def search(works: DataFrame, query: str, text: Column, limit: int = 20) -> DataFrame:
    """Works by the number of times that the query's distinct words occur in the text."""
    wanted = sorted(set(w for w in "".join(c if c.isalnum() else " " for c in query.lower()).split()))
    known = F.array(*[F.lit(w) for w in wanted]) if wanted else F.array().cast("array<string>")
    score = F.size(F.filter(tokens(text), lambda t: F.array_contains(known, t))).cast("long")
    return works.select("id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(limit)


def degrees(works: DataFrame, citations: DataFrame) -> DataFrame:
    """id, in_degree, out_degree."""
    into = citations.groupBy(F.col("cited").alias("id")).agg(F.count("*").alias("in_degree"))
    out = citations.groupBy(F.col("citing").alias("id")).agg(F.count("*").alias("out_degree"))
    return works.select("id").join(into, "id", "left").join(out, "id", "left").na.fill(0, ["in_degree", "out_degree"])


def neighbourhood(works: DataFrame, citations: DataFrame, authorships: DataFrame, work_concepts: DataFrame) -> DataFrame:
    """Per work: cites, cited_by, authors by position, concepts by score, as ordered arrays."""
    def lists(edges: DataFrame, key: str, value: Column, name: str) -> DataFrame:
        return edges.groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_list(value)).alias(name))

    out = works.select("id")
    for part in (
        lists(citations, "citing", F.col("cited"), "cites"),
        lists(citations, "cited", F.col("citing"), "cited_by"),
        lists(authorships, "work_id", F.struct("position", "author_id"), "authors"),
        lists(work_concepts, "work_id", F.struct((-F.col("score")).alias("rank"), "concept_id"), "concepts"),
    ):
        out = out.join(part, "id", "left")
    return out.select(
        "id", *[F.coalesce(c, F.array().cast("array<bigint>")).alias(c) for c in ("cites", "cited_by")],
        F.coalesce(F.transform("authors", lambda x: x["author_id"]), F.array().cast("array<bigint>")).alias("authors"),
        F.coalesce(F.transform("concepts", lambda x: x["concept_id"]), F.array().cast("array<string>")).alias("concepts"),
    )


def stats(inclusions: DataFrame, citations: DataFrame, authorships: DataFrame, work_concepts: DataFrame) -> DataFrame:
    """Per project: works, citations within it, authors, concepts."""
    own = inclusions.select("project_id", "work_id").distinct()
    n_works = own.groupBy("project_id").agg(F.count("*").alias("works"))
    ends = citations.join(own.select("project_id", F.col("work_id").alias("citing")), "citing").join(own.select(F.col("project_id").alias("p2"), F.col("work_id").alias("cited")), "cited").where("project_id = p2")
    n_edges = ends.groupBy("project_id").agg(F.count("*").alias("citations"))
    n_authors = authorships.join(own, "work_id").groupBy("project_id").agg(F.countDistinct("author_id").alias("authors"))
    n_concepts = work_concepts.join(own, "work_id").groupBy("project_id").agg(F.countDistinct("concept_id").alias("concepts"))
    out = n_works
    for x in (n_edges, n_authors, n_concepts):
        out = out.join(x, "project_id", "left")
    return out.na.fill(0)


def graph_view(works: DataFrame, citations: DataFrame, authors: DataFrame, authorships: DataFrame, concepts: DataFrame, work_concepts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of works and what is attached to them, in total order."""
    key = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    node = works.select(key("work", "id").alias("id"), F.lit("work").alias("kind"), F.col("title").alias("label"))
    wrote = authorships.join(works.select(F.col("id").alias("work_id")), "work_id", "left_semi")
    about = work_concepts.join(works.select(F.col("id").alias("work_id")), "work_id", "left_semi")
    node = node.union(authors.join(wrote.select(F.col("author_id").alias("id")), "id", "left_semi").select(key("author", "id"), F.lit("author"), F.col("name")))
    node = node.union(concepts.join(about.select(F.col("concept_id").alias("id")), "id", "left_semi").select(key("concept", "id"), F.lit("concept"), F.col("label")))
    own = works.select("id")
    cites = citations.join(own.withColumnRenamed("id", "citing"), "citing", "left_semi").join(own.withColumnRenamed("id", "cited"), "cited", "left_semi")
    edge = cites.select(key("work", "citing").alias("source"), key("work", "cited").alias("target"), F.lit("cites").alias("kind"))
    edge = edge.union(wrote.select(key("work", "work_id"), key("author", "author_id"), F.lit("authored_by"))).union(about.select(key("work", "work_id"), key("concept", "concept_id"), F.lit("has_concept")))
    return node.orderBy("kind", "id"), edge.orderBy("source", "target", "kind")


def lens(nodes: DataFrame, edges: DataFrame, filters: dict[str, object]) -> DataFrame:
    """Edges that touch a node which meets all filters."""
    chosen = nodes
    for c, v in filters.items():
        chosen = chosen.where(F.col(c) == v)
    chosen = chosen.select("id").distinct()
    source = edges.join(chosen.withColumnRenamed("id", "citing"), "citing", "left_semi").select("citing", "cited")
    target = edges.join(chosen.withColumnRenamed("id", "cited"), "cited", "left_semi").select("citing", "cited")
    return source.union(target).distinct()


def resolve(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes with the id asked for, else those whose label holds the fragment in either case."""
    rank = F.when(F.col("id").cast("string") == query, 0).when(F.contains(F.lower("label"), F.lit(query.lower())), 1)
    found = nodes.withColumn("rank", rank).where("rank IS NOT NULL")
    return found.join(found.agg(F.min("rank").alias("rank")), "rank").select("id", "label")


def overview(inclusions: DataFrame, works: DataFrame, work_concepts: DataFrame, most: int = 10) -> DataFrame:
    """Per project its top concepts by works and its top works by citations."""
    about = work_concepts.join(inclusions.select("project_id", "work_id").distinct(), "work_id").groupBy("project_id", F.col("concept_id").alias("item")).agg(F.count("*").alias("n"))
    cited = works.join(inclusions.select("project_id", F.col("work_id").alias("id")).distinct(), "id").select("project_id", F.col("id").cast("string").alias("item"), F.col("cited_by_count").cast("long").alias("n"))
    both = about.select("project_id", F.lit("concept").alias("kind"), "item", "n").union(cited.select("project_id", F.lit("work").alias("kind"), "item", "n"))
    place = F.row_number().over(Window.partitionBy("project_id", "kind").orderBy(F.desc("n"), "item"))
    return both.withColumn("place", place).where(F.col("place") <= most)


def paper_info(works: DataFrame, text: Column, most: int = 1600) -> DataFrame:
    return works.select("id", shorten(text, most).alias("abstract"))


def year_view(works: DataFrame, edges: DataFrame, lo: int, hi: int) -> DataFrame:
    """Works of the years, and what is attached to one of them: kind, id."""
    own = works.where(F.col("year").between(lo, hi))
    near = edges.join(own.select(F.col("id").alias("work_id")), "work_id", "left_semi").select(F.lit("concept").alias("kind"), F.col("concept_id").alias("id")).distinct()
    return own.select(F.lit("work").alias("kind"), F.col("id").cast("string").alias("id")).union(near)


def node_sizes(works: DataFrame) -> DataFrame:
    """Size on the map by citations: at most 18, 5 + 2.2 ln(1 + n)."""
    return works.select("id", F.round(F.least(F.lit(18.0), 5 + 2.2 * F.log1p(F.greatest(F.lit(0), "cited_by_count"))), 6).alias("size"))


def increment(after: DataFrame, before: DataFrame, most: int = 200) -> DataFrame:
    """The first ids that are new."""
    return after.select("id").join(before.select("id"), "id", "left_anti").orderBy("id").limit(most)


def labels_of(ids: DataFrame, concepts: DataFrame) -> DataFrame:
    """A concept's label, or one made of its id."""
    made = F.regexp_replace(F.regexp_replace(F.col("concept_id"), "^[^:]*:", ""), "[-_#]+", " ")
    return ids.select("concept_id").distinct().join(concepts.select(F.col("id").alias("concept_id"), "label"), "concept_id", "left").select("concept_id", F.coalesce("label", made).alias("label"))


# --- writes --------------------------------------------------------------------------------------------


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """New rows, and old rows whose columns the new values replace unless they are null."""
    rest = [c for c in old.columns if c != key]
    joined = old.alias("o").join(new.alias("n"), key, "full_outer")
    return joined.select(key, *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in rest])


def upsert_concepts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Labels are overwritten, aliases joined and sorted, verdicts kept."""
    joined = old.alias("o").join(new.alias("n"), "id", "full_outer")
    none = F.array().cast("array<string>")
    return joined.select(
        "id", F.coalesce("n.label", "o.label").alias("label"),
        F.array_sort(F.array_union(F.coalesce("o.aliases", none), F.coalesce("n.aliases", none))).alias("aliases"), F.coalesce("o.linkable", "n.linkable").alias("linkable"),
    )


def include(events: DataFrame) -> DataFrame:
    """(project, work) once: the first way it was found, the least depth, the first score."""
    return events.groupBy("project_id", "work_id").agg(
        F.min_by("discovered_via", "seq").alias("discovered_via"), F.min("depth").alias("depth"), F.min_by("score", F.when(F.col("score").isNotNull(), F.col("seq"))).alias("score")
    )


def valid_citations(edges: DataFrame, works: DataFrame) -> DataFrame:
    """Neither loops nor loose ends nor repeats."""
    own = works.select("id")
    kept = edges.where("citing <> cited").join(own.withColumnRenamed("id", "citing"), "citing", "left_semi").join(own.withColumnRenamed("id", "cited"), "cited", "left_semi")
    return kept.select("citing", "cited").distinct()


def replace_attached(old: DataFrame, new: DataFrame, key: str = "work_id") -> DataFrame:
    """The rows of keys that new has are replaced by those."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def delete(rows: DataFrame, key: str, value: object) -> DataFrame:
    return rows.where((F.col(key) != value) | F.col(key).isNull())


def newest_runs(runs: DataFrame, most: int = 50) -> DataFrame:
    """The newest runs of each project, and all that are active."""
    place = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("created_at"), F.desc("id")))
    return runs.withColumn("place", place).where((F.col("place") <= most) | F.col("active")).drop("place")


def edges_from_references(references: DataFrame, identity: DataFrame) -> DataFrame:
    """(citing, key) against (key, work_id): edges between known works."""
    known = identity.groupBy("key").agg(F.min("work_id").alias("cited"))
    return references.join(known, "key").where("citing <> cited").select("citing", "cited").distinct()


def quads(rows: DataFrame, subject: Column, graph: str, predicates: list[str]) -> DataFrame:
    """A quad for each value there is: s, p, o, g."""
    entries = F.array(*[F.struct(F.lit(p).alias("p"), F.col(p).cast("string").alias("o")) for p in predicates])
    out = rows.select(subject.alias("s"), F.explode(entries).alias("e"))
    return out.where("e.o IS NOT NULL").select("s", "e.p", "e.o", F.lit(graph).alias("g"))


def may_overwrite(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row that tells whether new has no fewer rows than old."""
    return old.agg(F.count("*").alias("had")).join(new.agg(F.count("*").alias("has"))).select("had", "has", (F.col("has") >= F.col("had")).alias("ok"))
