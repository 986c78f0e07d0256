"""Queries of document text: D01-D09, D12, G26, S19."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..bindings import view, views
from ..functions.text import fold, page_text, relaxed
from ..operators.outline import highlights, outlines
from ..registry import register


#: Quotes that one automaton holds; more of them go block by block.
MOST_QUOTES = 50_000


def quotes_in(docs: DataFrame, quotes: DataFrame, folded) -> DataFrame:
    """(doc_id, item_id, pos): the first place, from 1, of each quote in each folded text that holds it. Texts are read once for a
    block of quotes, by an automaton over all of them, whatever their number. Empty quotes stand nowhere."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", folded(F.col("text")).alias("t"))
    wanted = quotes.select("item_id", folded(F.col("text")).alias("q")).where("q <> ''")
    blocks = max(1, -(-wanted.count() // MOST_QUOTES))
    out = None
    for k in range(blocks):
        part: dict[str, list[int]] = {}
        for r in wanted.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == k).collect():  # about MOST_QUOTES
            part.setdefault(r["q"], []).append(r["item_id"])
        given = spark.sparkContext.broadcast(part)

        def task(batches: Iterator[pd.DataFrame], given=given) -> Iterator[pd.DataFrame]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for q in given.value:
                automaton.add_word(q, q)
            if given.value:
                automaton.make_automaton()
            for b in batches:
                rows = []
                for doc, text in b.itertuples(index=False):
                    first: dict[str, int] = {}
                    for end, q in automaton.iter(text) if text and given.value else ():
                        first.setdefault(q, end - len(q) + 2)
                    rows += [(doc, item, pos) for q, pos in first.items() for item in given.value[q]]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "pos"])

        found = texts.mapInPandas(task, "doc_id long, item_id long, pos int")
        out = found if out is None else out.union(found)
    return out


FOLD = "regexp_replace(lower({}), '[ \\t\\n\\r\\f\\v]+', '', 'g')"
RELAX = "regexp_replace(" + FOLD + ", '[\"''“”‘’…-]|\\.\\.\\.', '', 'g')"


@register("D01", "SELECT doc_id, rtrim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t]+\\n', chr(10), 'g'), '-\\n([a-z])', '\\1', 'g'), '\\n{4,}', chr(10) || chr(10) || chr(10), 'g'), ' ') AS text FROM documents")
def d01(spark, sf):
    return view(spark, sf, "documents").select("doc_id", page_text(F.col("text")).alias("text"))


@register("D03_D06", f"SELECT doc_id, item_id, strpos(t, q) AS pos FROM (SELECT doc_id, {FOLD.format('text')} AS t FROM documents) d, (SELECT item_id, {FOLD.format('text')} AS q FROM benchmark) b WHERE contains(t, q)")
def d03(spark, sf):
    return quotes_in(*views(spark, sf, "documents", "benchmark"), fold)


@register("D04", f"SELECT doc_id, item_id, strpos(t, q) AS pos FROM (SELECT doc_id, {RELAX.format('text')} AS t FROM documents) d, (SELECT item_id, {RELAX.format('text')} AS q FROM benchmark) b WHERE contains(t, q)")
def d04(spark, sf):
    return quotes_in(*views(spark, sf, "documents", "benchmark"), relaxed)


@register("D05", f"SELECT doc_id, min_by(item_id, row(abs(pos - 100), item_id)) AS item_id FROM (SELECT doc_id, item_id, strpos(t, q) AS pos FROM (SELECT doc_id, {FOLD.format('text')} AS t FROM documents) d, (SELECT item_id, {FOLD.format('text')} AS q FROM benchmark) b WHERE contains(t, q)) z GROUP BY doc_id")
def d05(spark, sf):
    hits = quotes_in(*views(spark, sf, "documents", "benchmark"), fold)
    return hits.groupBy("doc_id").agg(F.min_by("item_id", F.struct(F.abs(F.col("pos") - 100), "item_id")).alias("item_id"))


@register("D07", "SELECT doc_id, substring(text, CAST(greatest(1, strpos(text, 'token') - 100) AS BIGINT), 205) AS snippet FROM documents WHERE contains(text, 'token')")
def d07(spark, sf):
    docs = view(spark, sf, "documents").where(F.contains("text", F.lit("token")))
    return docs.select("doc_id", F.expr("substring(text, greatest(1, locate('token', text) - 100), 205)").alias("snippet"))


@register("D02_D08", "SELECT doc_id, i AS page, length(string_split(text, chr(10))[i]) AS n_chars FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i) t")
def d08(spark, sf):
    return view(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "t")).select("doc_id", (F.col("p") + 1).alias("page"), F.length("t").alias("n_chars"))


@register("D12", "SELECT count(*) AS found FROM documents d, benchmark b WHERE contains(trim(regexp_replace(d.text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), trim(regexp_replace(b.text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')))")
def d12(spark, sf):
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return quotes_in(*views(spark, sf, "documents", "benchmark"), flat).agg(F.count("*").alias("found"))


@register("D09_D10")
def d09(spark, sf):
    """Headings put before the lines of each text, so that every document has a sequence to follow."""
    docs = view(spark, sf, "documents")
    lines = F.split("text", "\n")
    numbered = F.array_join(F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(" Part "), i.cast("string"), F.lit("\n"), x)), "\n")
    return outlines(docs.select(F.col("doc_id").alias("id"), F.concat(F.lit("Abstract\n"), numbered).alias("text")))


@register("D11")
def d11(spark, sf):
    """Where on its lines each benchmark item stands that a document holds."""
    docs, items = views(spark, sf, "documents", "benchmark")
    found = quotes_in(docs, items, fold).select("doc_id", "item_id")
    pairs = found.join(docs.select("doc_id", "text"), "doc_id").join(items.select("item_id", F.col("text").alias("quote")), "item_id")
    return highlights(pairs)


@register("G26", """SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::VARCHAR AS page FROM conversations""")
def g26(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return view(spark, sf, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w).cast("string").alias("page"))


@register("S19_S20", "SELECT sha256(text) AS sha, min(doc_id) AS doc_id, count(*) AS copies, CASE WHEN trim(min(text), ' ') = '' THEN 'empty' ELSE 'ok' END AS status FROM documents GROUP BY 1")
def s19(spark, sf):
    docs = view(spark, sf, "documents")
    return docs.groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.when(F.trim(F.min("text")) == "", "empty").otherwise("ok").alias("status"))
