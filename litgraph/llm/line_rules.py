"""Quality rules: base statistics of a text, and cross-document line frequency. DataFrame functions only.

A line is normalised (lower case, runs of white space to one space) and hashed. For each host (``source``) the documents
that hold a line are counted; lines in more than ``MOST_DOCUMENTS`` of them are boilerplate and are removed, and a document
that they leave with fewer words than the base rule demands of any document is rejected as depleted. A document is
counted once however often it is copied: it stands for itself by the hash of its normalised lines, in order, so that a group
of copies is not boilerplate to itself. Texts that differ in any line are different documents.

Counting aggregates (host, line, document) with map-side partial counts. Only lines above the limit meet the documents
again, by a join on (host, line) and one on the document's key; texts are never shuffled.

Null text: no words, so the base rules fail. Null source: a host of its own. Null and repeated doc_ids are kept; rows that
are alike get like results. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, stored

#: Documents of a host that may hold a line; fewest words; share of repeated words (percent) that fails.
MOST_DOCUMENTS, LEAST_WORDS, MOST_REPEATED = 20, 10, 20
WINDOW = 5
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
_WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def word_array(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({_WORD})"))


def _windows(words: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(WINDOW)]))


def _covered(words: Column) -> Column:
    """Words in five-word windows that the text holds twice or more; windows are compared as they are, not by hash."""
    places = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.struct(F.slice(words, i + 1, WINDOW).alias("w"), i.alias("i")))

    def twice(s: Column) -> Column:
        last = F.size(s) - 1
        same = lambda x, k: F.when((k >= 0) & (k <= last), F.get(s, k)["w"] == x["w"]).otherwise(F.lit(False))
        return F.array_sort(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

    def total(at: Column) -> Column:
        last = F.size(at) - 1
        return F.aggregate(F.transform(at, lambda p, k: F.when(k == last, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), F.get(at, k + 1) - p))), F.lit(0), lambda a, b: a + b)

    return let(F.array_sort(places), lambda s: let(twice(s), total))


def repeat_words(words: Column) -> Column:
    """Most texts hold no window twice, which distinct hashes show; only others are sorted and compared."""
    def counted(w: Column) -> Column:
        some = let(_windows(w), lambda h: F.size(F.array_distinct(h)) < F.size(h))
        return F.when(F.size(w) < WINDOW, F.lit(0)).when(some, _covered(w)).otherwise(F.lit(0))

    return counted(words)


def lines_of(text: Column) -> Column:
    """The lines of a text that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, SPACE, "")) > 0)


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.regexp_replace(F.trim(F.lower(line)), r"[\x20\x09-\x0D]+", " "))


def base(docs: DataFrame) -> DataFrame:
    """doc_id, source, mark (of the text), the statistics, and an array of (hash, words) of the lines."""
    text = F.coalesce(F.col("text"), F.lit(""))
    n_words = lambda line: F.regexp_count(line, F.lit(_WORD))
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), text.alias("text"))
    stats = let(
        word_array(F.col("text")),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).cast("long").alias("n_repeat_words")),
    )
    lines = let(
        lines_of(F.col("text")),
        lambda ls: F.struct(
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            F.transform(ls, lambda line: F.struct(line_hash(line).alias("h"), n_words(line).alias("n"))).alias("lines"),
        ),
    )
    out = raw.select("doc_id", "source", F.xxhash64("text").alias("mark"), F.length(F.translate("text", SPACE, "")).cast("long").alias("word_chars"), (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"), stats.alias("s"), lines.alias("l"))
    return out.select("doc_id", "source", "mark", "s.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "s.n_repeat_words", "l.lines")


def line_counts(rows: DataFrame) -> DataFrame:
    """source, h, n: distinct documents of the host that hold the line."""
    hashes = F.transform("lines", lambda x: x["h"])
    each = rows.select("source", F.xxhash64(hashes).alias("d"), F.explode(F.array_distinct(hashes)).alias("h"))
    return each.distinct().groupBy("source", "h").agg(F.count("*").alias("n"))


def rules(spark: SparkSession, docs: DataFrame, most_documents: int = MOST_DOCUMENTS, least_words: int = LEAST_WORDS) -> DataFrame:
    """The statistics, base_failed, kept, removed_words and removed_lines (hashes) of each document."""
    folder = shared_dir(spark)
    rows = stored(base(docs), f"{folder}/rows")
    common = stored(line_counts(rows).where(F.col("n") > most_documents), f"{folder}/common")
    lines = rows.select("doc_id", "source", "mark", F.explode(F.array_distinct("lines")).alias("line")).select("doc_id", "source", "mark", F.col("line.h").alias("h"))
    key = ["doc_id", "source", "mark"]
    met = lines.alias("x").join(common.alias("c"), (F.col("x.h") == F.col("c.h")) & F.col("x.source").eqNullSafe(F.col("c.source"))).select(*[f"x.{k}" for k in key], "x.h")
    hit = stored(met.groupBy(*key).agg(F.collect_set("h").alias("removed_lines")), f"{folder}/hit")
    on = F.lit(True)
    for k in key:
        on = on & F.col(f"r.{k}").eqNullSafe(F.col(f"t.{k}"))
    both = rows.alias("r").join(hit.alias("t"), on, "left").select("r.*", F.col("t.removed_lines"))
    removed = F.aggregate(F.filter("lines", lambda x: F.array_contains("removed_lines", x["h"])), F.lit(0), lambda a, x: a + x["n"])
    both = both.withColumn("removed_words", F.when(F.col("removed_lines").isNull(), F.lit(0)).otherwise(removed).cast("long"))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    depleted = F.col("n_words") - F.col("removed_words") < least_words
    return both.withColumns({"base_failed": failed, "kept": ~failed & ~depleted}).drop("lines")


def without_lines(text: Column, removed: Column) -> Column:
    """A text less its removed lines (an array of hashes, or null)."""
    return F.when(removed.isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n"), lambda line: ~F.array_contains(removed, line_hash(line))), "\n"))


def verdicts(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return rules(spark, docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")
