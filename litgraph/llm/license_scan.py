"""License scans: an exact set-similarity join of text blocks with license templates. DataFrame functions only.

A template is contained in a block (a paragraph) if the block holds at least ``CONTAINED`` of the template's distinct
words. The join is exact. The words of all templates are ordered by the number of documents that hold them, over the whole
corpus, rarest first; with ``need`` words in common, a template and a block must share a word among the first
``size - need + 1`` of either (prefix filter), the block must hold ``need`` words of the templates at all (length filter), and
what stands behind the shared word on both sides must suffice (positional filter). Survivors are verified.

The texts are read once: only words that occur in templates are kept of each block. Templates are a fixed list, so the
table of their prefixes is small whatever the corpus, and is broadcast; hits are joined back on a row number.

Base: places where the words of a fixed phrase stand consecutively. Words are maximal runs of digits, a-z and characters
beyond ASCII, after lower-casing A-Z. Null text: no words. Null and repeated doc_ids are kept, each row gets a row. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, stored
from .line_rules import let

CONTAINED = 0.9
WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"
BLANK = r"\n[\x20\x09-\x0D]*\n"
#: Phrases of the contract and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Published notices, in lower case without punctuation, and their labels.
TEMPLATES = [
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("reserved", "all rights reserved"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _places(w: Column) -> Column:
    """Starts and labels of all phrases among the words."""
    def at(i: Column) -> Column:
        found = F.lit(None).cast("string")
        for phrase, label in PHRASES.items():
            same = F.lit(True)
            for j, part in enumerate(phrase.split()):
                same = same & (F.get(w, i + j) == part)
            found = F.when(same, F.lit(label)).otherwise(found)
        return F.struct(i.cast("long").alias("i"), found.alias("label"))

    some = F.arrays_overlap(w, strings([p.split()[0] for p in PHRASES])) & (F.size(w) > 0)
    empty = F.lit([]).cast("array<struct<i:bigint,label:string>>")
    return F.when(some, F.filter(F.transform(F.sequence(F.lit(0), F.size(w) - 1), at), lambda x: x["label"].isNotNull())).otherwise(empty)


def base(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """row, doc_id, n_words, places, blocks: of each block the distinct words that templates have."""
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), _UPPER, _LOWER)
    known = strings(vocabulary)
    least = min(math.ceil(CONTAINED * len(set(t.split()))) for _, t in TEMPLATES)

    def stats(blocks: Column) -> Column:
        kept = F.filter(F.transform(blocks, lambda b: F.array_intersect(known, b)), lambda b: F.size(b) >= least)
        return let(F.flatten(blocks), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _places(w).alias("places"), F.array_intersect(known, w).alias("seen"), kept.alias("blocks")))

    words = F.transform(F.split(text, BLANK), lambda b: F.regexp_extract_all(b, F.lit(WORD)))
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), let(words, stats).alias("s")).select("row", "doc_id", "s.*")


def contained(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """row, block, template, label, containment of every block and template that meet."""
    sets = [set(t.split()) for _, t in TEMPLATES]
    counted = {r["w"]: r["n"] for r in rows.select(F.explode("seen").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}  # words of templates only
    order = sorted(set().union(*sets), key=lambda w: (counted.get(w, 0), w))
    place = {w: i for i, w in enumerate(order)}
    prefixes = []
    for i, s in enumerate(sets):
        need = math.ceil(CONTAINED * len(s) - 1e-9)
        ordered = sorted(s, key=place.get)
        prefixes += [(i, TEMPLATES[i][0], w, p, need, ordered) for p, w in enumerate(ordered[: len(ordered) - need + 1])]
    prefix = spark.createDataFrame(prefixes, "template int, label string, w string, p int, need int, words array<string>")
    blocks = rows.where(F.size("blocks") > 0).select("row", F.posexplode("blocks").alias("block", "found"))
    blocks = blocks.where(F.arrays_overlap("found", strings([w for w in order if any(w == x[2] for x in prefixes)])))
    ordered = blocks.select("row", "block", F.array_intersect(strings(order), F.col("found")).alias("found"))
    probes = ordered.select("row", "block", "found", F.posexplode("found").alias("q", "w"))
    met = probes.join(F.broadcast(prefix), "w")
    size = F.size("found")
    met = met.where((size >= F.col("need")) & (F.col("q") <= size - F.col("need")))
    met = met.where(F.least(size - F.col("q"), F.size("words") - F.col("p")) >= F.col("need") - F.least("q", "p"))
    shared = F.size(F.array_intersect("found", "words"))
    return met.where(shared >= F.col("need")).select("row", "block", "template", "label", (shared / F.size("words")).alias("containment")).distinct()


def licenses(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    folder = shared_dir(spark)
    vocabulary = sorted(set(" ".join(t for _, t in TEMPLATES).split()))
    rows = stored(base(docs, vocabulary), f"{folder}/rows")
    hits = contained(spark, rows).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    both = rows.select("row", "doc_id", "n_words", "places").join(hits, "row", "left")
    own = F.array_sort(F.array_distinct(F.transform("places", lambda x: x["label"])))
    every = F.array_sort(F.array_union(own, F.coalesce("more", F.lit([]).cast("array<string>"))))
    starts = F.transform("places", lambda x: x["i"])
    return both.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(own, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
