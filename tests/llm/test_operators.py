"""Operators over small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import itertools
import zlib

import pytest
from pyspark.sql import functions as F

from litgraph.llm import decontaminate, license_scan, line_rules, near_dup, packing, quality, secrets_scan, sharding, site_tree, token_files
from litgraph.llm.queries import tokenizer_path

BASE = "the quick brown fox jumps over the lazy dog near the old river bank while seven tall trees sway in a cold wind and nobody says any word about it at all today or later"


def documents(spark, empty=False):
    near = BASE.replace("later", "tomorrow")
    texts = [BASE, BASE, near, None, "", "   ", "x", "long " + "word " * 30_000, BASE + " " + "password = hunter2222", "token: abcdef99\nAll rights reserved.\nline\nline", "!!! ###"]
    rows = [(i, t, "en" if i % 2 else None, "src0" if i % 3 else None, len(t or ""), i, 0) for i, t in enumerate(texts)]
    rows += [(0, BASE, None, None, 1, 5, 5), (None, None, None, None, None, None, None), (None, "lone text", "en", "s", 2, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, label int, bucket int")
    return df.where("false") if empty else df


OPERATORS = {
    "token_files": lambda s, d: token_files.token_files(s, d, tokenizer_path("byte_bpe_50k.json")),
    "line_rules": line_rules.verdicts,
    "secrets": secrets_scan.secrets,
    "licenses": license_scan.licenses,
    "shard": sharding.shard,
    "near_duplicates": near_dup.near_duplicates,
    "classify": lambda s, d: quality.classify(s, d, s.createDataFrame([(1, 1), (2, 0), (3, 1), (5, 0), (None, None)], "doc_id long, quality int")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_a_document(name, spark):
    got = OPERATORS[name](spark, documents(spark)).select("doc_id").collect()
    assert sorted((r[0] for r in got), key=lambda x: (x is None, x)) == [0, 0, *range(1, 11), None, None]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, spark):
    assert OPERATORS[name](spark, documents(spark, empty=True)).collect() == []


def test_token_files_stand_in_order(spark):
    from litgraph.llm.tokens import Encoder

    e = Encoder(tokenizer_path("byte_bpe_50k.json"))
    got = sorted(OPERATORS["token_files"](spark, documents(spark)).collect(), key=lambda r: r["start"])
    texts = {r["doc_id"]: r["text"] for r in documents(spark).where("doc_id IS NOT NULL").collect()}
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        if r["doc_id"] is not None:
            ids = [*e.plain([texts[r["doc_id"]] or ""])[0], 2]
            assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def test_near_duplicate_classes(spark):
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(spark, documents(spark)).where("doc_id IS NOT NULL").collect()}
    assert got[1] == got[2] == 0 and got[3] == got[4] == 3 and got[5] == 5 and got[10] == 10


def test_near_duplicates_of_a_hot_group(spark):
    """A chain of copies, each changed a little from the last: one class, though its ends have little in common."""
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        if i:
            words[(i * 7) % 120] = f"v{i}"
        rows.append((i, " ".join(words)))
    got = near_dup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["class_id"] for r in got} == {0}


def test_keep_one(spark):
    kept = near_dup.keep_one(spark, documents(spark))
    assert kept.columns == documents(spark).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == [0, 3, 5, 6, 7, 9, 10]


def test_stages_return_columns_of_clashing_names(spark):
    names = ("_id", "no_id", "ID_OR_0", "text_key", "key", "_text", "_label", "bands", "h", "f0", "row")
    docs = documents(spark).withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id"), F.lit(-1)).cast("string")) for c in names})
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (5, 0)], "doc_id long, quality int")
    items = spark.createDataFrame([(7, "no such words in any text at all here")], "item_id long, text string")
    for out in (near_dup.keep_one(spark, docs), quality.keep_good(spark, docs, labels, 0.0), decontaminate.keep_clean(spark, docs, items), secrets_scan.mask(spark, docs)):
        assert out.schema.simpleString() == docs.schema.simpleString()
        rows = out.collect()
        assert rows and all(r[c] == f"{c}{-1 if r['doc_id'] is None else r['doc_id']}" for r in rows for c in names)


def test_buckets_of_texts_that_are_alike_but_no_copies(spark):
    """Texts that share bands below the threshold, in one set or many, against brute force."""
    import random

    from .test_queries import brute_classes

    rnd = random.Random(11)
    stock, rows = [f"w{i}" for i in range(100)], []
    for i in range(260):
        w = stock[:]
        for _ in range(rnd.choice([0, 1, 2, 3, 4, 5])):
            w[rnd.randrange(100)] = f"v{rnd.randrange(10_000)}"
        rows.append((i, " ".join(w)))
    got = near_dup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == brute_classes(rows)


def test_shards(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"))
    rows = sharding.shard(spark, docs).collect()
    assert all(r["grown_shard"] in (r["shard"], 16) for r in rows)
    for s in range(16):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots))) and 150 < len(slots) < 350


def test_changed_weights_move_rows_of_that_subtree_only(spark):
    key = F.col("id")
    old, new = (sharding.topology(16, weights=w) for w in ({}, {5: 3.0}))
    rows = spark.range(4000).select(sharding.assign(old, key).alias("a"), sharding.assign(new, key).alias("b")).where("a <> b").collect()
    assert rows and all(r["b"] < 8 if r["a"] >= 8 else r["b"] in range(4, 8) if r["a"] < 4 else r["b"] == 5 for r in rows)


def test_packing_covers_every_document(spark):
    rows = packing.pack(spark, documents(spark), tokenizer_path("word_bpe_49k.json")).collect()
    used = {}
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in used.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    assert len({(r["doc_id"], r["piece"]) for r in rows if r["doc_id"] == 7}) == 15
    assert packing.pack(spark, documents(spark, empty=True), tokenizer_path("word_bpe_49k.json")).collect() == []


def test_line_rules(spark):
    shared = "This line stands in every text of the host."
    texts = [f"{shared}\nown words number {i} here and there and more of them {i * 7}" for i in range(40)] + [f"{shared}\nx{i}" for i in range(3)]
    docs = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in line_rules.verdicts(spark, docs).collect()}
    assert got[0]["kept"] and got[0]["removed_words"] == 9 and not got[40]["kept"] and not got[40]["base_failed"]
    copies = spark.createDataFrame([(i, texts[0], "h") for i in range(60)], "doc_id long, text string, source string")
    assert all(r["kept"] and r["removed_words"] == 0 for r in line_rules.verdicts(spark, copies).collect())


def test_depleted_documents(spark):
    """What is left after removal must have as many words as the base rule demands, however much was lost."""
    shared = "One notice stands here."
    own = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    texts = [f"{shared}\n{own(i, n)}" for i, n in enumerate([6, 9, 10, 40] * 8)]
    docs = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    for i, r in enumerate(sorted(line_rules.verdicts(spark, docs).collect(), key=lambda r: r["doc_id"])):
        assert not r["base_failed"] and r["removed_words"] == 4 and r["kept"] == (i % 4 > 1)


def test_lines_shared_by_distinct_documents(spark):
    """Documents made of shared lines alone, copies and a second host, against a brute-force count."""
    lines = [f"Shared line number {i} has ten words in it, as all." for i in range(15)]
    texts = [("h", "\n".join(c)) for c in itertools.combinations(lines, 3)]
    texts += [("h", texts[0][1].upper().replace(" ", "  "))] * 30 + [("g", lines[0] + "\n" + lines[i]) for i in (1, 2)] * 15
    texts += [(None, f"{lines[0]}\n{lines[1]}\nOwn line {i} of a document that has ten words here.") for i in range(25)]
    docs = spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(texts)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in line_rules.verdicts(spark, docs).collect()}
    holders = {}
    for s, t in texts:
        normal = [" ".join(x.lower().split()) for x in t.split("\n")]
        for x in normal:
            holders.setdefault((s, x), set()).add(tuple(normal))
    for i, (s, t) in enumerate(texts):
        gone = sum(len(x.split()) for x in t.split("\n") if len(holders[s, " ".join(x.lower().split())]) > line_rules.MOST_DOCUMENTS)
        assert got[i]["removed_words"] == gone
    assert got[0]["removed_words"] > 0 and not got[0]["kept"] and got[len(texts) - 1]["removed_words"] > 0


def test_licenses(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License."), (2, "cc by cc by"), (3, "GNU\nGeneral Public License")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.licenses(spark, docs).collect()}
    assert got[1]["labels"] == "mit" and got[1]["n_base"] == 0
    assert (got[2]["n_base"], got[2]["first_word"], got[2]["last_word"]) == (2, 0, 2)
    assert got[3]["base_labels"] == "gpl" and got[3]["first_word"] == 1


def test_leaks_and_empty_benchmark(spark):
    docs, item = documents(spark), " ".join(BASE.split()[3:20])
    items = spark.createDataFrame([(7, item), (8, None), (None, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(spark, docs, items).collect()}
    assert got == {(i, 7) for i in (0, 1, 2, 8)}
    assert decontaminate.leaks(spark, docs, items.where("false")).collect() == []
    kept = decontaminate.keep_clean(spark, docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 5


def test_masked_secrets(spark):
    got = {r["doc_id"]: r for r in secrets_scan.mask(spark, documents(spark)).where("doc_id IN (8, 9)").collect()}
    assert got[8]["text"] == BASE + " [secret]" and got[8]["n_chars"] == len(got[8]["text"]) and got[9]["text"].startswith("[secret]\nAll")


def test_pages(spark):
    pages = [(i, f"http://h.example/{i}", f"<body><div class='x'>Same notice for all</div><div id='p'><p>Text of page {i}</p></div></body>") for i in range(5)]
    pages += [(5, None, None), (6, "http://[bad", ""), (7, "http://o.example/", "<p>alone")]
    got = {r["page_id"]: r["text"] for r in site_tree.extract(spark, spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {**{i: f"Text of page {i}" for i in range(5)}, 5: "", 6: "", 7: "alone"}
    assert site_tree.extract(spark, spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_pages_where_the_tree_decides(spark):
    """Content outside the article, boilerplate inside it, a container with words of both kinds, and copies of a page."""
    def page(i):
        share = "<p>Share this page</p><div>Read more</div>"
        return f"<body><nav>Menu</nav><div class='lead'>Lead of {i}</div><article><p>Text of {i}</p>{share}</article><section>Mail us</section><div class='ad'>Buy {i}</div></body>"

    pages = [(i, f"http://h.example/{i}", page(i)) for i in range(12)] + [(100 + i, f"http://h.example/c{i}", page(0)) for i in range(30)]
    pages += [(200 + i, f"http://g.example/{i}", f"<body><div class='content with-sidebar'><p>Own words {i}</p></div></body>") for i in range(4)]
    got = {r["page_id"]: r["text"] for r in site_tree.extract(spark, spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    want = {i: f"Lead of {i}\n\nText of {i}" for i in range(12)} | {100 + i: "Lead of 0\n\nText of 0" for i in range(30)}
    assert got == want | {200 + i: f"Own words {i}" for i in range(4)}


def test_exceptions_by_list_and_by_join_agree(spark):
    pages = [(i, f"http://h{i % 3}.example/{i}", f"<nav>Menu</nav><article><p>Text {i}</p><p>Share</p></article><section>Mail</section><aside>Own {i}</aside>") for i in range(30)] + [(99, None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    one, other = (sorted(map(tuple, site_tree.extract(spark, df, most_keys=n).collect())) for n in (site_tree.MOST_BROADCAST, 0))
    assert one == other and one[0][2] == "Text 0"


def test_shared_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace

    from litgraph.llm import common

    away = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077"), conf=SimpleNamespace(get=lambda *_: None))
    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(away)


def test_released_folders_are_gone(spark):
    import os

    from litgraph.llm import common

    at = common.made()
    folder = common.shared_dir(spark)
    common.stored(spark.range(3), f"{folder}/x")
    assert os.path.isdir(folder.removeprefix("file:"))
    common.release(spark, at)
    assert not os.path.exists(folder.removeprefix("file:")) and common.made() == at


def test_rows_of_one_id_are_dealt_over_files(spark):
    docs = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 50).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is small
    try:
        got = token_files.token_files(spark, docs, tokenizer_path("byte_bpe_50k.json")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 2000 and len({r["shard"] for r in got}) > 1
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
