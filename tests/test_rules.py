"""Rules that SQL does not express, and operators with more than one way, against plain versions."""

from __future__ import annotations

import itertools
import random
from collections import defaultdict
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from litgraph.functions import keyterms as kt
from litgraph.functions.text import keyword
from litgraph.operators import analysis, concepts, evaluation, harvest, insights, lineage, outline, sequential, writes


def all_shortest(graph, s, t):
    paths, front, seen = [], [[s]], {s}
    while front and not paths:
        paths = [p for p in front if p[-1] == t]
        layer = [[*p, v] for p in front for v in graph[p[-1]] if v not in seen]
        seen |= {p[-1] for p in layer}
        front = layer
    return paths


@pytest.mark.parametrize("most_edges", [1000, 0])
def test_betweenness_of_one_graph(spark, most_edges):
    rnd = random.Random(1)
    edges = {tuple(sorted(rnd.sample(range(12), 2))) for _ in range(16)}
    graph = defaultdict(set)
    for a, b in edges:
        graph[a].add(b)
        graph[b].add(a)
    n, want = len(graph), dict.fromkeys(graph, 0.0)
    for s, t in itertools.combinations(sorted(graph), 2):
        paths = all_shortest(graph, s, t)
        for p in paths:
            for v in p[1:-1]:
                want[v] += 1 / len(paths)
    rows = spark.createDataFrame([*edges, *[(b, a) for a, b in edges][:3], (0, 0)], "citing long, cited long")
    got = {r["id"]: r["betweenness"] for r in sequential.betweenness(spark, rows, most_edges).collect()}
    assert got == {v: pytest.approx(x * 2 / ((n - 1) * (n - 2))) for v, x in want.items()}


def test_ranks_over_ranges(spark):
    rnd = random.Random(2)
    values = [(i, rnd.randrange(50)) for i in range(3000)]
    rows = spark.createDataFrame(values, "id long, v long")
    got = {r["id"]: r["p"] for r in lineage.ranked(rows, [F.desc("v"), F.col("id")], "p").collect()}
    assert got == {i: p for p, (i, _) in enumerate(sorted(values, key=lambda x: (-x[1], x[0])), 1)}
    top = {r["id"] for r in analysis.top_share(rows, "v").collect()}
    assert top == {i for i, p in got.items() if p <= 300}
    assert {r["id"] for r in analysis.top_share(rows.limit(3), "v", 0.29).collect()} <= {r["id"] for r in rows.limit(3).collect()}
    assert lineage.ranked(rows.where("false"), [F.col("id")], "p").collect() == []


def test_pairs_of_a_hot_key(spark):
    rows = spark.createDataFrame([(0, i) for i in range(40)] + [(1, 5), (1, 7), (2, 9)], "k long, v long")
    want = sorted([*itertools.combinations(range(40), 2), (5, 7)])
    for block in (1000, 7):
        assert sorted(map(tuple, analysis.pairs_within(rows, "k", "v", block).collect())) == want


def test_labels():
    assert insights.pick_terms(["Graph networks", "graph", "Attention", "Speech", "Vision"], ["x"]) == (["Graph networks", "Attention", "Speech"], ["Graph networks", "Attention", "Speech", "Vision"])
    assert insights.pick_terms(["Graph"], ["graph", "deep graph", "speech"]) == (["Graph", "speech"], ["Graph"])
    assert insights.pick_terms([], []) == ([], [])


def test_mentions():
    p = [(c, insights.surface_pattern(s)) for c, s in (("a", "language model"), ("b", "large language-model"), ("c", "model"), ("d", "x"))]
    assert p[3][1] is None
    text = "Large language models and a language-model; a model of models."
    found = insights.mentions_in(text, p[:3])
    assert [(c, text[s:e]) for c, s, e in found] == [("b", "Large language models"), ("a", "language-model"), ("c", "model")]
    assert insights.mentions_in("", p[:3]) == []


def test_outline():
    text = "=== page 1 ===\nAbstract\n1 Introduction\nfirst text.\n3 Skipped Section\n1.1 Aims\n=== page 2 ===\n2. Methods\nTable 1 Numbers\nabstract\nReferences\nAppendix A Proofs\n"
    assert [(t, level, page) for t, level, page, _ in outline.outline(text)] == [("Abstract", 1, 1), ("1 Introduction", 1, 1), ("1.1 Aims", 2, 1), ("2. Methods", 1, 2), ("References", 1, 2), ("Appendix A Proofs", 1, 2)]
    assert all(text[at:].startswith(t) for t, _, _, at in outline.outline(text)) and outline.outline("") == []
    assert outline.preferred([("Methods", 1, 2), ("Missing", 1, 2)], text) == [("Methods", 1, 2, text.index("2. Methods")), ("Missing", 1, 2, None)]
    assert outline.preferred([], text) == outline.outline(text)


def test_highlight():
    items = ["The quick brown-", "  fox  jumps", "over the dog"]
    assert outline.highlight(items, "BROWNFOX jumps over") == [(0, 10, 15), (1, 2, 12), (2, 0, 4)]
    assert outline.highlight(items, "cat") == [] and outline.highlight(items, "") == [] and outline.highlight([], "x") == []


def test_title_similarity(spark):
    pairs = [(1, "A Survey: of Graphs", "a survey of graph"), (2, "", "x"), (3, "same", "SAME!")]
    got = {r["id"]: r["similarity"] for r in harvest.similarity(spark.createDataFrame(pairs, "id long, a string, b string")).collect()}
    assert got == {1: SequenceMatcher(None, "asurveyofgraphs", "asurveyofgraph").ratio(), 2: 0.0, 3: 1.0}


def test_extraction_is_validated_before_it_is_written(spark, tmp_path):
    s = spark.createDataFrame([("s1", 1), ("s2", 2)], "id string, work_id long")
    e = spark.createDataFrame([("s1", 1, "q"), ("s1", 1, "q"), ("s2", 9, "q")], "statement string, work_id long, quote string")
    with pytest.raises(ValueError, match="nothing is written"):
        writes.write_extraction(s, e, "r", str(tmp_path / "x"))
    assert not (tmp_path / "x").exists()
    for run in ("r1", "r2", "r1"):
        got = writes.write_extraction(s.where("id = 's1'"), e.where("statement = 's1'"), run, str(tmp_path / "x"))
    assert got[0].count() == 2 and got[1].count() == 2  # one in each run; a run written again replaces its own


def test_turtle_escapes(spark, tmp_path):
    t = spark.createDataFrame([("a", "p", 'say "x"\n\\', False), ("a", "p", "b", True)], "subject string, predicate string, object string, is_iri boolean")
    assert sorted(r["line"] for r in writes.turtle(t, str(tmp_path / "t")).collect()) == ['<a> <p> "say \\"x\\"\\n\\\\" .', "<a> <p> <b> ."]


def test_preprints(spark):
    rows = [("preprint", None, "V", "10.1/x"), ("Working-Paper", None, None, None), ("article", "2101.1", "arXiv (Cornell)", None), ("article", "2101.1", "Journal", None), ("article", "2101.1", None, "https://doi.org/10.48550/arxiv.1"), ("article", "2101.1", None, "10.1/x"), (None, None, None, None)]
    got = spark.createDataFrame(rows, "t string, a string, v string, d string").select(analysis.preprint(*[F.col(c) for c in "tavd"]).alias("p")).collect()
    assert [r["p"] for r in got] == [True, True, True, False, True, False, False]


def test_key_terms(spark):
    row = lambda e: spark.range(1).select(e.alias("x")).first()["x"]
    assert row(kt.strip_boilerplate(F.lit("We do x. In: Proceedings of Y. Main in: z! Rest (c) 2020 Z."))) == "We do x. Main Rest"
    assert row(kt.strip_links(F.lit("See https://a.org/x and me@b.com"))) == "See  ;  and  ; "
    assert sorted(row(kt.acronyms(F.lit("GPUs and LLM or A")))) == ["GPU", "LLM"] and row(kt.acronyms(F.lit("ALL CAPS"))) == []
    assert row(F.transform(F.array(*[F.lit(w) for w in ("real-world", "self-attention", "fine-grained", "tree-based")]), lambda w: kt.modifier(w))) == [True, False, True, True]
    assert row(F.transform(F.array(*[F.lit(w) for w in ("Language Models", "graph_networks", "bus", "---", "(Studies)")]), keyword)) == ["language model", "graph network", "bus", None, "study"]


def test_identity_chain(spark):
    rows = [(i, f"k{i}") for i in range(60)] + [(i, f"k{i + 1}") for i in range(59)] + [(100, "z"), (101, "z")]
    got = {r["record"]: r["group"] for r in evaluation.identity_groups(spark.createDataFrame(rows, "record long, key string")).collect()}
    assert got == {**dict.fromkeys(range(60), 0), 100: 100, 101: 100}


def test_merge_takes_the_commonest_surface(spark):
    rows = [(1, "Models", 0.5), (2, "Models", None), (3, "model", float("nan")), (4, "!!", 1.0)]
    got = concepts.merge(spark.createDataFrame(rows, "work_id long, term string, score double")).collect()
    assert [(r["key"], r["label"], r["works"]) for r in got] == [("model", "Models", 3)]


def test_each_title_meets_its_own_search(spark):
    wanted = [(1, "large1996", "large ring - SMALL 5", 1996), (1, "small1996", "small bolt - STANDARD 5", 1996), (9, "small1996", "small ring: LARGE 5", 1996)]
    hits = [("small1996", 1, 9, "small ring: LARGE 5", 1996), ("small1996", 2, 7, "small bolt: STANDARD 5", 1996), ("large1996", 3, 8, "large nut", 1996)]
    w, h = spark.createDataFrame(wanted, "id long, p string, title string, year int"), spark.createDataFrame(hits, "p string, place int, hit long, title string, year int")
    got = sorted(tuple(r) for r in harvest.fallback(w, h, search="p").collect())
    assert got == [(1, 7, 1.0), (9, 9, 1.0)]  # not hit 9 for the first title of 1, whose search does not list it


def test_weight_grid_is_one_partition(spark):
    grid = evaluation.weight_grid(spark, (0.0, 1.0), 3)
    assert sorted(tuple(r) for r in grid.collect())[:2] == [(0.0, 0.0, 1.0), (0.0, 0.5, 0.5)] and grid.count() == 7
    plan = evaluation.weight_grid(spark)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


@pytest.mark.parametrize("seed", range(40))
def test_betweenness_by_branches_and_blocks(seed):
    """Sparse graphs of trees, cycles and cliques that share nodes, against a search from every node."""
    rnd = random.Random(seed)
    n = rnd.randint(1, 40)
    edges = [(v, rnd.randrange(v)) for v in range(1, n) if rnd.random() < 0.9] + [(rnd.randrange(n), rnd.randrange(n)) for _ in range(rnd.choice([0, 1, 3, 12]))]
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want = defaultdict(float)
    for v in range(n):
        sequential.shortest_paths(v, {x: sorted(y) for x, y in near.items()}, want)
    got = sequential.between(n, np.asarray([e[0] for e in edges], np.int64), np.asarray([e[1] for e in edges], np.int64))
    assert got == pytest.approx([want[v] for v in range(n)], abs=1e-9)


def test_betweenness_of_long_chains_is_quick():
    """A search from every node would visit 4e8 nodes."""
    a = np.arange(20_000, dtype=np.int64)
    got = sequential.between(20_002, a, a + 1)
    assert got[1] == 2 * 19_999 and got[0] == got[20_001] == 0 and got[10_000] == 2 * 10_000 * 10_000


def test_ground_all_is_ground_of_each_pair(spark):
    texts = spark.createDataFrame([(1, "Deep graph networks; a GNN"), (2, None), (3, "reinforcement learning"), (4, "RLs"), (5, "")], "work_id long, text string")
    terms = spark.createDataFrame([("graph networks",), ("graph nets (biology)",), ("reinforcement learning",), ("the",), (None,), ("networks",), ("",)], "term string")
    want = concepts.ground(texts.crossJoin(terms).select("work_id", "term", F.lit(1.0).alias("score"), "text"))
    plan = concepts.ground_all(texts, terms)
    key = lambda rows: sorted((r["work_id"], str(r["term"]), r["score"]) for r in rows)
    assert key(plan.collect()) == key(want.collect())
    assert concepts.ground_all(texts, terms.limit(0)).count() == 0


def test_titles_that_match_share_a_key(spark):
    rnd = random.Random(2)
    titles = [" ".join(rnd.sample("abcdefghijkl", rnd.randint(0, 12))) for _ in range(60)] + ["a b", "ab", "AB!"]
    t = spark.createDataFrame([(x,) for x in titles], "t string").distinct()
    rows = t.crossJoin(t.withColumnRenamed("t", "u"))
    from litgraph.functions import identity

    met = rows.where(identity.titles_match(F.col("t"), F.col("u")))
    assert met.where("t <> u").count() > 0
    assert met.where(~F.arrays_overlap(identity.match_keys(F.col("t")), identity.match_keys(F.col("u")))).count() == 0


def test_voids_as_bits_and_as_rows(spark):
    rnd = random.Random(3)
    rows = spark.createDataFrame([(w, f"é{c}" if c % 3 else f"z{c}") for w in range(150) for c in rnd.sample(range(70), 3)], "work_id long, concept_id string")
    got = [tuple(r) for r in analysis.matrix_voids(rows, limit=5000).collect()]
    assert len(got) > 100 and got == [tuple(r) for r in analysis.matrix_voids(rows, limit=5000, dense=0).collect()]


def test_phrases_within_texts_and_over_rows(spark):
    """Both ways of the key phrases, on odd words, repeated phrases, empty texts and texts that share an id."""
    from litgraph.operators import keyphrases

    rnd = random.Random(5)
    pool = "graph graphs GNNs GNN state-of-art state of art self-attention attention policies policy the 2020 b2b größe größen l'air x-ray fine-grained assembly bus buses, networks. models LLMS llm's and (deep) copyright arxiv learning".split()
    rows = [(i, " ".join(rnd.choices(pool, k=rnd.randint(0, 6))), " ".join(rnd.choices(pool, k=rnd.randint(0, 60)))) for i in range(80)] + [(90, None, ""), (91, "", None), (92, "graph networks", "graph networks learning")]
    save = lineage.saver(spark)
    texts = spark.createDataFrame(rows, "id long, title string, body string").repartition(3)
    fast, plain = keyphrases.Corpus(texts, save), keyphrases.Corpus(texts, save, most_plurals=-1)
    many = keyphrases.Corpus(texts, save, most_kept=0)
    assert fast.found is None and plain.found is not None and many.found is None
    key = lambda df: sorted(map(str, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))
    for get in (lambda c: c.statistics(), lambda c: c.truncated(), lambda c: c.counts(), lambda c: c.known(), lambda c: c.best(8).withColumn("raw", F.round("raw", 9)).withColumn("best", F.round("best", 9))):
        assert key(get(fast)) == key(get(plain)) == key(get(many))
    assert fast.best(8).count() > 100 and fast.truncated().count() >= 0
    twice = keyphrases.Corpus(texts.union(texts.where("id = 92")), save)
    assert twice.found is not None
    assert {r["phrase"]: r["df"] for r in twice.statistics().collect()} == {r["phrase"]: r["df"] for r in fast.statistics().collect()}


def test_texts_without_a_part_have_no_notice_or_link(spark):
    """What the patterns find in any spelling has one of the parts that let them search."""
    notices = ["Association  for\nComputational linguistics", "PROCEEDINGS of", "© x", "(C) 1999", "Copyright", "arXiv", "Published as a conference paper", "Licenced under", "LICENSED  under", "All rights\treserved", "x In: y"]
    links = ["ftp://a", "HTTP://x", "WWW.x", "a@b.cd", "DOI: x", "10.1000/x", "a.COM", "b.org/x", "c.net", "d.io", "e.ai", "f.edu", "g.gov", "h.dev", "i.htm", "j.html", "GitHub/x", "gitlab", "bitbucket", "huggingface"]
    cut = lambda texts, f: [r["y"] for r in spark.createDataFrame([(f"We do  q {t}",) for t in texts], "x string").select(f(F.col("x")).alias("y")).collect()]
    assert all(n not in got and got.startswith("We do  q") for n, got in zip(notices, cut(notices, kt.strip_boilerplate), strict=True))
    assert all(" ; " in got for got in cut(links, kt.strip_links))
    assert cut([" A b.  C d?\n e \t"], kt.strip_boilerplate) == ["We do  q  A b. C d? e"]
