from __future__ import annotations

from litgraph.operators.screening import greedy
from litgraph.operators.sequential import louvain, path_of
from litgraph.streaming.progress import kept


def test_main_path_counts_paths():
    # flow runs from the cited to the citing work
    edges = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("z", "d"), ("d", "e")]
    assert path_of(edges) == [("a", "b", 1), ("b", "d", 1), ("d", "e", 3)]


def test_main_path_breaks_cycles():
    assert path_of([("a", "b"), ("b", "c"), ("c", "b")]) == [("a", "b", 1), ("b", "c", 1)]


def test_louvain_two_groups():
    edges = [(a, b, 1.0) for g in ((0, 1, 2, 3), (4, 5, 6, 7)) for a in g for b in g if a < b] + [(3, 4, 0.1)]
    home = louvain(edges)
    assert len({home[v] for v in (0, 1, 2, 3)}) == 1 and len({home[v] for v in (4, 5, 6, 7)}) == 1 and home[0] != home[4]


def test_greedy_rewards_links():
    got = greedy([(1, 0.2), (2, 0.5), (3, 0.4), (4, 0.05)], {1: {3}, 3: {1}}, {1}, 10, 0.1, 0.2)
    assert [v for v, _ in got] == [1, 3, 2]


def test_throttle():
    assert kept([0, 1, 2, 5, 6], 2, None) == ([True, False, True, True, False], 5)


def test_stream_equals_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from litgraph.streaming import progress as op

    from .conftest import SF

    events = spark.read.parquet(f"{SF}/events.parquet").select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("at"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = op.throttle_stream(stream, 3.6e9).writeStream.format("memory").queryName("thin").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    want = {tuple(r) for r in op.throttle_batch(events, 3.6e9).collect()}
    assert {tuple(r) for r in spark.table("thin").collect()} == want


def test_communities_within_equal_those_of_the_global_graph(spark, tmp_path):
    import pandas as pd

    from litgraph.bindings import views
    from litgraph.operators import analysis as op
    from litgraph.operators.communities import communities_within
    from litgraph.operators.sequential import by_project

    from .conftest import SF

    members, citations, parts = views(spark, SF, "project_works", "citations", "work_parts")
    edges = by_project(op.similarity_graph(op.citation_weights(citations), op.coupling_weights(citations), op.concept_weights(parts)), members).toPandas()
    want = set()
    for project, rows in edges.groupby("project_id"):
        rows = rows.sort_values(["a", "b"])
        home = pd.Series(louvain(list(zip(rows.a.tolist(), rows.b.tolist(), rows.weight.tolist(), strict=True))))
        kept = sorted((sorted(m) for m in home.groupby(home).groups.values() if len(m) >= 3), key=lambda m: (-len(m), m))
        want |= {(project, v, f"c{i}") for i, m in enumerate(kept, 1) for v in m}
    got = communities_within(members, citations, parts, str(tmp_path))
    assert "weight" not in got._jdf.queryExecution().toString()
    rows = [tuple(r) for r in got.collect()]
    assert want and len(rows) == len(want) and set(rows) == want


def test_pairs_and_packing_in_any_blocks():
    import numpy as np

    from litgraph.operators.communities import edges_within, packed, shared, unpacked

    rng = np.random.default_rng(1)
    key = np.unique(rng.integers(0, 40 * 30, 300))
    owner, value = key // 30, key % 30 * 10**12 - 5
    sets = [set(value[owner == i].tolist()) for i in range(40)]
    want = {(i, j): len(sets[i] & sets[j]) for i in range(40) for j in range(i + 1, 40) if sets[i] & sets[j]}
    for most in (1, 7, 1 << 20):
        assert {(i, j): m for part in shared(owner, value, 40, most) for i, j, m in zip(*(x.tolist() for x in part), strict=True)} == want
    for x in (np.asarray([-(2**63), 2**63 - 1, 0]), np.asarray([7, 7]), np.zeros(0, np.int64), value):
        assert [y.tolist() for y in unpacked(packed(x) + packed(owner))] == [x.tolist(), owner.tolist()]
    # 13 shared of 64 is 0.1015625, which rounds up; of five, one is enough, of six it is not
    none = np.zeros(2, np.int64)
    a, b, w = edges_within(np.asarray([3, 9]), np.asarray([38, 39]), np.concatenate([np.arange(38), np.arange(25, 64)]), none, none[:0])
    assert (a.tolist(), b.tolist(), w.tolist()) == ([0], [1], [0.101563])
    for size, n in ((2, 1), (3, 0)):
        concepts = np.concatenate([np.arange(4), np.arange(3, 3 + size)])
        assert len(edges_within(np.asarray([3, 9]), np.asarray([4, size]), concepts, none, none[:0])[0]) == n
    # one cites the other both ways: once; nine works that both cite: two at most
    refs = np.concatenate([[9], np.arange(100, 109), [3], np.arange(100, 109)])
    assert edges_within(np.asarray([3, 9]), none, none[:0], np.asarray([10, 10]), refs)[2].tolist() == [3.0]
