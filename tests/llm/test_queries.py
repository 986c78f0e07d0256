"""The registered queries over the smallest tables, against brute-force versions."""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from litgraph.llm import decontaminate, near_dup, quality, queries, secrets_scan, sharding
from litgraph.llm.common import text_bytes
from litgraph.llm.queries import tokenizer_path
from litgraph.llm.tokens import Encoder

from ..conftest import SF


@pytest.fixture(scope="module")
def docs(duck):
    return duck.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


@pytest.fixture(scope="module")
def run(spark):
    done = {}

    def get(name):
        if name not in done:
            done[name] = [r.asDict() for r in queries.QUERIES[name](spark, SF).collect()]
        return done[name]

    return get


def test_op1(docs, run):
    e, at = Encoder(tokenizer_path("byte_bpe_50k.json")), 0
    got = {r["doc_id"]: r for r in run("op1_token_files")}
    for k, t in docs:
        ids = np.asarray([*e.plain([t])[0], 2], "<u4")
        assert (got[k]["start"], got[k]["n_tokens"], got[k]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids))
        at += len(ids)


def test_op2_base(docs, run):
    got = {r["doc_id"]: r for r in run("op2_line_rules")}
    for k, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n = Counter(windows)
        covered = {j for i, x in enumerate(windows) if n[x] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        want = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed)
        assert tuple(got[k][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == want
        assert not (failed and got[k]["kept"])


@pytest.mark.parametrize("name", queries.ORACLES)
def test_sql(name, duck, run):
    want = duck.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    key = lambda r: tuple(str(r[c]) for c in names)
    assert sorted(key(r) for r in run(name)) == sorted(key(dict(zip(names, r, strict=True))) for r in want.fetchall())


def test_op3_base(docs, run):
    got = {r["doc_id"]: r for r in run("op3_secrets")}
    for k, t in docs:
        found = [(m.start(), 0, m.end()) for m in secrets_scan.ASSIGN.finditer(t) if len(m[1]) >= 6]
        found += [(m.start(), 1, m.end()) for m in secrets_scan.ACCESS.finditer(t) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end()) for m in secrets_scan.HEX.finditer(t) if len(m[0]) >= 24]
        text = ",".join(f"{('assign', 'access', 'hex')[x]}:{s}:{e}" for s, x, e in sorted(found))
        assert got[k]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(got[k]["spans"].split(","))


def test_op5(docs, duck, run):
    got = {(r["doc_id"], r["item_id"]) for r in run("op5_simhash_leaks")}
    items = duck.execute("SELECT item_id, text FROM benchmark").fetchall()
    verbatim = {(k, i) for k, t in docs for i, x in items if x in t}
    assert verbatim <= got
    sets = {i: shingles(x) for i, x in items}
    assert all(sum((shingles(dict(docs)[k]) & sets[i]).values()) >= 0.8 * sum(sets[i].values()) for k, i in got)


def shingles(text):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in text))
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def descend(node, doc_id):
    """The shard by the least of the children's draws, with the xxhash library."""
    while node.shard is None:
        draws = []
        for child in node.children:
            h = xxhash.xxh64_intdigest(struct.pack("<q", doc_id), seed=xxhash.xxh64_intdigest(child.name.encode(), seed=42))
            draws.append(-math.log(((h >> 12) + 0.5) / 2**52) / child.weight)
        node = node.children[draws.index(min(draws))]
    return node.shard


def test_op6(docs, run):
    rows = run("op6_hash_tree")
    now, grown = sharding.topology(16), sharding.topology(17)
    want = {k: (len(t.encode()) + 1, zlib.crc32(t.encode()), descend(now, k), descend(grown, k)) for k, t in docs}
    assert {r["doc_id"]: (r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in rows} == want
    for s in range(16):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_op7(duck, run):
    import html

    got = {r["page_id"]: r["text"] for r in run("op7_site_trees")}
    for k, page in duck.execute("SELECT page_id, html FROM pages").fetchall():
        article = re.sub(r"<[^>]*$", "", re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)[1])
        blocks = [" ".join(html.unescape(x.replace("<br>", " ").replace("<b>", "")).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert got[k] == "\n\n".join(b for b in blocks if b)


def brute_classes(rows):
    """The least doc_id of each class: all pairs, exactly."""
    texts = list(dict.fromkeys(t for _, t in rows))
    vectors = near_dup._vectors(texts)
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = vectors[i], vectors[j]
            if len(a[0]) and len(b[0]) and near_dup.probability_jaccard(a, b) >= near_dup.THRESHOLD - 1e-12:
                parent[root(i)] = root(j)
    of = {t: root(i) for i, t in enumerate(texts)}
    least = {}
    for k, t in sorted(rows):
        least.setdefault(of[t], k)
    return {k: least[of[t]] for k, t in rows}


def test_op8(docs, run):
    assert {r["doc_id"]: r["class_id"] for r in run("op8_prob_minhash")} == brute_classes(docs)


def test_op9(duck, run):
    labels = dict(duck.execute("SELECT doc_id, min(quality) FROM labels GROUP BY doc_id").fetchall())
    rows = run("op9_discriminant")
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > 0.9


def test_op10(docs, run):
    e, rows = Encoder(tokenizer_path("word_bpe_49k.json")), run("op10_best_fit")
    got = {(r["doc_id"], r["piece"]): r for r in rows}
    for k, t in docs:
        ids = np.asarray([*e.plain([t])[0], 0], "<u4")
        for p in range(-(-len(ids) // 2048)):
            r, part = got.pop((k, p)), ids[p * 2048 : (p + 1) * 2048]
            assert (r["start"], r["length"], r["ids_crc32"]) == (p * 2048, len(part), zlib.crc32(part))
    assert not got
    fill = Counter()
    for r in rows:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 2048) + 2


def test_pipeline(spark, duck, docs):
    """Each stage by brute force, one after another."""
    labels = dict(duck.execute("SELECT doc_id, min(quality) FROM labels GROUP BY doc_id").fetchall())
    x = quality.features(*text_bytes(pa.array([t for _, t in docs])))
    train = np.asarray([k in labels and zlib.crc32(str(k).encode()) % 4 != 2 for k, _ in docs])
    y = np.asarray([labels.get(k, -1) for k, _ in docs])
    moments = {c: (float((train & (y == c)).sum()), x[train & (y == c)].sum(axis=0), x[train & (y == c)].T @ x[train & (y == c)]) for c in (0, 1)}
    good = [d for d, s in zip(docs, quality.fit(moments).score(x), strict=True) if s >= 0.7]
    least = brute_classes(good)
    one = [(k, t) for k, t in good if least[k] == k]
    index = decontaminate.Index(duck.execute("SELECT item_id, text FROM benchmark").fetchall())
    leaked = {m[0] for m in decontaminate.matches(index, pa.array([t for _, t in one]))}
    clean = [d for i, d in enumerate(one) if i not in leaked]
    spans = secrets_scan.scan(pa.array([t for _, t in clean]), secrets_scan.model())
    e, want = Encoder(tokenizer_path("word_bpe_49k.json")), {}
    for i, (k, t) in enumerate(clean):
        out, at = "", 0
        for s, _, stop in spans.get(i, []):
            if s >= at:
                out += t[at:s] + "[secret]"
            at = max(at, stop)
        ids = np.asarray([*e.plain([out + t[at:]])[0], 0], "<u4")
        want |= {(k, p): zlib.crc32(ids[p * 2048 : (p + 1) * 2048]) for p in range(-(-len(ids) // 2048))}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {(r["doc_id"], r["piece"]): r["ids_crc32"] for r in got} == want
