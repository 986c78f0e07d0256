"""Near duplicates by ProbMinHash over weighted word shingles, banding and exact verification.

Every distinct text becomes a vector of five-word shingles weighted by their counts. Each shingle is a Poisson process
whose rate is its weight; its arrivals fall on random registers of the signature, and a register keeps the shingle that
came first. Arrivals are drawn in rounds, and a shingle stops once its last arrival is later than every register's first:
two registers then agree with probability equal to the probability Jaccard similarity of the texts. Texts that share a
band of registers are candidates; the similarity of a candidate pair is then computed exactly, and pairs of
``THRESHOLD`` or more are links. Classes are the connected components of the links, and equal texts.

At ``BANDS`` bands of ``ROWS`` registers, a pair of similarity 0.8 is a candidate with probability 0.9996, of 0.9 with
more than 1 - 1e-7. No bucket is ever expanded into all its pairs. First every member meets its bucket's pivot, which joins
most members of a group; buckets whose members are all in one class are done. In every other bucket the members are
compared in blocks of bounded size, all with all: two matrix products bound the similarity of all pairs of two
blocks, and pairs of different classes that the bound lets through are verified. Buckets with the same members are compared
once, and where buckets overlap so much that it is less work, the union of their members is. So no link between classes is
lost, and no pair becomes a row unless it is a link.

Words are runs of ASCII letters (case ignored), digits and other characters beyond ASCII. Texts of fewer than five words
have one shingle of all; texts without words (and null, which counts as empty) are in a class only with equal texts. Null
and repeated doc_ids are kept, each row gets a row. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, shared_dir, shingles, slices, small, stored, text_bytes, unused, words
from .graph import components

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 5
#: Texts and characters of a block, and columns of the matrices that compare two.
BLOCK, BLOCK_CHARS, COLUMNS = 200, 2_000_000, 4096
#: Bits of the filter that keeps texts without candidates out of the shuffle: 4 MB, whatever the corpus.
FILTER_BITS = 1 << 25


def weighted(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles (52 bits of their hash), their documents and counts."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    bounds = np.searchsorted(doc, np.arange(0, n + 4096, 4096))
    for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        key = np.sort(((doc[a:b] - k * 4096).astype(np.uint64) << np.uint64(52)) | (h[a:b] >> np.uint64(12)))
        if not len(key):
            continue
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.append(first, len(key)))
        key = key[first]
        out.append((key & np.uint64((1 << 52) - 1), (key >> np.uint64(52)).astype(np.int64) + k * 4096, count.astype(float)))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def prob_minhash(element: np.ndarray, doc: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """Signatures of n documents: the elements that came first to each of m registers; zeros where there is no element."""
    first, holder = np.full(n * m, np.inf), np.zeros(n * m, np.uint64)
    time = np.zeros(len(element))
    live, k = np.arange(len(element)), 0
    while len(live):
        k += 1
        r = mix(element[live] + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        time[live] -= np.log(((r >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)) / weight[live]
        slot = doc[live] * m + (mix(r) % np.uint64(m)).astype(np.int64)
        t = time[live]
        better = np.flatnonzero(t < first[slot])
        order = better[np.argsort(-t[better], kind="stable")]  # the earliest is written last
        first[slot[order]], holder[slot[order]] = t[order], element[live[order]]
        last = first.reshape(n, m).max(axis=1)
        live = live[t < last[doc[live]]]
    return holder.reshape(n, m)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exactly: the sum over common elements d of 1 / sum over i of max(x_i / x_d, y_i / y_d)."""
    _, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    x, y = a[1][ia], b[1][ib]
    ratio = x / y
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    # elements of one text only have ratio infinity or zero, and so always add to that text's sum
    above = np.append(np.cumsum(x[::-1])[::-1], 0.0) + (a[1].sum() - x.sum())
    below = np.insert(np.cumsum(y), 0, 0.0) + (b[1].sum() - y.sum())
    at = np.searchsorted(ratio, ratio, side="right")
    return float((1.0 / (above[at] / x + below[at] / y)).sum())


def text_shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, starts = text_bytes(column)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0)
    h, _, doc = words(data, starts)
    s, d, _ = shingles(h, doc, len(column), SHINGLE)
    return weighted(s, d, len(column))


def text_key(text: str | None) -> bytes:
    return hashlib.md5((text or "").encode(), usedforsecurity=False).digest()


def sketch(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, key (of its text) and its bands' hashes; no bands without words."""
    m = BANDS * ROWS

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.arange(BANDS, dtype=np.uint64) << np.uint64(48)
        for batch in batches:
            for part in slices(batch):
                n = part.num_rows
                element, doc, weight = text_shingles(part.column("text"))
                signature = prob_minhash(element, doc, weight, n, m).reshape(n, BANDS, ROWS)
                bucket = np.repeat(salt[None, :], n, axis=0)
                for r in range(ROWS):
                    bucket = mix(bucket * np.uint64(0xD6E8FEB86659FD93) + signature[:, :, r])
                has = np.zeros(n, bool)
                has[doc] = True
                offsets = np.concatenate([[0], np.cumsum(has * BANDS)])
                bands = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(bucket[has].reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([text_key(t) for t in part.column("text").to_pylist()], pa.binary()), bands], names=["doc_id", "key", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, key binary, bands array<long>")


def _filter(keys: DataFrame, bits: int = FILTER_BITS):
    """A Bloom filter of keys as a bounded bitmap; once it is full, everything passes."""
    spots = keys.select(F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(i), "key"), F.lit(bits)) for i in range(3)])).alias("spot"))
    words_ = spots.groupBy((F.col("spot") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(spot % 64 AS INT))")).alias("mask"))
    got = words_.toPandas()  # bits / 64 rows at most
    bitmap = np.zeros(bits // 64, np.uint64)
    bitmap[got["word"].to_numpy()] = got["mask"].to_numpy(np.int64).view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(bitmap)


def candidate_texts(docs: DataFrame, keys: DataFrame, folder: str) -> DataFrame:
    """key and text of the distinct texts that have a candidate."""
    bitmap = _filter(keys)
    spots = [F.pmod(F.xxhash64(F.lit(i), "key"), F.lit(FILTER_BITS)).alias(f"s{i}") for i in range(3)]
    keyed = docs.select(F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("key"), "text").select("key", "text", *spots)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in batches:
            ok = np.ones(batch.num_rows, bool)
            for i in range(3):
                s = np.asarray(batch.column(f"s{i}"))
                ok &= (bits[s >> 6] >> (s & 63).astype(np.uint64)) & np.uint64(1) == 1
            if ok.any():
                yield batch.select(["key", "text"]).filter(pa.array(ok))

    likely = keyed.mapInArrow(task, "key binary, text string")
    return stored(likely.join(small(keys), "key", "left_semi").dropDuplicates(["key"]), f"{folder}/texts")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys that are similar, with their similarity."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_a", 1 << 20):
                x, y = _vectors(part.column("text_a").to_pylist()), _vectors(part.column("text_b").to_pylist())
                s = np.asarray([probability_jaccard(p, q) for p, q in zip(x, y, strict=True)], float)
                out = pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(s)], names=["a", "b", "similarity"])
                yield out.filter(pa.array(s >= THRESHOLD - 1e-12))

    left = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(task, "a binary, b binary, similarity double")


def _first_pairs(members: DataFrame, folder: str) -> DataFrame:
    """Pairs (a, b) of each member and its bucket's pivot: the member of the least hash, the same in many bands."""
    pivots = stored(members.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("key").alias("rank"), "key")).alias("p")).select("bucket", F.col("p.key").alias("pivot")), f"{folder}/pivots")
    met = members.join(small(pivots), "bucket").where("key <> pivot")
    return stored(met.select(F.least("key", "pivot").alias("a"), F.greatest("key", "pivot").alias("b")).distinct(), f"{folder}/pairs")


def bounds(x: list[tuple[np.ndarray, np.ndarray]], y: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """An upper bound of the similarity of each text of x to each of y, exact where all counts are 1.

    With u and v the shares of a pair's weights that the other text lacks, it is (1-u)(1-v) / (1-uv). The shares of all pairs
    are products of two matrices over the shingles that stand in both lists, taken some thousand columns at a time.
    """
    common = np.intersect1d(np.unique(np.concatenate([e for e, _ in x])), np.unique(np.concatenate([e for e, _ in y])), assume_unique=True)
    seen_x, seen_y = np.zeros((len(x), len(y)), np.float32), np.zeros((len(x), len(y)), np.float32)
    for at in range(0, len(common), COLUMNS):
        part = common[at : at + COLUMNS]

        def dense(side: list[tuple[np.ndarray, np.ndarray]], part: np.ndarray = part) -> np.ndarray:
            out = np.zeros((len(side), len(part)), np.float32)
            for r, (e, w) in enumerate(side):
                c = np.searchsorted(part, e)
                ok = c < len(part)
                ok[ok] = part[c[ok]] == e[ok]
                out[r, c[ok]] = w[ok] / w.sum()
            return out

        p, q = dense(x), dense(y)
        seen_x += p @ (q > 0).T.astype(np.float32)
        seen_y += (p > 0).astype(np.float32) @ q.T
    return seen_x * seen_y / np.maximum(1 - (1 - seen_x) * (1 - seen_y), 1e-9)


def block_links(one: list[dict], other: list[dict] | None) -> list[tuple[bytes, bytes, float]]:
    """Links between different classes within a block, or between two, enough to join all classes that links join."""
    x = _vectors([r["text"] for r in one])
    y = x if other is None else _vectors([r["text"] for r in other])
    right = one if other is None else other
    high = bounds(x, y) >= THRESHOLD - 1e-4
    left_label, right_label = [r["label"] for r in one], [r["label"] for r in right]
    parent: dict[bytes, bytes] = {}

    def root(v: bytes) -> bytes:
        while parent.get(v, v) != v:
            v = parent[v]
        return v

    out = []
    for i, j in zip(*map(np.ndarray.tolist, np.nonzero(high)), strict=True):
        if other is None and j <= i:
            continue
        a, b = root(left_label[i]), root(right_label[j])
        if a != b and (s := probability_jaccard(x[i], y[j])) >= THRESHOLD - 1e-12:
            parent[max(a, b)] = min(a, b)
            out.append((one[i]["key"], right[j]["key"], s))
    return out


def _vectors(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    element, doc, weight = text_shingles(pa.array(texts, pa.string()))
    at = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [(element[i:j], weight[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]


def _groups(members: DataFrame, labels: DataFrame, folder: str) -> DataFrame:
    """members, key, label: the sets of texts to compare, all with all, so that every two that share a mixed bucket meet.

    A mixed bucket holds texts of two classes or more. Buckets that overlap are a neighbourhood; the neighbourhood as a whole
    is one set where its blocks make fewer pairs than those of its buckets.
    """
    labelled = stored(members.join(small(labels), "key"), f"{folder}/labelled")
    seen = labelled.groupBy("bucket").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n"), F.sum(F.xxhash64("key") % (1 << 32)).alias("s"), F.bit_xor(F.xxhash64(F.lit(1), "key")).alias("x")
    )
    mixed = stored(seen.where("lo <> hi").groupBy("n", "s", "x").agg(F.min("bucket").alias("bucket"), F.min("lo").alias("lo")).select("bucket", "lo", "n"), f"{folder}/mixed")
    met = stored(labelled.join(small(mixed.select("bucket", "lo")), "bucket").select("bucket", "key", "label", "lo"), f"{folder}/met")
    around = stored(components(met.select(F.col("label").alias("a"), F.col("lo").alias("b")).distinct()).select(F.col("node").alias("lo"), F.col("label").alias("around")), f"{folder}/around")
    pairs = lambda n: F.ceil(n / BLOCK) * (F.ceil(n / BLOCK) + 1)
    by_bucket = mixed.join(small(around), "lo").groupBy("around").agg(F.sum(pairs(F.col("n"))).alias("apart"))
    texts = met.select("key", "lo").distinct().join(small(around), "lo").groupBy("around").agg(F.count_distinct("key").alias("n"))
    whole = stored(texts.join(by_bucket, "around").where(pairs(F.col("n")) <= F.col("apart")).select("around"), f"{folder}/whole")
    placed = stored(met.join(small(around), "lo").join(small(whole.withColumn("together", F.lit(True))), "around", "left"), f"{folder}/placed")
    one = placed.where("together").select(F.xxhash64(F.lit("around"), "around").alias("members"), "key", "label").distinct()
    return one.union(placed.where("together IS NULL").select(F.xxhash64(F.lit("bucket"), "bucket").alias("members"), "key", "label"))


def _rest(members: DataFrame, labels: DataFrame, texts: DataFrame, folder: str) -> DataFrame:
    """Links (a, b) between classes that still meet in a bucket.

    The texts of each set are dealt into blocks of a bounded number and size, and every two blocks are compared in one task: no
    pair becomes a row before it is verified.
    """
    groups = stored(_groups(members, labels, folder), f"{folder}/groups")
    sized = texts.select("key", F.length("text").alias("chars")).join(small(groups), "key")
    sizes = sized.groupBy("members").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("chars") / BLOCK_CHARS)).cast("int").alias("blocks"))
    sizes = stored(sizes, f"{folder}/sizes0")
    dealt = texts.join(small(groups), "key").join(small(sizes), "members").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    lists = stored(dealt.groupBy("members", "block", "blocks").agg(F.collect_list(F.struct("key", "label", "text")).alias("one")), f"{folder}/lists")
    same = lists.select("one", F.lit(None).cast(lists.schema["one"].dataType).alias("other"))
    left = lists.where("blocks > block + 1").select("members", "one", F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)).alias("block"))
    cross = left.join(lists.select("members", "block", F.col("one").alias("other")), ["members", "block"]).select("one", "other")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                got = block_links(batch.column("one")[i].as_py(), batch.column("other")[i].as_py())
                if got:
                    a, b, s = map(list, zip(*got, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(s, pa.float64())], names=["a", "b", "similarity"])

    rows = same.where(F.size("one") > 1).union(cross)
    many = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(rows.repartition(many).mapInArrow(task, "a binary, b binary, similarity double"), f"{folder}/rest")


def _joined(labels: DataFrame, links: DataFrame, to: str) -> DataFrame:
    """Labels after the classes of the links' ends are joined."""
    if not links.limit(1).count():
        return labels
    of = lambda c: small(labels.select(F.col("key").alias(c), F.col("label").alias(f"label_{c}")))
    edges = links.select("a", "b").join(of("a"), "a").join(of("b"), "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))
    merged = components(edges).select(F.col("node").alias("label"), F.col("label").alias("root"))
    return stored(labels.join(small(merged), "label", "left").select("key", F.coalesce("root", "label").alias("label")), to)


def classes(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, str]:
    """Per row: doc_id, key (of its text), label (of its class), all in written tables; and their folder."""
    folder = shared_dir(spark)
    rows = stored(sketch(docs), f"{folder}/rows")
    spread = rows.select(F.explode("bands").alias("bucket"), "key")
    mark = F.xxhash64("key")
    shared = stored(spread.groupBy("bucket").agg(F.min(mark).alias("lo"), F.max(mark).alias("hi")).where("lo <> hi").select("bucket"), f"{folder}/shared")
    members = stored(spread.join(small(shared), "bucket").distinct(), f"{folder}/members")
    labels = stored(members.select("key").distinct().withColumn("label", F.col("key")), f"{folder}/labels")
    texts = candidate_texts(docs, labels.select("key"), folder)
    links = stored(verified(_first_pairs(members, folder), texts), f"{folder}/links")
    labels = _joined(labels, links, f"{folder}/labels1")
    labels = _joined(labels, _rest(members, labels, texts, folder), f"{folder}/labels2")
    out = rows.select("doc_id", "key").join(small(labels), "key", "left").select("doc_id", "key", F.coalesce("label", "key").alias("label"))
    return stored(out, f"{folder}/classes"), folder


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per document: doc_id, class_id (the least doc_id of its class), class_size."""
    rows, folder = classes(spark, docs)
    sizes = stored(rows.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")), f"{folder}/sizes")
    return rows.join(sizes, "label").select("doc_id", "class_id", "class_size")


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One document of each class, with all its columns: that of the least doc_id (null last), then of the least text."""
    rows, folder = classes(spark, docs)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "key")
    best = stored(rows.groupBy("label").agg(F.min(order).alias("best")).select("best.*"), f"{folder}/best")
    names = unused(docs.schema, "no_id", "id_or_0", "text_key")
    own = (F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    kept = docs.withColumns(dict(zip(names, own, strict=True))).join(best.toDF(*names), names, "left_semi")
    # rows that repeat both id and text: one of them
    return kept.dropDuplicates(names).select(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns])
