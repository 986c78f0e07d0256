"""Benchmark decontamination by SimHash over item-sized windows.

Every benchmark item gives a weighted vector of word shingles and its SimHash of ``BITS`` bits. A document is read in windows
of the item's own number of words, one for each start; a window's SimHash is compared with the items of its size through a
multi-index. The fingerprint is cut into ``BLOCKS`` blocks of 16 bits; of two fingerprints within ``RADIUS`` bits, at
least one block differs in two bits or fewer (``BLOCKS`` blocks of three would make ``RADIUS + 1``). So the index holds every
block of an item with none or one of its bits flipped, and a window asks for its own blocks with none or one flipped:
the two meet for every pair within the radius. A pair of random fingerprints meets in 3.3 % of cases, all else is pruned.
Candidates within the radius are verified by their exact weighted shingle similarity (weighted Jaccard), of ``THRESHOLD``
or more.

Windows that share no shingle with an item of their size have similarity 0 to all of them, and are not fingerprinted:
a lossless step, as every verified pair shares shingles. Two windows without repeated shingles and a weighted Jaccard
similarity of 0.8 have a cosine of 0.889, so 38.8 of 256 bits differ on average, with a deviation of 5.7; 93 % of such pairs lie
within ``RADIUS``, of 0.85 more than 99 %. A document is lost only if all of its windows that are similar enough are.

Items go to the executors in blocks of ``ITEMS``, so that no more than one block is held at a time, however long the
benchmark is. Texts are read whole and nothing is shuffled but the matches.

Null and empty texts have no windows; items without words match nothing. Shorter items than five words have one shingle.
Null ids stay null in the result. Repeated rows give repeated results. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, shingles, slices, text_bytes, words

SHINGLE, THRESHOLD, RADIUS, ITEMS = 5, 0.8, 47, 20_000
BITS, BLOCKS = 256, 16
#: None or one of a block's 16 bits.
FLIPS = np.asarray([0, *(1 << i for i in range(16))], np.uint16)
#: Windows that are fingerprinted at once.
WINDOWS = 4096


def bit_rows(h: np.ndarray) -> np.ndarray:
    """The ``BITS`` bits that follow from each hash, as -1 and 1."""
    wide = np.stack([mix(h + np.uint64(0x9E3779B97F4A7C15 * k & 0xFFFFFFFFFFFFFFFF)) for k in range(BITS // 64)], axis=1)
    return np.unpackbits(wide.astype("<u8").view(np.uint8).reshape(-1, BITS // 8), axis=1, bitorder="little").astype(np.int8) * 2 - 1


def fingerprint(votes: np.ndarray) -> np.ndarray:
    """Rows of votes to fingerprints, as blocks of 16 bits."""
    return np.packbits(votes > 0, axis=1, bitorder="little").reshape(-1, BITS // 8).copy().view("<u2")


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two multisets of hashes: the sum of the lesser counts over the sum of the greater."""
    x, m = np.unique(a, return_counts=True)
    y, n = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    low = np.minimum(m[i], n[j]).sum()
    return float(low / (len(a) + len(b) - low)) if len(a) + len(b) else 0.0


class Index:
    """Items of one block, by their number of words."""

    def __init__(self, items: list[tuple[int | None, str | None]], radius: int = RADIUS):
        if radius >= 3 * BLOCKS:
            raise ValueError(f"blocks of two flips find a radius below {3 * BLOCKS} only")
        self.radius = radius
        texts = pa.array([t for _, t in items], pa.string())
        h, _, doc = words(*text_bytes(texts)) if len(items) else (np.zeros(0, np.uint64), None, np.zeros(0, np.int64))
        s, d, _ = shingles(h, doc, len(items), SHINGLE)
        n_words = np.bincount(doc, minlength=len(items))
        at = np.searchsorted(d, np.arange(len(items) + 1))
        self.ids = [i for i, _ in items]
        self.vectors = [s[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        self.prints = fingerprint(np.asarray([bit_rows(v).sum(axis=0, dtype=np.int32) for v in self.vectors], np.int32).reshape(-1, BITS))
        self.sizes: dict[int, tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]] = {}
        for size in np.unique(n_words[n_words > 0]).tolist():
            which = np.flatnonzero(n_words == size)
            tables = []
            for block in range(BLOCKS):
                value = (self.prints[which, block][:, None] ^ FLIPS[None, :]).reshape(-1)
                order = np.argsort(value, kind="stable")
                tables.append((value[order], (order // len(FLIPS)).astype(np.int32)))
            self.sizes[size] = (which, np.unique(np.concatenate([self.vectors[i] for i in which])), tables)
        self.all = np.unique(s)

    def candidates(self, size: int, prints: np.ndarray) -> np.ndarray:
        """Pairs (window * items of the size + item) that the blocks let through."""
        which, _, tables = self.sizes[size]
        found = []
        for block, (values, item) in enumerate(tables):
            asked = (prints[:, block][:, None] ^ FLIPS[None, :]).reshape(-1)
            lo, hi = np.searchsorted(values, asked, side="left"), np.searchsorted(values, asked, side="right")
            hit = np.flatnonzero(hi > lo)
            n = hi[hit] - lo[hit]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[hit], n)
            found.append(np.repeat(hit // len(FLIPS), n) * len(which) + item[at])
        return np.unique(np.concatenate(found))

    def near(self, size: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within the radius: exactly these."""
        which = self.sizes[size][0]
        pair = self.candidates(size, prints)
        window, item = pair // len(which), which[pair % len(which)]
        ok = hamming(prints[window], self.prints[item]) <= self.radius
        return window[ok], item[ok]


def matches(index: Index, texts: pa.Array) -> list[tuple[int, int, int, int, float]]:
    """(row, item, first word, words, similarity) of each row and item with a verified window: the best, then the first."""
    data, starts = text_bytes(texts)
    if not len(data) or not len(index.all):
        return []
    h, _, doc = words(data, starts)
    n_docs = len(texts)
    s, d, first = shingles(h, doc, n_docs, SHINGLE)
    known = index.all[np.minimum(np.searchsorted(index.all, s), len(index.all) - 1)] == s
    rows = np.unique(d[known])
    bounds, begin = np.searchsorted(d, np.arange(n_docs + 1)), np.searchsorted(doc, np.arange(n_docs + 1))
    out = []
    for row in rows.tolist():
        own = s[bounds[row] : bounds[row + 1]]
        hit = np.flatnonzero(known[bounds[row] : bounds[row + 1]])
        n_words = int(begin[row + 1] - begin[row])
        for size, (_, shared, _) in index.sizes.items():
            at = np.searchsorted(shared, own[hit])
            mine = hit[shared[np.minimum(at, len(shared) - 1)] == own[hit]]
            if not len(mine):
                continue
            width = max(1, size - SHINGLE + 1)  # shingles of a window
            if size < SHINGLE:  # one shingle of all words: only a document as short has the like
                where = np.asarray([0] if n_words == size else [], np.int64)
            else:
                last = max(0, n_words - size)
                where = np.unique((mine[:, None] - np.arange(width)[None, :]).reshape(-1))
                where = np.unique(np.clip(where, 0, last))
            best: dict[int, tuple] = {}
            # windows that stand together, so that no table spans the words between two far hits
            cuts = np.flatnonzero(np.diff(where) > width) + 1
            parts = [p[i : i + WINDOWS] for p in np.split(where, cuts) for i in range(0, len(p), WINDOWS)]
            for part in parts:
                for m in _windows(index, row, size, part, own, width, n_words):
                    if m[1] not in best or (m[4], -m[2]) > (best[m[1]][4], -best[m[1]][2]):
                        best[m[1]] = m
            out += best.values()
    return out


def _windows(index: Index, row: int, size: int, where: np.ndarray, own: np.ndarray, width: int, n_words: int) -> list[tuple[int, int, int, int, float]]:
    if not len(where):
        return []
    lo, hi = int(where[0]), min(int(where[-1]) + width, len(own))
    total = np.zeros((hi - lo + 1, BITS), np.int32)
    np.cumsum(bit_rows(own[lo:hi]), axis=0, out=total[1:])
    stop = np.minimum(where + width, len(own))
    window, item = index.near(size, fingerprint(total[stop - lo] - total[where - lo]))
    best: dict[int, tuple[float, int]] = {}
    for w, i in zip(window.tolist(), item.tolist(), strict=True):
        similarity = weighted_jaccard(own[where[w] : stop[w]], index.vectors[i])
        if similarity >= THRESHOLD - 1e-12:
            best[i] = max(best.get(i, (0.0, 0)), (similarity, -int(where[w])))
    return [(row, i, -at, min(size, n_words), s) for i, (s, at) in best.items()]


def _blocks(spark: SparkSession, items: DataFrame) -> list:
    """The items in blocks that are sent to the executors one after another."""
    count = items.count()
    n = max(1, -(-count // ITEMS))
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    if n == 1:
        return [rows]
    at = rows.withColumn("_block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    return [at.where(F.col("_block") == b).drop("_block") for b in range(n)]


def leaks(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, first_word, n_words, similarity: each document and item that match, with the best window."""
    out = None
    for block in _blocks(spark, items):
        index = spark.sparkContext.broadcast(Index([(r["item_id"], r["text"]) for r in block.collect()]))

        def task(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch):
                    if got := matches(index.value, part.column("text")):
                        row, item, first, n, s = map(list, zip(*got, strict=True))
                        yield pa.RecordBatch.from_arrays(
                            [part.column("doc_id").take(pa.array(row)), pa.array([index.value.ids[i] for i in item], pa.int64()), pa.array(first, pa.int64()), pa.array(n, pa.int64()), pa.array(s)],
                            names=["doc_id", "item_id", "first_word", "n_words", "similarity"],
                        )

        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, item_id long, first_word long, n_words long, similarity double")
        out = found if out is None else out.union(found)
    return out


def keep_clean(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents, with all their columns, that hold no benchmark item. One pass a block of items, without a shuffle."""
    for block in _blocks(spark, items):
        index = spark.sparkContext.broadcast(Index([(r["item_id"], r["text"]) for r in block.collect()]))

        def task(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch):
                    keep = np.ones(part.num_rows, bool)
                    keep[[m[0] for m in matches(index.value, part.column("text"))]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(task, docs.schema)
    return docs
