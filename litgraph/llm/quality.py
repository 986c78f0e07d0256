"""Quality scores by a regularised quadratic discriminant over transformed document statistics.

Each whole text gives ``FEATURES`` statistics, transformed to be near to symmetric. Counts, sums and products of these
over all labelled training rows (one aggregation with map-side partial sums; a few numbers reach the driver, whatever
the corpus) give each class a mean and a covariance, which is shrunk towards the pooled covariance and towards a
multiple of the identity. Scores are the logistic of the difference of log-densities, whose Mahalanobis terms use the
Cholesky factors computed once. Labels, lang, source and doc_id are not inputs.

Null and empty texts have the statistics of no words, and so a score. With fewer than two rows of a class to learn from,
every score is 1. Labels that are null are ignored; of several labels of one id the least counts. Repeated rows each get
a row. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, slices, stored, text_bytes, words

FEATURES = ("words", "word_length", "symbols", "marks", "exclaims", "capitals", "digits", "doubled", "distinct", "spread")
#: Shrinkage towards the pooled covariance, towards the identity, and the floor of a variance.
POOLED, ROUND, FLOOR = 0.1, 0.05, 1e-3
THRESHOLD = 0.7


def _flags(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_SPACE, _SYMBOL, _MARK, _EXCLAIM, _DIGIT = map(_flags, (" \t\n\x0b\x0c\r", "#*$%&|<>=~^_\\{}[]@+", ".,;:'\"?-()/", "!", "0123456789"))
_UPPER, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def features(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One row of transformed statistics a text."""
    n = len(starts) - 1

    def per(flag: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flag) + 1, np.int64)
        np.cumsum(flag, out=total[1:])
        return (total[starts[1:]] - total[starts[:-1]]).astype(float)

    space = _SPACE[data]
    first = ~space
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    first[1:] &= space[:-1] | edge[1 : len(data)]
    n_words, solid = per(first), per(~space)
    h, _, doc = words(data, starts)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    letters = np.bincount(doc, minlength=n).astype(float)
    doubled = np.bincount(doc, weights=same, minlength=n)
    distinct = np.zeros(n)
    step = 4096  # twelve bits of the key hold the text
    bounds = np.searchsorted(doc, np.arange(0, n + step, step))
    for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        key = np.sort(((doc[a:b] - k * step).astype(np.uint64) << np.uint64(52)) | (h[a:b] >> np.uint64(12)))
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        distinct[k * step : (k + 1) * step] = np.bincount((key[new] >> np.uint64(52)).astype(np.int64), minlength=min(step, n - k * step))[: n - k * step]
    length = (solid + 100) / (n_words + 20)
    upper, letter = per(_UPPER[data]), per(_LETTER[data])

    def share(part: np.ndarray, whole: np.ndarray, prior: float, weight: float = 30.0) -> np.ndarray:
        """Arcsine of the root of a share that few observations hardly move from its prior."""
        return np.arcsin(np.sqrt(np.clip((part + prior * weight) / (whole + weight), 0, 1)))

    return np.column_stack(
        [
            np.log(n_words + 20),
            np.log1p(length),
            np.log((per(_SYMBOL[data]) + 0.5) / (n_words + 50)),
            share(per(_MARK[data]), solid, 0.03),
            np.log((per(_EXCLAIM[data]) + 0.5) / (n_words + 50)),
            share(upper, letter, 0.03),
            share(per(_DIGIT[data]), solid, 0.01),
            share(doubled, letters, 0.01),
            # distinct words against what Heaps' law leads to expect
            np.log((distinct + 20) / ((letters + 20) ** 0.85)),
            share(per(data == 10), n_words, 0.05),
        ]
    )


@dataclass
class Discriminant:
    means: list[np.ndarray]
    factors: list[np.ndarray]
    logs: list[float]  # log prior - half the log determinant

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.ones(len(x))
        half = []
        for mean, factor, log in zip(self.means, self.factors, self.logs, strict=True):
            z = (x - mean) @ factor.T  # the inverse factor: a product in place of a solve
            half.append(log - 0.5 * (z * z).sum(axis=1))
        return 1 / (1 + np.exp(np.clip(half[0] - half[1], -500, 500)))


def fit(moments: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> Discriminant:
    """From count, sums and sums of products of classes 0 and 1."""
    if any(moments.get(c, (0,))[0] < 2 for c in (0, 1)):
        return Discriminant([], [], [])
    means = {c: s / n for c, (n, s, _) in moments.items()}
    scatter = {c: p - np.outer(s, s) / n for c, (n, s, p) in moments.items()}
    total = sum(n for n, _, _ in moments.values())
    pooled = (scatter[0] + scatter[1]) / total
    out = Discriminant([], [], [])
    for c in (0, 1):
        n = moments[c][0]
        own = (1 - POOLED) * scatter[c] / n + POOLED * pooled
        own = (1 - ROUND) * own + ROUND * np.diag(np.diag(own)) + FLOOR * np.eye(len(own))
        low = np.linalg.cholesky(own)
        out.means.append(means[c])
        out.factors.append(np.linalg.inv(low))
        out.logs.append(float(np.log(n / total) - np.log(np.diag(low)).sum()))
    return out


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep``, and the features of text as f0, f1, ..."""
    kept = docs.select(*keep, F.col("text").alias("_text"))
    names = [f"f{i}" for i in range(len(FEATURES))]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                x = features(*text_bytes(part.column("_text")))
                yield pa.RecordBatch.from_arrays([part.column(k) for k in keep] + [pa.array(x[:, i]) for i in range(x.shape[1])], names=keep + names)

    schema = ", ".join([f"`{k}` {kept.schema[k].dataType.simpleString()}" for k in keep] + [f"{f} double" for f in names])
    return kept.mapInArrow(task, schema)


def held_out(doc_id: str = "doc_id"):
    """The rows that nothing is learnt from; a null id is learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(stats: DataFrame, labels: DataFrame) -> Discriminant:
    d = len(FEATURES)
    least = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("_label"))
    rows = stats.where(~held_out()).join(least, "doc_id")
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = [F.sum(f"f{i}") for i in range(d)] + [F.sum(F.col(f"f{i}") * F.col(f"f{j}")) for i, j in pairs]
    moments = {}
    for row in rows.groupBy("_label").agg(F.count("*"), *sums).collect():  # two rows
        product = np.zeros((d, d))
        for (i, j), v in zip(pairs, row[2 + d :], strict=True):
            product[i, j] = product[j, i] = v
        moments[row[0]] = (float(row[1]), np.asarray(row[2 : 2 + d], float), product)
    return fit(moments)


def scored(stats: DataFrame, model: Discriminant, keep: list[str]) -> DataFrame:
    names = [f"f{i}" for i in range(len(FEATURES))]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([np.asarray(batch.column(f)) for f in names])
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + [pa.array(model.score(x))], names=[*keep, "score"])

    schema = ", ".join([f"`{k}` {stats.schema[k].dataType.simpleString()}" for k in keep] + ["score double"])
    return stats.mapInArrow(task, schema)


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    stats = stored(statistics(docs, ["doc_id"]), f"{shared_dir(spark)}/statistics")
    out = scored(stats, learn(stats, labels), ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that score the threshold or more. Texts are read twice and not shuffled."""
    model = learn(stored(statistics(docs, ["doc_id"]), f"{shared_dir(spark)}/statistics"), labels)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(model.score(features(*text_bytes(part.column("text")))) >= threshold))

    return docs.mapInArrow(task, docs.schema)
