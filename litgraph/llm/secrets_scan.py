"""Secret scans: fixed patterns, and a network over every other long token.

Patterns (leftmost, non-overlapping for each kind): assignments to a password, secret, token or key with a value of six
or more characters; access keys of 20 or more; runs of 24 or more lower-case hexadecimal digits. What these spans leave of
each run of characters of ``[A-Za-z0-9+/_.=-]``, in parts of ``LEAST`` characters or more, is a candidate: the network of
``secrets_cnn`` scores it with its surroundings (a long one in successive parts, of which the highest counts), and adds a span
of kind ``cnn`` from the calibrated threshold up. One pass over the texts, nothing is shuffled.

Null text: empty, without spans. Positions count code points, ends are exclusive. Repeated rows get a row each; null ids
stay null. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, text_bytes
from .secrets_cnn import BODY, Network, codes, model

#: The patterns of the contract; letters of the keywords in either case.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
KINDS = ("assign", "access", "hex", "cnn")
LEAST = 16
_ALPHABET = np.zeros(256, bool)
_ALPHABET[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_.=-"]] = True

Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str, runs: list[tuple[int, int]], assigned: bool) -> list[Span]:
    """Spans of the patterns. runs: where 16 or more characters of the alphabet stand; keys and digits lie within."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6] if assigned else []
    for a, b in runs:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text, a, b) if m.end() - m.start() >= 20]
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text, a, b) if m.end() - m.start() >= 24]
    return sorted(out)


def left_of(a: int, b: int, spans: list[Span]) -> list[tuple[int, int]]:
    """The parts of a to b outside the spans (sorted by start)."""
    out = []
    for s, _, e in spans:
        if s >= b:
            break
        if e > a:
            if s > a:
                out.append((a, s))
            a = min(e, b)
    return [*out, (a, b)] if a < b else out


def scan(column: pa.Array, network: Network) -> dict[int, list[Span]]:
    """Row to its spans, of all kinds, for rows that have any."""
    data, starts = text_bytes(column)
    if not len(data):
        return {}
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    inside = _ALPHABET[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1 : len(data)]
    last[:-1] &= ~inside[1:] | edge[1 : len(data)]
    at, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    long_ = end - at >= LEAST
    at, end = at[long_], end[long_]
    row = np.searchsorted(starts, at, side="right") - 1
    lower = data.tobytes().lower()
    named: set[int] = set()
    for k in KEYWORDS:
        i = lower.find(k)
        while i >= 0:
            named.add(int(np.searchsorted(starts, i, side="right")) - 1)
            i = lower.find(k, i + 1)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    begin = np.searchsorted(row, np.arange(len(column) + 1))
    spans: dict[int, list[Span]] = {}
    free: list[tuple[int, int, int]] = []  # row, first byte, end
    for r in sorted(set(row.tolist()) | named):
        mine = range(begin[r], begin[r + 1])
        zero = points[starts[r]]
        runs = [(int(points[at[i]] - zero), int(points[end[i]] - zero)) for i in mine]
        own = base_spans(column[r].as_py(), runs, r in named)
        if own:
            spans[r] = own
        for i, (a, b) in zip(mine, runs, strict=True):
            free += [(r, int(at[i]) + x - a, int(at[i]) + y - a) for x, y in left_of(a, b, own) if y - x >= LEAST]  # a run is ASCII
    if free:
        text, a, b = np.asarray(free, np.int64).T
        parts = -(-(b - a) // BODY)
        which = np.repeat(np.arange(len(free)), parts)
        offset = (np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)) * BODY
        score = np.zeros(len(free))
        for i in range(0, len(which), 8192):
            w = which[i : i + 8192]
            np.maximum.at(score, w, network.score(codes(data, a[w] + offset[i : i + 8192], b[w], starts[text[w]], starts[text[w] + 1])))
        for i in np.flatnonzero(score >= network.threshold).tolist():
            zero = points[starts[text[i]]]
            spans.setdefault(int(text[i]), []).append((int(points[a[i]] - zero), 3, int(points[b[i]] - zero)))
    return {r: sorted(s) for r, s in spans.items()}


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def secrets(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_cnn."""
    network = spark.sparkContext.broadcast(model())
    empty = hashlib.sha256(b"").hexdigest()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                n = part.num_rows
                counts, base, all_ = np.zeros((4, n), np.int64), [empty] * n, [""] * n
                for r, spans in scan(part.column("text"), network.value).items():
                    for _, k, _ in spans:
                        counts[k, r] += 1
                    base[r] = hashlib.sha256(written([s for s in spans if s[1] < 3]).encode()).hexdigest()
                    all_[r] = written(spans)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(counts[k]) for k in range(3)], pa.array(base), pa.array(all_, pa.string()), pa.array(counts[3])], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_cnn"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_cnn long")


def mask(spark: SparkSession, docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The documents with each secret replaced by ``mark``; n_chars, where there is one, follows."""
    network = spark.sparkContext.broadcast(model())
    schema = docs.schema

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = scan(part.column("text"), network.value)
                if found:
                    texts = part.column("text").to_pylist()
                    sizes = part.column("n_chars").to_pylist() if "n_chars" in part.schema.names else None
                    for r, spans in found.items():
                        out, at = [], 0
                        for s, _, e in spans:
                            if s >= at:
                                out += [texts[r][at:s], mark]
                            at = max(at, e)
                        texts[r] = "".join([*out, texts[r][at:]])
                        if sizes:
                            sizes[r] = len(texts[r])
                    columns = {"text": pa.array(texts, part.schema.field("text").type)} | ({"n_chars": pa.array(sizes, part.schema.field("n_chars").type)} if sizes else {})
                    part = pa.RecordBatch.from_arrays([columns.get(c, part.column(c)) for c in part.schema.names], names=part.schema.names)
                yield part

    return docs.mapInArrow(task, schema)
