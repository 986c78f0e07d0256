"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that the numpy kernels take at once: bounds their temporary arrays to some tens of MB.
SLICE_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders made for intermediate tables, in order.
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder, which driver and executors share.

    The cluster names the folder in ``spark.checkpoint.dir``. Only a local session without one (tests) gets a temporary
    folder; on a cluster, where executors would not see it, a missing setting is an error.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.gettempdir() + "/litgraph-checkpoints"
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(base)
    _MADE.append(f"{base.rstrip('/')}/{uuid.uuid4().hex}")
    return _MADE[-1]


def made() -> int:
    """How many folders shared_dir has given out."""
    return len(_MADE)


def release(spark: SparkSession, since: int = 0, until: int | None = None) -> None:
    """Deletes the folders given out from one count of made() to another; whatever reads them must be done."""
    for folder in _MADE[since:until]:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _MADE[since:until] = []


def stored(df: DataFrame, folder: str) -> DataFrame:
    """Write as Parquet in a shared folder and read back; columns can then be pruned, unlike in a checkpoint."""
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


#: Rows up to which a written table may be broadcast in a join, after it is counted.
MOST_BROADCAST = 200_000


def small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """Marks a written table for broadcast if it has few rows; a larger one is joined by a shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def local_path(uri: str) -> tuple[object, str]:
    """The pyarrow file system and path of a URI (file, hdfs, s3, gs or a plain path)."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri if "://" in uri else os.path.abspath(uri))


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each; a longer text stands alone, whole. After the last, what the batch's
    temporary arrays took goes back to the system."""
    lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
    ends = np.cumsum(lengths)
    at, n = 0, batch.num_rows
    while at < n:
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop
    trim()


def trim() -> None:
    """Gives the freed memory that the allocators of numpy and pyarrow keep back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string array, and where each text starts (one more than rows). Null: empty."""
    if column.null_count:
        column = pa.compute.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    starts = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[starts[0] : starts[-1]] if column.buffers()[2] else np.zeros(0, np.uint8)
    return data, starts - starts[0]


# --- hashing of words and word shingles, all vectorised ---------------------------------------------

#: Keep the first 0 to 8 bytes of a little-endian number.
_HEAD = np.asarray([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64 bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(data: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes (none is empty): the mixed sum of its mixed eight-byte pieces and their places.

    No polynomial: periodic bytes, such as Thue-Morse words, do not cancel out.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))  # the eight bytes from each place on
    size = end - at
    total = mix((eight[at] & _HEAD[np.minimum(size, 8)]) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    longer = np.flatnonzero(size > 8)
    if len(longer):
        more = (size[longer] - 1) >> 3
        own = np.repeat(longer, more)
        k = np.arange(len(own)) - np.repeat(np.cumsum(more) - more, more) + 1
        piece = at[own] + 8 * k
        value = mix(mix((eight[piece] & _HEAD[np.minimum(end[own] - piece, 8)]) + np.uint64(0x632BE59BD9B4E019)) + k.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        np.add.at(total, own, value)
    return mix(total)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and document of each word: a run of ASCII letters (either case), digits and non-ASCII bytes."""
    inside = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1 : len(data)]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1 : len(data)]
    at, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(at):
        return np.zeros(0, np.uint64), at, at
    h = span_hashes(_LOWER[data], at, end)
    return h, at, np.searchsorted(starts, at, side="right") - 1


def shingles(h: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document and first word of each run of k words; a shorter document has one, of all its words."""
    n = len(h)
    a = np.uint64(0xD6E8FEB86659FD93)
    if n >= k:
        s = h[: n - k + 1].copy()
        for j in range(1, k):
            s *= a
            s += h[j : n - k + 1 + j]
        ok = doc[: n - k + 1] == doc[k - 1 :]
        s, d, at = mix(s[ok]), doc[: n - k + 1][ok], np.flatnonzero(ok)
    else:
        s, d, at = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    count = np.bincount(doc, minlength=n_docs) if n else np.zeros(n_docs, np.int64)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        begin = np.concatenate([[0], np.cumsum(count)])
        extra = np.zeros(len(short), np.uint64)
        for x, i in enumerate(short):
            v = 0
            for w in h[begin[i] : begin[i + 1]].tolist():
                v = (v * int(a) + w) & 0xFFFFFFFFFFFFFFFF
            extra[x] = v
        s, d, at = np.concatenate([s, mix(extra + np.uint64(1))]), np.concatenate([d, short]), np.concatenate([at, begin[short]])
        order = np.argsort(d, kind="stable")
        s, d, at = s[order], d[order], at[order]
    return s, d, at


def unused(schema, *names: str) -> list[str]:
    """The names, each made longer until no column of the schema has it, in either case."""
    taken, out = {c.lower() for c in schema.names}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
