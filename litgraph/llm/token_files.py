"""Token-id output: documents in ascending order of id, as files of bit-packed ids in a shared folder.

One range shuffle sorts the texts; each task encodes its range and writes one file (to a name of its own, then
renamed, so that a task that runs again does no harm). A manifest of one row a file gives every file its first id.

Null text: empty, so the end id alone. Null doc_id: first. Rows that share a doc_id stand in the order of a hash of their texts,
and are dealt over several files if there are many. An empty table gives no documents. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import local_path, shared_dir, slices, stored
from .idfile import Reader, Writer
from .tokens import encoder

#: Ids that a reader unpacks at once.
CHUNK = 1 << 20


def write_ids(docs: DataFrame, folder: str, tokenizer: str, vocabulary: int, end_id: int) -> DataFrame:
    """Writes the files; returns the manifest: file, n_docs, n_ids, first_id (ids in all files before)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard, out = context.partitionId(), Writer(vocabulary)
        for batch in batches:
            for part in slices(batch):
                ids, bounds = encoder(tokenizer).encode(part.column("text"))
                sizes = np.diff(bounds)
                all_ids = np.insert(ids, bounds[1:], end_id)
                out.add(part.column("doc_id").to_pylist(), all_ids, sizes + 1)
        if not out.docs:
            return
        fs, path = local_path(folder)
        fs.create_dir(path, recursive=True)
        name = f"{path}/ids-{shard:06d}.bin"
        with fs.open_output_stream(f"{name}.{context.taskAttemptId()}") as f:
            out.write(f)
        fs.move(f"{name}.{context.taskAttemptId()}", name)
        yield pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [len(out.docs)], "n_ids": [out.starts[-1]]}, schema=pa.schema([("shard", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    text = F.col("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, F.xxhash64(text).alias("mark"), F.monotonically_increasing_id().alias("row"))
    ordered = rows.repartitionByRange("doc_id", "mark", "row").sortWithinPartitions("doc_id", "mark", "row").select("doc_id", "text")
    manifest = stored(ordered.mapInArrow(task, "shard int, n_docs long, n_ids long"), f"{folder}-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return manifest.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_ids(manifest: DataFrame, folder: str) -> DataFrame:
    """One row a document, from the files: doc_id, start, n_tokens, ids_crc32, shard, row (its place in the file)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = local_path(folder)
        for batch in batches:
            for shard, first_id in zip(batch.column("shard").to_pylist(), batch.column("first_id").to_pylist(), strict=True):
                with fs.open_input_file(f"{path}/ids-{shard:06d}.bin") as f:
                    file = Reader(f)
                    at = 0
                    while at < file.n_docs:
                        stop = max(at + 1, int(np.searchsorted(file.starts, file.starts[at] + CHUNK, side="right")) - 1)
                        base = file.starts[at]
                        ids = file.ids(int(base), int(file.starts[stop])).astype("<u4")
                        bounds = file.starts[at : stop + 1] - base
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(file.doc_ids[at:stop], pa.int64(), mask=file.nulls[at:stop]),
                                pa.array(first_id + file.starts[at:stop], pa.int64()),
                                pa.array(np.diff(bounds), pa.int64()),
                                pa.array([zlib.crc32(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.int64()),
                                pa.array(np.full(stop - at, shard), pa.int32()),
                                pa.array(np.arange(at, stop), pa.int64()),
                            ],
                            names=["doc_id", "start", "n_tokens", "ids_crc32", "shard", "row"],
                        )
                        at = stop

    spark = manifest.sparkSession
    files = manifest.select("shard", "first_id").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard")
    return files.mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, row long")


def token_files(spark: SparkSession, docs: DataFrame, tokenizer: str, vocabulary: int = 50257, end_id: int = 2, folder: str | None = None) -> DataFrame:
    folder = folder or f"{shared_dir(spark)}/ids"
    return read_ids(write_ids(docs, folder, tokenizer, vocabulary, end_id), folder)
