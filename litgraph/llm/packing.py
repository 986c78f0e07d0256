"""Best-fit packing planned over the histogram of lengths.

Tokens are counted once; a histogram of piece lengths (at most ``limit`` numbers, whatever the corpus) goes to the
driver, which runs best-fit decreasing over counts: a group of equally full sequences takes a run of equal pieces at a
time. The plan is a list of runs; each piece then finds its slot by joining on its length and its rank among pieces of
that length. Ranks come from local ranks within a task and offsets over (task, length) counts, so that no length, however
common, gathers in one task.

A null text is empty and gives the end id alone. Null and repeated doc_ids are kept: each row is packed. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, slices, stored
from .tokens import encoder

LIMIT = 2048


def plan(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: runs of (length, first rank, pieces, first sequence, pieces a sequence, offset).

    Piece first_rank + i of that length goes to sequence first_sequence + i // a_sequence, at offset
    + (i % a_sequence) * length. Best fit puts a piece into the fullest sequence with room, again and again into the
    same one while it still fits, so a group of equally full sequences takes floor(room / length) each. Every length
    splits at most one group, so there are at most 3 * limit groups and limit * 3 * limit runs, for any corpus.
    """
    groups: dict[int, list[tuple[int, int]]] = {}  # room: [(first sequence, sequences)]
    rooms: list[int] = []  # sorted, of groups with sequences
    runs, sequences = [], 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in groups:
                groups[room] = []
                bisect.insort(rooms, room)
            groups[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = limit // length
                room, first, n = limit, sequences, -(-left // each)
                sequences += n
            else:
                room = rooms[at]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
                each = room // length
            take = min(left, n * each)
            full, rest = divmod(take, each)
            runs.append((length, rank, take, first, each, limit - room))
            put(room - each * length, first, full)
            if rest:
                put(room - rest * length, first + full, 1)
            put(room, first + full + bool(rest), n - full - bool(rest))
            left, rank = left - take, rank + take
    return runs


def pieces(docs: DataFrame, tokenizer: str, end_id: int, limit: int = LIMIT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, task, task_rank (the piece's rank among those of its length in its task)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, seen = TaskContext.get().partitionId(), np.zeros(limit + 1, np.int64)
        for batch in batches:
            for part in slices(batch):
                ids, bounds = encoder(tokenizer).encode(part.column("text"))
                all_ids = np.insert(ids, bounds[1:], end_id).astype("<u4")
                sizes = np.diff(bounds) + 1
                base = np.cumsum(sizes) - sizes
                n = -(-sizes // limit)
                doc = np.repeat(np.arange(len(sizes)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * limit
                length = np.minimum(sizes[doc] - start, limit)
                order = np.argsort(length, kind="stable")
                ranked = length[order]
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order)) - np.searchsorted(ranked, ranked) + seen[ranked]
                seen += np.bincount(length, minlength=limit + 1)
                first = base[doc] + start
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(doc)),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array([zlib.crc32(all_ids[a:b]) for a, b in zip(first.tolist(), (first + length).tolist(), strict=True)], pa.int64()),
                        pa.array(np.full(len(doc), here), pa.int32()),
                        pa.array(rank, pa.int64()),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "task_rank"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        task, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, task_rank long"
    )


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 0, limit: int = LIMIT) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = stored(pieces(docs, tokenizer, end_id, limit), f"{shared_dir(spark)}/pieces")
    by_task = stored(cut.groupBy("task", "length").agg(F.count("*").alias("n")), f"{shared_dir(spark)}/counts")
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``limit`` rows
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    offsets = by_task.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = cut.join(offsets, ["task", "length"]).withColumn("rank", F.col("before") + F.col("task_rank"))
    runs: dict[int, list] = {}
    for length, *run in plan(histogram, limit):
        runs.setdefault(length, []).append(tuple(run))
    one_run = "struct<rank:bigint,n:bigint,first:bigint,each:bigint,place:bigint>"
    plans = spark.createDataFrame([(k, v) for k, v in runs.items()], f"length long, runs array<{one_run}>")
    run = F.element_at(F.filter("runs", lambda r: (r["rank"] <= F.col("rank")) & (F.col("rank") < r["rank"] + r["n"])), 1)
    placed = ranked.join(F.broadcast(plans), "length").withColumn("run", run)  # the plan's size is bounded by ``limit``
    i = F.col("rank") - F.col("run.rank")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("run.first") + (i / F.col("run.each")).cast("long")).alias("sequence_id"),
        (F.col("run.place") + i % F.col("run.each") * F.col("length")).alias("offset"),
    )
