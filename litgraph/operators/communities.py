"""Communities of projects: each project's similarity graph is made in the project's own task, and no pair of works is a row.

A work's concepts and references go once to each of its projects, packed. There, works that share one are paired in blocks
of bounded size, by sorting and counting, so that pairs below the threshold are dropped before the next block is made.
The result is that of the global similarity graph (``analysis.similarity_graph``) restricted to pairs within a project.
Weights are sums of whole millionths.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import written
from .sequential import louvain

#: Pairs of works that a task holds at once, and works that a task packs at once.
PAIRS, WORKS = 1 << 21, 100_000
_HEAD = struct.Struct("<qBq")


def packed(values: np.ndarray) -> bytes:
    """Integers in as few bytes each as their range takes."""
    low = int(values.min()) if len(values) else 0
    rest = (values.astype(np.int64) - np.int64(low)).view(np.uint64)
    width = -(-int(rest.max()).bit_length() // 8) if len(values) else 0
    return _HEAD.pack(low, width, len(values)) + rest.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(blob: bytes) -> list[np.ndarray]:
    """The arrays whose packed forms stand one after another."""
    out, at = [], 0
    while at < len(blob):
        low, width, n = _HEAD.unpack_from(blob, at)
        at += _HEAD.size
        rest = np.zeros((n, 8), np.uint8)
        rest[:, :width] = np.frombuffer(blob, np.uint8, n * width, at).reshape(n, width)
        out.append(rest.view("<u8").reshape(-1).view(np.int64) + np.int64(low))
        at += n * width
    return out


def _ragged(column: pa.Array, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and values of the lists of some rows. Null: empty."""
    offsets = np.asarray(column.offsets, np.int64)
    size = np.diff(offsets)
    if column.null_count:
        size = np.where(np.asarray(column.is_null()), 0, size)
    first, size = offsets[:-1][rows], size[rows]
    stop = np.cumsum(size)
    at = np.arange(stop[-1] if len(stop) else 0) + np.repeat(first - (stop - size), size)
    return size, np.asarray(column.values)[at]


def _by_project(table: pa.Table) -> pa.RecordBatch:
    """project_id and what its works among these have, packed."""
    work, projects, concepts, references = (table.column(c).combine_chunks() for c in ("work_id", "projects", "concepts", "refs"))
    work = np.asarray(work, np.int64)
    names = projects.flatten().dictionary_encode()
    code = np.asarray(names.indices, np.int64)
    order = np.argsort(code, kind="stable")
    rows = np.repeat(np.arange(len(work)), np.asarray(projects.value_lengths(), np.int64))[order]
    bounds = np.searchsorted(code[order], np.arange(len(names.dictionary) + 1))
    work = work[rows]
    (n_c, c), (n_r, r) = _ragged(concepts, rows), _ragged(references, rows)
    end_c, end_r = (np.concatenate([[0], np.cumsum(n)])[bounds] for n in (n_c, n_r))
    blobs = [
        b"".join(map(packed, (work[i:j], n_c[i:j], c[end_c[k] : end_c[k + 1]], n_r[i:j], r[end_r[k] : end_r[k + 1]])))
        for k, (i, j) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
    ]
    return pa.RecordBatch.from_arrays([names.dictionary, pa.array(blobs, pa.binary())], names=["project_id", "packed"])


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held, n = [*held, batch], n + batch.num_rows
        if n >= WORKS:
            yield _by_project(pa.Table.from_batches(held))
            held, n = [], 0
    if held:
        yield _by_project(pa.Table.from_batches(held))


def shared(owner: np.ndarray, value: np.ndarray, n: int, most: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """i < j and how many values they share, for all pairs of n owners that share one; some ``most`` pairs at a time. No owner has a
    value twice."""
    order = np.lexsort((owner, value))
    owner, value = owner[order], value[order]
    last = np.searchsorted(value, value, side="right")
    after = last - np.arange(len(owner)) - 1  # later owners of the same value
    by_owner = np.flatnonzero(after)
    by_owner = by_owner[np.argsort(owner[by_owner], kind="stable")]
    if not len(by_owner):
        return
    held = owner[by_owner]
    first_of = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
    pairs = np.concatenate([[0], np.cumsum(after[by_owner])])
    begin = np.append(first_of, len(by_owner))
    at = 0
    while at < len(first_of):
        stop = max(at + 1, int(np.searchsorted(pairs[begin], pairs[begin[at]] + most, side="right")) - 1)
        some = by_owner[begin[at] : begin[stop]]
        c = after[some]
        ends = np.cumsum(c)
        other = owner[np.arange(ends[-1]) + np.repeat(some + 1 - (ends - c), c)]
        key = np.sort(np.repeat(owner[some], c) * n + other)
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        yield key[new] // n, key[new] % n, np.diff(np.append(new, len(key)))
        at = stop


def edges_within(work: np.ndarray, n_concepts: np.ndarray, concepts: np.ndarray, n_refs: np.ndarray, refs: np.ndarray, least: float = 0.2, most: int = PAIRS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """a < b, as places in ``work``, which is sorted, and the weight: 1 if one cites the other, half for each work that both cite, at most
    two, and half the Jaccard similarity of their concepts, from ``least`` up; rounded to millionths, halves up."""
    n = len(work)
    citing = np.repeat(np.arange(n), n_refs)
    cited = np.minimum(np.searchsorted(work, refs), n - 1)
    inside = (work[cited] == refs) & (cited != citing)
    x, y = citing[inside], cited[inside]
    keys = [np.unique(np.minimum(x, y) * n + np.maximum(x, y))]
    weights = [np.full(len(keys[0]), 1_000_000, np.int64)]
    for i, j, m in shared(citing, refs, n, most):
        keys.append(i * n + j)
        weights.append(500_000 * np.minimum(m, 4))
    for i, j, m in shared(np.repeat(np.arange(n), n_concepts), concepts, n, most):
        union = n_concepts[i] + n_concepts[j] - m
        ok = m / union >= least
        keys.append((i * n + j)[ok])
        weights.append(((1_000_000 * m + union) // (2 * union))[ok])
    key, weight = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    if not len(key):
        return key, key, weight / 1e6
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[new] // n, key[new] % n, np.add.reduceat(weight, new) / 1e6


def _communities(least: int):
    def group(table: pa.Table) -> pa.Table:
        parts = [unpacked(b) for b in table.column("packed").to_pylist()]
        work, n_c, c, n_r, r = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(work, kind="stable")
        to_c, to_r = np.cumsum(n_c) - n_c, np.cumsum(n_r) - n_r

        def moved(first: np.ndarray, size: np.ndarray, values: np.ndarray) -> np.ndarray:
            stop = np.cumsum(size)
            return values[np.arange(stop[-1] if len(stop) else 0) + np.repeat(first - (stop - size), size)]

        c, r = moved(to_c[order], n_c[order], c), moved(to_r[order], n_r[order], r)
        work = work[order]
        a, b, w = edges_within(work, n_c[order], c, n_r[order], r)
        members = defaultdict(list)
        for v, k in louvain(list(zip(a.tolist(), b.tolist(), w.tolist(), strict=True))).items():
            members[k].append(v)
        kept = sorted((sorted(m) for m in members.values() if len(m) >= least), key=lambda m: (-len(m), m))
        size = [len(m) for m in kept]
        places = np.asarray([v for m in kept for v in m], np.int64)
        names = np.repeat(np.asarray([f"c{i}" for i in range(1, len(kept) + 1)], object), size)
        project = pa.array([table.column("project_id")[0].as_py()] * len(places), pa.string())
        return pa.table({"project_id": project, "work_id": pa.array(work[places], pa.int64()), "cluster": pa.array(names.tolist(), pa.string())})

    return group


def communities_within(members: DataFrame, citations: DataFrame, work_concepts: DataFrame, folder: str, least: int = 3) -> DataFrame:
    """project_id, work_id, cluster: communities of three or more, named c1, c2 ... by size, then members.

    members: project_id, work_id. Lists by work are written below ``folder``, one after another, so that the shuffle files of one are gone
    before the next is made. Ids of works and concepts are whole numbers.
    """
    one = members.select(F.col("project_id").cast("string").alias("project_id"), F.col("work_id").cast("long").alias("work_id")).distinct()
    projects = written(one.groupBy("work_id").agg(F.collect_list("project_id").alias("projects")), f"{folder}/projects")
    pairs = work_concepts.select(F.col("work_id").cast("long").alias("work_id"), F.col("concept_id").cast("long").alias("concept_id")).distinct()
    concepts = written(pairs.groupBy("work_id").agg(F.collect_list("concept_id").alias("concepts")), f"{folder}/concepts")
    cites = citations.select(F.col("citing").cast("long").alias("work_id"), F.col("cited").cast("long").alias("cited")).distinct()
    references = written(cites.groupBy("work_id").agg(F.collect_list("cited").alias("refs")), f"{folder}/refs")
    lists = written(projects.join(concepts, "work_id", "left").join(references, "work_id", "left").select("work_id", "projects", "concepts", "refs"), f"{folder}/lists")
    return lists.mapInArrow(_dealt, "project_id string, packed binary").groupBy("project_id").applyInArrow(_communities(least), "project_id string, work_id long, cluster string")
