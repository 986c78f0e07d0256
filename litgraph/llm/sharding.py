"""Sharding by a hierarchical tree of weighted hash draws.

A row descends region, rack and shard. At each node every child draws -ln(u) / weight, u a hash of the child's name and
the row's doc_id; the least draw wins, so a child gets its weight's share. A child's draw falls only when its own weight
grows: a change of weights moves rows into or out of the changed subtree alone, and within the others nothing moves. A
shard beyond the last full region opens a region of its own; rows then move into that shard only (the law ``key``).

Slots number the rows of each shard from 0 without gaps. They are counted in buckets of a hash, so that no shard's rows
meet in one task. Null doc_id: a hash like any other, so one shard. Null text: size 1, the checksum of no bytes.
Repeated rows go to one shard and get slots of their own. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, stored

#: Buckets of a shard's rows while slots are counted: at most so many.
MOST_BUCKETS = 4096


@dataclass
class Node:
    name: str
    shard: int | None = None
    own_weight: float = 1.0
    children: list[Node] = field(default_factory=list)

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def topology(shards: int, racks: int = 2, per_rack: int = 4, weights: dict[int, float] | None = None) -> Node:
    """Regions of ``racks`` racks of ``per_rack`` shards, filled one after another."""
    root = Node("root")
    for s in range(shards):
        region, rack = divmod(s // per_rack, racks)
        if region == len(root.children):
            root.children.append(Node(f"region{region}"))
        if rack == len(root.children[region].children):
            root.children[region].children.append(Node(f"region{region}/rack{rack}"))
        parent = root.children[region].children[rack]
        parent.children.append(Node(f"{parent.name}/shard{s}", s, (weights or {}).get(s, 1.0)))
    return root


def draw(node: Node, key: Column) -> Column:
    """An exponential number with the node's weight as its rate."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(node.name), key), 12)
    return -F.log((bits.cast("double") + 0.5) / float(1 << 52)) / F.lit(node.weight)


def assign(tree: Node, key: Column) -> Column:
    """The shard of a row; only the draws on its way down are made."""
    if tree.shard is not None:
        return F.lit(tree.shard)
    live = [c for c in tree.children if c.weight > 0]
    if len(live) == 1:
        return assign(live[0], key)
    least = F.array_min(F.array(*[F.struct(draw(c, key).alias("draw"), F.lit(i).alias("child")) for i, c in enumerate(live)]))["child"]
    pick = F.transform(F.array(least), lambda won: _choose(live, won, key))
    return pick[0]


def _choose(children: list[Node], won: Column, key: Column) -> Column:
    out = F
    for i, c in enumerate(children):
        out = out.when(won == i, assign(c, key))
    return out


def shard(spark: SparkSession, docs: DataFrame, shards: int = 16, racks: int = 2, per_rack: int = 4) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    key = F.col("doc_id")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = stored(
        docs.select(
            "doc_id",
            (F.octet_length(raw) + 1).cast("long").alias("size"),
            F.crc32(raw).alias("text_crc32"),
            assign(topology(shards, racks, per_rack), key).alias("shard"),
            assign(topology(shards + 1, racks, per_rack), key).alias("grown_shard"),
        ),
        f"{shared_dir(spark)}/rows",
    )
    buckets = min(MOST_BUCKETS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(buckets)).cast("int"))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))  # shards * MOST_BUCKETS rows at most
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    ranked = rows.withColumn("at", F.row_number().over(within)).join(F.broadcast(offsets), ["shard", "bucket"])
    return ranked.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("at") - 1).alias("slot"), "grown_shard")
