"""Shards by a hierarchical weighted hash tree: region, rack, shard.

At each level every child draws an exponential number from a hash of the document's key and the child's name, divided
by the child's weight; the smallest draw wins. A child's share follows its weight, and when a weight changes rows move
only from or to that child, so movement stays inside the subtree whose weights changed.

Defined results: a null key counts as the text ``null``; a null text has size 16 and checksum 0; repeated rows go to the
same shard with slots of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = "shards-1"
BUCKET_ROWS = 100_000


@dataclass(frozen=True)
class Node:
    """A child of the tree: its name, weight, and either its own children or its shard number."""

    name: str
    weight: float
    children: tuple[Node, ...] = ()
    shard: int | None = None


def tree(regions: int = 2, racks: int = 4, shards: int = 5, extra: int = 0) -> Node:
    """A balanced tree of ``regions * racks * shards`` shards, numbered in order.

    Each of ``extra`` further shards is a region of its own with the weight of one shard, so that growing by one takes
    an equal share of rows from everywhere and moves nothing else.
    """
    def shard(path, n):
        return Node(f"{path}/s{n}", 1.0, shard=n)

    top, n = [], 0
    for r in range(regions):
        made = []
        for k in range(racks):
            path = f"r{r}/k{k}"
            made.append(Node(path, float(shards), tuple(shard(path, n + i) for i in range(shards))))
            n += shards
        top.append(Node(f"r{r}", float(racks * shards), tuple(made)))
    for i in range(extra):
        path = f"x{i}"
        top.append(Node(path, 1.0, (Node(f"{path}/k0", 1.0, (shard(f"{path}/k0", n + i),)),)))
    return Node("", 1.0, tuple(top))


def hash32(*parts: Column) -> Column:
    """A number below 2**32 from the MD5 of the parts joined by ':'."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("bigint")


def _winner(children: tuple[Node, ...], key: Column, value) -> Column:
    """The value of the child with the smallest draw."""
    if len(children) == 1:
        return F.lit(value(children[0]))
    draws = [F.struct((-F.log((hash32(F.lit(SEED), F.lit(c.name), key) + 0.5) / float(1 << 32))
                       / F.lit(c.weight)).alias("cost"), F.lit(value(c)).alias("value")) for c in children]
    return F.array_min(F.array(*draws))["value"]


def place(rows: DataFrame, key: Column, root: Node, name: str) -> DataFrame:
    """Add the shard number of every row; one projection per level."""
    rows = rows.withColumn(f"_{name}_r", _winner(root.children, key, lambda c: c.name))
    pick = F.lit(None).cast("string")
    for region in root.children:
        pick = F.when(F.col(f"_{name}_r") == region.name, _winner(region.children, key, lambda c: c.name)).otherwise(pick)
    rows = rows.withColumn(f"_{name}_k", pick)
    pick = F.lit(None).cast("int")
    for rack in (k for region in root.children for k in region.children):
        pick = F.when(F.col(f"_{name}_k") == rack.name, _winner(rack.children, key, lambda c: c.shard)).otherwise(pick)
    return rows.withColumn(name, pick.cast("int")).drop(f"_{name}_r", f"_{name}_k")


def shard_documents(docs: DataFrame, root: Node, grown: Node, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Size, checksum, shard, slot within the shard and the shard after growing by one.

    Slots follow (hash of the key, key) within a shard. Each shard is cut into hash ranges of about ``bucket_rows`` rows;
    counts per range, taken from the keys alone, give every range its first slot, so no task numbers a whole shard.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    hashed = hash32(F.lit(SEED), F.lit("slot"), key)
    buckets = max(1, -(-docs.count() // (bucket_rows * _shards(root))))

    def cut(rows):
        rows = place(rows.withColumn("_h", hashed), key, root, "shard")
        return rows.withColumn("_b", F.floor(F.col("_h") * buckets / float(1 << 32)).cast("int"))

    first = (cut(docs.select("doc_id")).groupBy("shard", "_b").agg(F.count(F.lit(1)).alias("_n"))
             .withColumn("_first", F.sum("_n").over(Window.partitionBy("shard").orderBy("_b")) - F.col("_n")).drop("_n"))
    rows = cut(docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32")))
    rows = place(rows, key, grown, "grown_shard")
    within = Window.partitionBy("shard", "_b").orderBy("_h", "doc_id", "text_crc32", "size")
    return (rows.withColumn("_i", F.row_number().over(within)).join(first, ["shard", "_b"])
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    (F.col("_first") + F.col("_i") - 1).cast("bigint").alias("slot"), "grown_shard"))


def _shards(root: Node) -> int:
    return sum(len(k.children) for region in root.children for k in region.children)
