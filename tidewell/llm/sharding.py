"""Sharding by a hierarchical weighted hash tree: region, rack and shard are drawn in turn, in DataFrame functions.

At each node a child wins with the smallest -ln(u) / weight, u being hashed from the row's id and the child's own
name. Raising a child's weight, or adding a child, can only make that child win more: rows move only into the
subtree whose weight grew, and between its siblings nothing moves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved


@dataclass(frozen=True)
class Leaf:
    shard: int
    region: str
    rack: str
    weight: float = 1.0


def layout(shards: int, base: int = 24, regions: int = 3, racks: int = 2) -> list[Leaf]:
    """The tree of a shard count. Shards below base fill `regions` x `racks`; each later one opens a region of
    its own, so that one more shard changes no weight but its own and takes rows only into itself."""
    a_region = -(-base // regions)
    a_rack = -(-a_region // racks)
    tree = []
    for s in range(shards):
        if s < base:
            tree.append(Leaf(s, f"r{s // a_region}", f"k{s % a_region // a_rack}"))
        else:
            tree.append(Leaf(s, f"g{s}", "k0"))
    return tree


def _draw(key: Column, name: str, weight: float, seed: int) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(name), F.lit(seed)), 11) + F.lit(1)) / F.lit(float(2**53) + 1)
    return -F.log(u) / F.lit(float(weight))


def _descend(key: Column, leaves: list[Leaf], level: int, prefix: str, seed: int) -> Column:
    """The shard that wins below a node; the tree is small and each draw appears once in the expression."""
    children: dict[str, list[Leaf]] = {}
    for leaf in leaves:
        children.setdefault(f"{prefix}/{(leaf.region, leaf.rack, f's{leaf.shard}')[level]}", []).append(leaf)
    below = [F.lit(own[0].shard) if level == 2 else _descend(key, own, level + 1, name, seed) for name, own in children.items()]
    if len(below) == 1:
        return below[0]
    draws = [F.struct(_draw(key, name, sum(leaf.weight for leaf in own), seed), F.lit(i + 1).alias("at")) for i, (name, own) in enumerate(children.items())]
    return F.element_at(F.array(*below), F.array_min(F.array(*draws)).getField("at"))


def shard_of(key: Column, tree: list[Leaf], seed: int = 0) -> Column:
    """The shard of a key under a tree; weights must be positive. A null key is a key like any other."""
    if any(leaf.weight <= 0 for leaf in tree) or len({leaf.shard for leaf in tree}) != len(tree) or not tree:
        raise ValueError("a tree needs leaves of different shards with positive weights")
    return _descend(key, tree, 0, "", seed).cast("int")


def sharded(docs: DataFrame, tree: list[Leaf] | int = 24, id_col: str = "doc_id", seed: int = 0, into: str = "_tw_shard") -> DataFrame:
    """docs with the shard of each row, every column kept; write with partitionBy(into)."""
    return docs.withColumn(into, shard_of(F.col(id_col), layout(tree) if isinstance(tree, int) else tree, seed))


def shard_report(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, rows_a_slice: int = 100_000) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes of the text (null: none) plus 8. law is 'key': the id and the shard count decide, whatever
    the text. slot numbers the rows of a shard from 0 without gaps: a shard is dealt into slices by a second hash,
    slices are numbered within, and each starts where those before it end, so no shard meets in one task.
    Rows of one id share a shard; rows with null ids share one, too. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    key = F.col("doc_id")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.withColumn("shard", shard_of(key, layout(shards), seed)).withColumn("grown_shard", shard_of(key, layout(shards + 1), seed))
    rows = saved(rows)  # narrow: the texts are read once
    slices = max(1, -(-rows.count() // (rows_a_slice * shards)))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("text_crc32", "doc_id", "size", F.lit("slice")), F.lit(slices)).cast("int"))
    counts = rows.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    at = Window.partitionBy("shard", "slice").orderBy("doc_id", "text_crc32", "size")
    rows = rows.withColumn("at", F.row_number().over(at)).join(starts, ["shard", "slice"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("at") - 1).cast("long").alias("slot"), "grown_shard")
