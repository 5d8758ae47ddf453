"""From raw records to current items: keys, first-wins dedup, snapshots, merges, candidates, ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRICS = ["views", "likes", "comments", "shares", "favorites", "upvotes"]


def first_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """rows with keeper: the first row's order value among those of its key. A null key is no duplicate of anything."""
    first = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(order).alias("keeper"))
    return rows.join(first, F.col(key) == F.col("_key"), "left").drop("_key").withColumn("keeper", F.coalesce("keeper", order))


def latest_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key: what an upsert of all rows in order would leave. One aggregation with partial maxima."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*")


def suppress(snapshots: DataFrame, keys: list[str]) -> DataFrame:
    """Snapshots without those that repeat all metrics of another of the same keys; nulls are equal to nulls."""
    return snapshots.dropDuplicates([*keys, *[m for m in METRICS if m in snapshots.columns]])


def merge(existing: DataFrame, incoming: DataFrame, key: str, fill: list[str], take: list[str]) -> DataFrame:
    """A full merge: `fill` columns keep what exists and fill nulls, `take` columns take what comes unless it is null."""
    a, b = existing.alias("a"), incoming.alias("b")
    j = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    cols = [F.coalesce(f"a.{key}", f"b.{key}").alias(key)]
    cols += [F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in fill] + [F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in take]
    return j.select(*cols, F.when(F.col(f"a.{key}").isNull(), "new").when(F.col(f"b.{key}").isNull(), "kept").otherwise("merged").alias("status"))


def candidates(items: DataFrame, fingerprint: str = "fingerprint") -> DataFrame:
    """(item_a, item_b): each item of a fingerprint with the first one of it; flagged, never merged."""
    first = items.where(F.col(fingerprint).isNotNull()).groupBy(F.col(fingerprint).alias("_f")).agg(F.min("item_id").alias("item_a"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return items.join(first, F.col(fingerprint) == F.col("_f")).where("item_id <> item_a").select("item_a", F.col("item_id").alias("item_b"))


def confirm(items: DataFrame, pairs: DataFrame, fill: list[str]) -> DataFrame:
    """items after merging each item_b of pairs into its item_a: a pointer on the source, nulls of the target filled
    from its sources (the smallest value, where several have one)."""
    into = pairs.groupBy(F.col("item_b").alias("_b")).agg(F.min("item_a").alias("merged_into"))
    marked = items.join(into, F.col("item_id") == F.col("_b"), "left").drop("_b")
    gifts = marked.where("merged_into is not null").groupBy(F.col("merged_into").alias("_a")).agg(*[F.min(c).alias(f"_{c}") for c in fill], F.count(F.lit(1)).alias("sources"))
    out = marked.join(gifts, F.col("item_id") == F.col("_a"), "left")
    rest = [c for c in marked.columns if c not in fill]
    return out.select(*rest, *[F.coalesce(c, f"_{c}").alias(c) for c in fill], F.coalesce("sources", F.lit(0)).alias("sources"))


def rekeyed_snapshots(snapshots: DataFrame, pairs: DataFrame) -> DataFrame:
    """Snapshots of merged items under their targets."""
    into = pairs.groupBy(F.col("item_b").alias("_b")).agg(F.min("item_a").alias("_a"))
    return snapshots.join(into, F.col("item_id") == F.col("_b"), "left").withColumn("item_id", F.coalesce("_a", "item_id")).drop("_a", "_b")


def batch_status(rows: DataFrame, batch: str, valid: str) -> DataFrame:
    """Per batch: rows, failed, and completed, partial or failed."""
    g = rows.groupBy(batch).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col(valid)).alias("failed"))
    return g.withColumn("status", F.when(F.col("failed") == 0, "completed").when(F.col("failed") == F.col("n"), "failed").otherwise("partial"))


def changed_hashes(rows: DataFrame, key: str, digest: str, order: str) -> DataFrame:
    """A slowly changing history per key: each change of the digest with the order value that superseded it."""
    w = Window.partitionBy(key).orderBy(order)
    new = rows.withColumn("_was", F.lag(digest).over(w)).where(F.col("_was").isNull() | (F.col("_was") != F.col(digest)))
    return new.withColumn("superseded_at", F.lead(order).over(w)).drop("_was")
