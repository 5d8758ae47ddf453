"""Cutting lineage at the shared checkpoint folder, and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder; a folder of our own only where none is configured, on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        place = sc.getConf().get("spark.checkpoint.dir")
        if not place and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(place or tempfile.mkdtemp(prefix="tidewell-"))
    return sc.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """df with its lineage cut: rows are in the shared checkpoint folder, so a lost executor costs nothing."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def cut(df: DataFrame) -> DataFrame:
    """saved, for rounds that build on one another, as files in the shared checkpoint folder.

    A checkpoint hands on how large its plan was thought to be, a join being the product of its sides: in rounds that
    number's digits double until planning takes minutes. Files are as large as they are, so small ones are broadcast.
    """
    place = f"{checkpoint_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root being the smallest node reachable.

    Every round hooks each root to the smallest root beside it, follows the hooks to their ends (they only
    fall, so they end) and contracts the edges. The roots that still have edges at least halve every second
    round, so the rounds grow with the logarithm of the longest chain. Joins are on single keys with
    pre-aggregated sides; no neighbourhood is ever gathered. Self loops and repeated edges are harmless;
    an edge with a null end is left out; no edges give no rows.
    """
    e = edges.select(F.col("a").alias("a"), F.col("b").alias("b")).where("a is not null and b is not null")
    e = cut(e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = cut(e.select(F.col("a").alias("node")).union(e.select("b")).distinct().withColumn("root", F.col("node")))
    for _ in range(max_rounds):
        hooks = e.groupBy(F.col("b").alias("from")).agg(F.min("a").alias("to"))
        hooks = cut(hooks)
        if hooks.isEmpty():
            return labels
        while True:  # pointer jumping: the chains of hooks halve each time
            nxt = hooks.select(F.col("from").alias("_f"), F.col("to").alias("_t"))
            jumped = hooks.join(nxt, F.col("to") == F.col("_f"), "left").select("from", F.coalesce("_t", "to").alias("to"), F.col("_t").isNotNull().alias("_moved"))
            jumped = cut(jumped)
            moved = not jumped.where("_moved").isEmpty()
            hooks = jumped.select("from", "to")
            if not moved:
                break
        labels = cut(labels.join(hooks, F.col("root") == F.col("from"), "left").select("node", F.coalesce("to", "root").alias("root")))
        ha, hb = hooks.toDF("_fa", "_ta"), hooks.toDF("_fb", "_tb")
        e = e.join(ha, F.col("a") == F.col("_fa"), "left").join(hb, F.col("b") == F.col("_fb"), "left")
        e = e.select(F.coalesce("_ta", "a").alias("x"), F.coalesce("_tb", "b").alias("y")).where("x <> y")
        e = cut(e.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
