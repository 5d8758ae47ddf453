"""Who continues whom from run to run: topics that keep their id, and angles that inherit stored ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import saved
from .ranks import numbered


def claims(pairs: DataFrame, group: str, claimer: str, claimed: str, size: str, sim: str, digits: int = 9) -> DataFrame:
    """(claimer, claimed): in each group the claimers, by size falling, then id, take their most similar claimed one that
    is left (ties, after rounding, by id), as a loop over them would.

    A claimer settles as soon as no unsettled one before it has a pair with what it likes best. Each round settles all
    of these at once and drops their pairs: joins on single keys over what is left, no group in one task. The first of
    a group settles in every round, so the rounds end.
    """
    order = F.struct((-F.col(size)).alias("s"), F.col(claimer).alias("c"))
    left = saved(pairs.select(F.col(group).alias("g"), F.col(claimer).alias("c"), F.col(claimed).alias("d"), order.alias("o"), F.round(sim, digits).alias("sim")).where("c is not null and d is not null"))
    done = None
    while not left.isEmpty():
        likes = left.groupBy("g", "c").agg(F.max_by("d", F.struct("sim", -F.col("d"))).alias("d"), F.first("o").alias("o"))
        first = left.groupBy(F.col("g").alias("_g"), F.col("d").alias("_d")).agg(F.min("o").alias("_o"))
        won = likes.join(first, F.col("g").eqNullSafe(F.col("_g")) & (F.col("d") == F.col("_d")) & (F.col("o") == F.col("_o")))
        won = saved(won.select("g", "c", "d"))
        done = won if done is None else done.union(won)
        gone = won.select(F.col("g").alias("_g"), F.col("c").alias("_c"))
        taken = won.select(F.col("g").alias("_g2"), F.col("d").alias("_d2"))
        left = left.join(gone, F.col("g").eqNullSafe(F.col("_g")) & (F.col("c") == F.col("_c")), "left_anti")
        left = saved(left.join(taken, F.col("g").eqNullSafe(F.col("_g2")) & (F.col("d") == F.col("_d2")), "left_anti"))
    out = done if done is not None else left
    return out.select(F.col("c").alias(claimer), F.col("d").alias(claimed))


def identities(old: DataFrame, new: DataFrame, least: float = 0.3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clusters, members, topics) of a run: old (topic, id, locked) are the memberships before it, new (cluster, id) the
    clusters it found; an id is in one cluster at most.

    clusters: (cluster, topic, overlap, status). A cluster's candidate is the old topic of the largest Jaccard overlap
    (ties by id) if that is `least` or more. Clusters come by size falling, then id; the first to claim a topic keeps
    it, later ones are split off, and they and those without a candidate get new ids after the largest old one.
    members: (id, topic, method): the clusters' members; a locked one stays with its topic, in a cluster or not.
    topics: (topic, status): active if a cluster has it, else inactive.
    """
    new = new.where("id is not null and cluster is not null")
    old = old.where("id is not null and topic is not null").withColumn("locked", F.coalesce("locked", F.lit(False)))
    na = old.groupBy("topic").agg(F.count(F.lit(1)).alias("na"))
    nb = saved(new.groupBy("cluster").agg(F.count(F.lit(1)).alias("nb")))
    both = old.select("topic", F.col("id").alias("_id")).join(new, F.col("id") == F.col("_id")).groupBy("topic", "cluster").agg(F.count(F.lit(1)).alias("k"))
    j = both.join(na, "topic").join(nb, "cluster").withColumn("overlap", F.col("k") / (F.col("na") + F.col("nb") - F.col("k")))
    best = j.groupBy("cluster").agg(F.max_by(F.struct("topic", "overlap", "nb"), F.struct("overlap", -F.col("topic"))).alias("b")).select("cluster", "b.*").where(F.col("overlap") >= least)
    first = best.groupBy(F.col("topic").alias("_t")).agg(F.min(F.struct((-F.col("nb")).alias("n"), "cluster")).alias("f")).select("_t", F.col("f.cluster").alias("_first"))
    told = best.join(first, F.col("topic") == F.col("_t")).select(F.col("cluster").alias("_c"), "topic", "overlap", (F.col("cluster") == F.col("_first")).alias("keeps"))
    told = saved(nb.join(told, F.col("cluster") == F.col("_c"), "left").drop("_c"))
    fresh = numbered(told.where(~F.coalesce("keeps", F.lit(False))).select(F.col("cluster").alias("_n"), "nb"), [F.desc("nb"), "_n"])
    last = old.agg(F.coalesce(F.max("topic"), F.lit(-1)).alias("_last"))  # one row
    fresh = fresh.join(F.broadcast(last)).select("_n", (F.col("_last") + 1 + F.col("_tw_g")).alias("_new"))
    clusters = told.join(fresh, F.col("cluster") == F.col("_n"), "left")
    status = F.when(F.col("keeps"), "kept").when(F.col("topic").isNotNull(), "split").otherwise("new")
    clusters = saved(clusters.select("cluster", F.coalesce("_new", "topic").alias("topic"), "overlap", status.alias("status")))
    to = clusters.select(F.col("cluster").alias("_c"), "topic")
    auto = new.join(to, F.col("cluster") == F.col("_c")).select("id", "topic")
    locks = old.where("locked").groupBy(F.col("id").alias("_l")).agg(F.min("topic").alias("_lt"))
    members = auto.join(locks, F.col("id") == F.col("_l"), "full")
    members = members.select(F.coalesce("_l", "id").alias("id"), F.coalesce("_lt", "topic").alias("topic"), F.when(F.col("_l").isNotNull(), "manual").otherwise("automatic").alias("method"))
    used = clusters.select(F.col("topic").alias("_u"))
    topics = na.select("topic").union(used).distinct().join(used, F.col("topic") == F.col("_u"), "left")
    return clusters, members, topics.select("topic", F.when(F.col("_u").isNotNull(), "active").otherwise("inactive").alias("status"))

