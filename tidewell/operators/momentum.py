"""Momentum over trailing windows: first and last snapshot, deltas, weights, engagement and series."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.stats import half_up

METRICS = ("views", "likes", "comments", "shares", "favorites", "upvotes")
#: Weights of the deltas in a momentum; the upvoting platform's upvotes take the place of likes.
WEIGHTS = {"likes": 1, "comments": 2, "shares": 3, "favorites": 2}


def at(now: dt.datetime, **back) -> Column:
    return F.lit(now - dt.timedelta(**back)).cast("timestamp")


def hours_between(first: Column, last: Column) -> Column:
    """Hours, fractions of a second included."""
    return (F.unix_micros(last) - F.unix_micros(first)) / 3.6e9


def point() -> Column:
    """A snapshot as a struct that orders by time."""
    return F.struct("captured_at", *METRICS)


def edges(snapshots: DataFrame, now: dt.datetime, days: int = 7) -> DataFrame:
    """item_id, base, last, points: the first and last snapshot in the trailing window, and how many it holds.

    An item with a single one takes, if it has any, the latest snapshot before the window as its base. All of it
    is one aggregation of the snapshots: no join, and partial sums before the shuffle.
    """
    inside = (F.col("captured_at") >= at(now, days=days)) & (F.col("captured_at") <= at(now))
    earlier = F.col("captured_at") < at(now, days=days)
    per = snapshots.groupBy("item_id").agg(
        F.min_by(point(), F.when(inside, F.col("captured_at"))).alias("first"), F.max_by(point(), F.when(inside, F.col("captured_at"))).alias("last"),
        F.max_by(point(), F.when(earlier, F.col("captured_at"))).alias("before"), F.count_if(inside).alias("points"),
    ).where("points > 0")
    base = F.when(F.col("points") == 1, F.coalesce("before", "first")).otherwise(F.col("first"))
    used = F.when((F.col("points") == 1) & F.col("before").isNotNull(), F.lit(2)).otherwise(F.col("points"))
    return per.select("item_id", base.alias("base"), "last", used.alias("points"))


def deltas(pairs: DataFrame) -> DataFrame:
    """pairs (base, last) with d_<metric>: last - base, null if either is, and hours between the two."""
    out = pairs
    for m in METRICS:
        out = out.withColumn(f"d_{m}", F.col(f"last.{m}") - F.col(f"base.{m}"))
    return out.withColumn("span_hours", hours_between(F.col("base.captured_at"), F.col("last.captured_at")))


def momentum(upvoting: Column) -> Column:
    """The weighted sum of the deltas; unknown ones add nothing. Whole numbers, halves up."""
    total = F.coalesce(F.when(upvoting, F.col("d_upvotes")).otherwise(F.col("d_likes")), F.lit(0))
    for m, w in WEIGHTS.items():
        if m != "likes":
            total = total + F.coalesce(F.col(f"d_{m}") * w, F.lit(0))
    return half_up(total.cast("double")).cast("long")


def engagement(views: Column, *parts: Column) -> Column:
    """The parts over the views; unknown if one is missing or there are no views."""
    return F.when(views > 0, sum(parts[1:], parts[0]) / views)


def daily_rate(delta: Column) -> Column:
    return F.when(F.col("span_hours") > 0, delta * 24.0 / F.col("span_hours"))


def momentum_list(items: DataFrame, snapshots: DataFrame, now: dt.datetime, upvoting: str, days: int = 7) -> DataFrame:
    """Every item with two points to compare: momentum, deltas, rates and engagement, for the caller to order."""
    d = deltas(edges(snapshots, now, days).where("points >= 2"))
    j = items.join(d, "item_id")
    up = F.col("platform") == upvoting
    last = lambda m: F.col(f"last.{m}")
    unknown = F.array_compact(F.array(*[F.when(F.col(f"d_{m}").isNull(), F.lit(m)) for m in METRICS[:-1]]))
    return j.select(
        "item_id", "platform", "topic_id", "points", half_up(F.col("span_hours"), 6).alias("span_hours"), momentum(up).alias("momentum"),
        "d_likes", "d_comments", "d_shares", "d_favorites", "d_views", half_up(daily_rate(F.col("d_comments")), 6).alias("comments_per_day"),
        half_up(engagement(last("views"), last("likes"), last("comments"), last("shares"), last("favorites")), 6).alias("engagement"),
        F.array_join(unknown, ",").alias("unknown_components"),
    )


def as_of(items: DataFrame, snapshots: DataFrame, when: dt.datetime) -> DataFrame:
    """items with their latest snapshot strictly before `when`, if any: an as-of join as one aggregation."""
    last = snapshots.where(F.col("captured_at") < F.lit(when).cast("timestamp")).groupBy("item_id").agg(F.max_by(point(), "captured_at").alias("s"))
    return items.join(last, "item_id", "left").select("item_id", "s.*")


def overview_days(snapshots: DataFrame, now: dt.datetime, days: int = 7) -> DataFrame:
    """Per day of the window: snapshots taken and different items seen."""
    rows = snapshots.where((F.col("captured_at") >= at(now, days=days)) & (F.col("captured_at") <= at(now)))
    return rows.groupBy(F.to_date("captured_at").alias("day")).agg(F.count(F.lit(1)).alias("snapshots"), F.count_distinct("item_id").alias("items"))


def platform_mix(items: DataFrame, snapshots: DataFrame, now: dt.datetime, days: int = 7) -> DataFrame:
    rows = snapshots.where((F.col("captured_at") >= at(now, days=days)) & (F.col("captured_at") <= at(now)))
    return rows.join(items, "item_id").groupBy("platform").agg(F.count_distinct("item_id").alias("items"), F.count(F.lit(1)).alias("snapshots"))


def series(snapshots: DataFrame) -> DataFrame:
    """Each item's snapshots in order, with what they gained over the one before and over the first."""
    w = Window.partitionBy("item_id").orderBy("captured_at")
    gain = F.col("likes") - F.lag("likes").over(w)
    return snapshots.select("item_id", "captured_at", F.row_number().over(w).cast("long").alias("n"), "likes", gain.alias("gain"), (F.col("likes") - F.first("likes").over(w)).alias("gain_in_all"))
