"""Content burst and topic trend scores, lifecycles and their hysteresis."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.stats import clamp, growth, half_up, label, order_statistics, percentiles_of, upper_median_at, weighted
from tidewell.operators.graph import cut, saved
from tidewell.operators.momentum import WEIGHTS, at, hours_between, point
from tidewell.operators.ranks import FEW, largest, places, running
from tidewell.profiles import BURST, LIFECYCLE, TREND


def age_bucket(published: Column, now: dt.datetime, scale: float = 1.0) -> Column:
    """The half-open age class of a publication; unknown without a time; the future counts as age zero."""
    hours = F.greatest(F.lit(0.0), hours_between(published, at(now)))
    out = F.when(published.isNull(), "unknown")
    for name, most in BURST["age_buckets"]:
        out = out.when(hours < most * scale, name) if most else out.otherwise(name)
    return out


def same_keys(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined with other's further columns on keys, a null being equal to a null."""
    right = other.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in other.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(right, same).drop(*[f"_k_{k}" for k in keys])


def cohorts(items: DataFrame, now: dt.datetime, scale: float = 1.0, min_sample: int = BURST["min_sample"], floor_sample: int = BURST["floor_sample"]) -> DataFrame:
    """items with age, cohort, level, cohort_size, insufficient: the finest of four keys that enough items share.

    Sizes count all items of a key. The items are counted once, by the finest key, and these counts are stored; the
    coarser keys' sizes are sums of them, so that one small table is joined back and no platform's items meet in one task.
    """
    base = items.withColumn("age", age_bucket(F.col("published_at"), now, scale))
    levels = [["platform", "content_type", "age", "topic_id"], ["platform", "content_type", "age"], ["platform", "age"], ["platform"]]
    finest = cut(base.groupBy(*levels[0]).agg(F.count(F.lit(1)).alias("_n0")))
    sizes = finest
    for i, keys in enumerate(levels[1:], 1):
        n = finest.groupBy(*keys).agg(F.sum("_n0").alias(f"_n{i}"))
        sizes = same_keys(sizes, n, keys)
    rows = same_keys(base, sizes, levels[0])
    topic = F.concat(F.lit("topic:"), F.coalesce(F.col("topic_id").cast("string"), F.lit("-")))
    names = [F.concat_ws("|", "platform", "content_type", "age", topic), F.concat_ws("|", "platform", "content_type", "age"), F.concat_ws("|", "platform", "age"), F.col("platform")]
    level = F.when(F.col("_n0") >= min_sample, 0).when(F.col("_n1") >= min_sample, 1).when(F.col("_n2") >= min_sample, 2).otherwise(3)
    out = rows.withColumn("level", level).withColumn("cohort", F.when(level == 0, names[0]).when(level == 1, names[1]).when(level == 2, names[2]).otherwise(names[3]))
    size = F.when(level == 0, F.col("_n0")).when(level == 1, F.col("_n1")).when(level == 2, F.col("_n2")).otherwise(F.col("_n3"))
    return out.withColumn("cohort_size", size).withColumn("insufficient", (level == 3) & (F.col("_n3") < floor_sample)).drop("_n0", "_n1", "_n2", "_n3")


def observations(items: DataFrame, snapshots: DataFrame, now: dt.datetime, upvoting: str, scale: float = 1.0) -> DataFrame:
    """items with what a burst score looks at: velocity per window, views, engagement ratio, totals, snapshots, span.

    One aggregation over the snapshots yields first and last of every window.
    """
    inside = snapshots.where(F.col("captured_at") <= at(now))
    cuts = {k: F.col("captured_at") >= at(now, hours=h * scale) for k, h in BURST["windows_hours"].items()}
    # every window that holds a snapshot ends with the latest of all, so only the first of each is looked for
    aggs = [F.max_by(point(), "captured_at").alias("latest"), F.min("captured_at").alias("since"), F.count(F.lit(1)).alias("snapshots")]
    for k, cut in cuts.items():
        aggs += [F.min_by(point(), F.when(cut, F.col("captured_at"))).alias(f"b_{k}"), F.count_if(cut).alias(f"n_{k}")]
    per = inside.groupBy("item_id").agg(*aggs).withColumnRenamed("item_id", "_item")
    # What the velocities are made of comes before the join, the velocities after it, when the main reaction is known: each
    # side is one method of the plan's code, and the JVM doesn't compile methods of more than 8,000 bytes.
    last, made = F.col("latest"), []
    for k in cuts:
        base = F.col(f"b_{k}")
        rest = [(last[m] - base[m]) * w for m, w in WEIGHTS.items() if m != "likes"]
        made += [F.when(F.col(f"n_{k}") >= 2, hours_between(base["captured_at"], last["captured_at"])).alias(f"hours_{k}"), *[(last[m] - base[m]).alias(f"{m}_{k}") for m in ("likes", "upvotes")]]
        made += [F.when(F.coalesce(*rest).isNotNull(), sum((F.coalesce(p, F.lit(0)) for p in rest[1:]), F.coalesce(rest[0], F.lit(0)))).alias(f"rest_{k}")]
    per = per.select("_item", "latest", "since", "snapshots", *made)
    j = items.join(per, F.col("item_id") == F.col("_item"), "left").drop("_item")
    up = F.col("platform") == upvoting
    j = j.withColumns({f"gain_{k}": F.when(up, F.col(f"upvotes_{k}")).otherwise(F.col(f"likes_{k}")) for k in cuts})
    for k in cuts:
        gain, rest, hours = F.col(f"gain_{k}"), F.col(f"rest_{k}"), F.col(f"hours_{k}")
        total = half_up((F.coalesce(gain, F.lit(0)) + F.coalesce(rest, F.lit(0))).cast("double"))
        j = j.withColumn(f"v_{k}", F.when((hours > 0) & F.coalesce(gain, rest).isNotNull(), total / hours))
    latest = F.col("latest")
    main = F.when(up, latest["upvotes"]).otherwise(latest["likes"])
    deep = latest["comments"] + latest["shares"] + latest["favorites"]
    known = [main, latest["comments"], latest["shares"], latest["favorites"]]
    total = F.when(F.coalesce(*known).isNotNull(), sum((F.coalesce(c, F.lit(0)) for c in known), F.lit(0)))
    window = F.lit(None).cast("string")
    for k in reversed(BURST["fallback"]):
        window = F.when(F.col(f"v_{k}").isNotNull(), F.lit(k)).otherwise(window)
    j = j.withColumn("velocity", F.coalesce(*[F.col(f"v_{k}") for k in BURST["fallback"]])).withColumn("velocity_window", window)
    j = j.withColumn("ratio", F.when((main + deep) == 0, F.lit(0.0)).otherwise(deep / F.nullif(main + deep, F.lit(0))))
    j = j.withColumn("total", total).withColumn("views", latest["views"])
    j = j.withColumn("main", main).withColumn("comments", latest["comments"]).withColumn("shares", latest["shares"]).withColumn("favorites", latest["favorites"])
    span = F.when(F.col("snapshots") >= 2, hours_between(F.col("since"), latest["captured_at"]))
    j = j.withColumn("span_hours", span).withColumn("snapshots", F.coalesce("snapshots", F.lit(0)))
    return j.drop("latest", "since", *[f"{x}_{k}" for k in cuts for x in ("likes", "upvotes", "rest", "hours", "gain")])


def creator_percentile(rows: DataFrame, most: int | None = None, few: int = FEW) -> DataFrame:
    """rows with creator_rank, creator_history: the total among the author's other items of the platform, if enough.

    If no author has more than a few items (most, where that is known), they are ordered in windows an author; else by
    their different totals, as in percentile_of. The row itself is taken out.
    """
    keys = ["platform", "author_id"]
    if most is None:
        rows = saved(rows)
        most = largest(rows.where(F.col("author_id").isNotNull()), keys)
    if most <= few:
        # items without an author are dealt out, each by itself
        below, equal, known = places([*keys, F.when(F.col("author_id").isNull(), F.col("item_id"))], F.col("total"))
        has = F.col("total").isNotNull() & F.col("platform").isNotNull() & F.col("author_id").isNotNull() & (known - 1 >= BURST["creator_min_history"])
        rank = F.when(has, F.lit(100.0) * (below + F.lit(0.5) * (equal - 1)) / (known - 1))
        return rows.select(*rows.columns, rank.alias("creator_rank"), F.when(has, known - 1).alias("creator_history"))
    hist = rows.where(F.col("total").isNotNull() & F.col("author_id").isNotNull()).groupBy(*keys, "total").agg(F.count(F.lit(1)).alias("_equal"))
    hist = running(hist, keys, "total", "_equal", few=few)
    hist = hist.select(F.col("platform").alias("_p"), F.col("author_id").alias("_a"), F.col("total").alias("_t"), "_below", "_equal", (F.col("_all") - 1).alias("_others"))
    j = rows.join(hist, (F.col("platform") == F.col("_p")) & (F.col("author_id") == F.col("_a")) & (F.col("total") == F.col("_t")), "left")
    enough = F.col("_others") >= BURST["creator_min_history"]
    rank = F.lit(100.0) * (F.col("_below") + F.lit(0.5) * (F.col("_equal") - 1)) / F.col("_others")
    return j.withColumn("creator_rank", F.when(enough, rank)).withColumn("creator_history", F.when(enough, F.col("_others"))).drop("_p", "_a", "_t", "_below", "_equal", "_others")


def burst_components(items: DataFrame, snapshots: DataFrame, now: dt.datetime, upvoting: str, scale: float = 1.0, **how) -> DataFrame:
    """Items with their five components; the distribution of a cohort holds the items resolved to it."""
    base = cut(cohorts(items, now, scale, **how))
    in_cohort, by_author = largest(base, ["cohort"]), largest(base.where(F.col("author_id").isNotNull()), ["platform", "author_id"])
    rows = observations(base, snapshots, now, upvoting, scale).drop(*[f"v_{k}" for k in BURST["windows_hours"]])
    if max(in_cohort, by_author) > FEW:
        rows = saved(rows)  # read by each ranking
    rows = percentiles_of(rows, "item_id", ["cohort"], ["velocity", "views", "ratio", "total", "main", "comments", "shares", "favorites"], in_cohort)
    rows = creator_percentile(rows, by_author)
    four = [F.col(f"p_{m}") for m in ("main", "comments", "shares", "favorites")]
    n = sum((c.isNotNull().cast("int") for c in four), F.lit(0))
    structure = sum((F.coalesce(c, F.lit(0.0)) for c in four), F.lit(0.0)) / F.nullif(n, F.lit(0))
    return rows.withColumn("relative", F.coalesce("creator_rank", "p_total")).withColumn("structure", structure)


def burst(items: DataFrame, snapshots: DataFrame, now: dt.datetime, upvoting: str, scale: float = 1.0, **how) -> DataFrame:
    """One row per item: score (one decimal) or the reason for none, confidence, components and cohort."""
    rows = burst_components(items, snapshots, now, upvoting, scale, **how)
    w = BURST["weights"]
    score, used = weighted({"velocity": (F.col("p_velocity"), w["velocity"]), "reach": (F.col("p_views"), w["reach"]), "quality": (F.col("p_ratio"), w["engagement_quality"]), "relative": (F.col("relative"), w["relative"]), "structure": (F.col("structure"), w["structure"])})
    # one after the other, as each is used several times
    rows = rows.withColumns({"_score": score, "_used": used})
    used = F.col("_used")
    reason = F.when(F.col("snapshots") == 0, "insufficient_snapshots").when(used == 0, "insufficient_metrics").when(F.col("insufficient"), "insufficient_cohort")
    rows = rows.withColumns({"_reason": reason, "_confidence": burst_confidence(F.col("snapshots"), F.col("span_hours"), F.col("cohort_size"), used, F.col("creator_history"))})
    reason, score, confidence = F.col("_reason"), F.col("_score"), F.col("_confidence")
    ok = reason.isNull()
    return rows.select(
        "item_id", "platform", "topic_id", "author_id", "published_at", "cohort", "level", "cohort_size", "velocity_window", reason.alias("reason"),
        F.when(ok, half_up(score, 1)).alias("score"), F.when(ok, confidence).alias("confidence_score"), F.when(ok, label(confidence)).alias("confidence"),
        *[half_up(F.col(c), 6).alias(c) for c in ("p_velocity", "p_views", "p_ratio", "relative", "structure")],
    )


def burst_confidence(snapshots: Column, span_hours: Column, cohort_size: Column, used: Column, history: Column) -> Column:
    score = (
        F.lit(1.0)
        - F.when(snapshots < 2, 0.3).otherwise(0.0)
        - F.when((snapshots >= 2) & (span_hours > 0) & (span_hours < 1), 0.1).otherwise(0.0)
        - F.when(cohort_size < 10, 0.2).when(cohort_size < 30, 0.1).otherwise(0.0)
        - F.when(half_up(used, 9) <= 0.5, 0.15).otherwise(0.0)
        - F.when(history.isNull(), 0.05).otherwise(0.0)
    )
    return half_up(clamp(score, 0.0, 1.0) + F.lit(1e-9), 2)


def topic_days(items: DataFrame, snapshots: DataFrame, upvoting: str) -> DataFrame:
    """A topic's snapshot per day: new members, active creators and the mean level of the main reaction."""
    first = items.groupBy("topic_id", F.date_trunc("day", "published_at").alias("captured_at")).agg(F.count(F.lit(1)).alias("new"))
    j = snapshots.join(items.select("item_id", "topic_id", "author_id", "platform"), "item_id")
    main = F.when(F.col("platform") == upvoting, F.coalesce("upvotes", "likes")).otherwise(F.col("likes"))
    seen = j.groupBy("topic_id", "captured_at").agg(F.count_distinct("author_id").alias("creators"), F.avg(main.cast("double")).alias("level"))
    out = seen.join(first, ["topic_id", "captured_at"], "full")
    return out.select("topic_id", "captured_at", F.coalesce("new", F.lit(0)).alias("new"), "creators", "level")


def topic_windows(days: DataFrame, now: dt.datetime, hours: int = TREND["window_hours"]) -> DataFrame:
    """Per topic the sums of the current window and of the one before; with nothing in that, what older days had
    in the middle (the upper median)."""
    t = F.col("captured_at")
    d = days.where(t <= at(now))
    cur, base, old = t >= at(now, hours=hours), (t < at(now, hours=hours)) & (t >= at(now, hours=2 * hours)), t < at(now, hours=2 * hours)
    g = d.groupBy("topic_id").agg(
        F.count_if(cur).alias("_c"), F.count_if(base).alias("_b"), F.count(F.lit(1)).alias("days"),
        *[F.sum(F.when(cur, F.col(x))).alias(f"c_{x}") for x in ("new", "creators")], F.avg(F.when(cur, F.col("level"))).alias("c_level"),
        *[F.sum(F.when(base, F.col(x))).alias(f"b_{x}") for x in ("new", "creators")], F.avg(F.when(base, F.col("level"))).alias("b_level"),
    )
    middle = order_statistics(d.where(old), ["topic_id"], {f"o_{x}": (x, upper_median_at()) for x in ("new", "creators", "level")})
    g = g.join(middle, "topic_id", "left")
    pick = lambda x: F.when(F.col("_b") > 0, F.col(f"b_{x}")).otherwise(F.col(f"o_{x}"))
    return g.select("topic_id", "days", F.when(F.col("_c") > 0, F.col("c_new")).alias("c_new"), pick("new").alias("b_new"), "c_creators", pick("creators").alias("b_creators"), "c_level", F.coalesce("b_level", "o_level").alias("b_level"))


def topic_trend(items: DataFrame, snapshots: DataFrame, scores: DataFrame, now: dt.datetime, upvoting: str) -> DataFrame:
    """One row per topic: trend score or the reason for none, confidence, components and the windows behind them."""
    w = topic_windows(topic_days(items, snapshots, upvoting), now)
    members = items.groupBy("topic_id").agg(F.count(F.lit(1)).alias("members"), F.min("published_at").alias("since"))
    dens = scores.where("score is not null").groupBy("topic_id").agg(F.count(F.lit(1)).alias("scored"), F.count_if(F.col("score") >= TREND["burst_threshold"]).alias("bursting"))
    j = members.join(w, "topic_id", "left").join(dens, "topic_id", "left")
    c = F.col
    density = c("bursting") / c("scored")
    gain = c("c_new") - c("b_new")
    parts = {
        "content_growth": growth(c("c_new"), c("b_new")),
        "engagement_growth": growth(c("c_level"), c("b_level")),
        "creator_growth": growth(c("c_creators"), c("b_creators")),
        "burst_density": F.when(density.isNotNull(), F.least(F.lit(100.0), F.lit(100.0) * density / 0.3)),
        "acceleration": F.lit(50.0) + F.lit(50.0) * clamp(gain / F.greatest(c("b_new"), F.lit(3)), -1.0, 1.0),
    }
    parts["acceleration"] = F.when(gain.isNotNull(), parts["acceleration"])
    score, used = weighted({k: (v, TREND["weights"][k]) for k, v in parts.items()})
    reason = F.when(c("members") < TREND["min_members"], "insufficient_members").when(used == 0, "insufficient_snapshots")
    conf = F.lit(1.0) - F.when(c("members") < 10, 0.15).otherwise(0.0) - F.when(F.coalesce("days", F.lit(0)) < 3, 0.15).otherwise(0.0)
    conf = half_up(clamp(conf - F.when(F.coalesce(c("scored") / c("members"), F.lit(0.0)) <= 0.5, 0.2).otherwise(0.0), 0.0, 1.0) + F.lit(1e-9), 2)
    ok = reason.isNull()
    return j.select(
        "topic_id", "members", "since", reason.alias("reason"), F.when(ok, half_up(score, 1)).alias("score"), F.when(ok, conf).alias("confidence_score"),
        F.when(ok, label(conf)).alias("confidence"), *[half_up(v, 6).alias(k) for k, v in parts.items()], half_up(density, 6).alias("density"),
        c("c_new").cast("long").alias("recent_new"), c("b_new").cast("long").alias("baseline_new"), c("c_creators").cast("long").alias("creators"), c("b_creators").cast("long").alias("baseline_creators"),
    )


def lifecycle(trend: DataFrame, now: dt.datetime, history: Column | None = None) -> DataFrame:
    """trend with state: the first rule that holds of declining, emerging, peak, rising, saturated, evergreen, then
    the fallbacks; unknown without a score or with fewer than three members. history: earlier scores, oldest first."""
    p, c = LIFECYCLE, F.col
    past = history if history is not None else F.array().cast("array<double>")
    recent, base, score = c("recent_new"), c("baseline_new"), c("score")
    low = F.slice(past, -p["declining_low"], p["declining_low"])
    streak = F.when(F.size(past) >= p["declining_low"], F.forall(low, lambda x: x < p["declining_trend_max"])).otherwise(F.lit(False))
    mean = F.aggregate(past, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(past), F.lit(0))
    spread = F.sqrt(F.aggregate(past, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.nullif(F.size(past) - 1, F.lit(0)))
    age = hours_between(F.col("since"), at(now)) / 24
    ratio = F.when(base > 0, recent / base)
    density = F.coalesce("density", F.lit(0.0))
    shrinking = F.coalesce(c("creators") <= c("baseline_creators"), F.lit(False))
    zero = lambda x: F.coalesce(x, F.lit(0))
    yes = lambda x: F.coalesce(x, F.lit(False))
    state = (
        F.when(score.isNull() | (c("members") < 3), "unknown")
        .when(yes((recent == 0) & (zero(base) >= 3)) | (streak & (recent.isNull() | yes(recent <= zero(base)))), "declining")
        .when(yes(age <= p["emerging_max_age_days"]) & (c("members") <= p["emerging_max_members"]) & (zero(recent) > 0), "emerging")
        .when((c("members") >= p["peak_min_members"]) & (density >= p["peak_min_density"]) & (score >= p["peak_trend_min"]), "peak")
        .when((score >= p["rising_trend_min"]) & (zero(recent) > zero(base)) & ~shrinking & yes(F.coalesce(recent - base >= 0, F.lit(True))), "rising")
        .when((c("members") >= p["saturated_min_members"]) & yes(ratio.between(*p["saturated_band"])) & (density < p["peak_min_density"]), "saturated")
        .when(yes(age >= p["evergreen_min_age_days"]) & F.coalesce(spread <= p["evergreen_max_volatility"], F.lit(True)), "evergreen")
        .when(shrinking | (yes(recent < base) & (score < 55)), "saturated")
        .when((score >= 55) & (zero(recent) >= 0), "rising")
        .otherwise("evergreen")
    )
    return trend.withColumn("state", state)


def settle(before: DataFrame, now_states: DataFrame) -> DataFrame:
    """A run's lifecycle after hysteresis, from the current table before it (topic_id, state, pending, confirmations,
    score) and the run's raw states (topic_id, state, score).

    A new state becomes current once it is seen in two runs in a row, or at once if the score jumps by 25; an
    unscorable run keeps state and score but forgets what is pending.
    """
    b = before.select("topic_id", F.col("state").alias("_was"), F.col("pending").alias("_pending"), F.col("confirmations").alias("_n"), F.col("score").alias("_score"))
    j = now_states.join(b, "topic_id", "left")
    c = F.col
    unscored = c("state") == "unknown"
    first, same = c("_was").isNull() | (c("_was") == "unknown"), c("state") == c("_was")
    jump = F.coalesce(F.abs(c("score") - c("_score")) >= LIFECYCLE["strong_jump"], F.lit(False))
    n = F.when(c("state") == c("_pending"), c("_n") + 1).otherwise(F.lit(1))
    change = first | jump | (n >= LIFECYCLE["confirmations"])
    waits = ~unscored & ~F.coalesce(same, F.lit(False)) & ~change
    return j.select(
        "topic_id", F.when(unscored, F.coalesce("_was", "state")).when(waits, c("_was")).otherwise(c("state")).alias("state"),
        F.when(waits, c("state")).alias("pending"), F.when(waits, n).otherwise(F.lit(0)).alias("confirmations"),
        F.when(unscored, c("_score")).otherwise(c("score")).alias("score"), (~unscored & ~F.coalesce(same, F.lit(False)) & change & ~first).alias("changed"),
    )
