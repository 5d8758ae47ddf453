"""What sets viral content apart, how saturated a topic is, which angles are new, and where the opportunity lies."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.stats import clamp, concentration, half_up, label, low_quantile_at, order_statistics, quantiles, weighted
from tidewell.operators.graph import components, saved
from tidewell.operators.identity import claims
from tidewell.operators.momentum import at, hours_between
from tidewell.operators.scoring import same_keys
from tidewell.operators.similarity import centroids, cosine, edges
from tidewell.profiles import NOVELTY, OPPORTUNITY, PATTERN, SATURATION


def control_ladder(items: DataFrame, group: str, viral: str, attributes: list[str], everywhere: str | None = None, min_viral: int = PATTERN["min_viral"], min_control: int = PATTERN["min_control"]) -> DataFrame:
    """Rows (group, item_id, level): the controls of each group with enough viral items, at the finest level that has
    enough: sharing all attributes' values with some viral item of the group, then one attribute less from the left
    to right order given, then any of the group. A group without enough there takes, given the attribute `everywhere`,
    the items of all groups that share its value with a viral item of the group, if they are enough; else it is left out."""
    hot = items.where(viral)
    enough = hot.groupBy(group).agg(F.count(F.lit(1)).alias("_nv")).where(F.col("_nv") >= min_viral).select(F.col(group).alias("_g"))
    pool = items.where(f"not {viral}").join(enough, F.col(group) == F.col("_g")).drop("_g")
    for a in attributes:
        values = hot.select(F.col(group).alias("_g"), F.col(a).alias("_v")).distinct()
        pool = pool.join(values, (F.col(group) == F.col("_g")) & F.col(a).eqNullSafe(F.col("_v")), "left").withColumn(f"_has_{a}", F.col("_g").isNotNull()).drop("_g", "_v")
    level = F.lit(len(attributes))
    for n in range(len(attributes)):  # level n drops the n last attributes
        match = F.lit(True)
        for a in attributes[: len(attributes) - n]:
            match = match & F.col(f"_has_{a}")
        level = F.when(match, F.least(level, F.lit(n))).otherwise(level)
    pool = pool.withColumn("_level", level)
    sizes = pool.groupBy(F.col(group).alias("_g")).agg(*[F.count_if(F.col("_level") <= n).alias(f"_n{n}") for n in range(len(attributes) + 1)])
    pick = F.lit(None).cast("int")
    for n in reversed(range(len(attributes) + 1)):
        pick = F.when(F.col(f"_n{n}") >= min_control, F.lit(n)).otherwise(pick)
    chosen = sizes.select("_g", pick.alias("level")).where("level is not null")
    out = pool.join(chosen, F.col(group) == F.col("_g")).where("_level <= level").select(group, "item_id", "level")
    if everywhere is None:
        return out
    poor = enough.join(chosen.select("_g"), "_g", "left_anti")
    values = hot.join(poor, F.col(group) == F.col("_g")).select("_g", F.col(everywhere).alias("_v")).distinct()
    mine = hot.select(F.col(group).alias("_g"), "item_id")
    wide = saved(items.select("item_id", F.col(everywhere).alias("_x")).join(values, F.col("_x") == F.col("_v")).select("_g", "item_id").distinct().join(mine, ["_g", "item_id"], "left_anti"))
    some = wide.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_control).select(F.col("_g").alias("_h"))
    return out.union(wide.join(some, F.col("_g") == F.col("_h")).select("_g", "item_id", F.lit(len(attributes) + 1)))


def boolean_lift(rows: DataFrame, group: str, side: str, features: list[str]) -> DataFrame:
    """(group, feature, viral_rate, control_rate, lift, delta, direction, quality) of boolean features, side being
    true for viral rows; if either side has no hit, both rates are smoothed by one hit in two trials."""
    long = rows.select(group, side, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("hit")) for f in features])).alias("x")).select(group, side, "x.feature", "x.hit")
    g = long.groupBy(group, "feature").agg(F.count_if(side).alias("nv"), F.count_if(~F.col(side)).alias("nc"), F.count_if(F.col(side) & F.col("hit")).alias("hv"), F.count_if(~F.col(side) & F.col("hit")).alias("hc")).where("nv > 0 and nc > 0")
    zero = (F.col("hv") == 0) | (F.col("hc") == 0)
    v, c = (F.when(zero, (F.col(h) + 1) / (F.col(n) + 2)).otherwise(F.col(h) / F.col(n)) for h, n in (("hv", "nv"), ("hc", "nc")))
    direction = F.when(v / c > 1.15, "positive").when(v / c < 0.87, "negative").otherwise("none")
    return g.select(group, "feature", half_up(v, 6).alias("viral_rate"), half_up(c, 6).alias("control_rate"), half_up(v / c, 6).alias("lift"), half_up(v - c, 6).alias("delta"), direction.alias("direction"), evidence(F.least("nv", "nc")).alias("quality"), zero.alias("smoothed"))


def evidence(n: Column) -> Column:
    return F.when(n >= PATTERN["high"], "high").when(n >= PATTERN["medium"], "medium").otherwise("low")


def _sides(long: DataFrame, group: str, side: str, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """(group, feature, nv, nc, wanted quantiles) of rows (group, side, feature, x): xv are the values of the side, xc the
    others'."""
    two = long.select(group, "feature", F.when(F.col(side), F.col("x")).alias("xv"), F.when(~F.col(side), F.col("x")).alias("xc"))
    n = two.groupBy(F.col(group).alias("_g"), F.col("feature").alias("_f")).agg(F.count("xv").alias("nv"), F.count("xc").alias("nc"))
    return quantiles(two, [group, "feature"], wanted).join(n, F.col(group).eqNullSafe(F.col("_g")) & (F.col("feature") == F.col("_f"))).drop("_g", "_f")


def continuous_compare(rows: DataFrame, group: str, side: str, values: list[str]) -> DataFrame:
    """(group, feature, medians, quartiles, delta, direction) of continuous features on the two sides."""
    long = rows.select(group, side, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in values])).alias("y")).select(group, side, "y.feature", "y.x").where("x is not null")
    g = _sides(long, group, side, {"v25": ("xv", 0.25), "v": ("xv", 0.5), "v75": ("xv", 0.75), "c": ("xc", 0.5)}).where("nv > 0 and nc > 0")
    v, c = F.col("v"), F.col("c")
    ratio = (v - c) / F.when(F.abs(c) > 1e-9, F.abs(c)).otherwise(1.0)
    direction = F.when(ratio > 0.15, "positive").when(ratio < -0.15, "negative").otherwise("none")
    return g.select(group, "feature", half_up(v, 6).alias("viral_median"), half_up(c, 6).alias("control_median"), half_up(F.col("v25"), 6).alias("viral_p25"), half_up(F.col("v75"), 6).alias("viral_p75"), half_up(v - c, 6).alias("delta"), direction.alias("direction"))


def semantic_compare(rows: DataFrame, group: str, side: str, values: list[str], least: int = 3) -> DataFrame:
    """(group, feature, viral_median, control_median, delta, direction) of semantic numbers from 0 to 1; a feature needs
    `least` known values on each side, and a difference of medians over 0.1 to have a direction."""
    long = rows.select(group, side, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in values])).alias("y")).select(group, side, "y.feature", "y.x").where("x is not null")
    g = _sides(long, group, side, {"v": ("xv", 0.5), "c": ("xc", 0.5)}).where((F.col("nv") >= least) & (F.col("nc") >= least))
    d = half_up(F.col("v") - F.col("c"), 6)
    return g.select(group, "feature", half_up(F.col("v"), 6).alias("viral_median"), half_up(F.col("c"), 6).alias("control_median"), d.alias("delta"), F.when(d > 0.1, "positive").when(d < -0.1, "negative").otherwise("none").alias("direction"))


def categorical_share(rows: DataFrame, group: str, side: str, value: str) -> DataFrame:
    """(group, top, delta): the value whose share differs most between the sides; ties by value."""
    n = rows.groupBy(F.col(group).alias("_g")).agg(F.count_if(side).alias("nv"), F.count_if(~F.col(side)).alias("nc")).where("nv > 0 and nc > 0")
    t = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count_if(side).alias("v"), F.count_if(~F.col(side)).alias("c")).join(n, F.col(group) == F.col("_g"))
    d = half_up(F.col("v") / F.col("nv") - F.col("c") / F.col("nc"), 6)
    best = t.withColumn("d", d).groupBy(group).agg(F.min(F.struct((-F.abs("d")).alias("k"), F.col(value).alias("top"), F.col("d").alias("d"))).alias("b"))
    return best.select(group, "b.top", F.col("b.d").alias("delta"))


def nearest(vectors: DataFrame, group: str, newest: str, most: int = SATURATION["most_members"]) -> DataFrame:
    """(group, id, sim): each member's largest cosine to another member, among the `most` newest of its group.

    The cap is the score's own definition; it also bounds what one task holds.
    """
    top = vectors.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc_nulls_last(newest), "id"))).where(F.col("_r") <= most).select(group, "id", "v")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        u = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-300)
        s = np.clip(u @ u.T, -1, 1)
        np.fill_diagonal(s, -1.0)
        out = pd.DataFrame({group: pdf[group], "id": pdf["id"], "sim": s.max(axis=1)})
        return out[out["sim"] >= 0] if len(pdf) > 1 else out[:0]

    return top.where("v is not null").groupBy(group).applyInPandas(run, f"{group} {dict(top.dtypes)[group]}, id long, sim double")


def saturation(members: DataFrame, near: DataFrame, now: dt.datetime) -> DataFrame:
    """One row per topic of members (topic_id, item_id, author_id, published_at) and near (topic_id, id, sim):
    score or reason, and the five components."""
    p = SATURATION
    recent = F.col("published_at") >= at(now, days=7)
    g = members.groupBy("topic_id").agg(F.count(F.lit(1)).alias("members"), F.min("published_at").alias("since"), F.count_if(recent).alias("recent"))
    nn = near.groupBy("topic_id").agg(F.avg("sim").alias("mean_sim"), F.avg((F.col("sim") >= p["repetition_at"]).cast("double")).alias("repeats"), F.count(F.lit(1)).alias("n_sim"))
    j = g.join(nn, "topic_id", "left").join(concentration(members, "topic_id", "author_id"), "topic_id", "left")
    age = F.greatest(F.lit(0.5), hours_between(F.col("since"), at(now)) / 24)
    parts = {
        "volume": F.when(F.col("since").isNotNull(), F.least(F.lit(100.0), 100.0 * (F.col("members") / age) / p["volume_per_day"])),
        "frequency": F.least(F.lit(100.0), 100.0 * (F.col("recent") / 7.0) / p["frequency_per_day"]),
        "angle_similarity": F.when(F.col("n_sim") >= 2, F.col("mean_sim") * 100.0),
        "repetition": F.when(F.col("n_sim") >= 2, F.col("repeats") * 100.0),
        "concentration": F.col("concentration") * 100.0,
    }
    score, _ = weighted({k: (c, p["weights"][k]) for k, c in parts.items()})
    reason = F.when(F.col("members") < p["min_members"], "insufficient_members")
    conf = F.lit(1.0) - F.when(F.col("members") < 10, 0.15).otherwise(0.0) - F.when(F.col("recent") < 5, 0.1).otherwise(0.0)
    conf = conf - F.when(F.coalesce("n_sim", F.lit(0)) / F.least("members", F.lit(p["most_members"])) < 0.5, 0.15).otherwise(0.0)
    return j.select("topic_id", "members", reason.alias("reason"), F.when(reason.isNull(), half_up(score, 1)).alias("score"), F.when(reason.isNull(), label(conf)).alias("confidence"), *[half_up(c, 6).alias(k) for k, c in parts.items()])


def angles(members: DataFrame, known: DataFrame, now: dt.datetime) -> DataFrame:
    """The angles of each topic: topic_id, angle (smallest member), members, inherited, nearest_known, emerging, novelty.

    members: topic_id, id, v, author_id, published_at; known: topic_id, angle_id, centroid. All members of a topic are
    joined at cosine 0.6, block by block; angles by size (ties by angle) take the nearest known centroid left, from 0.6
    up. An angle of three or more that inherits nothing, was first seen within a week and is unlike every known one is
    emerging. Members without a vector or a topic belong to no angle.
    """
    p, c = NOVELTY, F.col
    m = members.where("v is not null and topic_id is not null")
    roots = components(edges(m.select("topic_id", "id", "v"), p["same_angle"], space="topic_id", joined=True).select("a", "b"))
    m = saved(m.join(roots, c("id") == c("node"), "left").withColumn("angle", F.coalesce("root", "id")).drop("node", "root"))
    cut = c("published_at") >= at(now, days=p["recent_days"])
    g = m.groupBy("topic_id", "angle").agg(F.count(F.lit(1)).alias("members"), F.count_if(cut).alias("fresh"), F.min("published_at").alias("since"), F.count_distinct("author_id").alias("authors"))
    k = known.select(c("topic_id").alias("_t"), "angle_id", "centroid")
    near = g.join(centroids(m, "angle").select(c("angle").alias("_a"), c("centroid").alias("_c")), c("angle") == c("_a")).join(k, c("topic_id") == c("_t"))
    near = saved(near.select("topic_id", "angle", "members", "angle_id", cosine(c("_c").cast("array<double>"), c("centroid").cast("array<double>")).alias("sim")))

    heirs = claims(near.where(c("sim") >= p["identity"]), "topic_id", "angle", "angle_id", "members", "sim").toDF("_angle", "inherited")
    g = g.join(heirs, c("angle") == c("_angle"), "left").drop("_angle")
    others = near.join(heirs, c("angle") == c("_angle"), "left").where(c("inherited").isNull() | (c("angle_id") != c("inherited")))
    g = g.join(others.groupBy(c("angle").alias("_o")).agg(F.max("sim").alias("nearest_known")), c("angle") == c("_o"), "left")
    enough, far, w = c("members") >= p["min_members"], c("nearest_known"), p["weights"]
    emerging = c("inherited").isNull() & enough & F.coalesce(c("since") >= at(now, days=p["recent_days"]), F.lit(False)) & (far.isNull() | (far < p["new_below"]))
    score = w["distance"] * F.when(far.isNull(), 100.0).otherwise((1 - far) * 100) + w["growth"] * F.least(F.lit(100.0), 100.0 * c("fresh") / c("members") / 0.6)
    score = score + w["adequacy"] * F.least(F.lit(100.0), 100.0 * c("members") / p["min_members"]) + w["diversity"] * 100.0 * c("authors") / c("members")
    return g.select("topic_id", "angle", c("members").cast("int").alias("members"), "inherited", "nearest_known", emerging.alias("emerging"), F.when(enough, half_up(score, 1)).alias("novelty"))


def topic_novelty(found: DataFrame) -> DataFrame:
    """(topic_id, novelty, emerging_angles, novelty_confidence) from angles: the best emerging one, else 0. Confidence
    is high with ten members in angles, medium with three, else low."""
    n = F.sum("members")
    return found.groupBy("topic_id").agg(F.coalesce(F.max(F.when(F.col("emerging"), F.col("novelty"))), F.lit(0.0)).alias("novelty"), F.count_if("emerging").alias("emerging_angles"), F.when(n >= 10, "high").when(n >= 3, "medium").otherwise("low").alias("novelty_confidence"))


def persisted_angles(stored: DataFrame, found: DataFrame) -> DataFrame:
    """The stored angles after a run: (angle_id, topic_id, label, status, members) from stored (angle_id, topic_id, label)
    and found (angle, topic_id, inherited, members). An inherited one is updated and keeps its label, one that nothing
    inherits turns inactive, a found one without an heir's place is new."""
    f = found.select(F.col("topic_id").alias("_t"), "angle", "inherited", F.col("members").alias("_m"))
    j = stored.select("angle_id", "topic_id", "label").join(f, F.col("angle_id") == F.col("inherited"), "full")
    status = F.when(F.col("angle_id").isNull(), "new").when(F.col("angle").isNull(), "inactive").otherwise("active")
    return j.select(F.coalesce("angle_id", "angle").alias("angle_id"), F.coalesce("topic_id", "_t").alias("topic_id"), "label", status.alias("status"), F.coalesce("_m", F.lit(0)).cast("long").alias("members"))


def burst_opportunity(scores: DataFrame, now: dt.datetime) -> DataFrame:
    """(topic_id, burst, coverage, recent_bursts, density) from (topic_id, score, published_at); a topic with nothing
    scored has nulls for all four."""
    m = OPPORTUNITY["burst_mix"]
    hot = (F.col("score") >= 80) & (F.col("published_at") >= at(now, days=7))
    g = scores.groupBy("topic_id").agg(F.count("score").alias("scored"), F.count(F.lit(1)).alias("all"), F.count_if(F.col("score") >= 80).alias("bursting"), F.count_if(hot).alias("recent_bursts"))
    g = same_keys(g, order_statistics(scores, ["topic_id"], {"p75": ("score", low_quantile_at(0.75))}), ["topic_id"])
    some = lambda x: F.when(F.col("scored") > 0, x)
    density = some(F.least(F.lit(100.0), F.lit(100.0) * (F.col("bursting") / F.nullif(F.col("scored"), F.lit(0))) / 0.3))
    score = clamp(m["density"] * density + m["p75"] * F.col("p75") + m["recent"] * F.least(F.lit(100.0), F.col("recent_bursts") * 20.0))
    return g.select("topic_id", half_up(score, 1).alias("burst"), some(half_up(F.col("scored") / F.col("all"), 6)).alias("coverage"), some(F.col("recent_bursts")).alias("recent_bursts"), half_up(density, 6).alias("density"))


def pattern_strength(patterns: DataFrame, most: int = 40) -> DataFrame:
    """(topic_id, pattern) from (topic_id, quality, effect, n): 20 and 12 points for high and medium evidence, scaled
    by effect, over the 40 newest; 100 at most."""
    w = Window.partitionBy("topic_id").orderBy("n")
    p = patterns.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    e = F.least(F.lit(1.0), F.col("effect"))
    points = F.when(F.col("quality") == "high", 20 * (0.6 + 0.4 * e)).when(F.col("quality") == "medium", 12 * (0.6 + 0.4 * e)).otherwise(0.0)
    good = F.col("quality").isin("high", "medium")
    return p.groupBy("topic_id").agg(half_up(F.least(F.lit(100.0), F.sum(points) + 20 * F.coalesce(F.max(F.when(good, e)), F.lit(0.0))), 6).alias("pattern"))


def opportunity(topics: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """topics (topic_id, members, trend, state, burst, density, coverage, novelty, emerging_angles, saturation, pattern,
    high_patterns, quality_mode, trend_age_hours, intel_age_hours and the *_confidence columns; those that are missing
    are unknown) with score or reason, level, confidence, and reason codes in a fixed order."""
    kinds = {"state": "string", "quality_mode": "string", "trend_confidence": "string", "novelty_confidence": "string", "saturation_confidence": "string"}
    for name in ("members", "trend", "state", "burst", "density", "coverage", "novelty", "emerging_angles", "saturation", "pattern", "high_patterns", "quality_mode", "trend_age_hours", "intel_age_hours", "trend_confidence", "novelty_confidence", "saturation_confidence"):
        if name not in topics.columns:
            topics = topics.withColumn(name, F.lit(None).cast(kinds.get(name, "double")))
    w, c, o = weights or OPPORTUNITY["balanced"], F.col, OPPORTUNITY
    yes = lambda x: F.coalesce(x, F.lit(False))
    fit = F.lit(None).cast("double")
    for state, value in o["lifecycle_fit"].items():
        fit = F.when(c("state") == state, F.lit(float(value))).otherwise(fit)
    raw = {"trend": c("trend"), "burst": c("burst"), "novelty": c("novelty"), "whitespace": clamp(100.0 - c("saturation")), "pattern": c("pattern"), "lifecycle": fit}
    n = sum((x.isNotNull().cast("int") for x in raw.values()), F.lit(0))
    score, _ = weighted({k: (x, w[k]) for k, x in raw.items()})
    reason = F.when(n < o["min_components"], "INSUFFICIENT_COMPONENTS").when(c("trend").isNull() & c("novelty").isNull(), "NO_CORE_EVIDENCE")
    worth = lambda x: F.when(x == "high", 1.0).when(x == "medium", 0.7).when(x == "low", 0.4).otherwise(0.55)
    upstream = [(c("trend"), c("trend_confidence")), (c("novelty"), c("novelty_confidence")), (raw["whitespace"], c("saturation_confidence"))]
    k = sum((x.isNotNull().cast("int") for x, _ in upstream), F.lit(0))
    mean = sum((F.when(x.isNotNull(), worth(said)).otherwise(0.0) for x, said in upstream), F.lit(0.0)) / F.nullif(k, F.lit(0))
    few = F.coalesce("members", F.lit(0)) < o["few_members"]
    lexical, thin = yes(c("quality_mode") == "lexical_baseline"), yes(c("coverage") < o["low_coverage"])
    old_trend, old_intel = yes(c("trend_age_hours") > o["trend_max_age_hours"]), yes(c("intel_age_hours") > o["intel_max_age_hours"])
    conf = F.coalesce(mean, F.lit(1.0)) - F.when(few, 0.2).otherwise(0.0)
    for lacks in (lexical, thin, old_trend, old_intel):
        conf = conf - F.when(lacks, 0.1).otherwise(0.0)
    conf = clamp(conf, 0.0, 1.0)
    codes = [
        (c("trend") >= 60, "HIGH_TREND"), (c("state") == "rising", "RISING_LIFECYCLE"), (c("state") == "emerging", "EMERGING_LIFECYCLE"), (c("novelty") >= 60, "HIGH_NOVELTY"),
        (c("emerging_angles") > 0, "EMERGING_ANGLES"), (c("saturation") < 40, "LOW_SATURATION"), (c("saturation") >= 67, "HIGH_SATURATION"), (c("density") >= 25, "STRONG_BURST_DENSITY"),
        (c("high_patterns") > 0, "CLEAR_VIRAL_PATTERNS"), (c("pattern").isNull(), "PATTERN_SAMPLE_INSUFFICIENT"), (few, "LOW_TOPIC_HISTORY"), (lexical, "LEXICAL_BASELINE_ONLY"), (thin, "LOW_BURST_COVERAGE"),
        (old_trend, "STALE_TREND"), (old_intel, "STALE_INTELLIGENCE"),
    ]
    said = F.array_join(F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in codes])), ",")
    ok, final = reason.isNull(), half_up(score, 1)
    level = F.when(score >= o["high"], "high").when(score >= o["medium"], "medium").otherwise("low")
    return topics.select("topic_id", *[half_up(x, 6).alias(f"c_{key}") for key, x in raw.items()], reason.alias("reason"), F.when(ok, final).alias("score"), F.when(ok, level).alias("level"), F.when(ok, half_up(conf + F.lit(1e-9), 2)).alias("confidence_score"), F.when(ok, label(conf)).alias("confidence"), F.when(ok, said).otherwise("").alias("codes"))


def why_changed(before: DataFrame, after: DataFrame, parts: list[str]) -> DataFrame:
    """(topic_id, delta, causes): the change of the score and the four largest changes of parts, name:change."""
    b = before.select(F.col("topic_id").alias("_t"), F.col("score").alias("_score"), *[F.col(p).alias(f"_{p}") for p in parts])
    j = after.join(b, F.col("topic_id") == F.col("_t"))
    d = [F.struct((-F.abs(half_up(F.coalesce(p, F.lit(0.0)) - F.coalesce(f"_{p}", F.lit(0.0)), 1))).alias("k"), F.lit(p).alias("p"), half_up(F.coalesce(p, F.lit(0.0)) - F.coalesce(f"_{p}", F.lit(0.0)), 1).alias("d")) for p in parts]
    top = F.slice(F.array_sort(F.filter(F.array(*d), lambda x: F.abs(x["d"]) > 0.05)), 1, 4)
    return j.select("topic_id", half_up(F.col("score") - F.col("_score"), 1).alias("delta"), F.array_join(F.transform(top, lambda x: F.concat(x["p"], F.lit(":"), x["d"].cast("string"))), ",").alias("causes"))
