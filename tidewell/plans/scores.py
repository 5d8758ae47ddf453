"""Registered queries over burst, trend and lifecycle scores."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidewell.functions.stats import half_up, percentile_of
from tidewell.operators import scoring as S
from tidewell.operators.graph import saved

from .views import EVENTS_SQL, NOW, ORDERS_SQL, UPVOTING, clocked_sql, event_items, event_snapshots, order_items, order_snapshots, seen_by

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_R6 = "floor(({}) * 1e6 + 0.5) / 1e6"


def _cohorts_sql(base: str, now: str, scale: int) -> str:
    cut = " ".join(f"WHEN h < {h * scale} THEN '{name}'" for name, h in (("0-6h", 6), ("6-24h", 24), ("1-3d", 72), ("3-7d", 168), ("7-30d", 720)))
    return f"""WITH {base},
aged AS (SELECT *, CASE WHEN published_at IS NULL THEN 'unknown' {cut} ELSE '30d+' END AS age FROM (SELECT *, greatest(0, (epoch(TIMESTAMP '{now}') - epoch(published_at)) / 3600.0) AS h FROM m1_items)),
sized AS (SELECT *, count(*) OVER (PARTITION BY platform, content_type, age, topic_id) AS n0, count(*) OVER (PARTITION BY platform, content_type, age) AS n1,
  count(*) OVER (PARTITION BY platform, age) AS n2, count(*) OVER (PARTITION BY platform) AS n3 FROM aged),
cohorts AS (SELECT item_id, platform, content_type, author_id, topic_id, published_at, age,
  CASE WHEN n0 >= 30 THEN 0 WHEN n1 >= 30 THEN 1 WHEN n2 >= 30 THEN 2 ELSE 3 END AS level,
  CASE WHEN n0 >= 30 THEN n0 WHEN n1 >= 30 THEN n1 WHEN n2 >= 30 THEN n2 ELSE n3 END AS cohort_size,
  CASE WHEN n0 >= 30 THEN platform || '|' || content_type || '|' || age || '|topic:' || topic_id WHEN n1 >= 30 THEN platform || '|' || content_type || '|' || age
    WHEN n2 >= 30 THEN platform || '|' || age ELSE platform END AS cohort, n0 < 30 AND n1 < 30 AND n2 < 30 AND n3 < 5 AS insufficient FROM sized)"""


_CLOCK = "2024-01-31"
_COHORTS = _cohorts_sql(EVENTS_SQL, _CLOCK, 1)


@query(f"{_COHORTS} SELECT item_id, age, cohort, level, cohort_size, insufficient FROM cohorts")
def cohort_ladder(spark, sf_dir):
    return S.cohorts(event_items(spark, sf_dir), NOW).select("item_id", "age", "cohort", "level", "cohort_size", "insufficient")


@query(f"{_COHORTS} SELECT age AS age_bucket, platform, count(*) AS items FROM cohorts GROUP BY 1, 2")
def age_buckets(spark, sf_dir):
    items = event_items(spark, sf_dir)
    return items.groupBy(S.age_bucket(F.col("published_at"), NOW).alias("age_bucket"), "platform").agg(F.count(F.lit(1)).alias("items"))


def _velocity(name: int, now: str, scale: int, up: str) -> str:
    k, hours = f"h{name}", name * scale
    return f"""{k} AS (SELECT item_id, (dm * 1.0) / span AS v FROM (SELECT f.item_id, (epoch(l.captured_at) - epoch(f.captured_at)) / 3600.0 AS span,
  coalesce(CASE WHEN platform = '{up}' THEN l.upvotes - f.upvotes ELSE l.likes - f.likes END, 0) + coalesce(2 * (l.comments - f.comments), 0) + coalesce(3 * (l.shares - f.shares), 0) + coalesce(2 * (l.favorites - f.favorites), 0) AS dm,
  coalesce(CASE WHEN platform = '{up}' THEN l.upvotes - f.upvotes ELSE l.likes - f.likes END, l.comments - f.comments, l.shares - f.shares, l.favorites - f.favorites) AS known
  FROM (SELECT item_id, min(captured_at) AS t0, max(captured_at) AS t1, count(*) AS n FROM m1_snapshots WHERE captured_at >= TIMESTAMP '{now}' - INTERVAL {hours} HOUR AND captured_at <= TIMESTAMP '{now}' GROUP BY 1) w
  JOIN m1_snapshots f ON f.item_id = w.item_id AND f.captured_at = w.t0 JOIN m1_snapshots l ON l.item_id = w.item_id AND l.captured_at = w.t1 JOIN m1_items i ON i.item_id = w.item_id WHERE n >= 2) WHERE span > 0 AND known IS NOT NULL)"""


def _observed_sql(base: str, now: str, scale: int = 1, up: str = "zeta") -> str:
    return f"""{_cohorts_sql(base, now, scale)}, {', '.join(_velocity(h, now, scale, up) for h in (24, 72, 168, 6))},
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY captured_at DESC) AS r, count(*) OVER (PARTITION BY item_id) AS snapshots,
  min(captured_at) OVER (PARTITION BY item_id) AS since FROM m1_snapshots WHERE captured_at <= TIMESTAMP '{now}') WHERE r = 1),
o AS (SELECT c.*, coalesce(h24.v, h72.v, h168.v) AS velocity, CASE WHEN h24.v IS NOT NULL THEN '24h' WHEN h72.v IS NOT NULL THEN '72h' WHEN h168.v IS NOT NULL THEN '7d' END AS velocity_window,
  h6.v AS v6, h24.v AS v24, h72.v AS v72, h168.v AS v168, l.views, CASE WHEN platform = '{up}' THEN l.upvotes ELSE l.likes END AS main, l.comments, l.shares, l.favorites,
  coalesce(l.snapshots, 0) AS snapshots, CASE WHEN l.snapshots >= 2 THEN (epoch(l.captured_at) - epoch(l.since)) / 3600.0 END AS span_hours
  FROM cohorts c LEFT JOIN h6 USING (item_id) LEFT JOIN h24 USING (item_id) LEFT JOIN h72 USING (item_id) LEFT JOIN h168 USING (item_id) LEFT JOIN latest l USING (item_id)),
obs AS (SELECT *, CASE WHEN main + comments + shares + favorites = 0 THEN 0.0 ELSE CAST(comments + shares + favorites AS DOUBLE) / (main + comments + shares + favorites) END AS ratio,
  CASE WHEN coalesce(main, comments, shares, favorites) IS NOT NULL THEN coalesce(main, 0) + coalesce(comments, 0) + coalesce(shares, 0) + coalesce(favorites, 0) END AS total FROM o)"""


_OBSERVED = _observed_sql(EVENTS_SQL, _CLOCK)


@query(f"{_OBSERVED} SELECT item_id, velocity_window, {_R6.format('v6')} AS v6, {_R6.format('v24')} AS v24, {_R6.format('v72')} AS v72, {_R6.format('v168')} AS v168, snapshots, {_R6.format('span_hours')} AS span_hours FROM obs")
def velocity_windows(spark, sf_dir):
    o = S.observations(event_items(spark, sf_dir), event_snapshots(spark, sf_dir), NOW, UPVOTING)
    return o.select("item_id", "velocity_window", *[half_up(F.col(f"v_{k}"), 6).alias(n) for k, n in (("6h", "v6"), ("24h", "v24"), ("72h", "v72"), ("7d", "v168"))], "snapshots", half_up(F.col("span_hours"), 6).alias("span_hours"))


@query(f"{_OBSERVED} SELECT item_id, {_R6.format('ratio')} AS engagement_ratio, total FROM obs")
def engagement_quality(spark, sf_dir):
    o = S.observations(event_items(spark, sf_dir), event_snapshots(spark, sf_dir), NOW, UPVOTING)
    return o.select("item_id", half_up(F.col("ratio"), 6).alias("engagement_ratio"), F.col("total").cast("long").alias("total"))


def _rank(value: str, keys: str = "cohort") -> str:
    return f"CASE WHEN {value} IS NOT NULL THEN 100.0 * ((rank() OVER (PARTITION BY {keys} ORDER BY {value} NULLS LAST) - 1) + 0.5 * count(*) OVER (PARTITION BY {keys}, {value})) / count({value}) OVER (PARTITION BY {keys}) END"


def parts_sql(base: str, now: str, scale: int = 1, up: str = "zeta") -> str:
    """Burst scores as common table expressions, the last of them named burst."""
    return f"""{_observed_sql(base, now, scale, up)}, ranked AS (SELECT *, {_rank('velocity')} AS p_velocity, {_rank('views')} AS p_views, {_rank('ratio')} AS p_ratio, {_rank('total')} AS p_total,
  {_rank('main')} AS p_main, {_rank('comments')} AS p_comments, {_rank('shares')} AS p_shares, {_rank('favorites')} AS p_favorites,
  count(total) OVER (PARTITION BY platform, author_id) - 1 AS others,
  100.0 * ((rank() OVER (PARTITION BY platform, author_id ORDER BY total NULLS LAST) - 1) + 0.5 * (count(*) OVER (PARTITION BY platform, author_id, total) - 1)) / nullif(count(total) OVER (PARTITION BY platform, author_id) - 1, 0) AS among FROM obs),
parts AS (SELECT *, CASE WHEN others >= 5 AND total IS NOT NULL THEN others END AS history, coalesce(CASE WHEN others >= 5 AND total IS NOT NULL THEN among END, p_total) AS relative,
  (coalesce(p_main, 0) + coalesce(p_comments, 0) + coalesce(p_shares, 0) + coalesce(p_favorites, 0)) / nullif((p_main IS NOT NULL)::INT + (p_comments IS NOT NULL)::INT + (p_shares IS NOT NULL)::INT + (p_favorites IS NOT NULL)::INT, 0) AS structure FROM ranked),
sums AS (SELECT *, CASE WHEN p_velocity IS NULL THEN 0 ELSE 0.35 END::DOUBLE + CASE WHEN p_views IS NULL THEN 0 ELSE 0.2 END::DOUBLE + CASE WHEN p_ratio IS NULL THEN 0 ELSE 0.2 END::DOUBLE + CASE WHEN relative IS NULL THEN 0 ELSE 0.15 END::DOUBLE + CASE WHEN structure IS NULL THEN 0 ELSE 0.1 END::DOUBLE AS used,
  coalesce(p_velocity * 0.35::DOUBLE, 0) + coalesce(p_views * 0.2::DOUBLE, 0) + coalesce(p_ratio * 0.2::DOUBLE, 0) + coalesce(relative * 0.15::DOUBLE, 0) + coalesce(structure * 0.1::DOUBLE, 0) AS mass FROM parts),
said AS (SELECT *, CASE WHEN snapshots = 0 THEN 'insufficient_snapshots' WHEN used = 0 THEN 'insufficient_metrics' WHEN insufficient THEN 'insufficient_cohort' END AS reason,
  greatest(0, least(100, mass / nullif(used, 0))) AS raw, 1.0 - CASE WHEN snapshots < 2 THEN 0.3 ELSE 0 END - CASE WHEN snapshots >= 2 AND span_hours > 0 AND span_hours < 1 THEN 0.1 ELSE 0 END
  - CASE WHEN cohort_size < 10 THEN 0.2 WHEN cohort_size < 30 THEN 0.1 ELSE 0 END - CASE WHEN round(used, 9) <= 0.5 THEN 0.15 ELSE 0 END - CASE WHEN history IS NULL THEN 0.05 ELSE 0 END AS conf FROM sums),
burst AS (SELECT item_id, platform, topic_id, author_id, published_at, cohort, level, cohort_size, velocity_window, reason, CASE WHEN reason IS NULL THEN floor(raw * 10 + 0.5) / 10 END AS score,
  CASE WHEN reason IS NULL THEN floor((greatest(0, least(1, conf))::DOUBLE + 1e-9) * 100 + 0.5) / 100 END AS confidence_score,
  CASE WHEN reason IS NULL THEN CASE WHEN conf >= 0.75 THEN 'high' WHEN conf >= 0.45 THEN 'medium' ELSE 'low' END END AS confidence,
  {_R6.format('p_velocity')} AS p_velocity, {_R6.format('p_views')} AS p_views, {_R6.format('p_ratio')} AS p_ratio, {_R6.format('relative')} AS relative, {_R6.format('structure')} AS structure FROM said)"""


_PARTS = parts_sql(EVENTS_SQL, _CLOCK)


def _burst(spark, sf_dir):
    return S.burst(event_items(spark, sf_dir), event_snapshots(spark, sf_dir), NOW, UPVOTING)


@query(f"{_PARTS} SELECT item_id, {_R6.format('p_total')} AS rank_in_cohort FROM parts")
def mean_rank_percentile(spark, sf_dir):
    o = S.observations(S.cohorts(event_items(spark, sf_dir), NOW), event_snapshots(spark, sf_dir), NOW, UPVOTING)
    return percentile_of(o, ["cohort"], "total", "p").select("item_id", half_up(F.col("p"), 6).alias("rank_in_cohort"))


@query(f"{_PARTS} SELECT item_id, {_R6.format('relative')} AS relative, history FROM parts")
def creator_relative(spark, sf_dir):
    parts = S.burst_components(event_items(spark, sf_dir), event_snapshots(spark, sf_dir), NOW, UPVOTING)
    return parts.select("item_id", half_up(F.col("relative"), 6).alias("relative"), F.col("creator_history").alias("history"))


@query(f"{_PARTS} SELECT item_id, {_R6.format('structure')} AS structure FROM parts")
def structure_score(spark, sf_dir):
    parts = S.burst_components(event_items(spark, sf_dir), event_snapshots(spark, sf_dir), NOW, UPVOTING)
    return parts.select("item_id", half_up(F.col("structure"), 6).alias("structure"))


@query(f"{_PARTS} SELECT item_id, cohort, level, cohort_size, velocity_window, reason, score, confidence_score, confidence, p_velocity, p_views, p_ratio, relative, structure FROM burst")
def burst_score(spark, sf_dir):
    return _burst(spark, sf_dir).drop("platform", "topic_id", "author_id", "published_at")


@query(f"{_PARTS} SELECT item_id, platform, score, confidence FROM burst WHERE score >= 40 AND platform IN ('alpha', 'zeta') ORDER BY score DESC, item_id DESC LIMIT 20")
def content_score_list(spark, sf_dir):
    rows = _burst(spark, sf_dir).where((F.col("score") >= 40) & F.col("platform").isin("alpha", "zeta"))
    return rows.select("item_id", "platform", "score", "confidence").orderBy(F.desc_nulls_last("score"), F.desc("item_id")).limit(20)


@query(f"{_PARTS} SELECT platform, count(*) AS items, count(score) AS scored, count(CASE WHEN reason IS NOT NULL THEN 1 END) AS unscored, max(score) AS best, {_R6.format('median(score)')} AS middle, {_R6.format('stddev_samp(score)')} AS spread FROM burst GROUP BY 1")
def score_coverage(spark, sf_dir):
    return _burst(spark, sf_dir).groupBy("platform").agg(F.count(F.lit(1)).alias("items"), F.count("score").alias("scored"), F.count_if(F.col("reason").isNotNull()).alias("unscored"), F.max("score").alias("best"), half_up(F.median("score"), 6).alias("middle"), half_up(F.stddev_samp("score"), 6).alias("spread"))


@query(f"{parts_sql(ORDERS_SQL, '2001-08-01', 60, 'none')} SELECT item_id, cohort, reason, score, confidence FROM burst")
def burst_score_orders(spark, sf_dir):
    """Burst scores over all orders as items: windows sixty times as long, clock at 2001-08-01."""
    return S.burst(order_items(spark, sf_dir), order_snapshots(spark, sf_dir), dt.datetime(2001, 8, 1), "none", scale=60.0).select("item_id", "cohort", "reason", "score", "confidence")


def _growth(c: str, b: str) -> str:
    return f"CASE WHEN {c} IS NULL OR {b} IS NULL THEN NULL WHEN {b} <= 0 THEN CASE WHEN {c} > 0 THEN 100.0 ELSE 50.0 END WHEN {c} < 0 THEN 0.0 ELSE 100.0 * (CAST({c} AS DOUBLE) / {b}) / ((CAST({c} AS DOUBLE) / {b}) + 1) END"


def trend_sql(now: str = _CLOCK, history: str | None = None, prefix: str = "") -> str:
    """Trends and raw states at a clock, as common table expressions; history is SQL of an array of a topic's earlier
    scores, oldest first, and prefix what it needs."""
    past = history or "CAST([] AS DOUBLE[])"
    cut = lambda h: f"TIMESTAMP '{now}' - INTERVAL {h} HOUR"
    old = f"captured_at < {cut(336)}"
    upper = lambda x: f"list_extract(list_sort(list(CASE WHEN {old} THEN {x} END) FILTER (WHERE {old} AND {x} IS NOT NULL)), 1 + CAST(floor(count(CASE WHEN {old} THEN {x} END) / 2) AS BIGINT))"
    return f"""{parts_sql(prefix + clocked_sql(now), now)}, fresh AS (SELECT topic_id, CAST(date_trunc('day', published_at) AS TIMESTAMP) AS captured_at, count(*) AS fresh FROM m1_items GROUP BY 1, 2),
seen AS (SELECT topic_id, captured_at, count(DISTINCT author_id) AS creators, avg(CAST(CASE WHEN platform = 'zeta' THEN coalesce(upvotes, likes) ELSE likes END AS DOUBLE)) AS level FROM m1_snapshots JOIN m1_items USING (item_id) GROUP BY 1, 2),
days AS (SELECT topic_id, captured_at, coalesce(fresh, 0) AS fresh, creators, level FROM seen FULL JOIN fresh USING (topic_id, captured_at)),
win AS (SELECT topic_id, count(*) AS days, count(CASE WHEN captured_at >= {cut(168)} THEN 1 END) AS nc, count(CASE WHEN captured_at < {cut(168)} AND captured_at >= {cut(336)} THEN 1 END) AS nb,
  sum(CASE WHEN captured_at >= {cut(168)} THEN fresh END) AS cn, sum(CASE WHEN captured_at >= {cut(168)} THEN creators END) AS cc, avg(CASE WHEN captured_at >= {cut(168)} THEN level END) AS cl,
  sum(CASE WHEN captured_at < {cut(168)} AND captured_at >= {cut(336)} THEN fresh END) AS bn, sum(CASE WHEN captured_at < {cut(168)} AND captured_at >= {cut(336)} THEN creators END) AS bc,
  avg(CASE WHEN captured_at < {cut(168)} AND captured_at >= {cut(336)} THEN level END) AS bl, {upper('fresh')} AS onew, {upper('creators')} AS ocr, {upper('level')} AS olev FROM days WHERE captured_at <= TIMESTAMP '{now}' GROUP BY 1),
w2 AS (SELECT topic_id, days, CASE WHEN nc > 0 THEN cn END AS cn, CASE WHEN nb > 0 THEN bn ELSE onew END AS bn, cc, CASE WHEN nb > 0 THEN bc ELSE ocr END AS bc, cl, coalesce(bl, olev) AS bl FROM win),
dens AS (SELECT topic_id, count(*) AS scored, count(CASE WHEN score >= 80 THEN 1 END) AS bursting FROM burst WHERE score IS NOT NULL GROUP BY 1),
mem AS (SELECT topic_id, count(*) AS members, min(published_at) AS since FROM m1_items GROUP BY 1),
g AS (SELECT m.topic_id, members, since, days, cn, bn, cc, bc, scored, CAST(bursting AS DOUBLE) / scored AS density, {_growth('cn', 'bn')} AS content_growth, {_growth('cl', 'bl')} AS engagement_growth, {_growth('cc', 'bc')} AS creator_growth,
  least(100.0, 100.0 * (CAST(bursting AS DOUBLE) / scored) / 0.3::DOUBLE) AS bd0, 50.0 + 50.0 * greatest(-1.0, least(1.0, CAST(cn - bn AS DOUBLE) / greatest(bn, 3))) AS ac0 FROM mem m LEFT JOIN w2 USING (topic_id) LEFT JOIN dens USING (topic_id)),
g1 AS (SELECT *, CASE WHEN density IS NOT NULL THEN bd0 END AS burst_density, CASE WHEN cn IS NOT NULL AND bn IS NOT NULL THEN ac0 END AS acceleration FROM g),
g2 AS (SELECT *, CASE WHEN content_growth IS NULL THEN 0 ELSE 0.35 END + CASE WHEN engagement_growth IS NULL THEN 0 ELSE 0.25 END + CASE WHEN creator_growth IS NULL THEN 0 ELSE 0.15 END + CASE WHEN burst_density IS NULL THEN 0 ELSE 0.15 END + CASE WHEN acceleration IS NULL THEN 0 ELSE 0.1 END AS used,
  coalesce(content_growth * 0.35, 0) + coalesce(engagement_growth * 0.25, 0) + coalesce(creator_growth * 0.15, 0) + coalesce(burst_density * 0.15, 0) + coalesce(acceleration * 0.1, 0) AS mass FROM g1),
g3 AS (SELECT *, CASE WHEN members < 3 THEN 'insufficient_members' WHEN used = 0 THEN 'insufficient_snapshots' END AS reason,
  1.0 - CASE WHEN members < 10 THEN 0.15 ELSE 0 END - CASE WHEN coalesce(days, 0) < 3 THEN 0.15 ELSE 0 END - CASE WHEN coalesce(scored / members, 0) <= 0.5 THEN 0.2 ELSE 0 END AS conf FROM g2),
trend AS (SELECT topic_id, members, since, reason, CASE WHEN reason IS NULL THEN floor(greatest(0, least(100, mass / used)) * 10 + 0.5) / 10 END AS score, CASE WHEN reason IS NULL THEN floor((conf::DOUBLE + 1e-9) * 100 + 0.5) / 100 END AS confidence_score,
  CASE WHEN reason IS NULL THEN CASE WHEN conf >= 0.75 THEN 'high' WHEN conf >= 0.45 THEN 'medium' ELSE 'low' END END AS confidence, {_R6.format('content_growth')} AS content_growth, {_R6.format('engagement_growth')} AS engagement_growth, {_R6.format('creator_growth')} AS creator_growth,
  {_R6.format('burst_density')} AS burst_density, {_R6.format('acceleration')} AS acceleration, {_R6.format('density')} AS density, CAST(cn AS BIGINT) AS recent_new, CAST(bn AS BIGINT) AS baseline_new, CAST(cc AS BIGINT) AS creators, CAST(bc AS BIGINT) AS baseline_creators FROM g3),
life0 AS (SELECT *, (epoch(TIMESTAMP '{now}') - epoch(since)) / 86400.0 AS age_days, {past} AS past FROM trend),
life AS (SELECT *, len(past) >= 2 AND past[-1] < 40 AND past[-2] < 40 AS streak, CASE WHEN len(past) >= 2 THEN list_stddev_samp(past) END AS spread FROM life0),
states AS (SELECT *, CASE WHEN score IS NULL OR members < 3 THEN 'unknown' WHEN coalesce(recent_new = 0 AND coalesce(baseline_new, 0) >= 3, false) OR (streak AND (recent_new IS NULL OR recent_new <= coalesce(baseline_new, 0))) THEN 'declining'
  WHEN age_days <= 3 AND members <= 30 AND coalesce(recent_new, 0) > 0 THEN 'emerging' WHEN members >= 20 AND coalesce(density, 0) >= 0.25 AND score >= 70 THEN 'peak'
  WHEN score >= 60 AND coalesce(recent_new, 0) > coalesce(baseline_new, 0) AND NOT coalesce(creators <= baseline_creators, false) AND coalesce(recent_new - baseline_new >= 0, true) THEN 'rising'
  WHEN members >= 30 AND baseline_new > 0 AND recent_new / CAST(baseline_new AS DOUBLE) BETWEEN 0.4 AND 1.6 AND coalesce(density, 0) < 0.25 THEN 'saturated' WHEN age_days >= 30 AND coalesce(spread <= 8, true) THEN 'evergreen'
  WHEN coalesce(creators <= baseline_creators, false) OR coalesce(recent_new < baseline_new AND score < 55, false) THEN 'saturated' WHEN score >= 55 AND coalesce(recent_new, 0) >= 0 THEN 'rising' ELSE 'evergreen' END AS state FROM life)"""


def stored_events(spark, sf_dir):
    """Event items and snapshots, saved: what several parts and runs read is derived from the events once. Neither depends
    on a clock; a run takes what it may know of them."""
    return saved(event_items(spark, sf_dir)), saved(event_snapshots(spark, sf_dir))


def _trend(spark, sf_dir, now=NOW, stored=None):
    items, snapshots = seen_by(*(stored or stored_events(spark, sf_dir)), now)
    return S.topic_trend(items, snapshots, S.burst(items, snapshots, now, UPVOTING), now, UPVOTING)


_TREND = trend_sql()


@query(f"{_TREND} SELECT * EXCLUDE (since) FROM trend")
def topic_trend(spark, sf_dir):
    return _trend(spark, sf_dir).drop("since")


@query(f"{_TREND} SELECT topic_id, state, score FROM states")
def lifecycle_decision(spark, sf_dir):
    return S.lifecycle(_trend(spark, sf_dir), NOW).select("topic_id", "state", "score")


@query(f"{_TREND} SELECT topic_id, score, confidence, state, members FROM states WHERE score IS NOT NULL ORDER BY score DESC, members DESC, topic_id LIMIT 10")
def topic_trend_list(spark, sf_dir):
    rows = S.lifecycle(_trend(spark, sf_dir), NOW).where("score is not null")
    return rows.select("topic_id", "score", "confidence", "state", "members").orderBy(F.desc("score"), F.desc("members"), "topic_id").limit(10)


_CLOCKS = (dt.datetime(2024, 1, 17), dt.datetime(2024, 1, 24), NOW)


def runs(spark, sf_dir, clocks=_CLOCKS):
    """Raw states (topic_id, state, score) of runs at clocks, each knowing the rows up to its clock and the scores of the
    runs before it."""
    out, past, stored = [], [], stored_events(spark, sf_dir)
    for now in clocks:
        trend = saved(_trend(spark, sf_dir, now, stored))
        known = trend
        for i, before in enumerate(past):
            known = known.join(before.select(F.col("topic_id").alias(f"_t{i}"), F.col("score").alias(f"_s{i}")), F.col("topic_id") == F.col(f"_t{i}"), "left")
        history = F.array_compact(F.array(*[F.col(f"_s{i}") for i in range(len(past))])) if past else None
        out.append(S.lifecycle(known, now, history).select("topic_id", "state", "score"))
        past.append(trend)
    return out


#: Clocks at which states change and are confirmed.
_EVENT_CLOCKS = (dt.datetime(2024, 1, 6), dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 13))


def _runs_sql(clocks=_CLOCKS) -> str:
    """WITH s0, s1, s2: the three runs' topic_id, state and score; each holds the runs before it."""
    out = []
    for k, now in enumerate(clocks):
        earlier = ", ".join(f"(SELECT score FROM s{i} WHERE s{i}.topic_id = trend.topic_id)" for i in range(k))
        history = f"list_filter([{earlier}], lambda x: x IS NOT NULL)" if k else None
        out.append(f"s{k} AS ({trend_sql(now.strftime('%Y-%m-%d'), history)} SELECT topic_id, state, score FROM states)")
    return "WITH " + ", ".join(out)


def _settled_sql(clocks=_CLOCKS) -> str:
    """The runs folded one after the other: f0, f1, f2 (topic_id, state, pending, confirmations, score, changed)."""
    out = [_runs_sql(clocks), "f0 AS (SELECT topic_id, state, CAST(NULL AS VARCHAR) AS pending, 0 AS confirmations, score, false AS changed FROM s0)"]
    for k in (1, 2):
        out.append(f"""j{k} AS (SELECT r.topic_id, r.state AS raw, r.score AS now_score, b.state AS was, b.pending AS held, b.confirmations AS n0, b.score AS old_score FROM s{k} r LEFT JOIN f{k - 1} b USING (topic_id)),
d{k} AS (SELECT *, raw = 'unknown' AS unscored, was IS NULL OR was = 'unknown' AS first_seen, coalesce(raw = was, false) AS same, coalesce(abs(now_score - old_score) >= 25, false) AS jump, CASE WHEN raw = held THEN n0 + 1 ELSE 1 END AS n FROM j{k}),
w{k} AS (SELECT *, first_seen OR jump OR n >= 2 AS change, NOT unscored AND NOT same AND NOT (first_seen OR jump OR n >= 2) AS waits FROM d{k}),
f{k} AS (SELECT topic_id, CASE WHEN unscored THEN coalesce(was, raw) WHEN waits THEN was ELSE raw END AS state, CASE WHEN waits THEN raw END AS pending, CASE WHEN waits THEN n ELSE 0 END AS confirmations,
  CASE WHEN unscored THEN old_score ELSE now_score END AS score, NOT unscored AND NOT same AND change AND NOT first_seen AS changed FROM w{k})""")
    return ", ".join(out)


@query(f"{_settled_sql()} SELECT topic_id, state, pending, confirmations, score, changed FROM f2")
def lifecycle_hysteresis(spark, sf_dir):
    """The current lifecycle after three runs, each folded into the table the run before left."""
    none = "topic_id long, state string, pending string, confirmations int, score double"
    now = spark.createDataFrame([], none)
    for run in runs(spark, sf_dir):
        now = S.settle(now, run)
    return now


@query(f"{_settled_sql(_EVENT_CLOCKS)} SELECT topic_id, 1 AS run, f0.state AS from_state, f1.state AS to_state, f1.score AS score FROM f1 JOIN f0 USING (topic_id) WHERE f1.changed UNION ALL SELECT topic_id, 2, f1.state, f2.state, f2.score FROM f2 JOIN f1 USING (topic_id) WHERE f2.changed")
def lifecycle_events(spark, sf_dir):
    """Changes of state, run by run: the events that the detail of a topic lists."""
    now, events = spark.createDataFrame([], "topic_id long, state string, pending string, confirmations int, score double"), []
    for k, run in enumerate(runs(spark, sf_dir, _EVENT_CLOCKS)):
        before, now = now, saved(S.settle(now, run))
        b = before.select("topic_id", F.col("state").alias("from_state"))
        events.append(now.where("changed").join(b, "topic_id").select("topic_id", F.lit(k).alias("run"), "from_state", F.col("state").alias("to_state"), "score"))
    return events[1].union(events[2])


@query(f"{_TREND} SELECT topic_id, {_R6.format('CAST(recent_new AS DOUBLE) / nullif(baseline_new, 0)')} AS ratio, content_growth, creator_growth, density FROM trend")
def growth_ratio(spark, sf_dir):
    return _trend(spark, sf_dir).select("topic_id", half_up(F.col("recent_new") / F.nullif(F.col("baseline_new"), F.lit(0)), 6).alias("ratio"), "content_growth", "creator_growth", "density")
