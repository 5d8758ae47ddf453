"""Registered queries over momentum, overview and series, each with its DuckDB oracle."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidewell.functions.stats import half_up
from tidewell.operators import momentum as M

from .views import EVENTS_SQL, NOW, UPVOTING, event_items, event_snapshots

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_EDGES = f"""WITH {EVENTS_SQL},
inside AS (SELECT * FROM m1_snapshots WHERE captured_at >= TIMESTAMP '2024-01-24' AND captured_at <= TIMESTAMP '2024-01-31'),
n AS (SELECT item_id, count(*) AS points, min(captured_at) AS t0, max(captured_at) AS t1 FROM inside GROUP BY 1),
b AS (SELECT item_id, max(captured_at) AS t FROM m1_snapshots WHERE captured_at < TIMESTAMP '2024-01-24' GROUP BY 1),
e AS (SELECT n.item_id, CASE WHEN points = 1 AND b.t IS NOT NULL THEN b.t ELSE t0 END AS t0, t1,
  CASE WHEN points = 1 AND b.t IS NOT NULL THEN 2 ELSE points END AS points FROM n LEFT JOIN b USING (item_id)),
d AS (SELECT e.item_id, e.points, (epoch(e.t1) - epoch(e.t0)) / 3600.0 AS span, l.views, l.likes, l.comments, l.shares, l.favorites,
  l.views - f.views AS dv, l.likes - f.likes AS dl, l.comments - f.comments AS dc, l.shares - f.shares AS ds, l.favorites - f.favorites AS df,
  l.upvotes - f.upvotes AS du FROM e JOIN m1_snapshots f ON f.item_id = e.item_id AND f.captured_at = e.t0
  JOIN m1_snapshots l ON l.item_id = e.item_id AND l.captured_at = e.t1 WHERE e.points >= 2)"""
_LIST = """SELECT i.item_id, i.platform, i.topic_id, points, floor(span * 1e6 + 0.5) / 1e6 AS span_hours,
  coalesce(CASE WHEN platform = 'zeta' THEN du ELSE dl END, 0) + coalesce(dc * 2, 0) + coalesce(ds * 3, 0) + coalesce(df * 2, 0) AS momentum,
  dl AS d_likes, dc AS d_comments, ds AS d_shares, df AS d_favorites, dv AS d_views,
  floor(CASE WHEN span > 0 THEN dc * 24.0 / span END * 1e6 + 0.5) / 1e6 AS comments_per_day,
  floor(CASE WHEN views > 0 THEN (likes + comments + shares + favorites) / CAST(views AS DOUBLE) END * 1e6 + 0.5) / 1e6 AS engagement,
  concat_ws(',', CASE WHEN dv IS NULL THEN 'views' END, CASE WHEN dl IS NULL THEN 'likes' END, CASE WHEN dc IS NULL THEN 'comments' END,
    CASE WHEN ds IS NULL THEN 'shares' END, CASE WHEN df IS NULL THEN 'favorites' END) AS unknown_components
  FROM m1_items i JOIN d USING (item_id)"""


@query(f"{_EDGES} {_LIST}")
def momentum_list(spark, sf_dir):
    return M.momentum_list(event_items(spark, sf_dir), event_snapshots(spark, sf_dir), NOW, UPVOTING)


@query(f"{_EDGES}, r AS ({_LIST}) SELECT item_id, platform, momentum FROM r ORDER BY momentum DESC, item_id DESC LIMIT 20 OFFSET 20")
def momentum_page(spark, sf_dir):
    """The second page of 20, by momentum; the limit is what is asked for."""
    return momentum_list(spark, sf_dir).select("item_id", "platform", "momentum").orderBy(F.desc_nulls_last("momentum"), F.desc("item_id")).offset(20).limit(20)


@query(f"WITH {EVENTS_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY captured_at DESC) AS r FROM m1_snapshots WHERE captured_at < TIMESTAMP '2024-01-24') SELECT i.item_id, b.captured_at, b.views, b.likes, b.comments, b.shares, b.favorites, b.upvotes FROM m1_items i LEFT JOIN b ON b.item_id = i.item_id AND b.r = 1")
def asof_baseline(spark, sf_dir):
    return M.as_of(event_items(spark, sf_dir), event_snapshots(spark, sf_dir), NOW - dt.timedelta(days=7))


@query(f"WITH {EVENTS_SQL} SELECT CAST(captured_at AS DATE) AS day, count(*) AS snapshots, count(DISTINCT item_id) AS items FROM m1_snapshots WHERE captured_at >= TIMESTAMP '2024-01-24' AND captured_at <= TIMESTAMP '2024-01-31' GROUP BY 1")
def trend_overview_days(spark, sf_dir):
    return M.overview_days(event_snapshots(spark, sf_dir), NOW)


@query(f"WITH {EVENTS_SQL} SELECT platform, count(DISTINCT item_id) AS items, count(*) AS snapshots FROM m1_snapshots JOIN m1_items USING (item_id) WHERE captured_at >= TIMESTAMP '2024-01-24' AND captured_at <= TIMESTAMP '2024-01-31' GROUP BY 1")
def platform_mix(spark, sf_dir):
    return M.platform_mix(event_items(spark, sf_dir), event_snapshots(spark, sf_dir), NOW)


@query(f"WITH {EVENTS_SQL} SELECT item_id, captured_at, row_number() OVER w AS n, likes, likes - lag(likes) OVER w AS gain, likes - first_value(likes) OVER w AS gain_in_all FROM m1_snapshots WINDOW w AS (PARTITION BY item_id ORDER BY captured_at)")
def item_series(spark, sf_dir):
    return M.series(event_snapshots(spark, sf_dir))


@query(f"WITH {EVENTS_SQL} SELECT item_id, captured_at, floor(CASE WHEN views > 0 THEN (likes + comments + shares + favorites) / CAST(views AS DOUBLE) END * 1e6 + 0.5) / 1e6 AS engagement FROM m1_snapshots")
def engagement_rate(spark, sf_dir):
    c = F.col
    return event_snapshots(spark, sf_dir).select("item_id", "captured_at", half_up(M.engagement(c("views"), c("likes"), c("comments"), c("shares"), c("favorites")), 6).alias("engagement"))
