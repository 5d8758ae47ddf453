"""Items, metric snapshots and texts as the queries know them, derived from the given tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NOW = dt.datetime(2024, 1, 31)
#: The platform whose main reaction is upvotes instead of likes.
UPVOTING = "zeta"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, platform, content_type, author_id, topic_id, published_at: one item per user of events."""
    u = F.col("user_id")
    first = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").cast("timestamp").alias("published_at"))
    platform = F.when(u % 4 == 0, "alpha").when(u % 4 == 1, "beta").when(u % 4 == 2, "gamma").otherwise("zeta")
    kind = F.when(u % 3 == 0, "video").when(u % 3 == 1, "article").otherwise("unknown")
    return first.select(u.alias("item_id"), platform.alias("platform"), kind.alias("content_type"), (u % 20).alias("author_id"), (u % 10).alias("topic_id"), "published_at")


def event_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, captured_at and cumulative views, likes, comments, shares, favorites, upvotes per day of events."""
    kinds = {"v": "view", "c": "click", "s": "signup", "p": "purchase", "e": "error"}
    days = table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("day", "ts").cast("timestamp").alias("captured_at"))
    d = days.agg(*[F.count_if(F.col("event_type") == k).alias(n) for n, k in kinds.items()])
    w = Window.partitionBy("user_id").orderBy("captured_at").rowsBetween(Window.unboundedPreceding, 0)
    s = {n: F.sum(n).over(w).cast("long") for n in kinds}
    u = F.col("user_id")
    return d.select(
        u.alias("item_id"), "captured_at", F.when(u % 5 != 0, s["v"]).alias("views"), s["c"].alias("likes"), s["s"].alias("comments"),
        F.when(u % 7 != 0, s["p"]).alias("shares"), s["e"].alias("favorites"), F.when(u % 4 == 3, s["c"]).alias("upvotes"),
    )


def seen_by(items: DataFrame, snapshots: DataFrame, now: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """What a run at a clock may know: items published and snapshots captured by then; items without a time stay."""
    return items.where(F.col("published_at").isNull() | (F.col("published_at") <= F.lit(now).cast("timestamp"))), snapshots.where(F.col("captured_at") <= F.lit(now).cast("timestamp"))


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from orders: an item per order, its region as platform."""
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.select(F.col("o_orderkey").alias("item_id"), F.col("r_name").alias("platform"), F.col("o_orderpriority").alias("content_type"), F.col("o_custkey").alias("author_id"), (F.col("o_custkey") % 40).alias("topic_id"), F.col("o_orderdate").cast("timestamp").alias("published_at"))


def order_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative quantities, prices and counts per shipping day of an order's lines."""
    whole = lambda c: F.sum(F.floor(c + F.lit(0.5)).cast("long"))
    lines = table(spark, sf_dir, "lineitem").repartition("l_orderkey")  # the one shuffle: days, sums and what reads them go by order
    d = lines.groupBy("l_orderkey", F.col("l_shipdate").cast("timestamp").alias("captured_at"))
    d = d.agg(whole(F.col("l_quantity")).alias("q"), whole(F.col("l_extendedprice") * 100).alias("x"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("rf"), F.count_if(F.col("l_linestatus") == "F").alias("ls"))
    w = Window.partitionBy("l_orderkey").orderBy("captured_at").rowsBetween(Window.unboundedPreceding, 0)
    s = {k: F.sum(k).over(w).cast("long") for k in ("q", "x", "n", "rf", "ls")}
    o = F.col("l_orderkey")
    return d.select(
        o.alias("item_id"), "captured_at", F.when(o % 5 != 0, s["x"]).alias("views"), s["q"].alias("likes"), s["n"].alias("comments"),
        F.when(o % 7 != 0, s["rf"]).alias("shares"), s["ls"].alias("favorites"), F.lit(None).cast("long").alias("upvotes"),
    )


def text_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as text items: the first sentence is the title, source the author, lang the platform."""
    d = table(spark, sf_dir, "documents")
    title = F.split_part("text", F.lit("."), F.lit(1))
    return d.select(F.col("doc_id").alias("item_id"), F.col("lang").alias("platform"), F.col("source").alias("author_id"), title.alias("title"), "text")


#: DuckDB SQL of the event views, as common table expressions.
EVENTS_SQL = """
m1_items AS (SELECT user_id AS item_id,
  CASE user_id % 4 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' WHEN 2 THEN 'gamma' ELSE 'zeta' END AS platform,
  CASE user_id % 3 WHEN 0 THEN 'video' WHEN 1 THEN 'article' ELSE 'unknown' END AS content_type,
  user_id % 20 AS author_id, user_id % 10 AS topic_id, CAST(min(ts) AS TIMESTAMP) AS published_at
  FROM events GROUP BY user_id),
m1_days AS (SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS captured_at,
  count(CASE WHEN event_type='view' THEN 1 END) AS v, count(CASE WHEN event_type='click' THEN 1 END) AS c,
  count(CASE WHEN event_type='signup' THEN 1 END) AS s, count(CASE WHEN event_type='purchase' THEN 1 END) AS p,
  count(CASE WHEN event_type='error' THEN 1 END) AS e FROM events GROUP BY 1, 2),
m1_sums AS (SELECT user_id, captured_at, CAST(sum(v) OVER w AS BIGINT) AS v, CAST(sum(c) OVER w AS BIGINT) AS c,
  CAST(sum(s) OVER w AS BIGINT) AS s, CAST(sum(p) OVER w AS BIGINT) AS p, CAST(sum(e) OVER w AS BIGINT) AS e
  FROM m1_days WINDOW w AS (PARTITION BY user_id ORDER BY captured_at ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
m1_snapshots AS (SELECT user_id AS item_id, captured_at, CASE WHEN user_id % 5 <> 0 THEN v END AS views, c AS likes,
  s AS comments, CASE WHEN user_id % 7 <> 0 THEN p END AS shares, e AS favorites, CASE WHEN user_id % 4 = 3 THEN c END AS upvotes
  FROM m1_sums)
"""

#: The same of the order views.
ORDERS_SQL = """
m1_items AS (SELECT o_orderkey AS item_id, r_name AS platform, o_orderpriority AS content_type, o_custkey AS author_id, o_custkey % 40 AS topic_id, CAST(o_orderdate AS TIMESTAMP) AS published_at
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
m1_days AS (SELECT l_orderkey, CAST(l_shipdate AS TIMESTAMP) AS captured_at, sum(CAST(floor(l_quantity + 0.5) AS BIGINT)) AS q, sum(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS x, count(*) AS n,
  count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS rf, count(CASE WHEN l_linestatus = 'F' THEN 1 END) AS ls FROM lineitem GROUP BY 1, 2),
m1_sums AS (SELECT l_orderkey, captured_at, CAST(sum(q) OVER w AS BIGINT) AS q, CAST(sum(x) OVER w AS BIGINT) AS x, CAST(sum(n) OVER w AS BIGINT) AS n, CAST(sum(rf) OVER w AS BIGINT) AS rf, CAST(sum(ls) OVER w AS BIGINT) AS ls
  FROM m1_days WINDOW w AS (PARTITION BY l_orderkey ORDER BY captured_at ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
m1_snapshots AS (SELECT l_orderkey AS item_id, captured_at, CASE WHEN l_orderkey % 5 <> 0 THEN x END AS views, q AS likes, n AS comments, CASE WHEN l_orderkey % 7 <> 0 THEN rf END AS shares, ls AS favorites, CAST(NULL AS BIGINT) AS upvotes FROM m1_sums)
"""


def clocked_sql(now: str) -> str:
    """The event views as a run at a clock may see them."""
    all_ = EVENTS_SQL.replace("m1_items AS (", "all_items AS (").replace("m1_snapshots AS (", "all_snapshots AS (")
    return f"{all_}, m1_items AS (SELECT * FROM all_items WHERE published_at IS NULL OR published_at <= TIMESTAMP '{now}'), m1_snapshots AS (SELECT * FROM all_snapshots WHERE captured_at <= TIMESTAMP '{now}')"
