"""Registered queries over sources and streams; what they read is written by Spark from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.operators.graph import checkpoint_dir
from tidewell.sources import files as S
from tidewell.streaming import jobs as J
from tidewell.streaming.collect import Collection
from tidewell.streaming.state import lateness

from .texts import _CANON
from .views import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _place(spark, name):
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT doc_id, lang, source, n_chars AS likes FROM documents")
def source_delimited(spark, sf_dir):
    """documents through delimited text and a guessed header mapping."""
    place = _place(spark, "delimited")
    table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").write.option("header", True).csv(place)
    n = S.normalised(S.read_delimited(spark, place))
    return n.select(F.col("content_id").cast("long").alias("doc_id"), F.col("platform").alias("lang"), F.col("author_name").alias("source"), "likes")


@query("SELECT conv_id, turn, role, text FROM conversations")
def source_json(spark, sf_dir):
    place = _place(spark, "json")
    table(spark, sf_dir, "conversations").write.json(place)
    return S.read_json(spark, place).select("conv_id", "turn", "role", "text")


@query("SELECT doc_id::VARCHAR AS content_id, source AS author_name, CASE WHEN doc_id % 3 = 2 THEN NULL ELSE lang END AS platform FROM documents")
def source_any_case(spark, sf_dir):
    """Records of JSON whose keys come in different cases, by one mapping; every third has no language at all."""
    place, c, k = _place(spark, "cases"), F.col, F.col("doc_id") % 3
    d = table(spark, sf_dir, "documents").select(c("doc_id").cast("string").alias("i"), "source", "lang", k.alias("k"))
    pack = lambda i, source, lang=None: F.to_json(F.struct(c("i").alias(i), c("source").alias(source), *([c("lang").alias(lang)] if lang else [])))
    d.select(F.when(c("k") == 0, pack("docId", "Source", "LANG")).when(c("k") == 1, pack("DOCID", "source", "lang")).otherwise(pack("docid", "SOURCE")).alias("value")).write.text(place)
    return S.keyed_records(spark.read.text(place), {"content_id": "docId", "author_name": "Source", "platform": "lang"})


@query("SELECT source AS envelope, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1")
def source_envelope(spark, sf_dir):
    """Rows packed into envelopes of a thousand of a source and taken out again."""
    place = _place(spark, "envelope")
    d = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("name"), F.floor(F.col("doc_id") / 1000).alias("part"))
    d.agg(F.first("lang").alias("platform"), F.collect_list(F.struct("doc_id", "n_chars")).alias("rows")).drop("part").write.json(place)
    return S.read_envelope(spark, place, lines=True).groupBy("envelope").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query(f"SELECT page_id, canonical AS url, 'Page ' || page_id AS title, CASE WHEN page_id % 2 = 0 THEN TIMESTAMP '2024-01-05 10:00:00' ELSE TIMESTAMP '2024-01-05 08:30:00' END AS published_at FROM ({_CANON})")
def source_feed(spark, sf_dir):
    """Pages written as items of an RSS feed (even ids) and as entries of an Atom feed (odd ones), and read again."""
    p, out = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("Page "), "page_id").alias("title"), "url"), []
    rss, atom = _place(spark, "feed"), _place(spark, "atom")
    p.where("page_id % 2 = 0").select("title", F.col("url").alias("link"), F.lit("<p>text</p>").alias("description"), F.lit("2024-01-05T10:00:00Z").alias("pubDate")).write.format("xml").option("rootTag", "channel").option("rowTag", "item").save(rss)
    p.where("page_id % 2 = 1").select("title", F.struct(F.col("url").alias("_href")).alias("link"), F.lit("text").alias("summary"), F.lit("2024-01-05T10:30:00+02:00").alias("updated")).write.format("xml").option("rootTag", "feed").option("rowTag", "entry").save(atom)
    for place, tag in ((rss, "item"), (atom, "entry")):
        f = S.read_feed(spark, place, tag)
        out.append(f.select(F.regexp_extract("title", r"(\d+)", 1).cast("long").alias("page_id"), "url", "title", "published_at"))
    return out[0].union(out[1])


@query("SELECT CASE WHEN doc_id % 2 = 0 THEN 'answer:' ELSE 'question:' END || doc_id AS content_id, source AS title, CASE WHEN doc_id % 2 = 0 THEN n_chars END AS upvotes, CASE WHEN doc_id % 2 = 1 THEN n_chars * 10000 END AS heat FROM documents")
def source_two_shapes(spark, sf_dir):
    """Documents as search results and as hot-list entries of one platform, in text, read as one table."""
    place, k, n = _place(spark, "shapes"), F.col("doc_id").cast("string"), F.col("n_chars").cast("string")
    found = F.to_json(F.struct(F.lit("answer").alias("type"), k.alias("id"), F.col("source").alias("title"), n.alias("voteup_count")))
    hot = F.to_json(F.struct(F.struct(F.lit("question").alias("type"), k.alias("id"), F.col("source").alias("title")).alias("target"), F.concat(n, F.lit(" 万热度")).alias("detail_text")))
    table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 2 == 0, found).otherwise(hot).alias("value")).write.text(place)
    return S.two_shapes(spark.read.text(place).select(F.col("value").alias("raw")))


@query("SELECT count(*) AS total, count(CASE WHEN ts >= TIMESTAMP '2024-01-30' AND ts < TIMESTAMP '2024-01-31' THEN 1 END) AS today, count(CASE WHEN event_type = 'error' AND ts >= TIMESTAMP '2024-01-30' THEN 1 END) AS failed_today, (SELECT count(*) FROM (SELECT user_id, max_by(event_type, (ts, event_id)) AS last FROM events GROUP BY 1) WHERE last = 'view') AS running FROM events")
def collection_stats(spark, sf_dir):
    """Runs in all, today's (a UTC day) and failed ones, and how many run now: users whose last event is a view."""
    e, c = table(spark, sf_dir, "events"), F.col
    today = (c("ts") >= "2024-01-30") & (c("ts") < "2024-01-31")
    last = e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last")).agg(F.count_if(c("last") == "view").alias("running"))
    g = e.agg(F.count(F.lit(1)).alias("total"), F.count_if(today).alias("today"), F.count_if((c("event_type") == "error") & (c("ts") >= "2024-01-30")).alias("failed_today"))
    return g.join(F.broadcast(last))  # one row each


@query("WITH m AS (SELECT 'doc_id' AS c, 'content_id' AS field UNION ALL SELECT 'lang', 'platform' UNION ALL SELECT 'source', 'author_name' UNION ALL SELECT 'text', 'text' UNION ALL SELECT 'n_chars', 'likes'), r AS (SELECT * FROM documents ORDER BY doc_id LIMIT 25) SELECT 25 AS shown, c AS column_name, field, (SELECT CASE c WHEN 'doc_id' THEN max(doc_id)::VARCHAR WHEN 'lang' THEN max(lang) WHEN 'source' THEN max(source) WHEN 'text' THEN max(left(text, 20)) ELSE max(n_chars)::VARCHAR END FROM r WHERE doc_id = (SELECT min(doc_id) FROM r)) AS sample FROM m")
def import_preview(spark, sf_dir):
    """What an import would take: of the first 25 rows the detected field and a sample of each column; nothing is written."""
    d = table(spark, sf_dir, "documents")
    first = d.orderBy("doc_id").limit(25)
    fields = {c: f for f, c in S.mapping(d.columns).items()}
    row = first.orderBy("doc_id").limit(1)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(fields.get(c)).alias("field"), F.left(F.col(c).cast("string"), F.lit(20)).alias("sample")) for c in d.columns])).alias("x")
    return row.select(F.lit(25).alias("shown"), each).select("shown", "x.*")


@query("SELECT CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS events, CAST(sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1")
def stream_day_buckets(spark, sf_dir):
    return J.run_to_end(J.day_buckets(J.stream(spark, f"{sf_dir}/events.parquet")), ["day"])


@query("WITH s AS (SELECT CAST(unnest(generate_series(CAST(date_trunc('day', ts) AS TIMESTAMP) - INTERVAL 6 DAY, CAST(date_trunc('day', ts) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS since, event_type FROM events) SELECT since, event_type, count(*) AS events FROM s GROUP BY 1, 2")
def stream_sliding_windows(spark, sf_dir):
    return J.run_to_end(J.sliding(J.stream(spark, f"{sf_dir}/events.parquet")), ["since", "event_type"])


@query("SELECT user_id, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1")
def stream_dedup(spark, sf_dir):
    """Each user's kinds of event, each taken once from the stream."""
    seen = J.run_to_end(J.once(J.stream(spark, f"{sf_dir}/events.parquet").select("user_id", "event_type", "ts"), ["user_id", "event_type"]), ["user_id", "event_type"], "append")
    return seen.groupBy("user_id").agg(F.count(F.lit(1)).alias("kinds"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def stream_current(spark, sf_dir):
    """The newest event of each user, upserted batch by batch."""
    rows = J.stream(spark, f"{sf_dir}/events.parquet").select("user_id", "event_id", "event_type", "ts")
    return J.upsert_stream(rows, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


_MOODS_SQL = """
WITH RECURSIVE e AS (
  SELECT user_id, ts, CASE WHEN event_type IN ('purchase', 'signup') THEN 'buying' WHEN event_type = 'error' THEN 'troubled' ELSE 'looking' END AS want,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k
  FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
s AS (
  SELECT user_id, k, want AS mood, CAST(NULL AS VARCHAR) AS pending, 0 AS changes FROM e WHERE k = 1
  UNION ALL
  SELECT user_id, k, CASE WHEN settles THEN want ELSE mood END, CASE WHEN want <> mood AND NOT settles THEN want END,
    changes + CASE WHEN want <> mood AND settles THEN 1 ELSE 0 END
  FROM (SELECT s.*, e.want, want = 'troubled' OR coalesce(want = pending, false) AS settles FROM (SELECT user_id, k + 1 AS k, mood, pending, changes FROM s) s JOIN e USING (user_id, k)))
SELECT user_id, mood AS state, changes, last FROM s JOIN (SELECT user_id, max(k) AS k, max(ts) AS last FROM e GROUP BY 1) USING (user_id, k)
"""


@query(_MOODS_SQL)
def stream_lifecycle(spark, sf_dir):
    """Each user's mood with hysteresis, in state that is kept between batches. The watermark's delay is what the stored
    files need, so that no event is late."""
    path = f"{sf_dir}/events.parquet"
    return J.moods(J.stream(spark, path).select("user_id", "event_id", "ts", "event_type"), lateness(spark, path))


_STATES_SQL = """
d AS (SELECT user_id % 10 AS topic_id, CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2),
r AS (SELECT topic_id, day, n, CASE WHEN n < 3 THEN 'unknown' WHEN n % 4 = 0 THEN 'peak' WHEN n % 4 = 1 THEN 'declining' ELSE 'rising' END AS raw,
  CASE WHEN n >= 3 THEN n % 50 * 1.0::DOUBLE END AS score, row_number() OVER (PARTITION BY topic_id ORDER BY day) AS k FROM d)"""


@query(f"""
WITH RECURSIVE {_STATES_SQL},
f AS (
  SELECT topic_id, k, raw AS state, CAST(NULL AS VARCHAR) AS pending, 0 AS n, score, 0 AS changes FROM r WHERE k = 1
  UNION ALL
  SELECT topic_id, k, CASE WHEN unscored THEN state WHEN waits THEN state ELSE raw END, CASE WHEN waits THEN raw END, CASE WHEN waits THEN seen ELSE 0 END,
    CASE WHEN unscored THEN score ELSE new_score END, changes + CASE WHEN NOT unscored AND NOT waits AND state <> 'unknown' AND state <> raw THEN 1 ELSE 0 END
  FROM (SELECT *, raw = 'unknown' AS unscored, CASE WHEN raw = pending THEN n + 1 ELSE 1 END AS seen,
      raw <> 'unknown' AND state <> 'unknown' AND state <> raw AND NOT coalesce(abs(new_score - score) >= 25, false) AND CASE WHEN raw = pending THEN n + 1 ELSE 1 END < 2 AS waits
    FROM (SELECT f.topic_id, r.k, f.state, f.pending, f.n, f.score, f.changes, r.raw, r.score AS new_score FROM f JOIN r ON r.topic_id = f.topic_id AND r.k = f.k + 1)))
SELECT topic_id, state, pending, n AS confirmations, score, changes FROM f JOIN (SELECT topic_id, max(k) AS k FROM r GROUP BY 1) USING (topic_id, k)
""")
def stream_topic_lifecycle(spark, sf_dir):
    """The lifecycle of topics after a run a day, each a row of a stream: the hysteresis of lifecycle_hysteresis in
    keyed state. A day's raw state and score come from the topic's number of events."""
    place, e = _place(spark, "runs"), table(spark, sf_dir, "events").where("user_id is not null and ts is not null")
    d = e.groupBy((F.col("user_id") % 10).alias("topic_id"), F.date_trunc("day", "ts").cast("timestamp").alias("run_at")).agg(F.count(F.lit(1)).alias("n"))
    state = F.when(F.col("n") < 3, "unknown").when(F.col("n") % 4 == 0, "peak").when(F.col("n") % 4 == 1, "declining").otherwise("rising")
    d = d.select("topic_id", "run_at", F.unix_date(F.to_date("run_at")).cast("long").alias("run_id"), state.alias("state"), F.when(F.col("n") >= 3, (F.col("n") % 50).cast("double")).alias("score"))
    d.write.parquet(place)
    return J.settled_stream(J.stream(spark, place), lateness(spark, place, "run_at")).drop("last")


_PAGED = "WITH p AS (SELECT doc_id, doc_id * 20 // (SELECT max(doc_id) + 1 FROM documents) AS k, CASE WHEN length(trim(text)) > 0 AND n_chars = length(text) AND doc_id % 7 > (doc_id * 20 // (SELECT max(doc_id) + 1 FROM documents)) % 7 THEN 1 ELSE 0 END AS fits FROM documents), s AS (SELECT k, count(*) AS n, avg(fits) >= 0.5 AS good FROM p GROUP BY 1), f AS (SELECT min(k) AS stop FROM s WHERE NOT good)"


@query(f"{_PAGED} SELECT k, n, CASE WHEN k < stop THEN 'taken' ELSE 'quarantined' END AS outcome FROM s, f WHERE k <= stop")
def stream_gate(spark, sf_dir):
    """documents in twenty pages through the gate in a stream: the first page of which less than half fits stops it and
    is kept apart. Some ids are taken as drifted, more of them from page to page."""
    d, place, c = table(spark, sf_dir, "documents"), _place(spark, "pages"), F.col
    end = d.agg(F.max("doc_id")).first()[0] + 1
    rows = d.withColumn("k", F.floor(c("doc_id") * 20 / end))
    rows.write.partitionBy("k").parquet(f"{place}/stored")  # one pass, as many files a page as tasks have rows of it
    for k in range(20):  # what comes in the stream, in this order, is a page's number
        spark.range(k, k + 1, 1, 1).toDF("k").write.mode("append").parquet(f"{place}/come")
    valid = (F.length(F.trim("text")) > 0) & (c("n_chars") == F.length("text")) & (c("doc_id") % 7 > c("k") % 7)
    stored = spark.read.schema(rows.schema).parquet(f"{place}/stored")
    run = Collection(spark, _place(spark, "collection"), valid)
    run.run(J.stream(spark, f"{place}/come", 1), load=lambda come: stored.where(c("k").isin([r["k"] for r in come.collect()])))
    counted = lambda df, said: df.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("outcome", F.lit(said))
    return counted(run.taken("doc_id long, k long"), "taken").union(counted(run.quarantined("doc_id long, k long"), "quarantined"))


@query("SELECT page_id, CASE WHEN length(t) > 80 THEN left(t, 80) || '…' ELSE t END AS excerpt FROM (SELECT page_id, trim(regexp_replace(url, '\\s+', ' ', 'g')) AS t FROM pages)")
def excerpts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.excerpt(F.col("url")).alias("excerpt"))


@query("SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_id, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 10")
def discovery_ranks(spark, sf_dir):
    """The ten highest values of each day with their rank."""
    from pyspark.sql import Window

    w = Window.partitionBy(F.to_date("ts")).orderBy(F.desc("value"), "event_id")
    return table(spark, sf_dir, "events").withColumn("rank", F.row_number().over(w)).where("rank <= 10").select(F.to_date("ts").alias("day"), "event_id", F.col("rank").cast("long").alias("rank"))
