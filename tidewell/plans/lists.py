"""Registered list, detail and status queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.functions.stats import half_up
from tidewell.operators import search as X
from tidewell.operators import silver as D

from .texts import _FP, _printed
from .views import EVENTS_SQL, UPVOTING, event_items, event_snapshots, table, text_items

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_PAIRS = f"WITH {_FP}, f AS (SELECT fingerprint, min(item_id) AS item_a FROM fp WHERE fingerprint IS NOT NULL GROUP BY 1 HAVING count(*) > 1), p AS (SELECT item_a, item_id AS item_b FROM fp JOIN f USING (fingerprint) WHERE item_id <> item_a)"


@query(f"{_PAIRS} SELECT item_a, item_b, a.title AS title_a, b.title AS title_b, a.author_id = b.author_id AS same_author FROM p JOIN fp a ON a.item_id = item_a JOIN fp b ON b.item_id = item_b ORDER BY item_b DESC LIMIT 100")
def duplicate_list(spark, sf_dir):
    """The hundred newest candidates with both items in brief."""
    items = _printed(spark, sf_dir)
    a, b = (items.select(F.col("item_id").alias(f"item_{x}"), F.col("title").alias(f"title_{x}"), F.col("author_id").alias(f"author_{x}")) for x in "ab")
    j = D.candidates(items).orderBy(F.desc("item_b")).limit(100).join(a, "item_a").join(b, "item_b")
    return j.select("item_a", "item_b", "title_a", "title_b", (F.col("author_a") == F.col("author_b")).alias("same_author"))


@query("SELECT o_orderkey AS item_id, c_name AS author, coalesce(n, 0) AS snapshots, first_day, last_day FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n, CAST(min(l_shipdate) AS DATE) AS first_day, CAST(max(l_shipdate) AS DATE) AS last_day FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def lineage_detail(spark, sf_dir):
    """Each item with its author and what was observed of it."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.to_date(F.min("l_shipdate")).alias("first_day"), F.to_date(F.max("l_shipdate")).alias("last_day"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(s, o.o_orderkey == s.l_orderkey, "left")
    return j.select(F.col("o_orderkey").alias("item_id"), F.col("c_name").alias("author"), F.coalesce("n", F.lit(0)).alias("snapshots"), "first_day", "last_day")


@query("WITH d AS (SELECT doc_id // 50 AS page, CASE WHEN text IS NOT NULL AND length(trim(text)) > 0 AND lang IS NOT NULL AND source IS NOT NULL AND n_chars = length(text) AND doc_id % 7 > doc_id // 50 % 7 THEN 1 ELSE 0 END AS fits FROM documents) SELECT page, count(*) AS n, floor(avg(fits) * 1e6 + 0.5) / 1e6 AS valid, avg(fits) >= 0.5 AS accepted FROM d GROUP BY 1")
def schema_drift_gate(spark, sf_dir):
    """A page of fifty records is taken only if at least half of them fit their schema: text, language, source, and the
    length as told; some ids are taken as drifted."""
    c = F.col
    ok = c("text").isNotNull() & (F.length(F.trim("text")) > 0) & c("lang").isNotNull() & c("source").isNotNull() & (c("n_chars") == F.length("text")) & (c("doc_id") % 7 > F.floor(c("doc_id") / 50) % 7)
    fits = F.avg(F.coalesce(ok, F.lit(False)).cast("double"))
    return table(spark, sf_dir, "documents").groupBy(F.floor(c("doc_id") / 50).alias("page")).agg(F.count(F.lit(1)).alias("n"), half_up(fits, 6).alias("valid"), (fits >= 0.5).alias("accepted"))


@query(f"{_PAIRS}, c AS (SELECT item_a, count(*) AS n FROM p GROUP BY 1), b AS (SELECT item_id // 100 AS batch, count(*) AS n FROM fp GROUP BY 1) SELECT fp.item_id, fp.item_id // 100 AS batch, b.n AS batch_rows, fp.fingerprint, p.item_a AS merged_into, coalesce(c.n, 0) AS candidates FROM fp JOIN b ON b.batch = fp.item_id // 100 LEFT JOIN p ON p.item_b = fp.item_id LEFT JOIN c ON c.item_a = fp.item_id")
def lineage_chain(spark, sf_dir):
    """Each item with the batch it came by, its fingerprint, the item it was merged into and its candidates."""
    items = _printed(spark, sf_dir).withColumn("batch", F.floor(F.col("item_id") / 100))
    batches = items.groupBy(F.col("batch").alias("_b")).agg(F.count(F.lit(1)).alias("batch_rows"))
    pairs = D.candidates(items)
    n = pairs.groupBy(F.col("item_a").alias("_a")).agg(F.count(F.lit(1)).alias("n"))
    j = items.join(batches, F.col("batch") == F.col("_b")).join(pairs.select(F.col("item_b").alias("_i"), F.col("item_a").alias("merged_into")), F.col("item_id") == F.col("_i"), "left").join(n, F.col("item_id") == F.col("_a"), "left")
    return j.select("item_id", "batch", "batch_rows", "fingerprint", "merged_into", F.coalesce("n", F.lit(0)).alias("candidates"))


_TERMS = ["license", "version", "secret"]


@query("SELECT item_id, regexp_replace(part, '(?i)({0})', '[\\1]', 'g') AS snippet FROM (SELECT doc_id AS item_id, regexp_extract(text, '[^\\n]{{0,30}}(?i:{0})[^\\n]{{0,30}}') AS part FROM documents) WHERE part <> ''".format("|".join(_TERMS)))
def search_snippets(spark, sf_dir):
    """Where the first of three words stands, with all of them marked."""
    return text_items(spark, sf_dir).select("item_id", X.snippet("text", _TERMS).alias("snippet")).where("snippet <> ''")


@query(f"WITH {EVENTS_SQL}, l AS (SELECT item_id, max_by(CASE WHEN item_id % 4 = 3 THEN coalesce(upvotes, likes) ELSE likes END, captured_at) AS level FROM m1_snapshots GROUP BY 1), j AS (SELECT *, coalesce('id:' || CASE WHEN item_id % 3 > 0 THEN author_id END, 'name:' || CASE WHEN item_id % 2 = 0 THEN author_id END, 'item:' || item_id) AS who FROM m1_items LEFT JOIN l USING (item_id)), p AS (SELECT topic_id, string_agg(platform || ':' || n, ',' ORDER BY platform) AS platforms FROM (SELECT topic_id, platform, count(*) AS n FROM j GROUP BY 1, 2) GROUP BY 1) SELECT topic_id, count(*) AS members, count(CASE WHEN published_at >= TIMESTAMP '2024-01-03' THEN 1 END) AS fresh, count(DISTINCT who) AS creators, any_value(platforms) AS platforms, floor(avg(level) * 1e6 + 0.5) / 1e6 AS level FROM j JOIN p USING (topic_id) GROUP BY 1")
def topic_snapshot(spark, sf_dir):
    """Members, new ones, different creators (by id, else by name, else each item its own), members by platform, level."""
    main = F.when(F.col("platform") == UPVOTING, F.coalesce("upvotes", "likes")).otherwise(F.col("likes"))
    last = event_snapshots(spark, sf_dir).groupBy("item_id").agg(F.max_by("upvotes", "captured_at").alias("upvotes"), F.max_by("likes", "captured_at").alias("likes"))
    j = event_items(spark, sf_dir).join(last, "item_id", "left")
    who = F.coalesce(F.concat(F.lit("id:"), F.when(F.col("item_id") % 3 > 0, F.col("author_id")).cast("string")), F.concat(F.lit("name:"), F.when(F.col("item_id") % 2 == 0, F.col("author_id")).cast("string")), F.concat(F.lit("item:"), F.col("item_id").cast("string")))
    n = j.groupBy("topic_id", "platform").agg(F.count(F.lit(1)).alias("n")).groupBy("topic_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "platform", "n"))), ",").alias("platforms"))
    g = j.groupBy("topic_id").agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("published_at") >= "2024-01-03").alias("fresh"), F.count_distinct(who).alias("creators"), half_up(F.avg(main), 6).alias("level"))
    return g.join(n, "topic_id").select("topic_id", "members", "fresh", "creators", "platforms", "level")


@query(f"WITH {EVENTS_SQL}, d AS (SELECT topic_id, CAST(captured_at AS DATE) AS day, count(DISTINCT item_id) AS seen FROM m1_snapshots JOIN m1_items USING (item_id) GROUP BY 1, 2) SELECT topic_id, day, seen, greatest(0, seen - lag(seen) OVER (PARTITION BY topic_id ORDER BY day)) AS gained FROM d")
def topic_new_content(spark, sf_dir):
    j = event_snapshots(spark, sf_dir).join(event_items(spark, sf_dir).select("item_id", "topic_id"), "item_id")
    d = j.groupBy("topic_id", F.to_date("captured_at").alias("day")).agg(F.count_distinct("item_id").alias("seen"))
    before = F.lag("seen").over(Window.partitionBy("topic_id").orderBy("day"))
    return d.withColumn("before", before).select("topic_id", "day", "seen", F.greatest(F.lit(0).cast("long"), F.when(F.col("before").isNotNull(), F.col("seen") - F.col("before")).otherwise(F.lit(0))).alias("gained"))


@query("SELECT user_id, event_id, event_type, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS superseded_at FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM events) WHERE was IS NULL OR was <> event_type")
def superseded_versions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return D.changed_hashes(e, "user_id", "event_type", "event_id")


@query("SELECT item_id, phrase FROM (SELECT item_id, phrase, row_number() OVER (PARTITION BY left(phrase, 8) ORDER BY item_id) AS r FROM (SELECT doc_id AS item_id, left(trim(regexp_replace(split_part(text, '.', 1), '[\\p{P}\\p{S}\\s]+', ' ', 'g')), 30) AS phrase FROM documents) WHERE length(phrase) >= 4) WHERE r = 1")
def hot_phrases(spark, sf_dir):
    """Titles as search phrases: cleaned, short, one per first eight characters."""
    d = text_items(spark, sf_dir).select("item_id", F.left(F.trim(F.regexp_replace("title", r"[\p{P}\p{S}\s]+", " ")), F.lit(30)).alias("phrase")).where(F.length("phrase") >= 4)
    return d.groupBy(F.left("phrase", F.lit(8)).alias("k")).agg(F.min_by(F.struct("item_id", "phrase"), "item_id").alias("r")).select("r.item_id", "r.phrase")


@query("WITH w AS (SELECT source, list_filter(string_split_regex(lower(split_part(text, '.', 1)), '[^\\p{L}]+'), lambda t: t <> '') AS w FROM documents), b AS (SELECT source, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bigram FROM w), c AS (SELECT source, bigram, count(*) AS n FROM b GROUP BY 1, 2 HAVING count(*) >= 2) SELECT source, bigram, n, r FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, bigram) AS r FROM c) WHERE r <= 2")
def title_labels(spark, sf_dir):
    """The two commonest word pairs of a source's titles that occur twice or more."""
    words = F.filter(F.split(F.lower("title"), r"[^\p{L}]+"), lambda t: t != "")
    d = text_items(spark, sf_dir).select(F.col("author_id").alias("source"), words.alias("w")).where(F.size("w") > 1)
    pairs = F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1)))
    c = d.select("source", F.explode(pairs).alias("bigram")).groupBy("source", "bigram").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    w = Window.partitionBy("source").orderBy(F.desc("n"), "bigram")
    return c.withColumn("r", F.row_number().over(w).cast("long")).where("r <= 2")


@query("SELECT 'documents' AS part, count(*) AS n, count(text) AS filled FROM documents UNION ALL SELECT 'labels', count(*), count(quality) FROM labels UNION ALL SELECT 'pages', count(*), count(html) FROM pages UNION ALL SELECT 'embeddings', count(*), count(embedding) FROM embeddings")
def status_overview(spark, sf_dir):
    parts = [("documents", "text"), ("labels", "quality"), ("pages", "html"), ("embeddings", "embedding")]
    out = [table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("n"), F.count(c).alias("filled")).select(F.lit(t).alias("part"), "n", "filled") for t, c in parts]
    return out[0].union(out[1]).union(out[2]).union(out[3])


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 20")
def newest_history(spark, sf_dir):
    """The twenty newest rows of each key."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").withColumn("r", F.row_number().over(w)).where("r <= 20").select("user_id", "event_id", "value")


@query("SELECT CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS runs, count(CASE WHEN event_type = 'error' THEN 1 END) AS failed, CASE WHEN count(CASE WHEN event_type = 'error' THEN 1 END) = 0 THEN 'completed' WHEN count(CASE WHEN event_type = 'error' THEN 1 END) = count(*) THEN 'failed' ELSE 'partial' END AS status FROM events GROUP BY 1")
def run_status(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), (F.col("event_type") != "error").alias("valid"))
    return D.batch_status(e, "day", "valid").select("day", F.col("n").alias("runs"), "failed", "status")


@query("SELECT item_id, words, CAST(len(words) AS BIGINT) AS n FROM (SELECT doc_id AS item_id, array_to_string(list_filter(regexp_extract_all(lower(split_part(text, '.', 1)), '[a-z0-9][a-z0-9''+.-]{1,23}'), lambda w: w NOT IN (%s)), ' ') AS words FROM documents)" % ", ".join("'{}'".format(w.replace("'", "''")) for w in T.STOP_WORDS))
def semantic_title(spark, sf_dir):
    """The title's words without stop words, as one line."""
    line = F.array_join(T.words(F.col("title")), " ")
    return text_items(spark, sf_dir).select("item_id", line.alias("words"), F.length(line).cast("long").alias("n"))


@query("SELECT page_id, host, path_depth, n_params FROM (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, CAST(len(list_filter(string_split(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/'), lambda p: p <> '')) AS BIGINT) AS path_depth, CAST(len(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> '')) AS BIGINT) AS n_params FROM pages)")
def url_parts(spark, sf_dir):
    some = lambda c, sep: F.size(F.filter(F.split(c, sep), lambda p: p != "")).cast("long")
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract(u, r"^https?://([^/?#]+)", 1)).alias("host"), some(F.regexp_extract(u, r"^https?://[^/?#]+([^?#]*)", 1), "/").alias("path_depth"), some(F.regexp_extract(u, r"\?([^#]*)", 1), "&").alias("n_params"))
