"""Registered queries over text functions, the silver layer and search."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.operators import search as X
from tidewell.operators import silver as D
from tidewell.operators.graph import checkpoint_dir, saved
from tidewell.operators.index import Index

from .views import EVENTS_SQL, event_items, event_snapshots, table, text_items

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_WRITTEN = "CASE l_orderkey % 7 WHEN 0 THEN '+' || CAST(l_partkey AS VARCHAR) || '.5万' WHEN 1 THEN CAST(l_partkey AS VARCHAR) || ',000 次' WHEN 2 THEN '未知' WHEN 3 THEN CAST(l_partkey AS VARCHAR) || 'w' WHEN 4 THEN '-' WHEN 5 THEN CAST(l_suppkey AS VARCHAR) || '亿' ELSE 'x' || CAST(l_partkey AS VARCHAR) END"


@query(f"""WITH w AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_WRITTEN} AS written FROM lineitem),
c AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(CASE WHEN trim(written) NOT IN ('-', '未知', '') THEN trim(written) END, '[,\\s_]', '', 'g'), '(次|个|条|人)$', ''), '^\\+', '') AS s FROM w)
SELECT written, count(*) AS n, CAST(max(floor(TRY_CAST(nullif(regexp_extract(s, '^(\\d+(?:\\.\\d+)?)(万|亿|w|W)?$', 1), '') AS DOUBLE) * CASE regexp_extract(s, '^(\\d+(?:\\.\\d+)?)(万|亿|w|W)?$', 2) WHEN '万' THEN 1e4 WHEN 'w' THEN 1e4 WHEN '亿' THEN 1e8 ELSE 1 END + 0.5)) AS BIGINT) AS metric FROM c GROUP BY 1""")
def parse_metric(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("written", F.expr(_WRITTEN.replace("VARCHAR", "STRING")))
    return li.groupBy("written").agg(F.count(F.lit(1)).alias("n")).withColumn("metric", T.parse_metric(F.col("written")))


_URL = "^([Hh][Tt][Tt][Pp][Ss]?)://([^/?#]+)([^?#]*)(?:\\?([^#]*))?(?:#.*)?$"
_CANON = f"""SELECT page_id, url, scheme || '://' || CASE WHEN scheme = 'http' THEN regexp_replace(host, ':80$', '') ELSE regexp_replace(host, ':443$', '') END ||
  CASE WHEN len(kept) > 0 THEN CASE WHEN path = '' THEN '/' ELSE path END || '?' || array_to_string(kept, '&') ELSE regexp_replace(path, '/$', '') END AS canonical FROM (
  SELECT page_id, url, lower(regexp_extract(trim(url), '{_URL}', 1)) AS scheme, lower(regexp_extract(trim(url), '{_URL}', 2)) AS host, regexp_extract(trim(url), '{_URL}', 3) AS path,
  list_transform(list_filter(string_split(regexp_extract(trim(url), '{_URL}', 4), '&'), lambda p: p <> '' AND lower(split_part(p, '=', 1)) NOT IN ({", ".join(f"'{p}'" for p in T.TRACKING)})), lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END) AS kept FROM pages)"""


@query(_CANON)
def canonical_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", T.canonical_url(F.col("url")).alias("canonical"))


@query(f"WITH c AS ({_CANON}) SELECT page_id, canonical, coalesce(min(page_id) OVER (PARTITION BY canonical), page_id) AS keeper FROM c")
def dedup_by_url(spark, sf_dir):
    return D.first_per_key(canonical_url(spark, sf_dir).drop("url"), "canonical", "page_id")


_FP = """items AS (SELECT doc_id AS item_id, lang AS platform, source AS author_id, split_part(text, '.', 1) AS title, text FROM documents),
fp AS (SELECT item_id, platform, author_id, title, CASE WHEN platform IS NOT NULL AND regexp_replace(lower(title), '[\\s\\p{P}\\p{S}]+', '', 'g') <> '' THEN
  sha256(platform || '|' || coalesce(author_id, '') || '|' || regexp_replace(lower(title), '[\\s\\p{P}\\p{S}]+', '', 'g') || '|') END AS fingerprint FROM items)"""


def _printed(spark, sf_dir):
    d = text_items(spark, sf_dir)
    return d.withColumn("fingerprint", T.fingerprint(F.col("platform"), F.col("author_id"), F.col("title"), F.lit(None).cast("timestamp")))


@query(f"WITH {_FP} SELECT item_id, fingerprint FROM fp")
def fingerprint(spark, sf_dir):
    return _printed(spark, sf_dir).select("item_id", "fingerprint")


@query(f"WITH {_FP}, f AS (SELECT fingerprint, min(item_id) AS item_a FROM fp WHERE fingerprint IS NOT NULL GROUP BY 1 HAVING count(*) > 1) SELECT item_a, item_id AS item_b FROM fp JOIN f USING (fingerprint) WHERE item_id <> item_a")
def dedup_candidates(spark, sf_dir):
    return D.candidates(_printed(spark, sf_dir))


@query(f"""WITH {_FP}, f AS (SELECT fingerprint, min(item_id) AS item_a FROM fp WHERE fingerprint IS NOT NULL GROUP BY 1 HAVING count(*) > 1), p AS (SELECT item_a, item_id AS item_b FROM fp JOIN f USING (fingerprint) WHERE item_id <> item_a),
h AS (SELECT item_id, CASE WHEN item_id % 3 > 0 THEN author_id END AS author_id FROM fp), g AS (SELECT item_a, min(author_id) AS gift, count(*) AS sources FROM p JOIN h ON item_b = item_id GROUP BY 1)
SELECT h.item_id, p.item_a AS merged_into, coalesce(h.author_id, g.gift) AS author_id, coalesce(g.sources, 0) AS sources FROM h LEFT JOIN p ON h.item_id = p.item_b LEFT JOIN g ON g.item_a = h.item_id""")
def confirm_merge(spark, sf_dir):
    items = _printed(spark, sf_dir)
    holes = items.select("item_id", F.when(F.col("item_id") % 3 > 0, F.col("author_id")).alias("author_id"))
    return D.confirm(holes, D.candidates(items), ["author_id"]).select("item_id", "merged_into", "author_id", "sources")


@query(f"WITH {EVENTS_SQL} SELECT count(*) AS snapshots, count(DISTINCT item_id) AS items FROM (SELECT DISTINCT item_id, date_trunc('week', captured_at), views, likes, comments, shares, favorites, upvotes FROM m1_snapshots)")
def snapshot_suppression(spark, sf_dir):
    s = event_snapshots(spark, sf_dir).withColumn("batch", F.date_trunc("week", "captured_at"))
    return D.suppress(s, ["item_id", "batch"]).agg(F.count(F.lit(1)).alias("snapshots"), F.count_distinct("item_id").alias("items"))


@query("""WITH a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS title, CAST(o_custkey AS BIGINT) AS likes FROM orders),
b AS (SELECT l_orderkey AS k, max(l_returnflag) AS title, CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE count(*) END AS likes FROM lineitem GROUP BY l_orderkey)
SELECT coalesce(a.k, b.k) AS k, coalesce(a.title, b.title) AS title, coalesce(b.likes, a.likes) AS likes, CASE WHEN a.k IS NULL THEN 'new' WHEN b.k IS NULL THEN 'kept' ELSE 'merged' END AS status FROM a FULL JOIN b ON a.k = b.k""")
def merge_fill_null(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("title"), F.col("o_custkey").alias("likes"))
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_returnflag").alias("title"), F.count(F.lit(1)).alias("n"))
    return D.merge(o, li.select("k", "title", F.when(F.col("k") % 4 != 0, F.col("n")).alias("likes")), "k", ["title"], ["likes"])


@query("SELECT o_orderpriority AS batch, count(*) AS n, count(CASE WHEN o_totalprice < 2000 THEN 1 END) AS failed, CASE WHEN count(CASE WHEN o_totalprice < 2000 THEN 1 END) = 0 THEN 'completed' WHEN count(CASE WHEN o_totalprice < 2000 THEN 1 END) = count(*) THEN 'failed' ELSE 'partial' END AS status FROM orders GROUP BY 1")
def batch_status(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("batch"), (F.col("o_totalprice") >= 2000).alias("valid"))
    return D.batch_status(o, "batch", "valid")


@query("SELECT k, status, total, day FROM (SELECT o_custkey AS k, o_orderstatus AS status, o_totalprice AS total, CAST(o_orderdate AS DATE) AS day, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def latest_upsert(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"), "o_orderdate", "o_orderkey")
    return D.latest_by(o, ["k"], ["o_orderdate", "o_orderkey"]).select("k", "status", "total", F.to_date("o_orderdate").alias("day"))


_QUALITY = """CASE WHEN trim(coalesce(title, '')) = '' AND trim(coalesce(text, '')) = '' THEN 'invalid' WHEN item_id IS NOT NULL AND author_id IS NOT NULL AND n IS NOT NULL AND stamp IS NOT NULL THEN 'complete' ELSE 'partial' END"""


@query(f"""WITH i AS (SELECT doc_id AS item_id, CASE WHEN doc_id % 4 > 0 THEN source END AS author_id, split_part(text, '.', 1) AS title, text, CASE WHEN doc_id % 3 > 0 THEN n_chars END AS n, CASE WHEN doc_id % 2 = 0 THEN doc_id END AS stamp FROM documents)
SELECT item_id, {_QUALITY} AS quality, concat_ws(',', CASE WHEN trim(coalesce(title, '')) = '' AND trim(coalesce(text, '')) = '' THEN 'missing_body' END, CASE WHEN coalesce(title, '') = '' THEN 'missing_title' END, CASE WHEN coalesce(text, '') = '' THEN 'missing_text' END,
CASE WHEN n IS NULL THEN 'missing_metrics' END, CASE WHEN author_id IS NULL THEN 'missing_author' END, CASE WHEN stamp IS NULL THEN 'missing_published_at' END) AS reasons FROM i""")
def data_quality(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    odd = lambda m, c: F.when(F.col("doc_id") % m > 0, F.col(c))
    stamp = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id"))
    q, why = T.data_quality(F.col("lang"), F.col("doc_id"), F.split_part("text", F.lit("."), F.lit(1)), F.col("text"), stamp, odd(4, "source"), [odd(3, "n_chars")])
    return d.select(F.col("doc_id").alias("item_id"), q.alias("quality"), F.array_join(why, ",").alias("reasons"))


_KINDS = [(alias, kind) for kind, aliases in T.CONTENT_TYPES.items() for alias in aliases.split()] + [("else", None), ("未知", None)]


@query("SELECT p_partkey, CASE p_partkey %% %d %s END AS kind FROM part" % (len(_KINDS), " ".join(f"WHEN {i} THEN {'NULL' if k is None else chr(39) + k + chr(39)}" for i, (_, k) in enumerate(_KINDS))))
def content_type(spark, sf_dir):
    """Every alias of a content type, and two words that are none."""
    alias = F.element_at(F.array(*[F.lit(f" {a.title()} ") for a, _ in _KINDS]), (F.col("p_partkey") % len(_KINDS) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", T.content_type(alias).alias("kind"))


@query("SELECT p_partkey, p_brand || ',' || lower(p_brand) || ',' || p_type AS tags FROM part")
def hashtags(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    written = F.concat(F.lit("#"), "p_brand", F.lit(" #"), F.lower("p_brand"), F.lit("x、#"), F.upper("p_brand"), F.lit("，"), F.regexp_replace("p_type", " ", "_"))
    return p.select("p_partkey", F.array_join(T.hashtags(written), ",").alias("tags"))


ORACLES["hashtags"] = "SELECT p_partkey, concat_ws(',', list_extract(t, 1), list_extract(t, 2), list_extract(t, 3), list_extract(t, 4)) AS tags FROM (SELECT p_partkey, list_transform(list_filter(list_zip(w, range(len(w))), lambda x: list_position(list_transform(w, lambda y: lower(y)), lower(x[1])) = x[2] + 1), lambda x: x[1]) AS t FROM (SELECT p_partkey, list_filter(string_split_regex('#' || p_brand || ' #' || lower(p_brand) || 'x、#' || upper(p_brand) || '，' || replace(p_type, ' ', '_'), '[,\\s、，]+|#+'), lambda p: p <> '') AS w FROM part))"


@query("SELECT event_id, strftime(ts - INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS local_as_utc, strftime(ts, '%Y-%m-%d %H:%M:%S') AS epoch_as_utc, NULL::VARCHAR AS impossible FROM events")
def normalize_date_tz(spark, sf_dir):
    e, ts = table(spark, sf_dir, "events"), F.col("ts").cast("timestamp")
    said = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return e.select("event_id", said(T.utc_time(F.date_format(ts, "yyyy/MM/dd HH:mm:ss"), "Asia/Shanghai")).alias("local_as_utc"), said(T.utc_time(F.unix_millis(ts).cast("string"))).alias("epoch_as_utc"), said(T.utc_time(F.concat(F.date_format(ts, "yyyy"), F.lit("-13-40 99:99:99")))).alias("impossible"))


_STRIP = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script.*?</script>', ' ', 'gis'), '<style.*?</style>', ' ', 'gis'), '<br\\s*/?>', chr(10), 'gi'), '</(p|div|li|h[1-6])>', chr(10), 'gi'), '<[^>]+>', ' ', 'g')"
for _k, _v in T.ENTITIES.items():
    if _k != "&amp;":
        _STRIP = "replace({}, '{}', '{}')".format(_STRIP, _k, _v.replace("'", "''"))
_STRIP = f"replace({_STRIP}, '&amp;', '&')"


@query(f"SELECT page_id, {_STRIP} AS plain FROM pages")
def strip_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.strip_html(F.col("html")).alias("plain"))


@query("SELECT k, n, total FROM (SELECT CAST(props->>'$.k' AS VARCHAR) AS k, count(*) AS n, CAST(sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1)")
def json_pick(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return e.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("value") * 100 + 0.5).cast("long")).alias("total"))


@query("SELECT count(*) AS rows_in_all, count(CASE WHEN views IS NULL AND shares IS NULL THEN 1 END) AS blind, count(CASE WHEN likes = 0 THEN 1 END) AS real_zeros, count(CASE WHEN upvotes IS NOT NULL THEN 1 END) AS upvoted FROM m1_snapshots".join([f"WITH {EVENTS_SQL} ", ""]))
def health_counts(spark, sf_dir):
    c = F.col
    return event_snapshots(spark, sf_dir).agg(F.count(F.lit(1)).alias("rows_in_all"), F.count_if(c("views").isNull() & c("shares").isNull()).alias("blind"), F.count_if(c("likes") == 0).alias("real_zeros"), F.count_if(c("upvotes").isNotNull()).alias("upvoted"))


@query(f"WITH {EVENTS_SQL} SELECT platform, count(*) AS items, max(published_at) AS newest, count(CASE WHEN s.item_id IS NOT NULL THEN 1 END) AS measured FROM m1_items i LEFT JOIN (SELECT DISTINCT item_id FROM m1_snapshots WHERE views IS NOT NULL) s ON s.item_id = i.item_id GROUP BY 1")
def platform_coverage(spark, sf_dir):
    seen = event_snapshots(spark, sf_dir).where("views is not null").select(F.col("item_id").alias("s")).distinct()
    j = event_items(spark, sf_dir).join(seen, F.col("item_id") == F.col("s"), "left")
    return j.groupBy("platform").agg(F.count(F.lit(1)).alias("items"), F.max("published_at").alias("newest"), F.count("s").alias("measured"))


@query(f"WITH {EVENTS_SQL} SELECT platform, content_type, count(*) AS items FROM m1_items GROUP BY 1, 2")
def dashboard_counts(spark, sf_dir):
    return event_items(spark, sf_dir).groupBy("platform", "content_type").agg(F.count(F.lit(1)).alias("items"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def pending_anti_join(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def semi_join_platform(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    c = table(spark, sf_dir, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey", "c_name")


_TOK = "tok AS (SELECT item_id, unnest(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')) AS token, generate_subscripts(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> ''), 1) - 1 AS pos FROM (SELECT doc_id AS item_id, text FROM documents))"


_STORED: dict = {}


def stored_index(spark, sf_dir) -> Index:
    """The stored index of documents, made by the first search of a session and read by all others."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _STORED:
        index = Index(spark, f"{checkpoint_dir(spark)}/index-{uuid.uuid4().hex}", ["text"])
        index.update(text_items(spark, sf_dir).select("item_id", "text"), 0)
        _STORED[at] = index
    return _STORED[at]


def _index(spark, sf_dir):
    return stored_index(spark, sf_dir).postings()


@query(f"WITH {_TOK} SELECT item_id, count(*) AS tokens, count(DISTINCT token) AS different, max(pos) AS last_pos FROM tok GROUP BY 1")
def search_tokens(spark, sf_dir):
    return _index(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("tokens"), F.count_distinct("token").alias("different"), F.max("pos").cast("long").alias("last_pos"))


@query(f"WITH {_TOK} SELECT item_id FROM tok WHERE token IN ('the', 'license', 'version') GROUP BY 1 HAVING count(DISTINCT token) = 3")
def search_and(spark, sf_dir):
    return X.matches(_index(spark, sf_dir), ["the", "license", "version"])


@query(f"WITH {_TOK} SELECT a.item_id, count(*) AS n FROM tok a JOIN tok b ON a.item_id = b.item_id AND b.pos = a.pos + 1 WHERE a.token = 'of' AND b.token = 'the' GROUP BY 1")
def search_phrase(spark, sf_dir):
    return X.phrase(_index(spark, sf_dir), ["of", "the"]).select("item_id", "n")


@query(f"WITH {_TOK} SELECT item_id FROM tok GROUP BY 1 HAVING count(CASE WHEN starts_with(token, 'licen') THEN 1 END) > 0 AND count(CASE WHEN token = 'under' THEN 1 END) > 0")
def search_prefix(spark, sf_dir):
    return X.matches(_index(spark, sf_dir), ["licen*", "under"])


@query(f"""WITH {_TOK}, s AS (SELECT item_id, count(*) AS size FROM tok GROUP BY 1), f AS (SELECT item_id, token, count(*) AS tf FROM tok WHERE token IN ('license', 'version', 'apache') GROUP BY 1, 2), d AS (SELECT token, count(*) AS df FROM f GROUP BY 1), a AS (SELECT count(*) AS n, avg(size) AS mean FROM s)
SELECT item_id, floor(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) * 1e6 + 0.5) / 1e6 AS score FROM f JOIN d USING (token) JOIN s USING (item_id), a GROUP BY 1""")
def search_bm25(spark, sf_dir):
    index = stored_index(spark, sf_dir)
    return X.bm25(index.postings(), ["license", "version", "apache"], sizes=index.sizes()).select("item_id", (F.floor(F.col("score") * 1e6 + 0.5) / 1e6).alias("score"))


_SNIPPET = ["license", "version", "secret"]
_ASKED = ", ".join(f"'{t}'" for t in _SNIPPET)


@query(f"""WITH {_TOK}, said AS (SELECT doc_id AS item_id, list_filter(string_split_regex(text, '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS words FROM documents), h AS (SELECT item_id, pos, token FROM tok WHERE token IN ({_ASKED})),
w AS (SELECT a.item_id, a.pos AS start, count(DISTINCT b.token) AS n FROM h a JOIN h b ON a.item_id = b.item_id AND b.pos BETWEEN a.pos AND a.pos + 19 GROUP BY 1, 2),
best AS (SELECT item_id, start, n FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, start) AS r FROM w) WHERE r = 1)
SELECT item_id, start::INTEGER AS start, n::INTEGER AS hits, CASE WHEN start > 0 THEN '…' ELSE '' END || list_aggregate(list_transform(words[start + 1:start + 20], lambda t: CASE WHEN lower(t) IN ({_ASKED}) THEN '[' || t || ']' ELSE t END), 'string_agg', ' ') || CASE WHEN len(words) > start + 20 THEN '…' ELSE '' END AS snippet FROM best JOIN said USING (item_id)""")
def search_best_snippets(spark, sf_dir):
    """The twenty tokens of each text that hold the most of three words."""
    return X.best_snippets(_index(spark, sf_dir), text_items(spark, sf_dir), _SNIPPET, "text")


_EDITED = "SELECT doc_id, CASE WHEN lang = 'fr' THEN text || ' Revised license.' ELSE text END AS text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r > 1)"


@query(f"WITH {_TOK.replace('FROM documents', f'FROM ({_EDITED})')} SELECT item_id, count(*) AS tokens, count(CASE WHEN token = 'revised' THEN 1 END) AS revised FROM tok WHERE item_id IN (SELECT item_id FROM tok WHERE token = 'license') GROUP BY 1")
def search_after_updates(spark, sf_dir):
    """A search in an index of its own after two updates: texts of one language are edited, and of equal texts all but the
    first item go, as when duplicates are merged."""
    index = Index(spark, f"{checkpoint_dir(spark)}/index-{uuid.uuid4().hex}", ["text"])
    docs = text_items(spark, sf_dir)
    index.update(docs.select("item_id", "text"), 0)
    same = docs.select("item_id", F.col("text").isNull().alias("n"), F.xxhash64("text").alias("d1"), F.xxhash64(F.lit("second"), "text").alias("d2"))  # texts by two hashes, as in the index
    first = same.groupBy("n", "d1", "d2").agg(F.min("item_id").alias("_first"))
    gone = saved(same.join(first, ["n", "d1", "d2"]).where("item_id <> _first").select("item_id"))
    edited = docs.where("platform = 'fr'").select("item_id", F.concat("text", F.lit(" Revised license.")).alias("text"))
    index.update(edited, 1, gone)
    index.update(docs.limit(0).select("item_id", "text"), 2, gone)
    rows = index.postings()
    revised = rows.where("token = 'revised'").groupBy(F.col("item_id").alias("_r")).agg(F.count(F.lit(1)).alias("n"))
    sizes = index.sizes().select(F.col("item_id").alias("_s"), "size")
    found = X.matches(rows, ["license"]).join(sizes, F.col("item_id") == F.col("_s")).join(revised, F.col("item_id") == F.col("_r"), "left")
    return found.select("item_id", F.col("size").alias("tokens"), F.coalesce("n", F.lit(0)).alias("revised"))


@query("SELECT doc_id AS item_id FROM documents WHERE contains(lower(text), 'mit license')")
def search_like_fallback(spark, sf_dir):
    return X.like(text_items(spark, sf_dir), "MIT License", ["text"]).select("item_id")


@query(f"WITH {_TOK}, a AS (SELECT item_id FROM tok WHERE token IN ('mit', 'license') GROUP BY 1 HAVING count(DISTINCT token) = 2), b AS (SELECT doc_id FROM documents WHERE contains(lower(text), 'ense. ')) SELECT 1 AS asked, item_id, 'fts' AS mode FROM a UNION ALL SELECT 2, doc_id, 'like' FROM b")
def search_with_fallback(spark, sf_dir):
    """Two searches: one that the index answers, and one for part of a word, which falls back to plain text."""
    index, docs, out = _index(spark, sf_dir), text_items(spark, sf_dir), []
    for k, terms in enumerate((["mit", "license"], ["ense. "]), 1):
        out.append(X.search(index, docs, terms, ["text"]).select(F.lit(k).alias("asked"), "item_id", "mode"))
    return out[0].union(out[1])


@query("""WITH w AS (SELECT DISTINCT doc_id, source, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9''+.-]{1,23}'), lambda x: x NOT IN (%s))) AS word FROM documents), tf AS (SELECT source, word, count(*) AS tf FROM w GROUP BY 1, 2), df AS (SELECT word, sum(tf) AS df FROM tf GROUP BY 1),
m AS (SELECT source, count(*) AS m FROM documents GROUP BY 1), r AS (SELECT source AS author_id, word, floor(CAST(tf AS DOUBLE) / m * ln(1 + CAST((SELECT count(*) FROM documents) AS DOUBLE) / (1 + df)) * 1e6 + 0.5) / 1e6 AS score FROM tf JOIN df USING (word) JOIN m USING (source))
SELECT author_id, word, score, r FROM (SELECT *, row_number() OVER (PARTITION BY author_id ORDER BY score DESC, word) AS r FROM r) WHERE r <= 8""" % ", ".join("'{}'".format(w.replace("'", "''")) for w in T.STOP_WORDS))
def keywords_tfidf(spark, sf_dir):
    """The eight best words of each source; top-k is what is asked for."""
    return X.keywords(text_items(spark, sf_dir).withColumn("words", T.words(F.col("text"))), "author_id")
