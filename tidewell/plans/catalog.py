"""Registered queries over imports, decisions, governance, evidence bundles, lists and details."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.functions import content as C
from tidewell.functions import text as T
from tidewell.functions.stats import half_up
from tidewell.operators import catalog as O
from tidewell.operators import intel as I
from tidewell.operators import scoring as S
from tidewell.operators import silver as D
from tidewell.operators import similarity as V
from tidewell.operators.graph import checkpoint_dir, saved
from tidewell.operators.ingest import Imports
from tidewell.profiles import TREND

from .intelligence import _TOPIC_LIFT, _F, _angles, _angles_sql
from .scores import _PARTS, _TREND, _trend, runs, _runs_sql
from .texts import _CANON, _FP, _printed
from .views import EVENTS_SQL, NOW, UPVOTING, event_items, event_snapshots, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_R6 = "floor(({}) * 1e6 + 0.5) / 1e6"

# pages arrive as records: three in a row share an id, every fifth has no platform, every seventh no title
_INCOMING = f"""cn AS ({_CANON}), inc AS (SELECT page_id AS row_no, CASE WHEN page_id % 5 > 0 THEN 'weibo' END AS platform, CASE WHEN page_id % 2 = 0 THEN CAST(page_id // 6 AS VARCHAR) END AS content_id,
  CASE WHEN page_id % 11 = 0 THEN 'https://same.example.org/x' ELSE canonical END AS canonical, CASE WHEN page_id % 7 > 0 THEN 'page ' || page_id END AS title FROM cn),
ex AS (SELECT 1000000 + page_id AS item_id, 'weibo' AS platform, CAST(page_id // 60 AS VARCHAR) AS content_id, canonical FROM cn WHERE canonical LIKE 'https%')"""


def _incoming(spark, sf_dir):
    """(existing, incoming): https pages are stored as items, all pages arrive."""
    c = F.col
    p = table(spark, sf_dir, "pages").select("page_id", T.canonical_url(c("url")).alias("canonical"))
    existing = p.where(F.startswith("canonical", F.lit("https"))).select((c("page_id") + 1000000).alias("item_id"), F.lit("weibo").alias("platform"), F.floor(c("page_id") / 60).cast("string").alias("content_id"), "canonical")
    url = F.when(c("page_id") % 11 == 0, "https://same.example.org/x").otherwise(c("canonical"))
    inc = p.select(c("page_id").alias("row_no"), F.when(c("page_id") % 5 > 0, "weibo").alias("platform"), F.when(c("page_id") % 2 == 0, F.floor(c("page_id") / 6).cast("string")).alias("content_id"), url.alias("canonical"), F.when(c("page_id") % 7 > 0, F.concat(F.lit("page "), c("page_id").cast("string"))).alias("title"), F.lit(None).cast("string").alias("text"))
    return existing, inc


_RESOLVED = f"""WITH RECURSIVE {_INCOMING}, noted AS (SELECT *, CASE WHEN platform IS NULL THEN 'no platform' WHEN title IS NULL THEN 'no title and no text' END AS note FROM inc),
f AS (SELECT row_no, n.platform, n.content_id, n.canonical, coalesce((SELECT min(item_id) FROM ex WHERE ex.platform = n.platform AND ex.content_id = n.content_id), (SELECT min(item_id) FROM ex WHERE ex.canonical = n.canonical)) AS target FROM noted n WHERE note IS NULL),
free AS (SELECT * FROM f WHERE target IS NULL), e AS (SELECT a.row_no AS a, b.row_no AS b FROM free a JOIN free b ON a.row_no <> b.row_no AND (a.canonical = b.canonical OR (a.platform = b.platform AND a.content_id = b.content_id))),
reach AS (SELECT row_no AS id, row_no AS root FROM free UNION SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.id), lead AS (SELECT id, min(root) AS leader FROM reach GROUP BY 1),
res AS (SELECT n.row_no, n.note, f.target, l.leader, CASE WHEN n.note IS NOT NULL THEN 'invalid' WHEN f.target IS NOT NULL THEN 'merged' WHEN l.leader = n.row_no THEN 'new' ELSE 'duplicate' END AS status FROM noted n LEFT JOIN f USING (row_no) LEFT JOIN lead l ON l.id = n.row_no)"""


@query(f"{_RESOLVED} SELECT row_no, note, target, leader, status FROM res")
def import_resolved(spark, sf_dir):
    """What becomes of each record of an import: invalid, merged into a stored item, new, or a duplicate in its batch."""
    return O.resolve_incoming(*_incoming(spark, sf_dir)).select("row_no", "note", "target", "leader", "status")


@query(f"{_RESOLVED} SELECT row_no // 100 AS batch, count(*) AS n, count(note) AS failed, count(CASE WHEN status = 'new' THEN 1 END) AS fresh, CASE WHEN count(note) = 0 THEN 'completed' WHEN count(note) = count(*) THEN 'failed' ELSE 'partial' END AS status, string_agg(CASE WHEN note IS NOT NULL THEN row_no || ':' || note END, ',' ORDER BY row_no) AS notes FROM res GROUP BY 1")
def import_batches(spark, sf_dir):
    """Batches of an import in brief, with the rows that failed and why."""
    r = O.resolve_incoming(*_incoming(spark, sf_dir)).select(F.floor(F.col("row_no") / 100).alias("batch"), "row_no", "note", "status")
    failed = F.array_sort(F.collect_list(F.when(F.col("note").isNotNull(), F.struct("row_no", "note"))))  # a batch is a hundred rows
    g = r.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.count("note").alias("failed"), F.count_if(F.col("status") == "new").alias("fresh"), failed.alias("f"))
    status = F.when(F.col("failed") == 0, "completed").when(F.col("failed") == F.col("n"), "failed").otherwise("partial")
    notes = F.array_join(F.transform("f", lambda x: F.concat(x["row_no"].cast("string"), F.lit(":"), x["note"])), ",")
    return g.select("batch", "n", "failed", "fresh", status.alias("status"), F.nullif(notes, F.lit("")).alias("notes"))


def _records(page):
    """The columns that imports take, from pages (page_id, canonical, title...) as SQL expressions of both engines."""
    c = F.col("page_id")
    return page.withColumn("views", F.when(c % 4 > 0, c * 7 % 1000)).withColumn("likes", F.when(c % 9 > 0, c % 50)).withColumn("content_type", F.when(c % 3 == 0, "article").when(c % 3 == 1, "unknown")).drop("page_id")


_TAKEN: dict = {}


def _imported(spark, sf_dir) -> Imports:
    """Two batches taken in, once a session: https pages first, then all pages."""
    at, c = (spark.sparkContext.applicationId, sf_dir), F.col
    if at in _TAKEN:
        return _TAKEN[at]
    p = table(spark, sf_dir, "pages").select("page_id", T.canonical_url(c("url")).alias("canonical"))
    none = F.lit(None).cast("string")
    first = p.where(F.startswith("canonical", F.lit("https"))).select("page_id", c("page_id").alias("row_no"), F.lit("weibo").alias("platform"), F.floor(c("page_id") / 60).cast("string").alias("content_id"), "canonical", F.when(c("page_id") % 2 == 0, F.concat(F.lit("stored "), c("page_id").cast("string"))).alias("title"), F.lit("body").alias("text"))
    then = _incoming(spark, sf_dir)[1].select(c("row_no").alias("page_id"), "row_no", "platform", "content_id", "canonical", "title", none.alias("text"))
    imports = Imports(spark, f"{checkpoint_dir(spark)}/imports-{uuid.uuid4().hex}", ["views", "likes"])
    for batch in (first, then):
        imports.run(_records(batch))
    _TAKEN[at] = imports
    return imports


def _import_sql() -> str:
    """WITH ... items1, raw, snapshots, merges: two batches b0 and b1, resolved one after the other."""
    extra = "CASE WHEN row_no % 4 > 0 THEN row_no * 7 % 1000 END AS views, CASE WHEN row_no % 9 > 0 THEN row_no % 50 END AS likes, CASE row_no % 3 WHEN 0 THEN 'article' WHEN 1 THEN 'unknown' END AS content_type"
    out = [f"""{_INCOMING}, b0 AS (SELECT *, {extra} FROM (SELECT page_id AS row_no, 'weibo' AS platform, CAST(page_id // 60 AS VARCHAR) AS content_id, canonical, CASE WHEN page_id % 2 = 0 THEN 'stored ' || page_id END AS title, 'body' AS text FROM cn WHERE canonical LIKE 'https%')),
b1 AS (SELECT *, {extra} FROM (SELECT row_no, platform, content_id, canonical, title, CAST(NULL AS VARCHAR) AS text FROM inc)),
items_ AS (SELECT -1::BIGINT AS item_id, '' AS platform, '' AS content_id, '' AS canonical, '' AS title, '' AS text, '' AS content_type, 0::BIGINT AS views, 0::BIGINT AS likes, 0 AS first_batch, 0 AS last_batch WHERE false)"""]
    for k, before in ((0, "items_"), (1, "items0")):
        text = ["platform", "content_id", "canonical", "title", "text"]
        first = ", ".join(f"arg_min({c}, row_no) FILTER ({c} IS NOT NULL) AS {c}, min(row_no) FILTER ({c} IS NOT NULL) AS by_{c}" for c in text)
        newest = ", ".join(f"arg_max({m}, row_no) FILTER ({m} IS NOT NULL) AS {m}" for m in ("views", "likes"))
        fill = ", ".join(f"coalesce(i.{c}, t.{c}) AS {c}" for c in text)
        out.append(f"""noted{k} AS (SELECT *, CASE WHEN platform IS NULL THEN 'no platform' WHEN title IS NULL AND text IS NULL THEN 'no title and no text' END AS note FROM b{k}),
found{k} AS (SELECT row_no, platform, content_id, canonical, coalesce((SELECT min(item_id) FROM {before} ex WHERE ex.platform = n.platform AND ex.content_id = n.content_id), (SELECT min(item_id) FROM {before} ex WHERE ex.canonical = n.canonical)) AS target FROM noted{k} n WHERE note IS NULL),
free{k} AS (SELECT * FROM found{k} WHERE target IS NULL), e{k} AS (SELECT a.row_no AS a, b.row_no AS b FROM free{k} a JOIN free{k} b ON a.row_no <> b.row_no AND (a.canonical = b.canonical OR (a.platform = b.platform AND a.content_id = b.content_id))),
reach{k} AS (SELECT row_no AS id, row_no AS root FROM free{k} UNION SELECT e{k}.b, reach{k}.root FROM reach{k} JOIN e{k} ON e{k}.a = reach{k}.id), lead{k} AS (SELECT id, min(root) AS leader FROM reach{k} GROUP BY 1),
made{k} AS (SELECT leader AS l, (SELECT coalesce(max(item_id), -1) FROM {before}) + row_number() OVER (ORDER BY leader) AS new_id FROM (SELECT DISTINCT leader FROM lead{k})),
r{k} AS (SELECT n.*, coalesce(f.target, m.new_id) AS item_id, CASE WHEN n.note IS NOT NULL THEN 'invalid' WHEN f.target IS NOT NULL THEN 'merged' WHEN l.leader = n.row_no THEN 'new' ELSE 'duplicate' END AS status FROM noted{k} n LEFT JOIN found{k} f USING (row_no) LEFT JOIN lead{k} l ON l.id = n.row_no LEFT JOIN made{k} m ON m.l = l.leader),
t{k} AS (SELECT item_id, {first}, {newest}, arg_min(content_type, row_no) FILTER (content_type <> 'unknown') AS content_type FROM r{k} WHERE note IS NULL GROUP BY 1),
items{k} AS (SELECT coalesce(t.item_id, i.item_id) AS item_id, {fill}, coalesce(nullif(i.content_type, 'unknown'), t.content_type, 'unknown') AS content_type, coalesce(t.views, i.views) AS views, coalesce(t.likes, i.likes) AS likes, coalesce(i.first_batch, {k}) AS first_batch, CASE WHEN t.item_id IS NULL THEN i.last_batch ELSE {k} END AS last_batch FROM t{k} t FULL JOIN {before} i USING (item_id)),
m{k} AS (SELECT {k} AS batch, row_no, r.item_id, status AS kind, concat_ws(',', {', '.join(f"CASE WHEN i.{c} IS NULL AND by_{c} = row_no THEN '{c}' END" for c in text)}) AS filled FROM r{k} r JOIN t{k} USING (item_id) LEFT JOIN {before} i USING (item_id) WHERE note IS NULL AND status <> 'new')""")
    return "WITH RECURSIVE " + ", ".join(out)


@query(f"{_import_sql()} SELECT item_id, platform, content_id, canonical, title, text, content_type, views, likes, first_batch, last_batch FROM items1")
def import_items(spark, sf_dir):
    """The items after two batches: texts filled, metrics replaced, unknown types learnt."""
    return _imported(spark, sf_dir).items()


@query(f"{_import_sql()} SELECT 0 AS batch, row_no, status, note, item_id FROM r0 UNION ALL SELECT 1, row_no, status, note, item_id FROM r1")
def import_raw(spark, sf_dir):
    """Every record of both batches and what became of it."""
    return _imported(spark, sf_dir).raw().drop("payload")


@query(f"{_import_sql()} SELECT 0 AS batch, min(row_no) AS row_no, item_id, views, likes FROM r0 WHERE note IS NULL GROUP BY item_id, views, likes UNION ALL SELECT 1, min(row_no), item_id, views, likes FROM r1 WHERE note IS NULL GROUP BY item_id, views, likes")
def import_snapshots(spark, sf_dir):
    return _imported(spark, sf_dir).snapshots()


@query(f"{_import_sql()} SELECT * FROM m0 UNION ALL SELECT * FROM m1")
def import_merges(spark, sf_dir):
    """Records merged into stored items or into those of their own batch, and what they filled."""
    return _imported(spark, sf_dir).merges()


_CAND = f"{_FP}, f1 AS (SELECT fingerprint, min(item_id) AS item_a FROM fp WHERE fingerprint IS NOT NULL GROUP BY 1 HAVING count(*) > 1), cand AS (SELECT item_id AS candidate_id, item_a, item_id AS item_b, CASE WHEN item_id % 5 = 0 THEN 'ignored' ELSE 'pending' END AS status FROM fp JOIN f1 USING (fingerprint) WHERE item_id <> item_a)"


@query(f"WITH {_CAND} SELECT candidate_id, item_a, item_b, CASE WHEN status <> 'pending' THEN status WHEN candidate_id % 4 = 1 THEN 'merged' WHEN candidate_id % 4 = 2 THEN 'not_duplicate' WHEN candidate_id % 4 = 3 THEN 'ignored' ELSE 'pending' END AS status FROM cand")
def candidate_resolution(spark, sf_dir):
    """Candidates after one decision for three in four; only pending ones take it, and only the first."""
    c, k = D.candidates(_printed(spark, sf_dir)), F.col("candidate_id")
    cand = c.select(F.col("item_b").alias("candidate_id"), "item_a", "item_b", F.when(F.col("item_b") % 5 == 0, "ignored").otherwise("pending").alias("status"))
    acts = cand.where(k % 4 > 0).select("candidate_id", F.when(k % 4 == 1, "confirm").when(k % 4 == 2, "not_duplicate").otherwise("ignore").alias("action"), F.lit(1).alias("decided_at"))
    later = cand.where(k % 4 > 0).select("candidate_id", F.lit("confirm").alias("action"), F.lit(2).alias("decided_at"))
    return O.resolve_candidates(cand, acts.union(later))


@query(f"WITH {_CAND} SELECT item_a, item_b FROM cand WHERE item_b % 2 = 0")
def candidate_pairs_new(spark, sf_dir):
    """Candidate pairs that no stored pair names in either order; those of odd items are stored, turned round."""
    c = saved(D.candidates(_printed(spark, sf_dir)))
    return O.new_pairs(c, c.where("item_b % 2 = 1").select(F.col("item_b").alias("item_a"), F.col("item_a").alias("item_b")))


@query(f"{_runs_sql()}, s AS (SELECT topic_id, score, TIMESTAMP '2024-01-17' AS stamp FROM s0 UNION ALL SELECT topic_id, score, TIMESTAMP '2024-01-24' FROM s1 UNION ALL SELECT topic_id, score, TIMESTAMP '2024-01-31' FROM s2), d AS (SELECT user_id % 10 AS topic_id, max_by(event_type, (ts, event_id)) AS status, CAST(max(ts) AS TIMESTAMP) AS decided_at FROM events GROUP BY 1) SELECT d.topic_id, status, decided_at, max_by(score, stamp) FILTER (WHERE score IS NOT NULL) AS decision_score FROM d LEFT JOIN s ON s.topic_id = d.topic_id AND s.stamp <= d.decided_at GROUP BY 1, 2, 3")
def pick_decisions(spark, sf_dir):
    """Each topic's current decision (its last event) with the score of the run before it."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("topic_id"), F.col("event_type").alias("status"), F.struct(F.col("ts").cast("timestamp").alias("ts"), "event_id").alias("decided_at"))
    last = e.groupBy("topic_id").agg(F.max_by("status", "decided_at").alias("status"), F.max("decided_at").alias("d")).select("topic_id", "status", F.col("d.ts").alias("decided_at"))
    clocks = (dt.datetime(2024, 1, 17), dt.datetime(2024, 1, 24), NOW)
    scores = [r.select("topic_id", "score", F.lit(now).cast("timestamp").alias("calculated_at")).where("score is not null") for r, now in zip(runs(spark, sf_dir), clocks)]
    return O.picks(last, scores[0].union(scores[1]).union(scores[2]))


@query("SELECT doc_id AS item_id FROM documents WHERE doc_id % 3 > 0 OR doc_id % 2 > 0")
def feature_cache_misses(spark, sf_dir):
    """Documents whose features must be computed: the cache holds every third one, of which odd ones under an old text."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"))
    cache = d.where("item_id % 3 = 0").select("item_id", F.lit("v1").alias("version"), F.when(F.col("item_id") % 2 == 0, F.col("text_hash")).otherwise("old").alias("text_hash"))
    return O.to_compute(d, cache, "v1").select("item_id")


@query("SELECT a.vec_id AS a, b.vec_id AS b, floor(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) * 1e6 + 0.5) / 1e6 AS sim FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.label % 3 = b.label % 3 WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3")
def space_edges(spark, sf_dir):
    """Similarity edges within embedding spaces, which are never mixed; three spaces by label."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), (F.col("label") % 3).alias("space"))
    return V.edges(v, 0.3, space="space").select("a", "b", half_up(F.col("sim"), 6).alias("sim"))


@query("WITH m AS (SELECT vec_id AS item_id, label AS topic_id, label % 2 AS space FROM embeddings) SELECT item_id, CASE WHEN item_id % 10 = 0 THEN 100 + item_id % 3 WHEN topic_id = 1 THEN 3 ELSE topic_id END AS topic_id, item_id % 10 = 0 AS locked FROM m")
def topic_governance(spark, sf_dir):
    """Topics after acts: every tenth item is moved or split off (and locked), topic 1 goes into 3, and 2 into 5 is
    refused, as their spaces differ."""
    m = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("topic_id"), F.col("vec_id").alias("item_id"), (F.col("label") % 2).alias("space"))
    kind = "kind string, topic_id long, item_id long, to_topic long, at int"
    own = m.where("item_id % 10 = 0").select(F.when(F.col("item_id") % 20 == 0, "move").otherwise("split").alias("kind"), "topic_id", "item_id", (F.col("item_id") % 3 + 100).alias("to_topic"), F.lit(2).alias("at"))
    before = own.withColumn("to_topic", F.lit(7).cast("long")).withColumn("at", F.lit(1))
    whole = spark.createDataFrame([("merge", 1, None, 3, 3), ("merge", 2, None, 5, 3)], kind)
    return O.governed(m, own.union(before).union(whole))


_LIVE = f"WITH {_FP}, f1 AS (SELECT fingerprint, min(item_id) AS item_a FROM fp WHERE fingerprint IS NOT NULL GROUP BY 1), live AS (SELECT fp.item_id, fp.platform, fp.author_id, length(items.text) AS likes, TIMESTAMP '2024-01-01' + INTERVAL (fp.item_id % 40) DAY AS published_at FROM fp JOIN items ON items.item_id = fp.item_id LEFT JOIN f1 ON f1.fingerprint = fp.fingerprint WHERE fp.fingerprint IS NULL OR fp.item_id = item_a)"


def _live(spark, sf_dir):
    items = _printed(spark, sf_dir)
    first = items.where("fingerprint is not null").groupBy(F.col("fingerprint").alias("_f")).agg(F.min("item_id").alias("_a"))
    j = items.join(first, F.col("fingerprint") == F.col("_f"), "left").where("_a is null or _a = item_id")
    day = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((F.col("item_id") % 40).cast("int"))
    return j.select("item_id", "platform", "author_id", F.length("text").cast("long").alias("likes"), day.alias("published_at"))


@query(f"{_LIVE}, s AS (SELECT * FROM live WHERE author_id ILIKE '%1%' AND published_at >= TIMESTAMP '2024-01-03' AND published_at < TIMESTAMP '2024-01-31') SELECT item_id, platform, author_id, likes, published_at, (SELECT count(*) FROM s) AS total FROM s ORDER BY likes DESC NULLS LAST, item_id DESC LIMIT 20 OFFSET 20")
def live_items_page(spark, sf_dir):
    """The second page of live items by an author and up to the end of a day, with the number of all."""
    rows = _live(spark, sf_dir).where(F.ilike("author_id", F.lit("%1%")) & (F.col("published_at") >= "2024-01-03") & O.until_day_end(F.col("published_at"), "2024-01-30"))
    return O.page(rows, [F.desc_nulls_last("likes"), F.desc("item_id")], 20, 2)


_KEYS = {"score": "score", "members": "members", "since": "since", "density": "density", "content_growth": "content_growth", "creator_growth": "creator_growth", "recent_new": "recent_new"}


@query(" UNION ALL ".join(f"SELECT * FROM ({_TREND} SELECT '{k}' AS sorted_by, topic_id, row_number() OVER (ORDER BY {c} DESC NULLS LAST, members DESC, topic_id) AS r FROM trend)" for k, c in _KEYS.items()))
def topic_list_orders(spark, sf_dir):
    """The places of the topics in each of the seven orders of their list; a topic is a row, so the windows are small."""
    t, out = saved(_trend(spark, sf_dir)), None
    for k, c in _KEYS.items():
        w = Window.orderBy(F.desc_nulls_last(c), F.desc("members"), "topic_id")
        one = t.select(F.lit(k).alias("sorted_by"), "topic_id", F.row_number().over(w).cast("long").alias("r"))
        out = one if out is None else out.union(one)
    return out


_PART_NAMES = ("content_growth", "engagement_growth", "creator_growth", "burst_density", "acceleration")
_USED = " + ".join(f"CASE WHEN {p} IS NULL THEN 0 ELSE {TREND['weights'][p]} END::DOUBLE" for p in _PART_NAMES)


@query(f"{_TREND} " + " UNION ALL ".join(f"SELECT topic_id, '{p}' AS part, {p} AS value, {TREND['weights'][p]}::DOUBLE AS weight, CASE WHEN {p} IS NOT NULL THEN {_R6.format(str(TREND['weights'][p]) + '::DOUBLE / (' + _USED + ')')} END AS effective, CASE WHEN {p} IS NULL THEN 'unknown' END AS reason FROM trend" for p in _PART_NAMES))
def trend_breakdown(spark, sf_dir):
    """What a trend score is made of: each part's value, weight, the weight it has with what is known, or why it has none."""
    t, w = _trend(spark, sf_dir), TREND["weights"]
    used = sum((F.when(F.col(p).isNotNull(), F.lit(w[p])).otherwise(0.0) for p in _PART_NAMES), F.lit(0.0))
    part = lambda p: F.struct(F.lit(p).alias("part"), F.col(p).alias("value"), F.lit(w[p]).alias("weight"), F.when(F.col(p).isNotNull(), half_up(F.lit(w[p]) / used, 6)).alias("effective"), F.when(F.col(p).isNull(), "unknown").alias("reason"))
    return t.select("topic_id", F.explode(F.array(*[part(p) for p in _PART_NAMES])).alias("x")).select("topic_id", "x.*")


@query("SELECT user_id % 10 AS topic_id, count(*) AS runs, CAST(max(ts) AS TIMESTAMP) AS newest FROM events GROUP BY 1")
def topic_runs(spark, sf_dir):
    """How many runs each topic had, and the newest."""
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("topic_id")).agg(F.count(F.lit(1)).alias("runs"), F.max("ts").cast("timestamp").alias("newest"))


@query(f"WITH {EVENTS_SQL}, c AS (SELECT topic_id, CASE WHEN author_id % 3 > 0 THEN author_id END AS a, count(*) AS c FROM m1_items GROUP BY 1, 2) SELECT topic_id, {_R6.format('max(CASE WHEN a IS NOT NULL THEN c END) / CAST(sum(c) AS DOUBLE)')} AS max_share FROM c GROUP BY 1")
def max_author_share(spark, sf_dir):
    m = event_items(spark, sf_dir).select("topic_id", F.when(F.col("author_id") % 3 > 0, F.col("author_id")).alias("author_id"))
    return O.author_share(m).select("topic_id", half_up(F.col("max_share"), 6).alias("max_share"))


@query("WITH e AS (SELECT user_id, ts, event_id, CASE WHEN event_type <> 'view' THEN value END AS value, CASE WHEN event_type = 'error' THEN event_id END AS failed FROM events) SELECT user_id, max_by(value, (ts, event_id)) FILTER (WHERE value IS NOT NULL) AS value, max_by(failed, (ts, event_id)) FILTER (WHERE failed IS NOT NULL) AS failed FROM e GROUP BY 1")
def last_known_values(spark, sf_dir):
    """Each user's last value that is not a view's, and last failed event."""
    e = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("at"), F.when(F.col("event_type") != "view", F.col("value")).alias("value"), F.when(F.col("event_type") == "error", F.col("event_id")).alias("failed"))
    return O.last_known(e, "user_id", "at", ["value", "failed"])


_GOVERNED = "g AS (SELECT item_id, CASE WHEN item_id % 10 = 0 THEN 100 + item_id % 3 WHEN topic_id = 1 THEN 3 ELSE topic_id END AS topic_id FROM (SELECT vec_id AS item_id, label AS topic_id FROM embeddings))"


@query(f"WITH {_GOVERNED}, t AS (SELECT DISTINCT label AS topic_id, 'topic ' || label AS name FROM embeddings), n AS (SELECT topic_id, count(*) AS members FROM g GROUP BY 1) SELECT coalesce(t.topic_id, n.topic_id)::BIGINT AS topic_id, CASE WHEN t.topic_id = 4 THEN 'later' WHEN t.topic_id % 2 = 0 THEN 'even ' || t.topic_id ELSE name END AS name, coalesce(t.topic_id % 3 = 0 AND t.topic_id <> 6, false) AS watched, coalesce(members, 0) AS members FROM t FULL JOIN n ON n.topic_id = t.topic_id")
def topic_governance_topics(spark, sf_dir):
    """Topics after renames (the last counts, a blank one not), watches, one taken back, and a recount of the members that
    topic_governance leaves them."""
    t = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("topic_id")).distinct()
    act = lambda rows, kind, name, at: rows.select(F.lit(kind).alias("kind"), "topic_id", name.alias("name"), F.lit(at).alias("at"))
    none = F.lit(None).cast("string")
    acts = act(t.where("topic_id % 2 = 0"), "rename", F.concat(F.lit("even "), "topic_id"), 1).union(act(t.where("topic_id = 4"), "rename", F.lit("later"), 2)).union(act(t.where("topic_id = 2"), "rename", F.lit(" "), 3))
    acts = acts.union(act(t.where("topic_id % 3 = 0"), "watch", none, 1)).union(act(t.where("topic_id = 6"), "unwatch", none, 2))
    return O.topics_after(t.withColumn("name", F.concat(F.lit("topic "), "topic_id")), acts, topic_governance(spark, sf_dir))


@query("SELECT o_orderkey AS item_id, c_name AS author FROM orders JOIN customer ON c_custkey = o_custkey WHERE (c_name ILIKE '%77%' OR c_custkey::VARCHAR ILIKE '%77%') AND (o_orderpriority ILIKE '%urg%' OR o_orderstatus ILIKE 'f')")
def author_and_keyword(spark, sf_dir):
    """Items by an author's name or id, whichever holds what is asked, and by a keyword in one of several columns."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = o.join(O.named_or_numbered(c, "77", "c_name", "c_custkey"), o.o_custkey == c.c_custkey)
    return rows.where(F.contains(F.lower("o_orderpriority"), F.lit("urg")) | (F.lower("o_orderstatus") == "f")).select(F.col("o_orderkey").alias("item_id"), F.col("c_name").alias("author"))


@query("SELECT CASE WHEN n_chars IS NULL THEN NULL WHEN n_chars % 100 < 34 THEN 'low' WHEN n_chars % 100 < 67 THEN 'medium' ELSE 'high' END AS band, count(*) AS n FROM documents GROUP BY 1")
def score_bands(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(O.band(F.col("n_chars") % 100).alias("band")).agg(F.count(F.lit(1)).alias("n"))


_LIFTS = f"s AS (SELECT CAST(label AS BIGINT) AS topic_id, toxic = 1 AS viral, {_F} FROM documents JOIN labels USING (doc_id) JOIN embeddings ON vec_id = doc_id), lg AS ({_TOPIC_LIFT}), lr AS (SELECT topic_id, feature, CASE WHEN hv = 0 OR hc = 0 THEN (hv + 1) / CAST(nv + 2 AS DOUBLE) ELSE hv / CAST(nv AS DOUBLE) END / CASE WHEN hv = 0 OR hc = 0 THEN (hc + 1) / CAST(nc + 2 AS DOUBLE) ELSE hc / CAST(nc AS DOUBLE) END AS lift, CASE WHEN least(nv, nc) >= 30 THEN 0 WHEN least(nv, nc) >= 10 THEN 1 ELSE 2 END AS q FROM lg WHERE nv > 0 AND nc > 0), pat AS (SELECT topic_id, feature, q, {_R6.format('lift')} AS lift FROM lr)"


def _patterns(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").cast("long").alias("topic_id")), "doc_id")
    sides = d.select("topic_id", (F.col("toxic") == 1).alias("viral"), *[c.alias(k) for k, c in T.features(F.col("text")).items()])
    return I.boolean_lift(sides, "topic_id", "viral", list(T.FEATURES))


@query(f"WITH {_LIFTS} SELECT topic_id, feature, lift, row_number() OVER (PARTITION BY topic_id ORDER BY q, abs(lift - 1) DESC, feature) AS r FROM pat")
def pattern_order(spark, sf_dir):
    """Patterns in order of evidence, then of effect."""
    w = Window.partitionBy("topic_id").orderBy(*O.by_evidence(F.col("quality"), F.col("lift") - 1), "feature")
    return _patterns(spark, sf_dir).select("topic_id", "feature", "lift", F.row_number().over(w).cast("long").alias("r"))


@query(f"""{_angles_sql()}, {_LIFTS}, bb AS ({_PARTS} SELECT topic_id, item_id, score, length(item_id || ' ' || score) AS n FROM burst WHERE score IS NOT NULL),
ll AS (SELECT topic_id, 0 AS part, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, item_id) AS r, 5 AS most, 'burst' AS name, item_id || ' ' || score AS line FROM bb UNION ALL SELECT topic_id, 1, row_number() OVER (PARTITION BY topic_id ORDER BY q, abs(lift - 1) DESC, feature), 8, 'pattern', feature || ' ' || lift FROM pat UNION ALL SELECT topic_id, 2, row_number() OVER (PARTITION BY topic_id ORDER BY members DESC, angle), 5, 'angle', angle || ' of ' || members FROM angles),
kk AS (SELECT * FROM ll WHERE r <= most), nk AS (SELECT *, part > 0 AND r > ceil(count(*) OVER (PARTITION BY topic_id, part) / 2.0) AS lower, sum(length(line)) OVER (PARTITION BY topic_id) AS whole FROM kk)
SELECT topic_id, name || '-' || r AS ref_id, line, whole <= 200 OR sum(length(line)) OVER (PARTITION BY topic_id ORDER BY lower, part, r ROWS UNBOUNDED PRECEDING) <= 200 AS kept FROM nk""")
def evidence_package(spark, sf_dir):
    """The evidence of each topic: best bursts, patterns and angles, numbered, within a budget of 200 characters."""
    c = F.col
    b = S.burst(event_items(spark, sf_dir), event_snapshots(spark, sf_dir), NOW, UPVOTING).where("score is not null")
    bursts = b.select("topic_id", F.concat_ws(" ", "item_id", "score").alias("line"), F.struct((-c("score")).alias("a"), c("item_id").alias("b")).alias("k"))
    rank = F.when(c("quality") == "high", 0).when(c("quality") == "medium", 1).otherwise(2)
    patterns = _patterns(spark, sf_dir).select("topic_id", F.concat_ws(" ", "feature", "lift").alias("line"), F.struct(rank.alias("a"), (-F.abs(c("lift") - 1)).alias("b"), c("feature").alias("c")).alias("k"))
    angles = _angles(spark, sf_dir).select("topic_id", F.concat_ws(" of ", "angle", "members").alias("line"), F.struct((-c("members")).alias("a"), c("angle").alias("b")).alias("k"))
    return O.evidence({"burst": (bursts, 5), "pattern": (patterns, 8), "angle": (angles, 5)}, 200)


@query(f"""{_TREND}, i AS (SELECT item_id, platform AS source, item_id % 5 = 0 AS made, (SELECT max(captured_at) FROM m1_snapshots n WHERE n.item_id = m1_items.item_id) AS captured_at, CASE WHEN item_id % 6 > 0 THEN published_at END AS published_at, CASE WHEN author_id % 3 > 0 THEN author_id END AS author_id, (SELECT arg_max(likes, captured_at) FROM m1_snapshots n WHERE n.item_id = m1_items.item_id) AS likes, topic_id FROM m1_items),
q AS (SELECT count(*) AS contents, count(DISTINCT source) AS sources, count(*) FILTER (made) AS made, max(captured_at) AS latest, count(*) FILTER (published_at IS NULL) AS without_time, count(*) FILTER (author_id IS NULL) AS without_author, count(*) FILTER (likes IS NULL) AS without_metric, count(*) FILTER (item_id NOT IN (SELECT vec_id FROM embeddings)) AS pending, count(*) FILTER (topic_id = 7) AS unclustered, count(DISTINCT CASE WHEN topic_id <> 7 THEN topic_id END) AS topics FROM i),
u AS (SELECT (SELECT count(score) FROM burst) AS scored, (SELECT count(score) FROM trend WHERE topic_id <> 7) AS trended)
SELECT contents, sources, CASE WHEN contents > 0 THEN floor(made * 1000 / contents::DOUBLE + 0.5) / 10 END AS made_share, latest, without_time, without_author, without_metric, contents - pending AS embedded, pending, unclustered, topics, CASE WHEN contents > 0 THEN floor(scored * 1000 / contents::DOUBLE + 0.5) / 10 END AS scored_share, CASE WHEN topics > 0 THEN floor(trended * 1000 / topics::DOUBLE + 0.5) / 10 END AS trended_share,
  CASE WHEN contents = 0 THEN 'collect' WHEN pending > 0 THEN 'embed' WHEN topics = 0 THEN 'cluster' WHEN scored = 0 THEN 'score' WHEN trended < topics THEN 'trend' END AS next_step FROM q, u""")
def analysis_status(spark, sf_dir):
    """How far the analysis of the event items is: vectors of the same ids, topics but for the seventh, burst and trend
    scores; a fifth of the items are taken as demonstration data."""
    c = F.col
    items, snapshots = saved(event_items(spark, sf_dir)), saved(event_snapshots(spark, sf_dir))
    last = snapshots.groupBy(c("item_id").alias("_i")).agg(F.max("captured_at").alias("captured_at"), F.max_by("likes", "captured_at").alias("likes"))
    rows = items.join(last, c("item_id") == c("_i"), "left").select("item_id", c("platform").alias("source"), (c("item_id") % 5 == 0).alias("made"), "captured_at", F.when(c("item_id") % 6 > 0, c("published_at")).alias("published_at"), F.when(c("author_id") % 3 > 0, c("author_id")).alias("author_id"), "likes")
    vectors = table(spark, sf_dir, "embeddings").select(c("vec_id").alias("item_id"))
    bursts = S.burst(items, snapshots, NOW, UPVOTING)
    trends = S.topic_trend(items, snapshots, bursts, NOW, UPVOTING).where("topic_id <> 7")
    return O.analysis_status(rows, vectors, items.where("topic_id <> 7").select("item_id", "topic_id"), bursts, trends)


_REPS = "flat AS (SELECT vec_id, label, pos, embedding[pos]::DOUBLE AS x FROM embeddings, range(1, 65) t(pos)), mid AS (SELECT label, list(x ORDER BY pos) AS c FROM (SELECT label, pos, avg(x) AS x FROM flat GROUP BY 1, 2) GROUP BY 1), rep AS (SELECT label AS topic_id, vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], c), 9) AS sim, row_number() OVER (PARTITION BY label ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], c), 9) DESC, vec_id) AS r FROM embeddings JOIN mid USING (label))"


@query(f"WITH {_REPS} SELECT topic_id, id, floor(sim * 1e6 + 0.5) / 1e6 AS sim, r FROM rep WHERE r <= 5")
def topic_representatives(spark, sf_dir):
    """The five vectors nearest to the centroid of each label."""
    v = table(spark, sf_dir, "embeddings").select(F.col("label").alias("topic_id"), F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return V.representatives(v, "topic_id").select("topic_id", "id", half_up(F.col("sim"), 6).alias("sim"), F.col("r").cast("long").alias("r"))


@query(f"""WITH RECURSIVE {_REPS}, m AS (SELECT label AS topic_id, d.* FROM documents d JOIN embeddings ON vec_id = doc_id),
l AS (SELECT topic_id, 'burst' AS part, row_number() OVER (PARTITION BY topic_id ORDER BY n_chars DESC, doc_id) AS r, doc_id || ' ' || left(text, 40 + doc_id % 120) AS line, 5 AS most FROM m
  UNION ALL SELECT topic_id, 'representative', r, id || ' at ' || CAST(floor(sim * 1000) AS INT), 5 FROM rep
  UNION ALL SELECT topic_id, 'pattern', row_number() OVER (PARTITION BY topic_id ORDER BY count(*) DESC, source), source || ' ' || count(*), 8 FROM m GROUP BY topic_id, source
  UNION ALL SELECT topic_id, 'angle', row_number() OVER (PARTITION BY topic_id ORDER BY count(*) DESC, lang), lang || ' ' || count(*), 5 FROM m GROUP BY topic_id, lang),
k AS (SELECT *, CASE WHEN part = 'burst' AND length(line) > 81 THEN left(line, 80) || '…' ELSE line END AS short FROM l WHERE r <= most),
a AS (SELECT topic_id, {', '.join(f"coalesce(list(length({line}) ORDER BY r) FILTER (part = '{part}'), []) AS {name}" for name, part, line in (("lb", "burst", "line"), ("sb", "burst", "short"), ("lr", "representative", "line"), ("lp", "pattern", "line"), ("la", "angle", "line")))}, 250 + topic_id * 30 AS budget FROM k GROUP BY 1),
t AS (
  SELECT topic_id, 0 AS step, false AS cut, len(lb) AS nb, len(lr) AS nr, len(lp) AS np, len(la) AS na FROM a
  UNION ALL
  SELECT topic_id, step + 1, cut OR can, CASE WHEN NOT can AND nr <= 1 AND nb > 1 THEN (nb + 1) // 2 ELSE nb END, CASE WHEN NOT can AND nr > 1 THEN (nr + 1) // 2 ELSE nr END,
    CASE WHEN NOT can AND nr <= 1 AND nb <= 1 AND np > 2 THEN (np + 1) // 2 ELSE np END, CASE WHEN NOT can AND nr <= 1 AND nb <= 1 AND np <= 2 AND na > 1 THEN (na + 1) // 2 ELSE na END
  FROM (SELECT t.*, NOT cut AND lb <> sb AS can, coalesce(list_sum((CASE WHEN cut THEN sb ELSE lb END)[1:nb]), 0) + coalesce(list_sum(lr[1:nr]), 0) + coalesce(list_sum(lp[1:np]), 0) + coalesce(list_sum(la[1:na]), 0) AS size, budget FROM t JOIN a USING (topic_id))
  WHERE size > budget AND (can OR nr > 1 OR nb > 1 OR np > 2 OR na > 1)),
z AS (SELECT t.*, lb, sb, lr, lp, la, coalesce(list_sum((CASE WHEN cut THEN sb ELSE lb END)[1:nb]), 0) + coalesce(list_sum(lr[1:nr]), 0) + coalesce(list_sum(lp[1:np]), 0) + coalesce(list_sum(la[1:na]), 0) > budget AS over FROM t JOIN a USING (topic_id) WHERE step = (SELECT max(step) FROM t u WHERE u.topic_id = t.topic_id)),
n AS (SELECT k.*, z.over, z.cut, CASE part WHEN 'burst' THEN nb WHEN 'representative' THEN nr WHEN 'pattern' THEN np ELSE na END AS n, CASE part WHEN 'burst' THEN len(lb) WHEN 'representative' THEN len(lr) WHEN 'pattern' THEN len(lp) ELSE len(la) END AS had FROM k JOIN z USING (topic_id))
SELECT topic_id, part || '-' || r AS ref_id, CASE WHEN cut AND part = 'burst' THEN short ELSE line END AS line, r <= n AS kept, n < had OR (cut AND part = 'burst') AS trimmed, over FROM n""")
def evidence_staged(spark, sf_dir):
    """Evidence of each label's documents within a budget of its own, trimmed in stages."""
    c, label = F.col, F.col("label").alias("topic_id")
    e = table(spark, sf_dir, "embeddings")
    m = table(spark, sf_dir, "documents").join(e.select("vec_id", label), c("doc_id") == c("vec_id"))
    bursts = m.select("topic_id", F.concat(c("doc_id").cast("string"), F.lit(" "), F.left("text", (40 + c("doc_id") % 120).cast("int"))).alias("line"), F.struct((-c("n_chars")).alias("a"), c("doc_id").alias("b")).alias("k"))
    reps = V.representatives(e.select(label, c("vec_id").alias("id"), c("embedding").alias("v")), "topic_id")
    reps = reps.select("topic_id", F.concat_ws(" at ", c("id").cast("string"), F.floor(c("sim") * 1000).cast("string")).alias("line"), F.struct(c("r").alias("a")).alias("k"))
    counted = lambda by: m.groupBy("topic_id", by).agg(F.count(F.lit(1)).alias("n")).select("topic_id", F.concat_ws(" ", by, "n").alias("line"), F.struct((-c("n")).alias("a"), c(by).alias("b")).alias("k"))
    parts = {"burst": (bursts, 5), "representative": (reps, 5), "pattern": (counted("source"), 8), "angle": (counted("lang"), 5)}
    return O.staged_evidence(parts, F.lit(250) + c("topic_id") * 30)  # budgets differ, so that every stage occurs


@query("SELECT DISTINCT vec_id % 10 AS topic_id, 'angle-' || vec_id % 8 AS ref_id FROM embeddings WHERE vec_id % 8 NOT BETWEEN 1 AND 5")
def unknown_evidence_refs(spark, sf_dir):
    """References to evidence that a topic does not have; each has angles 1 to 5."""
    e = table(spark, sf_dir, "embeddings")
    refs = e.select((F.col("vec_id") % 10).alias("topic_id"), F.concat(F.lit("angle-"), (F.col("vec_id") % 8).cast("string")).alias("ref_id"))
    known = e.select((F.col("vec_id") % 10).alias("topic_id"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("n")).select("topic_id", F.concat(F.lit("angle-"), F.col("n").cast("string")).alias("ref_id"))
    return O.unknown_refs(refs, known)


@query(f"{_TREND}, h AS (SELECT user_id % 10 AS topic_id, event_id, CAST(ts AS TIMESTAMP) AS stamp, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts DESC, event_id DESC) AS r FROM events) SELECT t.topic_id, t.score, t.state, h.event_id, h.stamp, h.r FROM states t JOIN h ON h.topic_id = t.topic_id WHERE h.r <= 20")
def topic_detail(spark, sf_dir):
    """Each topic's current row with its twenty newest events."""
    t = S.lifecycle(_trend(spark, sf_dir), NOW).select("topic_id", "score", "state")
    w = Window.partitionBy("topic_id").orderBy(F.desc("stamp"), F.desc("event_id"))
    h = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("topic_id"), "event_id", F.col("ts").cast("timestamp").alias("stamp"))
    return t.join(h.withColumn("r", F.row_number().over(w)).where("r <= 20"), "topic_id").select("topic_id", "score", "state", "event_id", "stamp", F.col("r").cast("long").alias("r"))


@query(f"{_TREND}, n AS (SELECT user_id % 10 AS topic_id, count(*) AS runs FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT topic_id, score, coalesce(runs, 0) AS runs FROM trend LEFT JOIN n USING (topic_id) ORDER BY score DESC NULLS LAST, topic_id LIMIT 5")
def topic_picker(spark, sf_dir):
    """The five topics to write about first, with how often they were picked; unknown scores last."""
    n = table(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy((F.col("user_id") % 10).alias("topic_id")).agg(F.count(F.lit(1)).alias("runs"))
    return _trend(spark, sf_dir).join(n, "topic_id", "left").select("topic_id", "score", F.coalesce("runs", F.lit(0)).alias("runs")).orderBy(F.desc_nulls_last("score"), "topic_id").limit(5)


@query("SELECT e.vec_id AS item_id, label AS space, sha256(coalesce(text, '')) AS text_hash, CASE WHEN text IS NULL THEN 'missing' WHEN vec_id % 4 = 0 THEN 'superseded' ELSE 'current' END AS status FROM embeddings e LEFT JOIN documents ON doc_id = vec_id")
def embedding_status(spark, sf_dir):
    """Each vector's space, the digest of its text, and whether it is current."""
    e, d = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents").select("doc_id", "text")
    j = e.join(d, F.col("vec_id") == F.col("doc_id"), "left")
    status = F.when(F.col("text").isNull(), "missing").when(F.col("vec_id") % 4 == 0, "superseded").otherwise("current")
    return j.select(F.col("vec_id").alias("item_id"), F.col("label").alias("space"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"), status.alias("status"))


_TITLES = "t AS (SELECT doc_id AS item_id, translate(lower(left(split_part(text, '.', 1), 30)), 'abcdefghijklmnopqrstuvwxyz', '探店美食学习电脑手机旅行购物健身穿搭的是我在北京教') AS title, TIMESTAMP '2024-01-31' - INTERVAL (doc_id % 48) HOUR AS published_at FROM documents)"


@query(f"WITH {_TITLES}, p AS (SELECT item_id, published_at, trim(left(trim(regexp_replace(regexp_replace(title, '[「」『』【】《》\"''（）()，。、；;：:!！?？…·\\-—|]', ' ', 'g'), '\\s+', ' ', 'g')), 30)) AS phrase FROM t WHERE published_at > TIMESTAMP '2024-01-30'), q AS (SELECT * FROM p WHERE length(phrase) >= 4 AND regexp_matches(phrase, '[一-龥]') AND phrase NOT IN (SELECT phrase FROM p WHERE item_id % 96 = 0)) SELECT item_id, phrase FROM (SELECT *, row_number() OVER (PARTITION BY left(phrase, 8) ORDER BY published_at DESC, item_id) AS r FROM q) WHERE r = 1")
def keyword_cascade(spark, sf_dir):
    """Search phrases of the last day's titles, without those asked within six hours."""
    d = table(spark, sf_dir, "documents")
    title = F.translate(F.lower(F.left(F.split_part("text", F.lit("."), F.lit(1)), F.lit(30))), "abcdefghijklmnopqrstuvwxyz", "探店美食学习电脑手机旅行购物健身穿搭的是我在北京教")
    t = d.select(F.col("doc_id").alias("item_id"), title.alias("title"), F.timestamp_seconds(F.unix_seconds(F.lit(NOW).cast("timestamp")) - F.col("doc_id") % 48 * 3600).alias("published_at"))
    asked = t.where("item_id % 96 = 0").select(C.hot_phrase(F.col("title")).alias("phrase"), F.lit(NOW - dt.timedelta(hours=1)).cast("timestamp").alias("asked_at"))
    return O.hot_queries(t, C.hot_phrase(F.col("title")), NOW, asked)
