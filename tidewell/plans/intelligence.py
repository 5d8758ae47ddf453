"""Registered queries over features, patterns, saturation, novelty and opportunity."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidewell.functions import stats as A
from tidewell.functions import text as T
from tidewell.operators import intel as I
from tidewell.operators import scoring as S
from tidewell.operators import similarity as V
from tidewell.operators.graph import saved
from tidewell.profiles import OPPORTUNITY

from .scores import _PARTS, parts_sql, stored_events, trend_sql
from .views import EVENTS_SQL, NOW, UPVOTING, clocked_sql, event_items, event_snapshots, seen_by, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_R6 = "floor(({}) * 1e6 + 0.5) / 1e6"
_F = ", ".join(f"regexp_matches(coalesce(text, ''), '{p}') AS {k}" for k, p in T.FEATURES.items())
#: A small lexicon of the given texts' languages.
LEXICON = ["license", "token", "password", "the", "der", "les", "los"]


@query(f"SELECT doc_id AS item_id, length(text) AS text_length, {_F} FROM documents")
def content_features(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("item_id"), F.length("text").cast("long").alias("text_length"), *[c.alias(k) for k, c in T.features(F.col("text")).items()])


@query("SELECT doc_id AS item_id, floor(least(1.0, (" + " + ".join(f"contains(text, '{w}')::INT" for w in LEXICON) + ") / 3.0) * 1e6 + 0.5) / 1e6 AS density, CASE WHEN regexp_matches(text, '[?？]') THEN 'question' WHEN regexp_matches(left(text, 40), '[0-9]') THEN 'number' WHEN length(text) <= 30 THEN 'opinion' ELSE 'none' END AS hook FROM documents")
def semantic_features(spark, sf_dir):
    t = F.col("text")
    hook = F.when(F.regexp_like(t, F.lit("[?？]")), "question").when(F.regexp_like(F.left(t, F.lit(40)), F.lit("[0-9]")), "number").when(F.length(t) <= 30, "opinion").otherwise("none")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), A.half_up(T.lexicon_density(t, LEXICON), 6).alias("density"), hook.alias("hook"))


def _sides(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.select("lang", (F.col("toxic") == 1).alias("viral"), F.col("doc_id").alias("item_id"), "source", F.col("n_chars"), F.length("text").alias("text_length"), F.when(F.col("n_chars") > 2000, "long").otherwise("short").alias("size"), *[c.alias(k) for k, c in T.features(F.col("text")).items()])


_S = f"WITH s AS (SELECT lang, toxic = 1 AS viral, doc_id AS item_id, source, n_chars, length(text) AS text_length, CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END AS size, {_F} FROM documents JOIN labels USING (doc_id))"
_LIFT = " UNION ALL ".join(f"SELECT lang, '{k}' AS feature, count(CASE WHEN viral THEN 1 END) AS nv, count(CASE WHEN NOT viral THEN 1 END) AS nc, count(CASE WHEN viral AND {k} THEN 1 END) AS hv, count(CASE WHEN NOT viral AND {k} THEN 1 END) AS hc FROM s GROUP BY lang" for k in T.FEATURES)


@query(f"""{_S}, g AS ({_LIFT}), r AS (SELECT *, hv = 0 OR hc = 0 AS smoothed, CASE WHEN hv = 0 OR hc = 0 THEN (hv + 1) / CAST(nv + 2 AS DOUBLE) ELSE hv / CAST(nv AS DOUBLE) END AS v, CASE WHEN hv = 0 OR hc = 0 THEN (hc + 1) / CAST(nc + 2 AS DOUBLE) ELSE hc / CAST(nc AS DOUBLE) END AS c FROM g WHERE nv > 0 AND nc > 0)
SELECT lang, feature, {_R6.format('v')} AS viral_rate, {_R6.format('c')} AS control_rate, {_R6.format('v / c')} AS lift, {_R6.format('v - c')} AS delta, CASE WHEN v / c > 1.15 THEN 'positive' WHEN v / c < 0.87 THEN 'negative' ELSE 'none' END AS direction, CASE WHEN least(nv, nc) >= 30 THEN 'high' WHEN least(nv, nc) >= 10 THEN 'medium' ELSE 'low' END AS quality, smoothed FROM r""")
def boolean_lift(spark, sf_dir):
    return I.boolean_lift(_sides(spark, sf_dir), "lang", "viral", list(T.FEATURES))


@query(f"{_S}, l AS (SELECT lang, viral, 'n_chars' AS feature, CAST(n_chars AS DOUBLE) AS x FROM s UNION ALL SELECT lang, viral, 'text_length', CAST(text_length AS DOUBLE) FROM s), q AS (SELECT lang, feature, quantile_cont(CASE WHEN viral THEN x END, 0.25) AS v1, quantile_cont(CASE WHEN viral THEN x END, 0.5) AS v2, quantile_cont(CASE WHEN viral THEN x END, 0.75) AS v3, quantile_cont(CASE WHEN NOT viral THEN x END, 0.5) AS c2 FROM l GROUP BY 1, 2 HAVING count(CASE WHEN viral THEN 1 END) > 0 AND count(CASE WHEN NOT viral THEN 1 END) > 0) SELECT lang, feature, {_R6.format('v2')} AS viral_median, {_R6.format('c2')} AS control_median, {_R6.format('v1')} AS viral_p25, {_R6.format('v3')} AS viral_p75, {_R6.format('v2 - c2')} AS delta, CASE WHEN (v2 - c2) / CASE WHEN abs(c2) > 1e-9 THEN abs(c2) ELSE 1 END > 0.15 THEN 'positive' WHEN (v2 - c2) / CASE WHEN abs(c2) > 1e-9 THEN abs(c2) ELSE 1 END < -0.15 THEN 'negative' ELSE 'none' END AS direction FROM q")
def continuous_compare(spark, sf_dir):
    return I.continuous_compare(_sides(spark, sf_dir), "lang", "viral", ["n_chars", "text_length"])


@query(f"{_S}, n AS (SELECT lang, count(CASE WHEN viral THEN 1 END) AS nv, count(CASE WHEN NOT viral THEN 1 END) AS nc FROM s GROUP BY 1), t AS (SELECT lang, source AS top, {_R6.format('count(CASE WHEN viral THEN 1 END) / CAST(max(nv) AS DOUBLE) - count(CASE WHEN NOT viral THEN 1 END) / CAST(max(nc) AS DOUBLE)')} AS delta FROM s JOIN n USING (lang) WHERE nv > 0 AND nc > 0 GROUP BY 1, 2) SELECT lang, top, delta FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY abs(delta) DESC, top) AS r FROM t) WHERE r = 1")
def categorical_share(spark, sf_dir):
    return I.categorical_share(_sides(spark, sf_dir), "lang", "viral", "source")


@query(f"""{_S}, e AS (SELECT lang FROM s WHERE viral GROUP BY 1 HAVING count(*) >= 8), p AS (SELECT s.*, EXISTS (SELECT 1 FROM s v WHERE v.viral AND v.lang = s.lang AND v.source = s.source) AS h1, EXISTS (SELECT 1 FROM s v WHERE v.viral AND v.lang = s.lang AND v.size = s.size) AS h2 FROM s JOIN e USING (lang) WHERE NOT viral),
k AS (SELECT lang, item_id, CASE WHEN h1 AND h2 THEN 0 WHEN h1 THEN 1 ELSE 2 END AS l FROM p), n AS (SELECT lang, count(CASE WHEN l = 0 THEN 1 END) AS n0, count(CASE WHEN l <= 1 THEN 1 END) AS n1, count(*) AS n2 FROM k GROUP BY 1), c AS (SELECT lang, CASE WHEN n0 >= 15 THEN 0 WHEN n1 >= 15 THEN 1 WHEN n2 >= 15 THEN 2 END AS level FROM n)
SELECT lang, item_id, level FROM k JOIN c USING (lang) WHERE l <= level""")
def control_ladder(spark, sf_dir):
    return I.control_ladder(_sides(spark, sf_dir), "lang", "viral", ["source", "size"])


@query(f"""{_S}, e AS (SELECT source AS g FROM s WHERE viral GROUP BY 1 HAVING count(*) >= 1), p AS (SELECT s.*, EXISTS (SELECT 1 FROM s v WHERE v.viral AND v.source = s.source AND v.size = s.size) AS h FROM s JOIN e ON g = source WHERE NOT viral),
n AS (SELECT source, count(CASE WHEN h THEN 1 END) AS n0, count(*) AS n1 FROM p GROUP BY 1), c AS (SELECT source, CASE WHEN n0 >= 6 THEN 0 WHEN n1 >= 6 THEN 1 END AS level FROM n), poor AS (SELECT g FROM e WHERE g NOT IN (SELECT source FROM c WHERE level IS NOT NULL)),
wide AS (SELECT DISTINCT poor.g AS source, s.item_id FROM poor JOIN s v ON v.source = poor.g AND v.viral JOIN s ON s.lang = v.lang WHERE NOT (s.viral AND s.source = poor.g)), w AS (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM wide)
SELECT source, item_id, level FROM p JOIN c USING (source) WHERE level = 1 OR (level = 0 AND h) UNION ALL SELECT source, item_id, 2 FROM w WHERE n >= 6""")
def control_ladder_everywhere(spark, sf_dir):
    """Controls of each source with a viral item; where it has fewer than six, those of all sources in its languages."""
    return I.control_ladder(_sides(spark, sf_dir), "source", "viral", ["size"], "lang", 1, 6)


@query(f"WITH {EVENTS_SQL}, c AS (SELECT topic_id, CASE WHEN author_id % 3 > 0 THEN author_id END AS owner, count(*) AS c FROM m1_items GROUP BY 1, 2), g AS (SELECT topic_id, CAST(sum(c) AS DOUBLE) AS n, sum(CASE WHEN owner IS NOT NULL THEN c * c END) AS q FROM c GROUP BY 1) SELECT topic_id, {_R6.format('CASE WHEN q IS NULL THEN NULL WHEN n = 1 THEN 1 ELSE greatest(0, least(1, (q / (n * n) - 1 / n) / (1 - 1 / nullif(n, 1)))) END')} AS concentration FROM g")
def hhi_concentration(spark, sf_dir):
    items = event_items(spark, sf_dir).select("topic_id", F.when(F.col("author_id") % 3 > 0, F.col("author_id")).alias("owner"))
    return A.concentration(items, "topic_id", "owner").select("topic_id", A.half_up(F.col("concentration"), 6).alias("concentration"))


@query("SELECT o_orderpriority AS k, floor(median(o_totalprice) * 1e6 + 0.5) / 1e6 AS middle, list_sort(list(o_totalprice))[1 + CAST(floor(count(*) / 2) AS BIGINT)] AS upper_middle, floor(quantile_cont(o_totalprice, 0.25) * 1e6 + 0.5) / 1e6 AS p25, list_sort(list(o_totalprice))[1 + CAST(floor((count(*) - 1) * 0.75) AS BIGINT)] AS low_p75, floor(stddev_samp(o_totalprice) * 100 + 0.5) / 100 AS spread FROM orders GROUP BY 1")
def medians_and_quantiles(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("k"), F.col("o_totalprice").alias("p"))
    spread = o.groupBy("k").agg(A.half_up(F.stddev_samp("p"), 2).alias("spread"))
    between = A.quantiles(o, ["k"], {"middle": ("p", 0.5), "p25": ("p", 0.25)}).select("k", *[A.half_up(F.col(c), 6).alias(c) for c in ("middle", "p25")])
    by_place = A.order_statistics(o, ["k"], {"upper_middle": ("p", A.upper_median_at()), "low_p75": ("p", A.low_quantile_at(0.75))})
    return spread.join(between, "k").join(by_place, "k")


def _members(spark, sf_dir, now=NOW):
    """Vectors as members of topics: the label is the topic, the id decides author and age; those known at a clock."""
    e = table(spark, sf_dir, "embeddings")
    back = F.make_dt_interval(F.col("vec_id") % 40)
    m = e.select(F.col("label").cast("long").alias("topic_id"), F.col("vec_id").alias("id"), F.col("embedding").alias("v"), (F.col("vec_id") % 9).alias("author_id"), (F.lit(NOW).cast("timestamp") - back).alias("published_at"))
    return m.where(F.col("published_at") <= F.lit(now).cast("timestamp"))


def _members_sql(days_ago: int = 0) -> str:
    """m (topic_id, id, v, author_id, age) at a clock some days before, and nn, the nearest other one of the 300 newest."""
    return f"WITH RECURSIVE m AS (SELECT * FROM (SELECT CAST(label AS BIGINT) AS topic_id, vec_id AS id, embedding::DOUBLE[] AS v, vec_id % 9 AS author_id, vec_id % 40 - {days_ago} AS age FROM embeddings) WHERE age >= 0), top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY age, id) AS r FROM m) WHERE r <= 300), nn AS (SELECT a.topic_id, a.id, max(list_cosine_similarity(a.v, b.v)) AS sim FROM top a JOIN top b ON a.topic_id = b.topic_id AND a.id <> b.id GROUP BY 1, 2 HAVING max(list_cosine_similarity(a.v, b.v)) >= 0)"


_M = _members_sql()


@query(f"{_M} SELECT topic_id, count(*) AS members, {_R6.format('avg(sim)')} AS mean_sim, {_R6.format('avg(CASE WHEN sim >= 0.35 THEN 1.0 ELSE 0.0 END)')} AS repeats FROM nn GROUP BY 1")
def nn_repetition(spark, sf_dir):
    near = I.nearest(_members(spark, sf_dir), "topic_id", "published_at")
    return near.groupBy("topic_id").agg(F.count(F.lit(1)).alias("members"), A.half_up(F.avg("sim"), 6).alias("mean_sim"), A.half_up(F.avg((F.col("sim") >= 0.35).cast("double")), 6).alias("repeats"))


def _saturation_sql(days_ago: int = 0) -> str:
    return f"""{_members_sql(days_ago)}, g AS (SELECT topic_id, count(*) AS members, max(age) AS age, count(CASE WHEN age <= 7 THEN 1 END) AS recent FROM m GROUP BY 1), s AS (SELECT topic_id, avg(sim) AS ms, avg(CASE WHEN sim >= 0.7 THEN 1.0 ELSE 0.0 END) AS rp FROM nn GROUP BY 1), c AS (SELECT topic_id, sum(c * c) / (sum(c) * sum(c)) AS h, sum(c) AS n FROM (SELECT topic_id, author_id, CAST(count(*) AS DOUBLE) AS c FROM m GROUP BY 1, 2) GROUP BY 1),
p AS (SELECT topic_id, members, recent, least(100, 100.0 * (CAST(members AS DOUBLE) / greatest(0.5, age)) / 1.5) AS volume, least(100, 100.0 * (recent / 7.0::DOUBLE) / 1.0) AS frequency, ms * 100 AS angle_similarity, rp * 100 AS repetition, greatest(0, least(1, (h - 1 / n) / (1 - 1 / n))) * 100 AS concentration FROM g JOIN s USING (topic_id) JOIN c USING (topic_id))
SELECT topic_id, members, CASE WHEN members < 5 THEN 'insufficient_members' END AS reason, CASE WHEN members >= 5 THEN floor((0.2 * volume + 0.2 * frequency + 0.25 * angle_similarity + 0.2 * repetition + 0.15 * concentration) * 10 + 0.5) / 10 END AS score,
CASE WHEN members >= 5 THEN CASE WHEN 1.0 - CASE WHEN members < 10 THEN 0.15 ELSE 0 END - CASE WHEN recent < 5 THEN 0.1 ELSE 0 END >= 0.75 THEN 'high' ELSE 'medium' END END AS confidence, {_R6.format('volume')} AS volume, {_R6.format('frequency')} AS frequency, {_R6.format('angle_similarity')} AS angle_similarity, {_R6.format('repetition')} AS repetition, {_R6.format('concentration')} AS concentration FROM p"""


@query(_saturation_sql())
def saturation(spark, sf_dir):
    m = _members(spark, sf_dir)
    return I.saturation(m, I.nearest(m, "topic_id", "published_at"), NOW)


def _angles(spark, sf_dir, now=NOW):
    """Angles of all members known at a clock; what is stored are the topics' centroids of a week before."""
    m = _members(spark, sf_dir, now)
    before = m.where(F.col("published_at") < F.lit(now - dt.timedelta(days=7)).cast("timestamp"))
    known = V.centroids(before, "topic_id").select("topic_id", (F.col("topic_id") * 10).alias("angle_id"), "centroid")
    return I.angles(m, known, now)


def _angles_sql(days_ago: int = 0) -> str:
    """Common table expressions up to angles; one stored centroid a topic, so the first angle by size that is near it
    inherits it."""
    mean = lambda rows, key: f"(SELECT {key}, list(x ORDER BY pos) AS c FROM (SELECT {key}, pos, avg(v[pos]) AS x FROM {rows}, range(1, 65) t(pos) GROUP BY 1, 2) GROUP BY 1)"
    return f"""{_members_sql(days_ago)}, e AS (SELECT a.id AS a, b.id AS b FROM m a JOIN m b ON a.topic_id = b.topic_id AND a.id <> b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.6),
reach AS (SELECT id, id AS root FROM m UNION SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.id), roots AS (SELECT id, min(root) AS angle FROM reach GROUP BY 1), ma AS (SELECT m.*, angle FROM m JOIN roots USING (id)),
g AS (SELECT topic_id, angle, count(*) AS members, count(CASE WHEN age <= 7 THEN 1 END) AS fresh, max(age) AS oldest, count(DISTINCT author_id) AS authors FROM ma GROUP BY 1, 2),
old AS (SELECT * FROM m WHERE age > 7), k AS {mean('old', 'topic_id')}, ac AS {mean('ma', 'angle')},
near AS (SELECT g.*, list_cosine_similarity(ac.c, k.c) AS sim FROM g JOIN ac USING (angle) LEFT JOIN k USING (topic_id)),
claims AS (SELECT *, CASE WHEN sim >= 0.6 THEN row_number() OVER (PARTITION BY topic_id, sim >= 0.6 ORDER BY members DESC, angle) END AS r FROM near),
far AS (SELECT *, coalesce(r = 1, false) AS inherits, CASE WHEN coalesce(r = 1, false) THEN NULL ELSE sim END AS nearest FROM claims),
angles AS (SELECT topic_id, angle, CAST(members AS INT) AS members, CASE WHEN inherits THEN topic_id * 10 END AS inherited, nearest, NOT inherits AND members >= 3 AND oldest <= 7 AND (nearest IS NULL OR nearest < 0.5) AS emerging,
  CASE WHEN members >= 3 THEN floor((0.4::DOUBLE * CASE WHEN nearest IS NULL THEN 100.0 ELSE (1 - nearest) * 100 END + 0.25::DOUBLE * least(100.0, 100.0 * (fresh::DOUBLE / members) / 0.6::DOUBLE) + 0.2::DOUBLE * least(100.0, 100.0 * members / 3.0) + 0.15::DOUBLE * 100.0 * (authors::DOUBLE / members)) * 10 + 0.5) / 10 END AS novelty FROM far)"""


@query(f"{_angles_sql()} SELECT topic_id, angle, members, inherited, {_R6.format('nearest')} AS nearest_known, emerging, novelty FROM angles")
def novelty_angles(spark, sf_dir):
    """Angles of each label's vectors, against its centroid of a week before."""
    return _angles(spark, sf_dir).withColumn("nearest_known", A.half_up(F.col("nearest_known"), 6))


@query(f"{_angles_sql(14)}, stored AS (SELECT angle AS angle_id, topic_id, CAST(angle AS VARCHAR) AS label FROM angles), now_m AS (SELECT CAST(label AS BIGINT) AS topic_id, vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), ne AS (SELECT a.id AS a, b.id AS b FROM now_m a JOIN now_m b ON a.topic_id = b.topic_id AND a.id <> b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.6), nr AS (SELECT id, id AS root FROM now_m UNION SELECT ne.b, nr.root FROM nr JOIN ne ON ne.a = nr.id), found AS (SELECT topic_id, angle, count(*) AS members FROM (SELECT id, min(root) AS angle FROM nr GROUP BY 1) JOIN now_m USING (id) GROUP BY 1, 2) SELECT coalesce(s.angle_id, f.angle) AS angle_id, coalesce(s.topic_id, f.topic_id) AS topic_id, s.label, CASE WHEN s.angle_id IS NULL THEN 'new' WHEN f.angle IS NULL THEN 'inactive' ELSE 'active' END AS status, CAST(coalesce(f.members, 0) AS BIGINT) AS members FROM stored s FULL JOIN found f ON s.angle_id = f.angle")
def angle_persistence(spark, sf_dir):
    """The angles stored two weeks before, after a run that finds the present ones; equal first members inherit."""
    stored = _angles(spark, sf_dir, NOW - dt.timedelta(days=14)).select(F.col("angle").alias("angle_id"), "topic_id", F.col("angle").cast("string").alias("label"))
    found = _angles(spark, sf_dir).select("topic_id", "angle", "members")
    known = stored.select(F.col("angle_id").alias("inherited"))
    return I.persisted_angles(stored, found.join(known, F.col("angle") == F.col("inherited"), "left"))


def _bursts_sql(parts: str, now: str) -> str:
    return f"""{parts}, bo AS (SELECT topic_id, count(score) AS scored, count(*) AS n, count(CASE WHEN score >= 80 THEN 1 END) AS hot, list_sort(list(score) FILTER (WHERE score IS NOT NULL))[1 + CAST(floor((count(score) - 1) * 0.75) AS BIGINT)] AS p75, count(CASE WHEN score >= 80 AND published_at >= TIMESTAMP '{now}' - INTERVAL 7 DAY THEN 1 END) AS rb FROM burst GROUP BY 1),
bo2 AS (SELECT topic_id, p75, CASE WHEN scored > 0 THEN rb END AS recent_bursts, CASE WHEN scored > 0 THEN {_R6.format('CAST(scored AS DOUBLE) / n')} END AS coverage, CASE WHEN scored > 0 THEN least(100.0, 100.0 * (CAST(hot AS DOUBLE) / nullif(scored, 0)) / 0.3::DOUBLE) END AS dens FROM bo),
bo3 AS (SELECT topic_id, CASE WHEN dens IS NOT NULL THEN floor(greatest(0, least(100, 0.5 * dens + 0.3 * p75 + 0.2 * least(100.0, recent_bursts * 20.0))) * 10 + 0.5) / 10 END AS burst, coverage, recent_bursts, {_R6.format('dens')} AS density FROM bo2)"""


@query(f"{_bursts_sql(_PARTS, '2024-01-31')} SELECT topic_id, burst, coverage, recent_bursts, density FROM bo3")
def burst_opportunity(spark, sf_dir):
    s = S.burst(event_items(spark, sf_dir), event_snapshots(spark, sf_dir), NOW, UPVOTING)
    return I.burst_opportunity(s.select("topic_id", "score", "published_at"), NOW)


@query(f"""{_S}, g AS ({_LIFT}), r AS (SELECT lang, feature, CASE WHEN hv = 0 OR hc = 0 THEN (hv + 1) / CAST(nv + 2 AS DOUBLE) ELSE hv / CAST(nv AS DOUBLE) END / CASE WHEN hv = 0 OR hc = 0 THEN (hc + 1) / CAST(nc + 2 AS DOUBLE) ELSE hc / CAST(nc AS DOUBLE) END AS lift, least(nv, nc) AS n FROM g WHERE nv > 0 AND nc > 0), e AS (SELECT lang AS topic_id, least(1.0, abs(floor(lift * 1e6 + 0.5) / 1e6 - 1)) AS e, CASE WHEN n >= 30 THEN 20 WHEN n >= 10 THEN 12 ELSE 0 END AS w FROM r)
SELECT topic_id, floor(least(100, sum(w * (0.6::DOUBLE + 0.4::DOUBLE * e)) + 20 * coalesce(max(CASE WHEN w > 0 THEN e END), 0)) * 1e6 + 0.5) / 1e6 AS pattern FROM e GROUP BY 1""")
def pattern_strength(spark, sf_dir):
    lifts = boolean_lift(spark, sf_dir)
    return I.pattern_strength(lifts.select(F.col("lang").alias("topic_id"), "quality", F.abs(F.col("lift") - 1).alias("effect"), F.col("feature").alias("n")))


def _topic_patterns(spark, sf_dir):
    """Pattern strength by topic: a document's topic is the label of the vector of its id."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").cast("long").alias("topic_id")), "doc_id")
    sides = d.select("topic_id", (F.col("toxic") == 1).alias("viral"), *[c.alias(k) for k, c in T.features(F.col("text")).items()])
    lifts = I.boolean_lift(sides, "topic_id", "viral", list(T.FEATURES))
    p = saved(lifts.select("topic_id", "quality", F.abs(F.col("lift") - 1).alias("effect"), F.col("feature").alias("n")))
    return I.pattern_strength(p).join(p.groupBy("topic_id").agg(F.count_if(F.col("quality") == "high").alias("high_patterns")), "topic_id")


_TOPIC_LIFT = " UNION ALL ".join(f"SELECT topic_id, '{k}' AS feature, count(CASE WHEN viral THEN 1 END) AS nv, count(CASE WHEN NOT viral THEN 1 END) AS nc, count(CASE WHEN viral AND {k} THEN 1 END) AS hv, count(CASE WHEN NOT viral AND {k} THEN 1 END) AS hc FROM s GROUP BY topic_id" for k in T.FEATURES)
_PATTERNS = f"""WITH s AS (SELECT CAST(label AS BIGINT) AS topic_id, toxic = 1 AS viral, {_F} FROM documents JOIN labels USING (doc_id) JOIN embeddings ON vec_id = doc_id), g AS ({_TOPIC_LIFT}),
r AS (SELECT topic_id, feature, CASE WHEN hv = 0 OR hc = 0 THEN (hv + 1) / CAST(nv + 2 AS DOUBLE) ELSE hv / CAST(nv AS DOUBLE) END / CASE WHEN hv = 0 OR hc = 0 THEN (hc + 1) / CAST(nc + 2 AS DOUBLE) ELSE hc / CAST(nc AS DOUBLE) END AS lift, least(nv, nc) AS n FROM g WHERE nv > 0 AND nc > 0),
e AS (SELECT topic_id, n, least(1.0, abs(floor(lift * 1e6 + 0.5) / 1e6 - 1)) AS e, CASE WHEN n >= 30 THEN 20 WHEN n >= 10 THEN 12 ELSE 0 END AS w FROM r)
SELECT topic_id, floor(least(100, sum(w * (0.6::DOUBLE + 0.4::DOUBLE * e)) + 20 * coalesce(max(CASE WHEN w > 0 THEN e END), 0)) * 1e6 + 0.5) / 1e6 AS pattern, count(CASE WHEN n >= 30 THEN 1 END) AS high_patterns FROM e GROUP BY 1"""


def _topics(spark, sf_dir, now, stored=None):
    """All that opportunity weighs, as known at a clock."""
    items, snapshots = seen_by(*(stored or stored_events(spark, sf_dir)), now)
    scores = saved(S.burst(items, snapshots, now, UPVOTING))
    t = S.lifecycle(S.topic_trend(items, snapshots, scores, now, UPVOTING), now)
    m = _members(spark, sf_dir, now)
    sat = I.saturation(m, I.nearest(m, "topic_id", "published_at"), now).select("topic_id", F.col("score").alias("saturation"), F.col("confidence").alias("saturation_confidence"))
    b = I.burst_opportunity(scores.select("topic_id", "score", "published_at"), now).select("topic_id", "burst", "coverage", "density")
    t = t.select("topic_id", "members", F.col("score").alias("trend"), "state", F.col("confidence").alias("trend_confidence"))
    return t.join(b, "topic_id", "left").join(sat, "topic_id", "left").join(I.topic_novelty(_angles(spark, sf_dir, now)), "topic_id", "left").join(_topic_patterns(spark, sf_dir), "topic_id", "left")


def _opportunity_sql(now: str, days_ago: int, weights: dict[str, float]) -> str:
    """One SELECT of the opportunity of each topic at a clock."""
    fit = " ".join(f"WHEN '{k}' THEN {v}" for k, v in OPPORTUNITY["lifecycle_fit"].items())
    parts = {"trend": "trend", "burst": "burst", "novelty": "novelty", "whitespace": "whitespace", "pattern": "pattern", "lifecycle": "fit"}
    used = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE {weights[k]} END::DOUBLE" for k, c in parts.items())
    mass = " + ".join(f"coalesce({c} * {weights[k]}::DOUBLE, 0)" for k, c in parts.items())
    known = " + ".join(f"({c} IS NOT NULL)::INT" for c in parts.values())
    worth = lambda c: f"CASE {c} WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.7 WHEN 'low' THEN 0.4 ELSE 0.55 END::DOUBLE"
    up = [("trend", "trend_confidence"), ("novelty", "novelty_confidence"), ("whitespace", "saturation_confidence")]
    mean = "(" + " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE {worth(w)} END" for c, w in up) + ") / nullif(" + " + ".join(f"({c} IS NOT NULL)::INT" for c, _ in up) + ", 0)"
    codes = [("trend >= 60", "HIGH_TREND"), ("state = 'rising'", "RISING_LIFECYCLE"), ("state = 'emerging'", "EMERGING_LIFECYCLE"), ("novelty >= 60", "HIGH_NOVELTY"), ("emerging_angles > 0", "EMERGING_ANGLES"), ("saturation < 40", "LOW_SATURATION"), ("saturation >= 67", "HIGH_SATURATION"), ("density >= 25", "STRONG_BURST_DENSITY"), ("high_patterns > 0", "CLEAR_VIRAL_PATTERNS"), ("pattern IS NULL", "PATTERN_SAMPLE_INSUFFICIENT"), ("coalesce(members, 0) < 10", "LOW_TOPIC_HISTORY"), ("coverage < 0.5", "LOW_BURST_COVERAGE")]
    said = "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for c, k in codes) + ")"
    columns = ", ".join(f"{_R6.format(c)} AS c_{k}" for k, c in parts.items())
    return f"""SELECT topic_id, {columns}, reason, CASE WHEN reason IS NULL THEN floor(score * 10 + 0.5) / 10 END AS score, CASE WHEN reason IS NULL THEN CASE WHEN score >= 70 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END END AS level,
  CASE WHEN reason IS NULL THEN floor((conf + 1e-9) * 100 + 0.5) / 100 END AS confidence_score, CASE WHEN reason IS NULL THEN CASE WHEN conf >= 0.75 THEN 'high' WHEN conf >= 0.45 THEN 'medium' ELSE 'low' END END AS confidence, CASE WHEN reason IS NULL THEN {said} ELSE '' END AS codes
FROM (SELECT *, CASE WHEN {known} < 3 THEN 'INSUFFICIENT_COMPONENTS' WHEN trend IS NULL AND novelty IS NULL THEN 'NO_CORE_EVIDENCE' END AS reason, greatest(0, least(100, ({mass}) / nullif({used}, 0))) AS score,
    greatest(0, least(1, coalesce({mean}, 1) - CASE WHEN coalesce(members, 0) < 10 THEN 0.2 ELSE 0 END::DOUBLE - CASE WHEN coverage < 0.5 THEN 0.1 ELSE 0 END::DOUBLE)) AS conf
  FROM (SELECT *, CASE state {fit} END AS fit, 100.0 - saturation AS whitespace FROM ({trend_sql(now)} SELECT topic_id, members, score AS trend, state, confidence AS trend_confidence FROM states)
    LEFT JOIN ({_bursts_sql(parts_sql(clocked_sql(now), now), now)} SELECT * FROM bo3) USING (topic_id)
    LEFT JOIN (SELECT topic_id, score AS saturation, confidence AS saturation_confidence FROM ({_saturation_sql(days_ago)})) USING (topic_id)
    LEFT JOIN ({_angles_sql(days_ago)} SELECT topic_id, coalesce(max(CASE WHEN emerging THEN novelty END), 0) AS novelty, count(CASE WHEN emerging THEN 1 END) AS emerging_angles, CASE WHEN sum(members) >= 10 THEN 'high' WHEN sum(members) >= 3 THEN 'medium' ELSE 'low' END AS novelty_confidence FROM angles GROUP BY 1) USING (topic_id)
    LEFT JOIN ({_PATTERNS}) USING (topic_id)))"""


@query(_opportunity_sql("2024-01-31", 0, OPPORTUNITY["balanced"]))
def opportunity_index(spark, sf_dir):
    return I.opportunity(_topics(spark, sf_dir, NOW))


@query(f"SELECT topic_id, score, level, codes FROM ({_opportunity_sql('2024-01-31', 0, OPPORTUNITY['early_discovery'])}) ORDER BY score DESC NULLS LAST, topic_id LIMIT 10")
def opportunity_list(spark, sf_dir):
    """The ten best topics, early discovery preferred."""
    rows = I.opportunity(_topics(spark, sf_dir, NOW), OPPORTUNITY["early_discovery"])
    return rows.select("topic_id", "score", "level", "codes").orderBy(F.desc_nulls_last("score"), "topic_id").limit(10)


_WHY = ["c_trend", "c_burst", "c_novelty", "c_whitespace", "c_lifecycle"]
_CHANGES = ", ".join(f"{{'k': -abs(floor((coalesce(a.{p}, 0) - coalesce(b.{p}, 0)) * 10 + 0.5) / 10), 'p': '{p}', 'd': floor((coalesce(a.{p}, 0) - coalesce(b.{p}, 0)) * 10 + 0.5) / 10}}" for p in _WHY)


@query(f"SELECT topic_id, floor((a.score - b.score) * 10 + 0.5) / 10 AS delta, array_to_string(list_transform(list_sort(list_filter([{_CHANGES}], lambda x: abs(x.d) > 0.05))[1:4], lambda x: x.p || ':' || CAST(x.d AS VARCHAR)), ',') AS causes FROM ({_opportunity_sql('2024-01-31', 0, OPPORTUNITY['balanced'])}) a JOIN ({_opportunity_sql('2024-01-24', 7, OPPORTUNITY['balanced'])}) b USING (topic_id)")
def why_changed(spark, sf_dir):
    """What moved each topic's opportunity within a week, by two runs of which neither sees later rows."""
    stored = stored_events(spark, sf_dir)
    before, after = (saved(I.opportunity(_topics(spark, sf_dir, now, stored))) for now in (NOW - dt.timedelta(days=7), NOW))
    return I.why_changed(before, after, _WHY)


@query(f"{_PARTS} SELECT topic_id, item_id, score, r FROM (SELECT topic_id, item_id, score, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, item_id) AS r FROM burst WHERE score IS NOT NULL) WHERE r <= 5")
def evidence_topk(spark, sf_dir):
    """The five best items of each topic."""
    from pyspark.sql import Window

    s = S.burst(event_items(spark, sf_dir), event_snapshots(spark, sf_dir), NOW, UPVOTING).where("score is not null")
    w = Window.partitionBy("topic_id").orderBy(F.desc("score"), "item_id")
    return s.withColumn("r", F.row_number().over(w)).where("r <= 5").select("topic_id", "item_id", "score", F.col("r").cast("long").alias("r"))


@query("SELECT conv_id, count(*) AS claims FROM (SELECT conv_id, unnest(regexp_extract_all(text, '[A-Za-z]{8,}')) AS claim FROM conversations WHERE role = 'assistant') a WHERE NOT EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = a.conv_id AND c.role <> 'assistant' AND list_contains(regexp_extract_all(c.text, '[A-Za-z]{8,}'), a.claim)) GROUP BY 1")
def claim_check(spark, sf_dir):
    """Long words that an assistant uses and nobody else in the conversation does, as a check of unsupported claims."""
    c = table(spark, sf_dir, "conversations")
    n = c.select("conv_id", "role", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{8,}"), F.lit(0))).alias("claim"))
    known = n.where("role <> 'assistant'").select("conv_id", "claim").distinct()
    return n.where("role = 'assistant'").join(known, ["conv_id", "claim"], "left_anti").groupBy("conv_id").agg(F.count(F.lit(1)).alias("claims"))
