"""Registered queries over vectors and clusters. The threshold 0.30 suits the given vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.functions.stats import half_up
from tidewell.operators import identity as N
from tidewell.operators import similarity as V
from tidewell.operators.graph import checkpoint_dir, components
from tidewell.operators.simjoin import Pivots, near_pairs
from tidewell.operators.spaces import Spaces

from .views import table, text_items

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


_E = "WITH RECURSIVE e AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3), both_ways AS (SELECT a, b, sim FROM e UNION ALL SELECT b, a, sim FROM e)"


@query(f"{_E} SELECT a, b, floor(sim * 1e6 + 0.5) / 1e6 AS sim FROM e")
def similarity_edges(spark, sf_dir):
    e = V.edges(_vectors(spark, sf_dir).select("id", "v"), 0.3)
    return e.select("a", "b", half_up(F.col("sim"), 6).alias("sim"))


@query(f"{_E} SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS r FROM both_ways) WHERE r <= 3")
def neighbor_topk(spark, sf_dir):
    v = _vectors(spark, sf_dir).where(F.col("id").isNotNull() & V.links(F.col("v")))
    return near_pairs(v.select("id", "v"), 0.3, 3).select("a", "b")


@query(f"{_E}, reach AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT both_ways.b, reach.root FROM reach JOIN both_ways ON both_ways.a = reach.id) SELECT id, min(root) AS component FROM reach GROUP BY 1")
def connected_components(spark, sf_dir):
    v = _vectors(spark, sf_dir).select("id", "v")
    roots = components(V.edges(v, 0.3, joined=True).select("a", "b"))
    return v.join(roots, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("component"))


@query("SELECT q, id, floor(sim * 1e6 + 0.5) / 1e6 AS sim, r FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(sim, 9) DESC, id) AS r FROM (SELECT a.vec_id AS q, b.vec_id AS id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)) WHERE r <= 10")
def similar_topk(spark, sf_dir):
    """The ten nearest of every hundredth vector, among all."""
    v = _vectors(spark, sf_dir).select("id", "v")
    asked = v.where("id % 100 = 0").select(F.col("id").alias("q"), F.col("v").alias("qv"))
    return V.similar(v, asked).select("q", "id", half_up(F.col("sim"), 6).alias("sim"), F.col("r").cast("long").alias("r"))


def _pivots(spark, sf_dir):
    return Pivots(_vectors(spark, sf_dir).select("id", "v"), f"{checkpoint_dir(spark)}/pivots-{uuid.uuid4().hex}", rows_each=200)


@query(f"{_E} SELECT a, b, floor(sim * 1e6 + 0.5) / 1e6 AS sim FROM e")
def similarity_edges_by_pivots(spark, sf_dir):
    """The same edges from vectors stored by pivot; pairs of pivots that are too far apart never meet."""
    return _pivots(spark, sf_dir).edges(0.3).select("a", "b", half_up(F.col("sim"), 6).alias("sim"))


@query("SELECT q, id, floor(sim * 1e6 + 0.5) / 1e6 AS sim, r FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(sim, 9) DESC, id) AS r FROM (SELECT a.vec_id AS q, b.vec_id AS id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)) WHERE r <= 10")
def similar_topk_by_pivots(spark, sf_dir):
    """The ten nearest of every hundredth vector, by pivots whose vectors may be near enough."""
    asked = _vectors(spark, sf_dir).where("id % 100 = 0").select(F.col("id").alias("q"), F.col("v").alias("qv"))
    return _pivots(spark, sf_dir).nearest(asked).select("q", "id", half_up(F.col("sim"), 6).alias("sim"), F.col("r").cast("long").alias("r"))


@query("SELECT q, id, floor(sim * 1e6 + 0.5) / 1e6 AS sim, r FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(sim, 9) DESC, id) AS r FROM (SELECT a.vec_id AS q, b.vec_id AS id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND b.label % 2 = 0) WHERE sim >= 0.15) WHERE r <= 5")
def similar_on_platforms(spark, sf_dir):
    """The five nearest of every hundredth vector among those of some labels, at a cosine of 0.15 or more."""
    v = _vectors(spark, sf_dir)
    asked = v.where("id % 100 = 0").select(F.col("id").alias("q"), F.col("v").alias("qv"))
    return V.similar(v.where("label % 2 = 0").select("id", "v"), asked, 5, 0.15).select("q", "id", half_up(F.col("sim"), 6).alias("sim"), F.col("r").cast("long").alias("r"))


_C = "WITH x AS (SELECT label, pos, avg(embedding[pos]::DOUBLE) AS x FROM embeddings, range(1, 65) t(pos) GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY pos) AS centroid FROM x GROUP BY 1)"


@query(f"{_C} SELECT label, floor(list_sum(list_transform(centroid, lambda v: v * v)) * 1e6 + 0.5) / 1e6 AS squares, floor(centroid[1] * 1e6 + 0.5) / 1e6 AS first_x, (SELECT count(*) FROM embeddings e WHERE e.label = c.label) AS members FROM c")
def centroids(spark, sf_dir):
    c = V.centroids(_vectors(spark, sf_dir), "label")
    return c.select("label", half_up(V.dot(F.col("centroid"), F.col("centroid")), 6).alias("squares"), half_up(F.get("centroid", F.lit(0)), 6).alias("first_x"), "members")


@query(f"{_C} SELECT label, count(*) AS members, floor(greatest(0, least(1, avg(list_cosine_similarity(embedding::DOUBLE[], centroid)))) * 1e6 + 0.5) / 1e6 AS cohesion FROM embeddings JOIN c USING (label) GROUP BY 1")
def cohesion(spark, sf_dir):
    c = V.cohesion(_vectors(spark, sf_dir), "label")
    return c.select("label", "members", half_up(F.col("cohesion"), 6).alias("cohesion"))


@query()
def topic_clusters(spark, sf_dir):
    return V.clusters(_vectors(spark, sf_dir).select("id", "v"))


@query(f"{_E}, reach AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT both_ways.b, reach.root FROM reach JOIN both_ways ON both_ways.a = reach.id), k AS (SELECT id, min(root) AS k FROM reach GROUP BY 1), t AS (SELECT k, label, count(*) AS n FROM k JOIN embeddings ON vec_id = id GROUP BY 1, 2), p AS (SELECT CAST((SELECT sum(n * (n - 1) / 2) FROM t) AS DOUBLE) AS r, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM t GROUP BY k)) AS tog, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM t GROUP BY label)) AS lab, (SELECT sum(m) / CAST(sum(n) AS DOUBLE) FROM (SELECT max(n) AS m, sum(n) AS n FROM t GROUP BY k)) AS purity, (SELECT sum(CASE WHEN n < 3 THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE) FROM (SELECT sum(n) AS n FROM t GROUP BY k)) AS noise) SELECT floor(purity * 1e6 + 0.5) / 1e6 AS purity, floor(r / tog * 1e6 + 0.5) / 1e6 AS precision, floor(r / lab * 1e6 + 0.5) / 1e6 AS recall, floor(2 * (r / tog) * (r / lab) / (r / tog + r / lab) * 1e6 + 0.5) / 1e6 AS f1, floor(noise * 1e6 + 0.5) / 1e6 AS noise FROM p")
def cluster_agreement(spark, sf_dir):
    k = connected_components(spark, sf_dir).join(_vectors(spark, sf_dir).select("id", "label"), "id")
    return V.agreement(k, "component", "label").select(*[half_up(F.col(c), 6).alias(c) for c in ("purity", "precision", "recall", "f1", "noise")])


_R = f"{_E}, reach AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT both_ways.b, reach.root FROM reach JOIN both_ways ON both_ways.a = reach.id), o AS (SELECT vec_id AS id, label AS topic FROM embeddings), n AS (SELECT id, min(root) AS cluster FROM reach GROUP BY 1), k AS (SELECT topic, cluster, count(*) AS k FROM o JOIN n USING (id) GROUP BY 1, 2), na AS (SELECT topic, count(*) AS na FROM o GROUP BY 1), nb AS (SELECT cluster, count(*) AS nb FROM n GROUP BY 1), j AS (SELECT *, k / CAST(na + nb - k AS DOUBLE) AS overlap FROM k JOIN na USING (topic) JOIN nb USING (cluster)), m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY overlap DESC, topic) AS r FROM j WHERE overlap >= 0.01) WHERE r = 1), z AS (SELECT cluster AS c, topic, overlap, row_number() OVER (PARTITION BY topic ORDER BY overlap DESC, nb DESC, cluster) AS r FROM m)"


@query(f"{_R} SELECT cluster, CASE WHEN r = 1 THEN topic END AS topic, floor(overlap * 1e6 + 0.5) / 1e6 AS overlap, CASE WHEN c IS NULL THEN 'new' WHEN r = 1 THEN 'kept' ELSE 'split' END AS status FROM nb LEFT JOIN z ON c = cluster")
def topic_reconcile_jaccard(spark, sf_dir):
    """The given labels as old topics, the components of all vectors as new clusters; these hardly overlap, hence 0.01."""
    old = _vectors(spark, sf_dir).select("id", F.col("label").alias("topic"))
    new = connected_components(spark, sf_dir).select("id", F.col("component").alias("cluster"))
    return V.reconcile(old, new, 0.01).select("cluster", "topic", half_up(F.col("overlap"), 6).alias("overlap"), "status")


def _identity(spark, sf_dir):
    """Memberships before a run, and its clusters. Before: users seen in the first half of the month, by user_id % 10,
    those divisible by 25 locked (the ones divisible by 50 in topic 3). The run: users of the whole month, those of
    topic 9 by user_id % 7, all others by topic and whether views are over half of their events."""
    e = table(spark, sf_dir, "events").where("user_id is not null")
    u = F.col("user_id")
    old = e.where("ts < timestamp '2024-01-16'").select("user_id").distinct()
    old = old.select(F.when(u % 50 == 0, 3).otherwise(u % 10).cast("long").alias("topic"), u.alias("id"), (u % 25 == 0).alias("locked"))
    new = e.groupBy("user_id").agg((F.count_if(F.col("event_type") == "view") * 2 > F.count(F.lit(1))).alias("views"))
    return old, new.select(u.alias("id"), F.when(u % 10 == 9, 300 + u % 7).otherwise(100 + u % 10 + F.when(F.col("views"), 0).otherwise(100)).cast("long").alias("cluster"))


_IDENTITY = """WITH o AS (SELECT CASE WHEN user_id % 50 = 0 THEN 3 ELSE user_id % 10 END AS topic, user_id AS id, user_id % 25 = 0 AS locked FROM (SELECT DISTINCT user_id FROM events WHERE ts < TIMESTAMP '2024-01-16')),
n AS (SELECT user_id AS id, CASE WHEN user_id % 10 = 9 THEN 300 + user_id % 7 ELSE 100 + user_id % 10 + CASE WHEN count(CASE WHEN event_type = 'view' THEN 1 END) * 2 > count(*) THEN 0 ELSE 100 END END AS cluster FROM events GROUP BY user_id),
na AS (SELECT topic, count(*) AS na FROM o GROUP BY 1), nb AS (SELECT cluster, count(*) AS nb FROM n GROUP BY 1),
j AS (SELECT topic, cluster, nb, count(*) / CAST(na + nb - count(*) AS DOUBLE) AS overlap FROM o JOIN n USING (id) JOIN na USING (topic) JOIN nb USING (cluster) GROUP BY topic, cluster, na, nb),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY overlap DESC, topic) AS r FROM j) WHERE r = 1 AND overlap >= 0.3),
told AS (SELECT nb.cluster, nb.nb, b.topic, b.overlap, b.k FROM nb LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY nb DESC, cluster) AS k FROM best) b USING (cluster)),
clusters AS (SELECT cluster, CASE WHEN k = 1 THEN topic ELSE (SELECT max(topic) FROM o) + row_number() OVER (PARTITION BY coalesce(k = 1, false) ORDER BY nb DESC, cluster) END AS topic, overlap, CASE WHEN k = 1 THEN 'kept' WHEN topic IS NOT NULL THEN 'split' ELSE 'new' END AS status FROM told)"""


@query(f"{_IDENTITY} SELECT cluster, topic, floor(overlap * 1e6 + 0.5) / 1e6 AS overlap, status FROM clusters")
def topic_identity(spark, sf_dir):
    """Which topic each cluster of a run is: kept, split off or new."""
    clusters, _, _ = N.identities(*_identity(spark, sf_dir))
    return clusters.withColumn("overlap", half_up(F.col("overlap"), 6))


@query(f"{_IDENTITY}, l AS (SELECT id, topic FROM o WHERE locked), a AS (SELECT n.id, c.topic FROM n JOIN clusters c USING (cluster)) SELECT coalesce(l.id, a.id) AS id, coalesce(l.topic, a.topic) AS topic, CASE WHEN l.id IS NULL THEN 'automatic' ELSE 'manual' END AS method FROM a FULL JOIN l ON a.id = l.id")
def topic_identity_members(spark, sf_dir):
    """The memberships after the run, locked ones unmoved."""
    return N.identities(*_identity(spark, sf_dir))[1]


@query(f"{_IDENTITY} SELECT topic, CASE WHEN topic IN (SELECT topic FROM clusters) THEN 'active' ELSE 'inactive' END AS status FROM (SELECT topic FROM o UNION SELECT topic FROM clusters)")
def topic_identity_topics(spark, sf_dir):
    """Topics that a cluster continues or founds are active, all others inactive."""
    return N.identities(*_identity(spark, sf_dir))[2]


@query("""WITH RECURSIVE flat AS (SELECT vec_id, label, pos, embedding[pos]::DOUBLE AS x FROM embeddings, range(1, 65) t(pos)),
a AS (SELECT label, min(first) AS angle, max(size) AS members, list(x ORDER BY pos) AS c FROM (SELECT label, vec_id % 13 AS g, pos, avg(x) AS x, count(*) AS size, min(vec_id) AS first FROM flat GROUP BY 1, 2, 3) GROUP BY label, g),
k AS (SELECT label, label * 10 + g AS angle_id, list(x ORDER BY pos) AS c FROM (SELECT label, vec_id % 7 AS g, pos, avg(x) AS x FROM flat GROUP BY 1, 2, 3) GROUP BY label, g),
p AS (SELECT a.label, angle, members, angle_id, round(list_cosine_similarity(a.c, k.c), 9) AS sim FROM a JOIN k USING (label)),
w AS (SELECT label, angle, members, list(angle_id ORDER BY sim DESC, angle_id) AS likes, row_number() OVER (PARTITION BY label ORDER BY members DESC, angle) AS i FROM p WHERE sim >= 0.2 GROUP BY 1, 2, 3),
f AS (SELECT label, i, angle, likes[1] AS took, [likes[1]] AS used FROM w WHERE i = 1
  UNION ALL
  SELECT label, i, angle, took, CASE WHEN took IS NULL THEN used ELSE list_append(used, took) END FROM (SELECT w.label, w.i, w.angle, list_filter(w.likes, lambda x: NOT list_contains(f.used, x))[1] AS took, f.used FROM f JOIN w ON w.label = f.label AND w.i = f.i + 1))
SELECT angle, took AS angle_id FROM f WHERE took IS NOT NULL""")
def angle_claims(spark, sf_dir):
    """Drafts of angles (a label's vectors by vec_id % 13) claim its stored ones (by vec_id % 7) one after the other, from
    cosine 0.2 up: several on each side, so that claims collide."""
    v = _vectors(spark, sf_dir)
    part = lambda n: v.withColumn("g", F.concat_ws(":", "label", F.col("id") % n))
    names = lambda n: part(n).groupBy(F.col("g").alias("_g")).agg(F.first("label").alias("label"), F.min("id").alias("angle"), F.min(F.col("id") % n).alias("k"))
    made = lambda n: V.centroids(part(n), "g").join(names(n), F.col("g") == F.col("_g"))
    a = made(13).select("label", "angle", "members", F.col("centroid").alias("ca"))
    k = made(7).select(F.col("label").alias("_l"), (F.col("label") * 10 + F.col("k")).cast("long").alias("angle_id"), F.col("centroid").alias("ck"))
    pairs = a.join(k, F.col("label") == F.col("_l")).withColumn("sim", F.round(V.cosine(F.col("ca"), F.col("ck")), 9)).where("sim >= 0.2")
    return N.claims(pairs, "label", "angle", "angle_id", "members", "sim")


_WRITES = """WITH d AS (SELECT vec_id AS id, coalesce(text, '') AS text, embedding[1]::DOUBLE AS x FROM embeddings LEFT JOIN documents ON doc_id = vec_id),
w AS (SELECT id, text, x, 10 AS t FROM d UNION ALL SELECT id, text || ' revised', -x, 20 FROM d WHERE id % 2 = 0 UNION ALL SELECT id, text, 2 * x, 30 FROM d WHERE id % 4 = 0 UNION ALL SELECT id, text, 3 * x, 30 FROM d WHERE id % 3 = 0 AND id % 2 = 1),
v AS (SELECT id, text, min(t) AS created_at, max(t) AS updated_at, arg_max(x, t) AS x FROM w GROUP BY 1, 2)"""


@query(f"{_WRITES} SELECT id AS item_id, sha256(text) AS text_hash, created_at, updated_at, (SELECT min(t) FROM w WHERE w.id = v.id AND w.t > v.updated_at) AS superseded_at, floor(x * 1e6 + 0.5) / 1e6 AS x, CASE WHEN length(said) > 80 THEN left(said, 80) || '…' ELSE said END AS preview FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS said FROM v) v")
def vector_versions(spark, sf_dir):
    """Every version of every vector in the active space after three writes: all items, new texts for even ones, the old
    texts again for every fourth and new vectors of the same text for some odd ones; with a preview of the text."""
    spaces = Spaces(spark, f"{checkpoint_dir(spark)}/spaces-{uuid.uuid4().hex}")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_d"), "text")
    e = _vectors(spark, sf_dir).join(d, F.col("id") == F.col("_d"), "left")
    rows = lambda add, by: e.select("id", F.concat(F.coalesce("text", F.lit("")), F.lit(add)).alias("text"), F.transform("v", lambda x: x * F.lit(by).cast("float")).alias("v"))
    back = rows("", 2).where("id % 4 = 0").union(rows("", 3).where("id % 3 = 0 and id % 2 = 1"))
    writes = [rows("", 1), rows(" revised", -1).where("id % 2 = 0"), back]
    digest = F.sha2("text", 256).alias("text_hash")
    at = spaces.ensure("local", "given", "v1", sample=e.select("v"))
    spaces.activate(at)
    for k, w in enumerate(writes):
        spaces.write(spaces.active(), w.select(F.col("id").alias("item_id"), digest, "v"), 10 * (k + 1))
    texts = writes[0].union(writes[1]).select(F.col("id").alias("_i"), F.sha2("text", 256).alias("_h"), T.excerpt(F.col("text")).alias("preview"))
    v = spaces.all().where(F.col("space_id") == at).join(texts, (F.col("item_id") == F.col("_i")) & (F.col("text_hash") == F.col("_h")))
    when = [F.col(c).cast("int").alias(c) for c in ("created_at", "updated_at", "superseded_at")]
    return v.select("item_id", "text_hash", *when, half_up(F.get("v", F.lit(0)).cast("double"), 6).alias("x"), "preview")


@query()
def lexical_embedding(spark, sf_dir):
    return text_items(spark, sf_dir).select("item_id", V.lexical_vectors(F.col("text"), 512).alias("v"))


@query()
def lexical_topics(spark, sf_dir):
    """Clusters of the titles' hashed vectors."""
    rows = text_items(spark, sf_dir).select(F.col("item_id").alias("id"), V.lexical_vectors(F.col("title"), 128).alias("v"))
    return V.clusters(rows, threshold=0.72, sparse=True)
