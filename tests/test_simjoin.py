"""Pruned joins and searches against all pairs, and how much they compare."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidewell.operators import similarity as V
from tidewell.operators import simjoin as J


def pairs(df):
    return sorted((r.a, r.b, round(r.sim, 9)) for r in df.collect())


def dense(seed, n=600, dim=12, spread=0.25):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(15, dim))[rng.integers(0, 15, n)] + spread * rng.normal(size=(n, dim))
    x[: n // 3] = x[0]
    return [(k, [float(z) for z in v]) for k, v in enumerate(x)]


@pytest.mark.parametrize("threshold", [0.3, 0.72])
def test_lexical_join_loses_no_pair(spark, threshold):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.select(F.col("doc_id").alias("id"), V.lexical_vectors(F.split_part("text", F.lit("."), F.lit(1)), 512).alias("v"))
    more = spark.createDataFrame([(-1, None), (-2, [0.0] * 512), (-3, [1.0] + [0.0] * 511), (-4, [-1.0] + [0.0] * 511)], "id long, v array<float>")
    rows = rows.unionByName(more)
    got, want = pairs(J.sparse_edges(rows, threshold, block=60)), pairs(V.edges(rows, threshold))
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])
    n = rows.count()
    assert len(got) > 10 and J.compared(J.prefixes(rows, threshold)).first()[0] < (0.6 if threshold < 0.5 else 0.25) * n * n / 2


def test_dense_join_by_pivots(spark, tmp_path):
    rows = spark.createDataFrame(dense(1), "id long, v array<double>")
    index = J.Pivots(rows, str(tmp_path / "v"), rows_each=20)
    assert len(index.points) == 30
    for threshold in (0.5, 0.9):
        got, want = pairs(index.edges(threshold, block=100)), pairs(V.edges(rows, threshold))
        assert [g[:2] for g in got] == [w[:2] for w in want] and len(got) > 1000
    met = index.near(np.sqrt(2 - 2 * 0.9))
    assert sum(index.sizes[p] * index.sizes[q] for p, q in met) < 0.6 * index.sizes.sum() ** 2


def test_search_by_pivots(spark, tmp_path):
    data = dense(2) + [(1000, [0.0] * 12), (1001, None)]
    rows = spark.createDataFrame(data, "id long, v array<double>")
    index = J.Pivots(rows, str(tmp_path / "v"), rows_each=20)
    asked = rows.where("id % 7 = 0 and id < 1000").select(F.col("id").alias("q"), F.col("v").alias("qv"))
    got = index.nearest(asked, 5, block=50).collect()
    x = np.array([v for _, v in data[:600]])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = set()
    for q in range(0, 600, 7):
        s = np.round(np.clip(u @ u[q], -1, 1), 9)
        want |= {(q, int(i), r + 1) for r, i in enumerate([i for i in np.lexsort((np.arange(600), -s)) if i != q][:5])}
    assert {(r.q, r.id, r.r) for r in got} == want
    assert np.mean([r.parts for r in got]) < 0.6 * len(index.points)
    few = J.Pivots(rows.limit(3), str(tmp_path / "w"))
    assert {(r.q, r.r) for r in few.nearest(rows.limit(1).select(F.col("id").alias("q"), F.col("v").alias("qv")), 5).collect()} == {(0, 1), (0, 2)}


def plain_clusters(rows, threshold, most=24, smallest=3, largest=400, least=0.55, step=0.15):
    """Clusters by loops: neighbours, components, cohesion, and one more cut of what is too large or loose."""
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows], dtype=np.float64)
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    s = u @ u.T
    near = set()
    for a in range(len(ids)):
        best = sorted((b for b in range(len(ids)) if b != a and s[a, b] >= threshold), key=lambda b: (-s[a, b], ids[b]))[:most]
        near |= {(min(a, b), max(a, b)) for b in best}

    def parts(nodes, edges):
        root = {k: k for k in nodes}

        def find(k):
            while root[k] != k:
                k = root[k]
            return k

        for a, b in edges:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        out = {}
        for k in nodes:
            out.setdefault(find(k), []).append(k)
        return out

    out = {}
    for root, mine in parts(range(len(ids)), near).items():
        c = x[mine].mean(axis=0)
        tight = 1.0 if len(mine) == 1 else float(np.clip((u[mine] @ c / max(np.linalg.norm(c), 1e-300)).mean(), 0, 1))
        bad = len(mine) > largest or tight < least
        again = {}
        if len(mine) >= smallest and bad:
            again = {r: p for r, p in parts(mine, [e for e in near if e[0] in set(mine) and s[e] >= threshold + step]).items() if len(p) >= smallest}
        inner = {k: r for r, p in again.items() for k in p}
        for k in mine:
            status = "noise" if len(mine) < smallest else "active" if not bad or k in inner else "noise" if again else "needs_review"
            out[ids[k]] = (ids[inner.get(k, root)], status)
    return out


@pytest.mark.parametrize("threshold,least", [(0.3, 0.55), (0.25, 0.3), (0.5, 0.55)])
def test_clusters_by_brute_force(spark, threshold, least):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").collect()]
    rows += [(10_000 + k, v) for k, v in dense(3, n=300, dim=64, spread=0.7)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {r.id: (r.cluster, r.status) for r in V.clusters(df, threshold, least_cohesion=least).collect()}
    assert got == plain_clusters(rows, threshold, least=least)
    assert {s for _, s in got.values()} >= {"noise", "active"}


def test_lexical_clusters_by_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.select(F.col("doc_id").alias("id"), V.lexical_vectors(F.split_part("text", F.lit("."), F.lit(1)), 128).alias("v")).where(F.exists("v", lambda x: x != 0))
    plain = [(r.id, list(r.v)) for r in rows.orderBy("id").collect()]
    got = {r.id: (r.cluster, r.status) for r in V.clusters(rows, 0.72, sparse=True).collect()}
    assert got == plain_clusters(plain, 0.72)


def test_hashed_vector_by_hand():
    """Two words, by the published hash: offset 2166136261, prime 16777619, over UTF-16 units."""

    def fnv(text, h):
        for unit in text:
            h = (h ^ ord(unit)) * 16777619 % 2**32
        return h

    want = np.zeros(512)
    for word, weight in (("w:spark", 2.0), ("w:joins", 4.0), ("u:好", 0.5)):
        want[fnv(word, 2166136261) % 512] += weight if fnv(word, 0x9DC5B117) % 2 == 0 else -weight
    assert np.allclose(V.hashed_vector("Spark joins, joins 好", 512), want / np.linalg.norm(want))


def test_clusters_pair_no_copies_and_keep_every_row(spark):
    """Forty copies are one node that counts forty times; null, zero and endless vectors are noise and stay."""
    rows = [(k, [1.0, 0.0]) for k in range(40)] + [(50, [0.95, 0.1]), (60, None), (61, [0.0, 0.0]), (62, [0.0, 0.0]), (63, [0.0, 0.0]), (64, [float("inf"), 1.0]), (70, [0.0, 1.0])]
    got = {r.id: (r.cluster, r.status) for r in V.clusters(spark.createDataFrame(rows, "id long, v array<double>"), 0.7).collect()}
    assert got == {k: (0, "active") for k in [*range(40), 50]} | {k: (k, "noise") for k in (60, 61, 62, 63, 64, 70)}
    giant = {r.id: (r.cluster, r.status) for r in V.clusters(spark.createDataFrame(rows, "id long, v array<double>"), 0.7, largest=30, step=0.299).collect()}
    assert {giant[k] for k in range(40)} == {(0, "active")} and giant[50] == (0, "noise")  # the copies stay one cluster when it is cut


def test_joined_edges_join_the_same(spark):
    from tidewell.operators.graph import components

    rows = spark.createDataFrame([(k, v) for k, v in dense(5, n=400, dim=16, spread=0.6)], "id long, v array<double>")
    roots = lambda e: {r.node: r.root for r in components(e.select("a", "b")).collect()}
    all_, few = V.edges(rows, 0.5, block=90), V.edges(rows, 0.5, block=90, joined=True)
    assert roots(all_) == roots(few) and few.count() < all_.count()


def test_cut_forgets_how_large_its_plan_was(spark):
    from tidewell.operators.graph import cut

    df = spark.range(50).toDF("x")
    for _ in range(12):  # as checkpoints, the size told for the last of these has thousands of digits
        df = cut(df.join(df.withColumnRenamed("x", "y"), F.col("x") == F.col("y")).select("x"))
    assert df.count() == 50 and int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1_000_000


def test_rows_go_to_bundles_of_pivots(spark, tmp_path):
    """A row meets as many tasks as there are bundles, not pivots; a pivot larger than a bundle is cut."""
    rng = np.random.default_rng(11)
    v = rng.normal(size=(240, 8))
    v[:90] = v[0]  # equal vectors have one pivot
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    index = J.Pivots(rows, str(tmp_path / "v"), rows_each=4)
    made = index.bundles(40)
    sizes = {}
    for p, pieces, _, bundle in made:
        sizes[bundle] = sizes.get(bundle, 0) + index.sizes[p] / pieces
    assert len(index.points) == 60 and len(sizes) <= 12 and max(sizes.values()) <= 41
    assert pairs(index.edges(0.3, block=40)) == pairs(V.edges(rows, 0.3))
    assert sum(index.sizes) == 240


def plain_near(rows, threshold, most):
    """Pairs among the `most` nearest of an end, by loops; ties to 12 digits by id."""
    out = set()
    for dim in {len(v) for _, v in rows}:
        same = sorted((i, v) for i, v in rows if len(v) == dim)
        ids, x = [i for i, _ in same], np.array([v for _, v in same])
        x = x / np.abs(x).max(axis=1, keepdims=True)
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        s = u @ u.T
        for a in range(len(ids)):
            best = sorted((b for b in range(len(ids)) if b != a and s[a, b] >= threshold), key=lambda b: (-round(s[a, b], 12), ids[b]))[:most]
            out |= {(min(ids[a], ids[b]), max(ids[a], ids[b]), round(float(s[a, b]), 9)) for b in best}
    return sorted(out)


@pytest.mark.parametrize("block", [90, 2000])
def test_near_pairs_by_brute_force(spark, block):
    """Ties, copies, vectors of two lengths and of very large and small numbers, in blocks and in one."""
    rng = np.random.default_rng(7)
    rows = dense(7, n=700, dim=16, spread=0.5) + [(1000 + k, v) for k, v in dense(8, n=60, dim=5)]
    rows += [(2000 + k, [float(z) for z in rng.integers(0, 2, 16) + np.eye(16)[k % 16]]) for k in range(300)]  # whole numbers: many ties
    rows += [(3000, [1e200] * 16), (3001, [1e-200] * 16)]
    got = pairs(J.near_pairs(spark.createDataFrame(rows, "id long, v array<double>"), 0.4, 4, block=block))
    assert got == plain_near(rows, 0.4, 4)


def test_sparse_near_pairs_by_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.select(F.col("doc_id").alias("id"), V.lexical_vectors(F.split_part("text", F.lit("."), F.lit(1)), 128).alias("v")).where(V.links(F.col("v")))
    plain = [(r.id, list(r.v)) for r in rows.collect()]
    for threshold, most in ((0.72, 5), (0.3, 3)):
        assert pairs(J.near_pairs(rows, threshold, most, sparse=True, block=60)) == plain_near(plain, threshold, most)


def test_folded_vectors_exclude_most_pairs(spark):
    """Prefixes of the same titles compare some four of ten pairs; folded vectors leave under one of a hundred to compare in full."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    x = np.unique([r.v for r in docs.select(V.lexical_vectors(F.split_part("text", F.lit("."), F.lit(1)), 128).alias("v")).collect()], axis=0)
    x = x[(x != 0).any(axis=1)]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    short = J.folded(u)
    bound, sim, pair = short @ short.T, u @ u.T, ~np.eye(len(u), dtype=bool)
    assert short.shape[1] <= 40 and (bound >= sim - 1e-9).all()
    assert (bound[pair] >= 0.72).mean() < 0.01 and (sim[pair] >= 0.72).any()


def test_cohesion_of_weighted_nodes(spark):
    rng = np.random.default_rng(9)
    rows = [(k % 7, [float(z) for z in rng.normal(size=6)], k % 3 + 1) for k in range(60)] + [(9, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0], 2), (9, [-1.0, 0.0, 0.0, 0.0, 0.0, 0.0], 2)]
    df = V._weighted_cohesion(spark.createDataFrame(rows, "cluster long, v array<double>, w long"))
    assert "collect_list" not in df._jdf.queryExecution().toString()  # sums only: no row meets its cluster's centroid
    got = {r.cluster: r.cohesion for r in df.collect()}
    for c in {r[0] for r in rows}:
        x, w = (np.array([r[k] for r in rows if r[0] == c], dtype=float) for k in (1, 2))
        mean = (x * w[:, None]).sum(axis=0) / w.sum()
        cosines = x @ mean / np.maximum(np.linalg.norm(x, axis=1) * np.linalg.norm(mean), 1e-300)
        assert got[c] == pytest.approx(max(0.0, (cosines * w).sum() / w.sum()), abs=1e-12)


def test_copies_with_either_zero_stay_together(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, -0.0]), (3, [1.0, 0.0]), (4, [-0.0, 1.0])]
    for kind in ("double", "float"):
        df = V.clusters(spark.createDataFrame(rows, f"id long, v array<{kind}>"), 0.7)
        assert {r.id: (r.cluster, r.status) for r in df.collect()} == {1: (1, "active"), 2: (1, "active"), 3: (1, "active"), 4: (4, "noise")}
        assert "xxhash64" in df._jdf.queryExecution().optimizedPlan().toString()  # joined by a number first
