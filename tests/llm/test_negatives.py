"""Hard negatives against brute force, with trees of many leaves."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int"


def expected(rows):
    size = {}
    for i, v, y in rows:
        if i is None or v is None or y is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = ((y + 1) % 10 if i % 7 == 0 else y, [math.floor(256 * x) for x in v])
        size[i] = min(size.get(i, row), row)
    out = []
    for a, (ya, va) in size.items():
        if a % 100:
            continue
        scored = sorted((-sum(x * z for x, z in zip(va, v)), i, y) for i, (y, v) in size.items() if i != a)
        for ps, pid, _ in [s for s in scored if s[2] == ya][:5]:
            fit = [s for s in scored if s[2] != ya and -80 * ps <= -100 * s[0] <= -100 * ps][:5]
            out += [(a, pid, k + 1, i, -ps, -s) for k, (s, i, _) in enumerate(fit)]
    return sorted(out)


def clusters(seed, n=1500, dim=12, kinds=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(25, dim))
    at = rng.integers(0, 25, n)
    x = centres[at] + 0.3 * rng.normal(size=(n, dim))
    x[: n // 3] = x[0]  # a third of all rows is the same vector
    ids = rng.permutation(3 * n)[:n]
    ids[:12] = np.arange(12) * 100
    return [(int(i), [float(z) for z in v], int(y)) for i, v, y in {int(i): (i, v, y) for i, v, y in zip(ids, x, rng.integers(0, kinds, n))}.values()]


@pytest.mark.parametrize("how", [{}, {"leaf_rows": 40, "block_rows": 64, "anchor_rows": 64}])
def test_by_brute_force(spark, how):
    rows = clusters(1)
    odd = [(100, None, 1), (30_000, [1.0] * 12, None), (30_100, [float("nan")] * 12, 1), (30_200, [None] * 12, 1), (None, [1.0] * 12, 1), rows[5], (rows[6][0], [9.0] * 12, 99)]
    df = spark.createDataFrame(rows + odd, SCHEMA).withColumn("leaf", F.lit("mine")).withColumn("id", F.lit(0))
    if how:
        assert len(negatives.Index(negatives.usable(df), 100, **how).tree.paths) > 20
    got = sorted(tuple(r) for r in negatives.negatives_report(df, **how).collect())
    assert got == expected(rows + odd)


def test_leaves_are_left_out(spark):
    """On clustered vectors most leaves miss the annulus of an anchor's windows."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 16)) * 4
    x = np.floor(64 * np.concatenate([c + 0.05 * rng.normal(size=(40, 16)) for c in centres])).astype(np.int64)
    tree = negatives.Tree(x, (x * x).sum(axis=1).max(), len(x), leaf_rows=60)
    leaf = tree.leaf(x)
    tree.learn({k: tree.spans(x[leaf == k], k) for k in np.unique(leaf)})
    seen = 0
    for a in range(0, len(x), 100):
        scores = x @ x[a]
        low, high = int(np.sort(scores)[-10]), int(scores.max())
        to = tree.visits(x[a : a + 1], np.array([[low]]), np.array([[high]]))
        assert set(leaf[(scores >= low) & (scores <= high)]) <= set(to)
        seen += len(to)
    assert seen < 0.3 * len(tree.paths) * len(range(0, len(x), 100))


def test_odd_tables(spark):
    assert negatives.negatives_report(spark.createDataFrame([], SCHEMA)).collect() == []
    long = [(k * 100, [1e5 + k, 2e5], k % 2) for k in range(6)]  # products beyond 2**53
    for rows in ([(0, [], 1), (1, [], 1), (2, [], 2)], [(0, [1.0], 1)], [(0, [0.5, 0.5], 1), (100, [0.5, 0.5], 1), (2, [0.45, 0.5], 2), (3, [1.0], 2)], long):
        usual = max({len(v) for _, v, _ in rows}, key=lambda d: (sum(len(v) == d for _, v, _ in rows), d))
        got = negatives.negatives_report(spark.createDataFrame(rows, SCHEMA))
        assert sorted(tuple(r) for r in got.collect()) == expected([r for r in rows if len(r[1]) == usual])
    too_long = [(0, [1e9, 1e9], 1), (1, [1e9, 1e9], 1), (2, [1e9, 1e9], 2)]
    assert negatives.negatives_report(spark.createDataFrame(too_long, SCHEMA)).collect() == []
