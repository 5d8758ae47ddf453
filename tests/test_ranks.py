"""Row numbers and running sums by range, against plain sorting; a key of a third of all rows is in no one task."""

import datetime as dt
import math
import random
import re
import statistics
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidewell.functions import stats as A
from tidewell.operators import scoring as S
from tidewell.operators.ranks import numbered, running


def made(seed, n=900):
    rng = random.Random(seed)
    return [(k, rng.choice(["hot"] * 5 + ["a", "b", None]), rng.choice([None, float(rng.randrange(300)), rng.random() * 300])) for k in range(n)]


def test_numbered(spark):
    rows = made(1)
    got = numbered(spark.createDataFrame(rows, "id long, k string, x double"), ["k", F.desc("x"), "id"], "g", parts=7).orderBy("g").collect()
    assert [r.g for r in got] == list(range(len(rows)))
    assert [r.id for r in got] == [r[0] for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[2] is None, -(r[2] or 0), r[0]))]
    assert numbered(spark.createDataFrame([], "id long"), ["id"]).count() == 0


@pytest.mark.parametrize("few", [0, 10**6])
def test_running_and_what_rests_on_it(spark, few):
    rows = made(2)
    df = spark.createDataFrame(rows, "id long, k string, x double")
    counts = df.groupBy("k", "x").agg(F.count(F.lit(1)).alias("n"))
    want, groups = {}, defaultdict(list)
    for _, k, x in rows:
        groups[k].append(x)
    for k, xs in groups.items():
        for x in set(xs):
            before = sum(y is None if x is not None else False for y in xs) + sum(y is not None and x is not None and y < x for y in xs)
            want[k, x] = (before, len(xs))
    got = running(counts, ["k"], "x", "n", few=few, parts=6)
    assert {(r.k, r.x): (r["_below"], r["_all"]) for r in got.collect()} == want
    known = {k: sorted(x for x in xs if x is not None) for k, xs in groups.items()}
    p = {r.id: r.p for r in A.percentile_of(df, ["k"], "x", "p", few=few).collect()}
    for i, k, x in rows:
        assert p[i] == (None if x is None else pytest.approx(100 * (sum(y < x for y in known[k]) + known[k].count(x) / 2) / len(known[k])))
    q = A.quantiles(df, ["k"], {"mid": ("x", 0.5), "low": ("x", 0.25)}, few=few).collect()
    assert {r.k: r.mid for r in q} == pytest.approx({k: statistics.median(v) for k, v in known.items()})
    assert {r.k: r.low for r in q} == pytest.approx({k: statistics.quantiles(v, n=4, method="inclusive")[0] for k, v in known.items()})
    o = A.order_statistics(df, ["k"], {"up": ("x", A.upper_median_at())}, few=few).collect()
    assert {r.k: r.up for r in o} == {k: v[len(v) // 2] for k, v in known.items()}


def test_no_task_holds_a_hot_key(spark):
    """A key of all rows: the ordered parts are of about equal size."""
    df = spark.range(40_000).select(F.lit("hot").alias("k"), F.xxhash64("id").alias("x"), F.lit(1).alias("n"))
    got = running(df, ["k"], "x", "n", few=0, parts=8)
    assert got.agg(F.max("_below")).first()[0] == 39_999
    sorted_ = df.repartitionByRange(8, "k", "x").groupBy(F.spark_partition_id()).count().collect()
    assert len(sorted_) == 8 and max(r["count"] for r in sorted_) < 2 * 40_000 / 8


@pytest.mark.parametrize("few", [0, 10**6])
def test_percentiles_of_several_values(spark, few):
    """Small keys ordered a key at a time, large ones by ranges: null keys are a key, -0.0 is 0.0, NaN equals NaN."""
    rng = random.Random(3)
    rows = [(i, rng.choice(["hot"] * 5 + ["a", "b", None]), rng.choice([None, rng.randrange(40)]), rng.choice([None, math.nan, -0.0, 0.0, rng.random()])) for i in range(700)]
    df = spark.createDataFrame([*rows, (700, "alone", None, None)], "id long, k string, n long, x double")
    got = {r.id: r for r in A.percentiles_of(df, "id", ["k"], ["n", "x"], few=few).collect()}
    key = lambda v: (math.isnan(v), 0.0 if math.isnan(v) else v + 0.0)
    for i, k, *vs in rows:
        for j, name in enumerate(("p_n", "p_x")):
            known = [key(r[2 + j]) for r in rows if r[1] == k and r[2 + j] is not None]
            want = None if vs[j] is None else 100 * (sum(v < key(vs[j]) for v in known) + known.count(key(vs[j])) / 2) / len(known)
            assert got[i][name] == (want if want is None else pytest.approx(want))
    assert len(got) == 701 and got[700].p_n is None and got[700].p_x is None


def test_keys_go_on_over_arrow_batches():
    import pyarrow as pa

    rows = pa.table({"k": ["a"] * 5 + ["b"] * 23 + ["c"] * 2 + [None], "v": [3, 1, 2, 2, None, *range(23), 1, 1, 7]})
    out = pa.Table.from_batches(list(A._ranked(["k"], ["v"], at_once=4)(iter(rows.to_batches(max_chunksize=3)))))
    assert out["k"].to_pylist() == rows["k"].to_pylist() and out["v"].to_pylist() == rows["v"].to_pylist()
    assert out["p_v"].to_pylist() == pytest.approx([87.5, 12.5, 50.0, 50.0, None, *[100 * (i + 0.5) / 23 for i in range(23)], 50.0, 50.0, 50.0])
    assert list(A._ranked(["k"], ["v"])(iter([]))) == []


def test_creators_both_ways(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["p", "q", None]), rng.choice([1, 2, 2, 2, None]), rng.choice([None, rng.randrange(30)])) for i in range(300)]
    df = spark.createDataFrame(rows, "item_id long, platform string, author_id long, total long")
    one, two = ({r.item_id: (r.creator_rank, r.creator_history) for r in S.creator_percentile(df, few=few).collect()} for few in (0, 10**6))
    assert one == two and len(one) == 300 and any(rank is not None for rank, _ in one.values())


def test_burst_is_compiled_and_shuffles_no_row_a_value(spark):
    """Methods over 8,000 bytes are interpreted by the JVM; eight rows an item were shuffled three times."""
    at = [dt.datetime(2024, 1, d) for d in range(1, 5)]
    items = spark.createDataFrame([(i, "p", "video", i % 3, 1, at[0]) for i in range(40)], "item_id long, platform string, content_type string, author_id long, topic_id long, published_at timestamp")
    points = [(i, t, *[i * 7 % 11 + k for k in range(6)]) for i in range(40) for t in at]
    snapshots = spark.createDataFrame(points, "item_id long, captured_at timestamp, views long, likes long, comments long, shares long, favorites long, upvotes long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = S.burst(items, snapshots, at[-1], "zeta")
        said = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", said)]
        assert sizes and max(sizes) < 8000
        assert "explode" not in df._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert df.count() == 40
