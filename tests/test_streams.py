"""Streams with state and stores between batches: restarts, late and unordered rows, and what a batch writes."""

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from tidewell.streaming import jobs
from tidewell.streaming.state import lateness
from tidewell.streaming.store import Store

EVENTS = "user_id long, event_id long, ts timestamp, event_type string"
DAY = dt.datetime(2024, 1, 1)


def parquet_in(place):
    return {os.path.join(d, x) for d, _, names in os.walk(place) for x in names if x.endswith(".parquet")}


def files(spark, place, *batches, schema=EVENTS):
    """A file each batch, in the order given by their time of change."""
    for rows in batches:
        old = parquet_in(place)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(place)
        for p in parquet_in(place) - old:
            os.utime(p, (1_700_000_000 + len(old), 1_700_000_000 + len(old)))


def plain(rows):
    out = []
    for user in sorted({r[0] for r in rows if r[0] is not None}):
        mood, pending, n, changes = None, None, 0, 0
        mine = sorted((r[2], r[1], r[3]) for r in rows if r[0] == user and r[2] is not None)
        for _, _, kind in mine:
            new = {"purchase": "buying", "signup": "buying", "error": "troubled"}.get(kind, "looking")
            if mood is None or new == mood:
                mood, pending, n = new, None, 0
                continue
            n, pending = n + 1 if new == pending else 1, new
            if n == 2 or new == "troubled":
                mood, pending, n, changes = new, None, 0, changes + 1
        if mine:
            out.append((user, mood, changes, mine[-1][0]))
    return out


def events(seed, n, users=4):
    rng = random.Random(seed)
    return [(rng.randrange(users), k, DAY + dt.timedelta(minutes=rng.randrange(60 * 24 * 20)), rng.choice(["view", "purchase", "signup", "error", "click"])) for k in range(n)]


def test_moods_stay_between_batches(spark, tmp_path):
    """Batches one file each, in no order; the stream is stopped and started again after some of them."""
    src, place = str(tmp_path / "events.parquet"), str(tmp_path / "place")
    rows = events(1, 120) + [(None, 500, DAY, "error"), (1, 501, None, "error"), (9, 502, DAY, None)]
    some = [rows[k::4] for k in range(4)]
    got = lambda: sorted(tuple(r) for r in jobs.moods(jobs.stream(spark, src, 1), "30 days", place).collect())
    files(spark, src, *some[:2])
    assert got() == plain(some[0] + some[1])
    assert got() == plain(some[0] + some[1])  # nothing new
    files(spark, src, *some[2:])
    assert got() == plain(rows)


def test_rows_settle_behind_the_watermark(spark, tmp_path):
    """Rows within the delay come right; one that is later than it is left out, as a watermark has it."""
    src = str(tmp_path / "events.parquet")
    at = lambda d: DAY + dt.timedelta(days=d)
    first = [(1, 1, at(0), "view"), (1, 2, at(10), "purchase"), (2, 3, at(10), "view")]
    second = [(1, 4, at(9), "purchase"), (2, 5, at(12), "view")]  # settles what lies before day 8
    third = [(1, 6, at(1), "error"), (2, 7, at(7), "error"), (1, 8, at(20), "view")]  # events 6 and 7 are too late
    files(spark, src, first, second, third)
    got = sorted(tuple(r) for r in jobs.moods(jobs.stream(spark, src, 1), "2 days").collect())
    kept = [r for r in first + second + third if r[1] not in (6, 7)]
    assert got == plain(kept)


def test_lateness_of_stored_files(spark, tmp_path):
    src = str(tmp_path / "events.parquet")
    at = lambda d: (1, 1, DAY + dt.timedelta(days=d), "view")
    files(spark, src, [at(0), at(5)], [at(6)], [at(4), at(9)], [at(8)])
    assert lateness(spark, src) == f"{2 * 86400 + 1} seconds"
    alone = str(tmp_path / "one.parquet")
    files(spark, alone, [at(3), at(0)])
    assert lateness(spark, alone) == "1 seconds"


def test_topic_lifecycle_in_state(spark, tmp_path):
    """The same hysteresis as the batch form, run by run, however the runs lie in files."""
    from tidewell.operators import scoring as S

    rng, runs = random.Random(4), []
    for k in range(12):
        runs.append([(t, rng.choice(["rising", "peak", "declining", "unknown"]), rng.choice([None, 10.0, 20.0, 50.0])) for t in range(6)])
    runs = [[(t, s, None if s == "unknown" else x or 30.0) for t, s, x in run] for run in runs]
    now = spark.createDataFrame([], "topic_id long, state string, pending string, confirmations int, score double")
    for run in runs:
        now = spark.createDataFrame(S.settle(now, spark.createDataFrame(run, "topic_id long, state string, score double")).drop("changed").collect(), now.schema)
    want = sorted(tuple(r) for r in now.collect())
    src = str(tmp_path / "runs.parquet")
    flat = [(t, DAY + dt.timedelta(hours=k), k, s, x) for k, run in enumerate(runs) for t, s, x in run]
    rng.shuffle(flat)
    files(spark, src, *[flat[k::3] for k in range(3)], schema="topic_id long, run_at timestamp, run_id long, state string, score double")
    got = jobs.settled_stream(jobs.stream(spark, src, 1), lateness(spark, src, "run_at"))
    assert sorted(tuple(r) for r in got.drop("changes", "last").collect()) == want


def size(place):
    return sum(map(os.path.getsize, parquet_in(place)))


def test_a_batch_writes_what_it_brings(spark, tmp_path):
    place, schema = str(tmp_path / "store"), "k long, t long, text string"
    made = lambda lo, hi, t: spark.range(lo, hi).select(F.col("id").alias("k"), F.lit(t).cast("long").alias("t"), F.sha2(F.concat("id", F.lit(f":{t}")), 256).alias("text"))
    store = Store(spark, place, ["k"], ["t"], made(0, 1, 0).schema, buckets=8)
    store.upsert(made(0, 20_000, 0), 0)
    whole, last = size(place), 0
    for n in range(1, 5):
        before = size(place)
        touched = store.upsert(made(100 * n, 100 * n + 100, n), n)
        last = size(place) - before
        assert len(touched) == 8 and (last < whole / 10 or n == 4)
    assert whole / 2 < last < 1.5 * whole  # the fifth folder of a bucket has it rewritten as one
    assert {len(v) for v in store.live().values()} == {1}
    got = {r.t: r.n for r in store.current().groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {0: 19_600, 1: 100, 2: 100, 3: 100, 4: 100}
    store.upsert(made(400, 500, 4), 4)  # a batch that is repeated
    assert store.current().count() == 20_000 and schema
    one = spark.createDataFrame([(7, 9, "seven")], schema)
    assert len(store.upsert(one, 5)) == 1 and store.current().where("k = 7").collect() == [(7, 9, "seven")]
    assert store.upsert(one.limit(0), 6) == []


def test_a_store_forgets_removed_keys_and_bad_runs(spark, tmp_path):
    schema = "k long, t long, gone boolean"
    store = Store(spark, str(tmp_path / "s"), ["k"], ["t"], spark.createDataFrame([], schema).schema, removed="gone")
    assert store.current().count() == 0
    store.upsert(spark.createDataFrame([(1, 1, None), (2, 1, False), (None, 1, None)], schema), 0)
    store.upsert(spark.createDataFrame([(1, 2, True)], schema), 1)
    assert sorted(store.current().collect(), key=str) == [(2, 1, False), (None, 1, None)]
    store._put(spark.createDataFrame([(2, 9, False)], schema), 4)  # a batch that died before its manifest
    assert sorted(store.current().collect(), key=str) == [(2, 1, False), (None, 1, None)]
    store.upsert(spark.createDataFrame([(1, 3, False)], schema), 2)
    assert sorted(r.k or 0 for r in store.current().collect()) == [0, 1, 2]


def test_refresh_after_a_collection(spark, tmp_path):
    """Each batch with rows refreshes once, with its rows and the current ones of the buckets they touch."""
    src, seen, schema = str(tmp_path / "in.parquet"), [], "k long, t long"
    say = lambda batch, touched: seen.append((sorted(r.k for r in batch.collect()), sorted(map(tuple, touched.collect()))))
    again = lambda: jobs.refresh_after(jobs.stream(spark, src), say, str(tmp_path / "place"), ["k"], ["t"], buckets=1)
    files(spark, src, [(1, 1), (2, 1)], schema=schema)
    again()
    again()
    files(spark, src, [(2, 2), (3, 1)], schema=schema)
    again()
    assert seen == [([1, 2], [(1, 1), (2, 1)]), ([2, 3], [(1, 1), (2, 2), (3, 1)])]
