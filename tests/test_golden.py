"""Small hand-made cases of the scores, the text functions, clusters, sources and streams."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidewell.functions import content as C
from tidewell.functions import stats as A
from tidewell.functions import text as T
from tidewell.operators import catalog as O
from tidewell.operators import intel as I
from tidewell.operators import momentum as M
from tidewell.operators import scoring as S
from tidewell.operators import search as X
from tidewell.operators import silver as D
from tidewell.operators import similarity as V
from tidewell.operators.graph import components

NOW = dt.datetime(2024, 1, 31)
ITEM = "item_id long, platform string, content_type string, author_id long, topic_id long, published_at timestamp"
SNAP = "item_id long, captured_at timestamp, views long, likes long, comments long, shares long, favorites long, upvotes long"


def values(df, col, key):
    return {r[key]: r[col] for r in df.collect()}


def one(spark, expr_of, text):
    return spark.createDataFrame([(text,)], "x string").select(expr_of(F.col("x")).alias("y")).first().y


def test_percentiles(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 1.0), ("a", 3, 5.0), ("a", 4, None), ("b", 5, 7.0), (None, 6, 3.0)], "k string, id long, x double")
    assert values(A.percentile_of(df, ["k"], "x", "p"), "p", "id") == pytest.approx({1: 100 / 3, 2: 100 / 3, 3: 250 / 3, 4: None, 5: 50.0, 6: 50.0})
    wide = A.percentiles_of(df.where("k is not null"), "id", ["k"], ["x"])
    assert values(wide, "p_x", "id") == pytest.approx({1: 100 / 3, 2: 100 / 3, 3: 250 / 3, 4: None, 5: 50.0})


def test_growth_rounding_and_weights(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, 4.0, 1.0), (3, 2.0, 0.0), (4, 0.0, 0.0), (5, None, 1.0), (6, -1.0, 2.0)], "id int, c double, b double")
    assert values(df.select("id", A.growth(F.col("c"), F.col("b")).alias("g")), "g", "id") == {1: 50.0, 2: 80.0, 3: 100.0, 4: 50.0, 5: None, 6: 0.0}
    r = spark.createDataFrame([(-2.5,), (2.5,), (None,)], "x double").select(A.half_up("x").alias("y")).collect()
    assert [x.y for x in r] == [-2.0, 3.0, None]
    w = spark.createDataFrame([(50.0, None), (None, None)], "a double, b double")
    score, used = A.weighted({"a": (F.col("a"), 0.3), "b": (F.col("b"), 0.7)})
    assert [(x.s, x.u) for x in w.select(score.alias("s"), used.alias("u")).collect()] == [(50.0, 0.3), (None, 0.0)]


def test_medians_and_concentration(spark):
    df = spark.createDataFrame([("k", float(x)) for x in (4, 1, 3, 2)], "k string, x double")
    df = df.union(spark.createDataFrame([("n", None), ("o", 7.0), ("o", None), ("h", 2.0), ("h", 2.0), ("h", 2.0), ("h", 9.0)], "k string, x double"))
    got = A.order_statistics(df, ["k"], {"u": ("x", A.upper_median_at()), "q": ("x", A.low_quantile_at(0.75))})
    assert {r.k: (r.u, r.q) for r in got.collect()} == {"k": (3.0, 3.0), "n": (None, None), "o": (7.0, 7.0), "h": (2.0, 2.0)}
    own = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("c", None), ("c", None), ("d", "x"), ("d", "y")], "t string, o string")
    assert values(A.concentration(own, "t", "o"), "concentration", "t") == {"a": 1.0, "b": 1.0, "c": None, "d": 0.0}


@pytest.mark.parametrize("text,want", [("1.2万", 12000), ("+3w", 30000), ("3.5亿", 350000000), ("1,234 次", 1234), ("0", 0), ("-", None), ("未知", None), ("abc", None), ("-5", None), (None, None), ("", None)])
def test_parse_metric(spark, text, want):
    assert one(spark, T.parse_metric, text) == want


@pytest.mark.parametrize("text,want", [
    ("HTTPS://Example.com:443/a/?utm_source=x&b=2#top", "https://example.com/a/?b=2"), ("http://a.com:80/", "http://a.com"), ("www.a.com/x/", "https://www.a.com/x"), ("ftp://a.com/x", None), ("nothing", None),
    ("https://a.com/p?from=x&spm=1", "https://a.com/p"), ("https://a.com?x", "https://a.com/?x="), (None, None),
])
def test_canonical_url(spark, text, want):
    assert one(spark, T.canonical_url, text) == want


def test_dates(spark):
    at = lambda s, zone=None: one(spark, lambda c: F.date_format(T.utc_time(c, zone), "yyyy-MM-dd HH:mm:ss"), s)
    assert at("2024-01-05 21:34:00", "Asia/Shanghai") == "2024-01-05 13:34:00"
    assert at("2024-01-05T10:00:00+02:00") == "2024-01-05 08:00:00"
    assert at("1704448800") == at("1704448800000") == "2024-01-05 10:00:00"
    assert at("2024/01/05") == at("2024年1月5日") == "2024-01-05 00:00:00"
    assert at("2024-02-30") is None and at("2026-13-40 99:99:99") is None and at(None) is None


def test_texts(spark):
    assert one(spark, T.hashtags, "#a #B,#b、c，A") == ["a", "B", "c"]
    assert one(spark, T.hashtags, None) == []
    assert one(spark, T.strip_html, "<style>x</style><p>a &amp; b&#39;&#8364;</p><br/>c<script>z</script>") == "  a & b'€\n\nc "
    assert one(spark, T.content_type, " 短视频 ") == "video" and one(spark, T.content_type, "else") is None
    assert one(spark, T.words, "The cat's 2x of Éa") == ["cat's", "2x"]


def test_momentum(spark):
    items = spark.createDataFrame([(1, "a", "video", 1, 1, None), (2, "zeta", "video", 1, 1, None), (3, "a", "video", 1, 1, None), (4, "a", "video", 1, 1, None)], ITEM)
    d = lambda n: dt.datetime(2024, 1, n)
    snaps = [(1, d(25), 10, 1, 1, 1, 1, None), (1, d(30), 20, 5, 2, None, 4, None), (2, d(25), 0, 1, 0, 0, 0, 3), (2, d(26), 0, 9, 0, 0, 0, 4), (3, d(1), 1, 1, 1, 1, 1, None), (3, d(30), 1, 3, 1, 1, 1, None), (4, d(30), 1, 1, 1, 1, 1, None)]
    got = {r.item_id: r for r in M.momentum_list(items, spark.createDataFrame(snaps, SNAP), NOW, "zeta").collect()}
    assert set(got) == {1, 2, 3}  # 4 has a single snapshot and nothing before the window
    assert (got[1].momentum, got[1].d_shares, got[1].unknown_components) == (4 + 2 + 6, None, "shares")
    assert got[2].momentum == 1 and got[3].momentum == 2 and got[2].engagement is None


def test_cohort_ladder(spark):
    some = lambda n, first, topic, kind="video": [(first + k, "p", kind, 1, topic, NOW) for k in range(n)]
    rows = some(30, 0, 1) + some(10, 100, 2) + [(200 + k, "q", "video", 1, 1, NOW) for k in range(4)]
    got = {r.item_id: (r.level, r.cohort_size, r.insufficient) for r in S.cohorts(spark.createDataFrame(rows, ITEM), NOW).collect()}
    assert got[0] == (0, 30, False) and got[100] == (1, 40, False) and got[200] == (3, 4, True)


def test_burst_reasons(spark):
    items = spark.createDataFrame([(k, "p", "video", 1, 1, NOW) for k in range(6)] + [(9, "q", "video", 1, 1, NOW)], ITEM)
    snaps = [(k, NOW, k, k, k, k, k, None) for k in range(4)] + [(4, NOW, *[None] * 6), (9, NOW, 1, 1, 1, 1, 1, None)]
    got = {r.item_id: r for r in S.burst(items, spark.createDataFrame(snaps, SNAP), NOW, "zeta").collect()}
    assert got[5].reason == "insufficient_snapshots" and got[4].reason == "insufficient_metrics" and got[9].reason == "insufficient_cohort"
    assert got[3].score > got[0].score and got[3].reason is None and got[5].score is None


def test_hysteresis(spark):
    kind, state = "topic_id long, state string, pending string, confirmations int, score double", "topic_id long, state string, score double"
    now = spark.createDataFrame([], kind)
    said = []
    for run in ([(1, "rising", 50.0), (2, "rising", 50.0)], [(1, "saturated", 55.0), (2, "peak", 80.0)], [(1, "saturated", 54.0), (2, "unknown", None)], [(1, "rising", 50.0), (2, "rising", 79.0)], [(1, "unknown", None), (2, "peak", 79.0)], [(1, "rising", 50.0), (2, "rising", 79.0)]):
        now = S.settle(now, spark.createDataFrame(run, state))
        said.append({r.topic_id: r.state for r in now.collect()})
    assert [s[1] for s in said] == ["rising", "rising", "saturated", "saturated", "saturated", "saturated"]
    assert [s[2] for s in said] == ["rising", "peak", "peak", "peak", "peak", "peak"]


def test_merge_and_candidates(spark):
    a = spark.createDataFrame([(1, None, 5), (2, "x", 6)], "k int, t string, n int")
    b = spark.createDataFrame([(1, "new", None), (3, "z", 7)], "k int, t string, n int")
    got = {r.k: (r.t, r.n, r.status) for r in D.merge(a, b, "k", ["t"], ["n"]).collect()}
    assert got == {1: ("new", 5, "merged"), 2: ("x", 6, "kept"), 3: ("z", 7, "new")}
    items = spark.createDataFrame([(1, "f"), (2, "f"), (3, None), (4, None), (5, "f")], "item_id long, fingerprint string")
    assert sorted((r.item_a, r.item_b) for r in D.candidates(items).collect()) == [(1, 2), (1, 5)]


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (7, 7), (103, 102)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and got[101] == got[100] == 100 and got[103] == 102
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_clusters_and_reconcile(spark):
    v = lambda *x: [float(y) for y in x]
    rows = [(k, v(1, 0.01 * k, 0)) for k in range(4)] + [(10 + k, v(0, 1, 0.01 * k)) for k in range(3)] + [(20, v(0, 0, 1))]
    got = {r.id: (r.cluster, r.status) for r in V.clusters(spark.createDataFrame(rows, "id long, v array<double>"), threshold=0.7).collect()}
    assert all(got[k] == (0, "active") for k in range(4)) and got[11] == (10, "active") and got[20] == (20, "noise")
    old = spark.createDataFrame([(7, k) for k in range(6)], "topic long, id long")
    new = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (1, 3), (2, 4), (2, 5), (3, 99)], "cluster long, id long")
    assert {r.cluster: (r.topic, r.status) for r in V.reconcile(old, new).collect()} == {1: (7, "kept"), 2: (None, "split"), 3: (None, "new")}


def test_lexical_vector():
    v = V.hashed_vector("Hello hello world", 64)
    assert sum(x * x for x in v) == pytest.approx(1.0) and V.hashed_vector("", 8) == [0.0] * 8 and v == V.hashed_vector("hello HELLO world", 64)


def test_angles(spark):
    m = [(1, k, [1.0, 0.02 * k, 0.0], k, NOW) for k in range(4)] + [(1, 10 + k, [0.0, 0.02 * k, 1.0], k, NOW) for k in range(3)] + [(1, 20, [0.0, 1.0, 0.0], 1, NOW)]
    members = spark.createDataFrame(m, "topic_id long, id long, v array<double>, author_id long, published_at timestamp")
    known = spark.createDataFrame([(1, 5, [1.0, 0.0, 0.0])], "topic_id long, angle_id long, centroid array<double>")
    got = {r.angle: r for r in I.angles(members, known, NOW).collect()}
    assert got[0].inherited == 5 and not got[0].emerging and got[10].emerging and got[10].novelty > 60 and got[20].novelty is None


def test_nothing_scored_is_no_burst(spark):
    rows = spark.createDataFrame([(1, None, NOW), (1, None, None), (2, 90.0, NOW), (2, 10.0, NOW), (2, None, NOW)], "topic_id long, score double, published_at timestamp")
    got = {r.topic_id: r for r in I.burst_opportunity(rows, NOW).collect()}
    assert (got[1].burst, got[1].coverage, got[1].recent_bursts, got[1].density) == (None, None, None, None)
    assert got[2].density == 100.0 and got[2].recent_bursts == 1 and got[2].coverage == pytest.approx(2 / 3) and got[2].burst == 0.5 * 100 + 0.3 * 10 + 0.2 * 20


def test_similar_and_edges_take_odd_vectors(spark):
    kind = "id long, v array<double>"
    rows = [(k, [1.0, 0.1 * k]) for k in range(5)] + [(10, None), (11, [1.0, 0.0, 0.0]), (12, []), (13, [0.0, 0.0])]
    df = spark.createDataFrame(rows, kind)
    got = V.edges(df, 0.99, block=2)
    want = [(a, b) for a in range(5) for b in range(a + 1, 5) if (1 + 0.01 * a * b) / ((1 + 0.01 * a * a) * (1 + 0.01 * b * b)) ** 0.5 >= 0.99]
    assert sorted((r.a, r.b) for r in got.collect()) == want
    spaced = df.withColumn("s", F.when(F.col("id") % 2 == 0, "even").when(F.col("id") < 10, "odd"))
    assert sorted((r.a, r.b) for r in V.edges(spaced, 0.9, space="s").collect()) == [(0, 2), (0, 4), (1, 3), (2, 4)]
    asked = df.select(F.col("id").alias("q"), F.col("v").alias("qv"))
    near = V.similar(df, asked, top=1, least=0.5, block=2).collect()
    assert {r.q: r.id for r in near} == {0: 1, 1: 0, 2: 1, 3: 2, 4: 3} or {r.q for r in near} == {0, 1, 2, 3, 4}
    assert V.similar(df, asked.limit(0)).count() == 0


def test_lifecycle_uses_its_history(spark):
    kind = "topic_id long, members long, since timestamp, score double, density double, recent_new long, baseline_new long, creators long, baseline_creators long"
    old = NOW - dt.timedelta(days=100)
    t = spark.createDataFrame([(1, 10, old, 45.0, 0.0, 1, 1, 1, 1)], kind)
    state = lambda *past: S.lifecycle(t, NOW, F.array(*[F.lit(float(x)) for x in past])).first().state
    assert state(30, 20) == "declining" and state(50, 20) != "declining" and state(45, 46) == "evergreen" and state(90, 41) == "saturated"


def test_angle_persistence(spark):
    stored = spark.createDataFrame([(1, 7, "a"), (2, 7, "b")], "angle_id long, topic_id long, label string")
    found = spark.createDataFrame([(50, 7, 1, 5), (60, 7, None, 3)], "angle long, topic_id long, inherited long, members int")
    got = {r.angle_id: (r.label, r.status, r.members) for r in I.persisted_angles(stored, found).collect()}
    assert got == {1: ("a", "active", 5), 2: ("b", "inactive", 0), 60: (None, "new", 3)}


def test_header_mapping_and_export(spark, tmp_path):
    from tidewell.sources import files

    assert files.mapping(["Item ID", "标题", "点赞数", "Author_Name", "other"]) == {"content_id": "Item ID", "title": "标题", "likes": "点赞数", "author_name": "Author_Name"}
    df = spark.createDataFrame([("1", "t", "1.5万", None), ("2", "", "-", "x")], "`Item ID` string, `标题` string, `点赞数` string, other string")
    assert [(r.content_id, r.title, r.likes) for r in files.normalised(df).collect()] == [("1", "t", 15000), ("2", None, None)]
    assert files.export(df.toDF("id", "title", "likes", "other"), str(tmp_path / "out"), ["id", "likes"], {"id", "likes"}, most=1) == {"total": 2, "truncated": True}
    with pytest.raises(ValueError):
        files.export(df.toDF("id", "title", "likes", "other"), str(tmp_path / "no"), ["other"], {"id"})


def test_paged_source(spark, tmp_path):
    from tidewell.sources.paged import PagedJson

    for k in (1, 2):
        (tmp_path / f"p{k}.json").write_text(json.dumps({"data": {"list": [{"id": k, "content": {"title": f"t{k}"}}, {"id": "bad"}]}}))
    spark.dataSource.register(PagedJson)
    df = spark.read.format("paged_json").option("url", f"file://{tmp_path}/p{{page}}.json").option("pages", 2).option("items", "data.list").option("fields", "title=content.title").schema("id long, title string").load()
    assert sorted((r.id or 0, r.title) for r in df.collect() if r.title) == [(1, "t1"), (2, "t2")] and df.count() == 4


def test_paged_source_by_cursor_and_as_stream(spark, tmp_path):
    from tidewell.sources.paged import PagedJson

    spark.dataSource.register(PagedJson)
    for k, after in (("", "b"), ("b", "c"), ("c", None)):
        (tmp_path / f"c{k}.json").write_text(json.dumps({"list": [{"id": ord(k or "a")}], "next": after}))
    for k in range(1, 31):
        (tmp_path / f"p{k}.json").write_text(json.dumps({"list": [{"id": k}]}))
    by = lambda r, name, **o: r.format("paged_json").options(url=f"file://{tmp_path}/{name}.json", items="list", **o).schema("id long").load()
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(by(spark.read, "c{cursor}", next="next")) == [97, 98, 99]
    assert ids(by(spark.read, "c{cursor}", next="next", pages="2")) == [97, 98]
    assert ids(by(spark.read, "p{page}", pages="30")) == list(range(1, 31))
    for name, opts, want in (("c{cursor}", {"next": "next"}, [97, 98, 99]), ("p{page}", {"pages": "3"}, [1, 2, 3])):
        out, done = str(tmp_path / f"out{len(name)}"), str(tmp_path / f"done{len(name)}")
        q = by(spark.readStream, name, **opts).writeStream.format("parquet").option("path", out).option("checkpointLocation", done).start()
        for _ in range(60):
            q.processAllAvailable()
            if ids(spark.read.schema("id long").parquet(out)) == want:
                break
        q.stop()
        assert ids(spark.read.parquet(out)) == want


def test_streams_go_on_after_a_restart(spark, tmp_path):
    from tidewell.streaming import jobs

    src, place = str(tmp_path / "in.parquet"), str(tmp_path / "place")
    rows = lambda *r: spark.createDataFrame(r, "k long, t long").coalesce(1).write.mode("append").parquet(src)
    got = lambda: {r.k: r.t for r in jobs.upsert_stream(jobs.stream(spark, src), ["k"], ["t"], place).collect()}
    rows((1, 1), (2, 5))
    assert got() == {1: 1, 2: 5} == got()
    rows((1, 3), (2, 4), (3, 1))
    assert got() == {1: 3, 2: 5, 3: 1}
    counts = lambda: {r.k: r.n for r in jobs.run_to_end(jobs.stream(spark, src).groupBy("k").agg(F.count(F.lit(1)).alias("n")), ["k"], place=place + "2").collect()}
    assert counts() == {1: 2, 2: 2, 3: 1}
    rows((3, 9))
    assert counts() == {1: 2, 2: 2, 3: 2}
    none = str(tmp_path / "none.parquet")
    spark.createDataFrame([], "k long, t long").write.parquet(none)
    assert jobs.upsert_stream(jobs.stream(spark, none), ["k"], ["t"]).count() == 0


def test_manual_records(spark):
    from tidewell.sources import files

    kind = "title string, likes long"
    assert files.manual_record(spark, {"title": "t"}, kind).collect() == [("t", None)]
    for bad in ({"other": 1}, {"likes": "many"}):
        with pytest.raises(Exception):
            files.manual_record(spark, bad, kind).collect()


def test_han_texts(spark):
    assert one(spark, C.collapsed, "好!!!! 。。。。 ok....") == "好! 。 ok."
    assert one(spark, C.han_spaced, "探店vlog2好") == "探 店 vlog2 好"
    assert one(spark, C.match_query, ' 探店 "vlog* -- ') == '"探 店" AND "vlog"*' and one(spark, C.match_query, "--") is None
    assert one(spark, C.tokens, "北京的美食攻略 Good food") == ["北京", "美食", "食攻", "good", "food"]
    assert one(spark, C.platform, "小红书") == one(spark, C.platform, "RedNote") == "xiaohongshu" and one(spark, C.platform, "nope") is None
    assert one(spark, C.clean_id, " 123.00 ") == "123" and one(spark, C.clean_id, "N/A") is None
    assert one(spark, C.hot_phrase, "【热】今天吃什么好呢?") == "热 今天吃什么好呢" and one(spark, C.hot_phrase, "abc def") is None
    tags = F.array(F.lit("a"), F.lit("#b"), F.lit("c"), F.lit("d"))
    assert one(spark, lambda c: C.angle_text(F.lit(" "), c, tags), "第一句!第二句") == "第一句! #a #b #c"
    said = one(spark, lambda c: C.semantic_text(F.lit("article"), F.lit("Title"), c, F.lit("left out"), F.array(F.lit("x"))), "ti tle")
    assert said == "Title\n#x"
    long = one(spark, lambda c: C.semantic_text(F.lit("video"), F.lit("T"), c, F.lit("more"), F.array(F.lit("x")), 64), "w" * 100)
    assert long == "T\n" + "w" * 59 + "…\n#x"
    assert one(spark, lambda c: C.data_block("d", c), "a【/DATA·d】b").count("【/DATA·d】") == 1


def test_evidence_keeps_to_its_budget(spark):
    rows = lambda n, size: spark.createDataFrame([(1, f"{k}" * size, (k,)) for k in range(n)], "topic_id long, line string, k struct<a: int>")
    got = {r.ref_id: r.kept for r in O.evidence({"burst": (rows(3, 10), 2), "pattern": (rows(4, 10), 4)}, 45).collect()}
    assert got == {"burst-1": True, "burst-2": True, "pattern-1": True, "pattern-2": True, "pattern-3": False, "pattern-4": False}
    assert all(r.kept for r in O.evidence({"burst": (rows(3, 10), 3)}, 30).collect())


def test_evidence_is_trimmed_in_stages(spark):
    rows = lambda n, size, topic=1: spark.createDataFrame([(topic, f"{k}" * size, (k,)) for k in range(n)], "topic_id long, line string, k struct<a: int>")
    parts = {"burst": (rows(3, 200), 5), "representative": (rows(4, 10), 5), "pattern": (rows(9, 10), 8), "angle": (rows(3, 10), 5)}
    sizes = lambda budget: {(r.kept, r.over): r.n for r in O.staged_evidence(parts, budget).groupBy("kept", "over").agg(F.sum(F.length("line")).alias("n")).collect()}
    assert sizes(750) == {(True, False): 750}  # eight of nine patterns at most
    assert sizes(393) == {(True, False): 393}  # excerpts of 81
    assert sizes(392) == {(True, False): 373, (False, False): 20}  # half the representatives
    said = {r.ref_id: (r.kept, r.trimmed) for r in O.staged_evidence(parts, 201).collect()}
    assert {k for k, v in said.items() if v[0]} == {"burst-1", "representative-1", *[f"pattern-{k}" for k in range(1, 9)], "angle-1", "angle-2", "angle-3"} and said["burst-2"] == (False, True) and said["angle-1"] == (True, False)
    assert sizes(100)[False, True] and {r.kept for r in O.staged_evidence(parts, 100).where("ref_id in ('burst-1', 'pattern-2', 'angle-1')").collect()} == {True}


def test_import_of_a_chain(spark):
    """Two rows that share an id, of which one shares its URL with a third, are one item; a stored id comes before a URL."""
    existing = spark.createDataFrame([(7, "p", "1", "u1"), (8, "p", "2", "u2")], "item_id long, platform string, content_id string, canonical string")
    rows = [(0, "p", "1", "u2", "t"), (1, "p", None, "u2", "t"), (2, "p", "9", "a", "t"), (3, "p", "9", "b", "t"), (4, "p", None, "b", "t"), (5, None, "1", "u1", "t"), (6, "p", "1", "u1", " "), (7, "q", None, None, "t")]
    inc = spark.createDataFrame(rows, "row_no long, platform string, content_id string, canonical string, title string").withColumn("text", F.lit(None).cast("string"))
    got = {r.row_no: (r.status, r.target, r.leader) for r in O.resolve_incoming(existing, inc).collect()}
    assert got == {0: ("merged", 7, None), 1: ("merged", 8, None), 2: ("new", None, 2), 3: ("duplicate", None, 2), 4: ("duplicate", None, 2), 5: ("invalid", None, None), 6: ("invalid", None, None), 7: ("new", None, 7)}


def test_stream_equals_batch(spark):
    from tidewell.plans import feeds
    from tidewell.streaming import jobs

    got = feeds.QUERIES["stream_lifecycle"](spark, SMALL)
    want = jobs.moods_of(spark.read.parquet(f"{SMALL}/events.parquet"))
    key = lambda r: r["user_id"]
    assert sorted((tuple(r) for r in got.select("user_id", "state", "changes", "last").collect())) == sorted(tuple(r) for r in want.collect())


def test_streams_over_many_unordered_files(spark, tmp_path):
    """70 files, two batches, the newest events first; the days reach back 140."""
    import os
    import random
    from collections import Counter, defaultdict

    import pyarrow as pa
    import pyarrow.parquet as pq

    from tidewell.plans import feeds

    rng, day0, rows = random.Random(1), dt.datetime(2024, 1, 1), []
    (tmp_path / "events.parquet").mkdir()
    for k in range(70):
        some = [{"event_id": 10 * k + j, "ts": day0 + dt.timedelta(days=2 * (69 - k), minutes=rng.randrange(2880)), "user_id": rng.randrange(5), "event_type": rng.choice(["view", "purchase", "error", "click"]), "value": float(j)} for j in range(10)]
        rows += some
        path = tmp_path / "events.parquet" / f"part-{k:03}.parquet"
        pq.write_table(pa.Table.from_pylist(some).cast(pa.schema([("event_id", "int64"), ("ts", pa.timestamp("us")), ("user_id", "int64"), ("event_type", "string"), ("value", "float64")])), path)
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    q = lambda name: [tuple(r) for r in feeds.QUERIES[name](spark, str(tmp_path)).collect()]
    days, since, kinds = Counter(r["ts"].date() for r in rows), Counter(), defaultdict(set)
    for r in rows:
        kinds[r["user_id"]].add(r["event_type"])
        since.update((r["ts"].date() - dt.timedelta(days=d), r["event_type"]) for d in range(7))
    assert {r[0]: r[1] for r in q("stream_day_buckets")} == days
    assert {r[:2]: r[2] for r in q("stream_sliding_windows")} == since
    assert sorted(q("stream_dedup")) == sorted((u, len(k)) for u, k in kinds.items())
    want = []
    for u in range(5):
        mood, pending, n, changes = None, None, 0, 0
        mine = sorted((r["ts"], r["event_id"], r["event_type"]) for r in rows if r["user_id"] == u)
        for _, _, kind in mine:
            new = {"purchase": "buying", "error": "troubled"}.get(kind, "looking")
            if mood is None or new == mood:
                mood, pending, n = new, None, 0
                continue
            n, pending = n + 1 if new == pending else 1, new
            if n == 2 or new == "troubled":
                mood, pending, n, changes = new, None, 0, changes + 1
        want.append((u, mood, changes, mine[-1][0]))
    assert sorted(q("stream_lifecycle")) == want


def test_a_stored_index_is_pruned(spark, tmp_path):
    from tidewell.operators import search as X

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(F.col("doc_id").alias("item_id"), "text")
    index = X.tokens(docs, ["text"])
    kept = X.store(index, str(tmp_path / "index"), 4)
    asked = lambda i: {r.item_id for r in X.matches(i, ["the", "license"]).collect()}
    assert asked(kept) == asked(index) != set() and kept.count() == index.count()
    assert "In(token" in X.phrase(kept, ["of", "the"])._jdf.queryExecution().toString().replace("PushedFilters: [", "")
    rank = lambda i: sorted((r.item_id, round(r.score, 9)) for r in X.bm25(i, ["license", "version"]).collect())
    assert rank(kept) == rank(index)


def test_plans_push_down(spark):
    df = spark.read.parquet(f"{SMALL}/events.parquet").where("user_id = 3").select("user_id", "value")
    plan = df._jdf.queryExecution().toString()
    assert "EqualTo(user_id,3)" in plan and "ReadSchema: struct<user_id:bigint,value:double>" in plan


def test_ages_count_fractions_of_a_second(spark):
    """Published within the second after the bound of an age class, an item is younger than the bound."""
    t = [dt.datetime(2024, 1, 1, 0, 0, 0, k) for k in (0, 1, 999_999)]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(t)], "k long, t timestamp")
    assert [r.age for r in rows.select("k", S.age_bucket(F.col("t"), NOW).alias("age")).orderBy("k").collect()] == ["30d+", "7-30d", "7-30d"]
    trend = rows.selectExpr("k AS topic_id", "40L AS members", "t AS since", "50.0D AS score", "5L AS recent_new", "0L AS baseline_new", "2L AS creators", "1L AS baseline_creators", "0.0D AS density")
    assert [r.state for r in S.lifecycle(trend, NOW).orderBy("topic_id").collect()] == ["evergreen", "evergreen", "evergreen"]
    age = lambda now: [r.state for r in S.lifecycle(trend.withColumn("score", F.lit(56.0)), now).orderBy("topic_id").collect()]
    assert age(NOW) == ["evergreen", "rising", "rising"]


def test_semantic_text_names_each_part_once(spark):
    """Parts are cleaned once a row, not at each of their uses, which nest and multiply."""
    df = spark.range(3).select(C.semantic_text(F.lit("video"), F.lit("Title"), F.concat(F.lit("t!!! "), F.col("id").cast("string")), F.lit("ti tle"), F.array(F.lit("#x")), 64).alias("said"))
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_replace(") < 60
    assert [r.said for r in df.orderBy("said").collect()] == [f"Title\nt! {k}\n#x" for k in range(3)]


def test_snippets_look_near_the_first_term_only(spark):
    """The same as the pattern over the whole text, which tries thirty places ahead of each."""
    terms, around = ["ab", "c"], 3
    rng = random.Random(5)
    texts = ["".join(rng.choice("aAbBCcxyz😀\n ") for _ in range(rng.randrange(30))).replace("c", rng.choice("cx")) for _ in range(300)]
    said = X.snippet("t", terms, around)
    rows = spark.createDataFrame(list(enumerate([*texts, None])), "k long, t string")
    plain = F.regexp_replace(F.regexp_extract("t", r"[^\n]{0,3}(?i:ab|c)[^\n]{0,3}", 0), "(?i)(ab|c)", "[$1]")
    assert rows.where(~said.eqNullSafe(plain)).count() == 0 and rows.where(plain != "").count() > 50
    assert "regexp_extract(substring(" in rows.select(said)._jdf.queryExecution().analyzed().toString()


def test_features_are_hashed_once_a_worker(monkeypatch):
    calls, plain = [], V._fnv
    monkeypatch.setattr(V, "_fnv", lambda text, start: calls.append(text) or plain(text, start))
    V._placed.cache_clear()
    assert V.hashed_vector("good food good", 16) == V.hashed_vector("Food good good", 16) and sum(abs(x) for x in V.hashed_vector("", 16)) == 0
    assert sorted(calls) == ["w:food", "w:food", "w:good", "w:good"]
