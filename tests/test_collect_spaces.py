"""The gate in the stream, runs and their ledger; vectors by space and version."""

import pytest
from pyspark.sql import functions as F

from tests.test_streams import files
from tidewell.operators.spaces import Spaces, space_id
from tidewell.streaming import jobs
from tidewell.streaming.collect import Collection

SCHEMA = "k long, text string"


def test_a_bad_page_stops_the_stream(spark, tmp_path):
    src = str(tmp_path / "in.parquet")
    good, bad, half = [(1, "a"), (2, "b"), (3, None)], [(4, None), (5, None), (6, "c")], [(7, None), (8, "d")]
    run = lambda c, **how: c.run(jobs.stream(spark, src, 1), **how)
    c = Collection(spark, str(tmp_path / "c"), F.col("text").isNotNull())
    files(spark, src, good, half, bad, good, schema=SCHEMA)
    assert run(c) == "partial"
    ids = lambda df: sorted(r.k for r in df.collect())
    assert ids(c.taken(SCHEMA)) == [1, 2, 3, 7, 8]
    assert sorted((r.k, r._valid) for r in c.quarantined(SCHEMA).collect()) == [(4, False), (5, False), (6, True)]
    assert run(c) == "failed" and ids(c.taken(SCHEMA)) == [1, 2, 3, 7, 8]  # the same page again
    assert run(c, cancelled=lambda: True) == "cancelled"
    c.valid = F.lit(True)  # the schema was mended
    assert run(c) == "completed"
    assert ids(c.taken(SCHEMA)) == [1, 1, 2, 2, 3, 3, 4, 5, 6, 7, 8] and c.quarantined(SCHEMA).count() == 0
    assert [tuple(r) for r in c.runs().orderBy("run").collect()] == [(1, "partial", "SCHEMA_DRIFT", 2, 5), (2, "failed", "SCHEMA_DRIFT", 0, 0), (3, "cancelled", "CANCELLED", 0, 0), (4, "completed", None, 2, 6)]


def test_versions_come_back_to_life(spark, tmp_path):
    s = Spaces(spark, str(tmp_path / "s"), buckets=2)
    rows = lambda *r: spark.createDataFrame(r, "item_id long, text_hash string, v array<double>")
    probe = rows((1, "x", None), (2, "x", [1.0, 2.0]))
    a = s.ensure("local", "lexical", "v1", sample=probe)
    assert a == "local:lexical:2:v1" == s.ensure("local", "lexical", "v1", dimension=2) and s.active() is None
    b = s.ensure("remote", "m", "v1", dimension=2)
    for at in (a, b, a):
        s.activate(at)
        assert s.active() == at
    with pytest.raises(ValueError):
        s.ensure("local", "other", "v1", sample=probe.limit(1))
    with pytest.raises(ValueError):
        space_id("a:b", "m", 2, "v1")
    s.write(a, rows((1, "h1", [1.0, 0.0]), (2, "h1", [0.0, 1.0])), 10)
    s.write(b, rows((1, "h1", [5.0, 5.0])), 11)
    s.write(a, rows((1, "h2", [2.0, 0.0]), (3, "h9", [3.0, 3.0]), (None, "h", [1.0, 1.0])), 20)
    for bad in (rows((4, "h", [1.0])), rows((4, "h", None))):
        with pytest.raises(ValueError):
            s.write(a, bad, 25)
    s.write(a, rows((1, "h1", [9.0, 0.0]), (2, "h1", [0.0, 1.0])), 30)  # the first text again
    got = sorted((r.space_id, r.item_id, r.text_hash, r.v[0], r.created_at, r.updated_at, r.superseded_at) for r in s.all().collect())
    assert got == [
        (a, 1, "h1", 9.0, 10, 30, None),
        (a, 1, "h2", 2.0, 20, 20, 30),
        (a, 2, "h1", 0.0, 10, 30, None),
        (a, 3, "h9", 3.0, 20, 20, None),
        (b, 1, "h1", 5.0, 11, 11, None),
    ]
    asked = rows((1, "h1", None), (1, "h2", None), (3, "h8", None), (8, "h", None)).select("item_id", "text_hash")
    assert sorted(map(tuple, s.missing(a, asked).collect())) == [(1, "h2"), (3, "h8"), (8, "h")]
    assert Spaces(spark, str(tmp_path / "s"), buckets=2).active() == a  # another session reads the same


def test_an_announced_page_lies_in_many_files(spark, tmp_path):
    """The stream brings a page's number; its rows are read from as many files as tasks have written, and pass as one page."""
    src, stored = str(tmp_path / "come.parquet"), str(tmp_path / "stored")
    spark.range(0, 40, 1, 4).selectExpr("id % 4 AS k", "CASE WHEN id % 4 < 2 THEN 'x' END AS text").write.partitionBy("k").parquet(stored)
    files(spark, src, [(0,)], [(3,)], [(1,)], schema="k long")
    rows = spark.read.schema("text string, k long").parquet(stored)
    c = Collection(spark, str(tmp_path / "c"), F.col("text").isNotNull())
    assert c.run(jobs.stream(spark, src, 1), load=lambda come: rows.where(F.col("k").isin([r.k for r in come.collect()]))) == "partial"
    assert rows.where("k = 0").select(F.input_file_name()).distinct().count() == 4
    assert sorted((r.k, r.page, r["count"]) for r in c.taken(SCHEMA).groupBy("k", "page").count().collect()) == [(0, 0, 10)]
    assert c.quarantined(SCHEMA).where("k = 3 and not _valid").count() == 10
