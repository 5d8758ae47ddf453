"""The stored index against tokens made anew: updates, tombstones, merges, repeats and what an update writes."""

import os
import random

from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidewell.operators import search as X
from tidewell.operators.index import Index

DOCS = "item_id long, title string, text string"
WORDS = "the old license of a new version under apache or mit with secret tea".split()


def rows_of(df):
    return sorted(tuple(r) for r in df.select("item_id", "field", "pos", "token").collect())


def fresh(spark, docs):
    return rows_of(X.tokens(spark.createDataFrame([(k, *v) for k, v in docs.items()], DOCS), ["title", "text"]))


def test_updates_equal_a_rebuild(spark, tmp_path):
    """Random updates, removals and returns, with merges of segments in between; the searches, too."""
    rng, docs = random.Random(3), {}
    index = Index(spark, str(tmp_path / "i"), ["title", "text"], most=3, buckets=2)
    made = lambda: (rng.choice([None, "", "Apache License"]), " ".join(rng.choices(WORDS, k=rng.randint(0, 8))))
    merged = False
    for n in range(7):
        batch = {k: made() for k in rng.sample(range(12), 5)}
        lost = [k for k in rng.sample(range(12), 3) if k not in batch]
        docs = {k: v for k, v in (docs | batch).items() if k not in lost}
        given = [(k, *v) for k, v in batch.items()]
        index.update(spark.createDataFrame(given + [(None, "x", "y"), given[0]], DOCS), n, spark.createDataFrame([(k,) for k in lost + [99]], "item_id long"))
        if n == 4:  # the same update again
            index.update(spark.createDataFrame(given, DOCS), n, spark.createDataFrame([(k,) for k in lost], "item_id long"))
        assert rows_of(index.postings()) == fresh(spark, docs)
        segments, _ = index._manifest(1 << 30)
        merged |= any(s % 2 for s in segments)
        assert len(segments) <= 3 + 1 and not index.off(len(docs)) and index.off(len(docs) + 1)
    assert merged
    sizes = {r.item_id: r["size"] for r in index.sizes().collect()}
    want = fresh(spark, docs)
    assert sizes == {k: sum(r[0] == k for r in want) for k in docs}
    plain = X.tokens(spark.createDataFrame([(k, *v) for k, v in docs.items()], DOCS), ["title", "text"])
    rank = lambda df: sorted((r.item_id, round(r.score, 9)) for r in df.collect())
    assert rank(X.bm25(index.postings(), ["license", "tea"], sizes=index.sizes())) == rank(X.bm25(plain, ["license", "tea"]))


def test_an_update_writes_one_segment(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(F.col("doc_id").alias("item_id"), "text")
    place = str(tmp_path / "i")
    index = Index(spark, place, ["text"])
    index.update(docs, 0)
    files = lambda: {os.path.join(d, x): os.path.getmtime(os.path.join(d, x)) for d, _, names in os.walk(f"{place}/postings") for x in names if x.endswith(".parquet")}
    before = files()
    one = docs.where("item_id = 7").select("item_id", F.lit("entirely different words").alias("text"))
    index.update(one.union(docs.where("item_id = 8")), 1)  # item 8 has not changed
    new = set(files()) - set(before)
    assert {k: v for k, v in files().items() if k in before} == before and all("/postings/2/" in f for f in new)
    assert sum(os.path.getsize(f) for f in new) < sum(os.path.getsize(f) for f in before) / 10
    assert [r.item_id for r in X.matches(index.postings(), ["entirely", "different"]).collect()] == [7]
    assert index.postings().where("item_id = 7").count() == 3 and index.postings().where("item_id = 8").count() > 3
    plan = index.postings().where("token = 'license'")._jdf.queryExecution().toString()
    assert "EqualTo(token,license)" in plan


def test_sync_makes_the_index_fit(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"), ["title", "text"])
    index.update(spark.createDataFrame([(1, "a", "b"), (2, "c", "d"), (3, None, None)], DOCS), 0)
    assert not index.off(3)  # an item without tokens counts
    now = {2: ("c", "d e"), 4: ("f", None)}
    assert index.off(2)
    index.sync(spark.createDataFrame([(k, *v) for k, v in now.items()], DOCS), 1)
    assert rows_of(index.postings()) == fresh(spark, now) and not index.off(2)


def test_best_snippets(spark):
    filler = " ".join(f"w{k}" for k in range(30))
    docs = [(1, None, f"Secret, {filler} the License - v2 VERSION! {filler}"), (2, None, "license"), (3, None, filler), (4, None, f"{filler} secret {filler} secret license license"), (5, None, None)]
    df = spark.createDataFrame(docs, DOCS)
    got = {r.item_id: (r.start, r.hits, r.snippet) for r in X.best_snippets(X.tokens(df, ["text"]), df, ["secret", "license", "version"], "text", 5).collect()}
    assert got == {1: (32, 2, "…[License] v2 [VERSION] w0 w1…"), 2: (0, 1, "[license]"), 4: (61, 2, "…[secret] [license] [license]")}


def test_postings_stay_with_their_items(spark, tmp_path):
    """No posting is shuffled by token: an item's postings are in one file of a segment, in the order of tokens."""
    rows = [(k, " ".join(f"w{(k * 7 + j) % 50}" for j in range(30))) for k in range(200)]
    index = Index(spark, str(tmp_path / "index"), ["text"])
    index.update(spark.createDataFrame(rows, "item_id long, text string"), 0)
    files = index.postings().selectExpr("item_id", "input_file_name() AS f").distinct()
    assert files.count() == 200
    assert index.postings().count() == 6000


def test_no_task_sorts_more_than_it_should(spark, tmp_path):
    """A file holds what one task sorted; items that come twice count once, their larger row."""
    rng = random.Random(5)
    docs = {k: (None, " ".join(rng.choices(WORDS, k=40))) for k in range(60)}
    index = Index(spark, str(tmp_path / "i"), ["title", "text"], each=200)
    twice = [(k, None, "a") for k in range(5)]
    index.update(spark.createDataFrame([(k, *v) for k, v in docs.items()] + twice, DOCS).coalesce(1), 0)
    assert rows_of(index.postings()) == fresh(spark, docs)
    files = spark.read.parquet(str(tmp_path / "i" / "postings" / "0")).groupBy(F.input_file_name()).count().collect()
    assert len(files) > 6 and max(r["count"] for r in files) < 800
    texts = spark.read.parquet(str(tmp_path / "i" / "changed" / "0")).columns
    assert not {"title", "text"} & set(texts)  # what is joined with the registry holds no texts
