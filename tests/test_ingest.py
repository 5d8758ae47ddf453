"""Imports as a whole: four outputs that agree, failed runs, odd records."""

import json

import pytest

from tidewell.operators.ingest import Imports

SCHEMA = "row_no long, platform string, content_id string, canonical string, title string, text string, content_type string, views long, likes long"


def batch(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA)


def of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_two_batches(spark, tmp_path):
    imports = Imports(spark, str(tmp_path / "i"), ["views", "likes"], buckets=2)
    assert imports.items().count() == imports.raw().count() == imports.batches().count() == 0
    one = batch(
        spark,
        (1, "p", "a", None, None, "text", "unknown", 5, None),
        (2, "p", "a", "u1", "title", "other", "video", None, 7),  # the same item: fills the title and the URL
        (3, "p", None, None, None, " ", None, 1, 1),  # bad
        (4, "q", "a", "u2", "t", None, None, None, None),
        (5, "p", "a", "u1", "t", "x", "article", None, 7),  # repeats the metrics of row 2
    )
    assert imports.run(one) == 0
    assert of(imports.items(), "item_id", "title", "text", "canonical", "content_type", "views", "likes") == [(0, "title", "text", "u1", "video", 5, 7), (1, "t", None, "u2", "unknown", None, None)]
    assert of(imports.snapshots(), "row_no", "item_id", "views", "likes") == [(1, 0, 5, None), (2, 0, None, 7), (4, 1, None, None)]
    assert of(imports.merges(), "row_no", "item_id", "kind", "filled") == [(2, 0, "duplicate", "canonical,title"), (5, 0, "duplicate", "")]
    bad = imports.raw().where("status = 'invalid'").collect()
    assert [(r.row_no, r.note, r.item_id) for r in bad] == [(3, "no title and no text", None)] and json.loads(bad[0].payload)["views"] == 1
    two = batch(spark, (1, "q", "a", None, "new title", "body", "article", 0, None), (2, "r", None, "u9", "t9", None, None, None, None))
    assert imports.run(two) == 1
    assert of(imports.items(), "item_id", "title", "text", "content_type", "views", "first_batch", "last_batch") == [(0, "title", "text", "video", 5, 0, 0), (1, "t", "body", "article", 0, 0, 1), (2, "t9", None, "unknown", None, 1, 1)]
    assert of(imports.merges().where("batch = 1"), "row_no", "item_id", "kind", "filled") == [(1, 1, "merged", "text")]
    assert of(imports.batches(), "batch", "rows", "failed", "fresh", "merged", "status") == [(0, 5, 1, 2, 2, "partial"), (1, 2, 0, 1, 1, "completed")]


def test_a_failed_run_leaves_nothing(spark, tmp_path, monkeypatch):
    imports = Imports(spark, str(tmp_path / "i"), ["views", "likes"], buckets=2)
    good = batch(spark, (1, "p", "a", None, "t", None, None, 1, 1))
    imports.run(good)
    state = lambda: (of(imports.items(), "*"), of(imports.raw(), "*"), of(imports.snapshots(), "*"), of(imports.merges(), "*"), of(imports.batches(), "*"))
    before = state()
    more = batch(spark, (1, "p", "a", None, None, "late", None, 9, None), (2, "z", "z", None, "z", None, None, None, None))
    for step in ("_commit", "_write"):
        with monkeypatch.context() as m:
            m.setattr(Imports, step, lambda *a: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError):
                imports.run(more)
        assert state() == before
    assert imports.run(batch(spark, (1, "y", "y", None, "y", None, None, None, None))) == 1  # another batch takes the number
    assert of(imports.items(), "item_id", "platform", "text") == [(0, "p", None), (1, "y", None)]
    assert imports.run(more) == 2 and of(imports.items(), "item_id", "platform", "text", "views") == [(0, "p", "late", 9), (1, "y", None, None), (2, "z", None, None)]
    none = batch(spark, (1, None, None, None, None, None, None, None, None))
    assert imports.run(none) == 3 and [r.status for r in imports.batches().where("batch = 3").collect()] == ["failed"] and imports.items().count() == 3
