"""Runs at several clocks derive items and snapshots from the events once."""

import datetime as dt

from tests.conftest import SMALL
from tidewell.plans import scores


def test_runs_share_what_events_give(spark, monkeypatch):
    asked, made = [], scores.event_snapshots
    monkeypatch.setattr(scores, "event_snapshots", lambda *a: asked.append(a) or made(*a))
    monkeypatch.setattr(scores.S, "burst", lambda items, snapshots, *a: (items, snapshots))
    monkeypatch.setattr(scores.S, "topic_trend", lambda items, snapshots, *a: snapshots.groupBy().agg({"captured_at": "max"}).selectExpr("1L AS topic_id", "1D AS score", "`max(captured_at)` AS last"))
    monkeypatch.setattr(scores.S, "lifecycle", lambda trend, *a: trend.withColumnRenamed("last", "state"))
    clocks = (dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 20))
    last = [r.first()["state"] for r in scores.runs(spark, SMALL, clocks)]
    assert len(asked) == 1
    assert last[0] <= clocks[0] < last[1] <= clocks[1]  # each run knows what its clock allows
