"""Structured Streaming versions of the batch queries; over the same rows they give the same results.

Each runs with availableNow over what is there and keeps its progress in a checkpoint folder, so a restart goes on
where it stopped. Results of update mode are appended with their batch number, and the newest row of a key counts.
Files may come in any order: without a watermark, the default, no row is late. An endless stream gives one (`late`) to
bound its state, and rows later than that are then left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewell.operators.graph import checkpoint_dir
from tidewell.operators.silver import latest_by
from tidewell.profiles import LIFECYCLE
from tidewell.streaming.state import ordered, rocks
from tidewell.streaming.store import Store


def stream(spark: SparkSession, path: str, files_a_batch: int = 64) -> DataFrame:
    """A Parquet file or folder as a stream; its last character as a pattern lets a single file pass, too."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(f"{path[:-1]}[{path[-1]}]")


def landed(df: DataFrame, mode: str = "append", place: str | None = None) -> DataFrame:
    """All rows that a streaming frame has given, with the number of their batch (_batch). With `place`, a shared folder,
    a later call goes on where this one stopped, and gives what it found, too."""
    spark = df.sparkSession
    place = place or f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{place}/rows/_b={number}")  # the same batch again replaces itself

    df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{place}/progress").trigger(availableNow=True).start().awaitTermination()
    return _stored(spark, f"{place}/rows", df.select("*", F.lit(0).alias("_batch")).schema).drop("_b")


def _stored(spark: SparkSession, place: str, schema: StructType) -> DataFrame:
    """What is stored in a folder; no rows if nothing was ever written."""
    try:
        return spark.read.option("basePath", place).parquet(place)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def run_to_end(df: DataFrame, keys: list[str], mode: str = "update", place: str | None = None) -> DataFrame:
    """All that a streaming frame has to say now: the last row of each key."""
    return latest_by(landed(df, mode, place), keys, ["_batch"]).drop("_batch")


def _timed(events: DataFrame, late: str | None) -> DataFrame:
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", late) if late else rows


def day_buckets(events: DataFrame, late: str | None = None) -> DataFrame:
    """Per day: events and values."""
    g = _timed(events, late).groupBy(F.window(F.col("ts"), "1 day"))
    return g.agg(F.count(F.lit(1)).alias("events"), F.sum(F.floor(F.col("value") * 100 + 0.5).cast("long")).alias("total")).select(F.to_date("window.start").alias("day"), "events", "total")


def sliding(events: DataFrame, size: str = "7 days", step: str = "1 day", late: str | None = None) -> DataFrame:
    g = _timed(events, late).groupBy(F.window("ts", size, step), "event_type")
    return g.agg(F.count(F.lit(1)).alias("events")).select(F.to_date("window.start").alias("since"), "event_type", "events")


def once(events: DataFrame, keys: list[str], late: str | None = None) -> DataFrame:
    """The stream without rows that repeat keys; with a watermark, that repeat them within it."""
    rows = _timed(events, late)
    return rows.dropDuplicatesWithinWatermark(keys) if late else rows.dropDuplicates(keys)


STATE = "user_id long, state string, changes int, last timestamp"
_MOODS = {"purchase": "buying", "signup": "buying", "error": "troubled"}


def _advance(state: tuple, kind: str | None) -> tuple:
    """(mood, pending, confirmations, changes): a new mood counts from its second event in a row, errors at once."""
    mood, pending, n, changes = state
    want = _MOODS.get(kind, "looking")
    if mood is None or want == mood:
        return want, None, 0, changes
    n = n + 1 if want == pending else 1
    if n >= 2 or want == "troubled":
        return want, None, 0, changes + 1
    return mood, want, n, changes


def moods_of(events: DataFrame) -> DataFrame:
    """The batch form: each user's mood after all events, with hysteresis. A task goes over its users' events in the
    order of time and holds one Arrow batch, however many events a user has. Events without a user or time are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, state, last = None, (None, None, 0, 0), None
        said = lambda: (user, state[0], state[3], last)
        for pdf in batches:
            done = []
            for key, rows in pdf.groupby("user_id", sort=False):
                if key != user:
                    if user is not None:
                        done.append(said())
                    user, state, last = key, (None, None, 0, 0), None
                for kind in rows["event_type"]:
                    state = _advance(state, kind)
                new = rows["ts"].max()
                last = new if last is None or pd.isna(last) else last if pd.isna(new) else max(last, new)
            if done:
                yield pd.DataFrame(done, columns=["user_id", "state", "changes", "last"])
        if user is not None:
            yield pd.DataFrame([said()], columns=["user_id", "state", "changes", "last"])

    rows = events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type").where("user_id is not null and ts is not null")
    rows = rows.repartition("user_id").sortWithinPartitions("user_id", "ts", F.asc_nulls_last("event_id"))
    return rows.select("user_id", "ts", "event_type").mapInPandas(run, STATE)


def _fold_mood(state: tuple, row: tuple) -> tuple:
    return *_advance(state[:4], row[2]), row[0]


def moods(events: DataFrame, late: str, place: str | None = None) -> DataFrame:
    """The streaming form: each user's state stays between batches (see tidewell.streaming.state), and what users say is
    upserted batch by batch. `late` is the watermark's delay. With `place`, a shared folder, a later call goes on where
    this one stopped."""
    say = lambda s: (s[0], s[3], pd.Timestamp(s[4], unit="us"))
    told = ordered(events, "user_id", "ts", "event_id", {"event_type": "string"}, _fold_mood, (None, None, 0, 0, 0), "mood string, pending string, n int, changes int, last long", say, STATE, late)
    with rocks(events.sparkSession):
        return upsert_stream(told, ["user_id"], ["last", "changes"], place, mode="update", arrival=True)


def settled_stream(states: DataFrame, late: str, place: str | None = None) -> DataFrame:
    """The lifecycle of each topic after a stream of runs (topic_id, run_at, run_id, state, score), as settle folds them
    run by run in batch: a new state is current once it is seen in two runs in a row, or at once if the score jumps."""
    told = ordered(states, "topic_id", "run_at", "run_id", {"state": "string", "score": "double"}, _fold_run, (None, None, 0, None, 0, 0), "state string, pending string, confirmations int, score double, changes int, last long", lambda s: s, "topic_id long, state string, pending string, confirmations int, score double, changes int, last long", late)
    with rocks(states.sparkSession):
        return upsert_stream(told, ["topic_id"], ["last"], place, mode="update", arrival=True)


def _fold_run(now: tuple, row: tuple) -> tuple:
    was, pending, n, held, changes, _ = now
    at, _, state, score = row
    if state == "unknown":
        return was or state, None, 0, held, changes, at
    if was is None or was == "unknown" or state == was:
        return state, None, 0, score, changes, at
    n = n + 1 if state == pending else 1
    jump = score is not None and held is not None and abs(score - held) >= LIFECYCLE["strong_jump"]
    if jump or n >= LIFECYCLE["confirmations"]:
        return state, None, 0, score, changes + 1, at
    return was, state, n, score, changes, at


def upsert_stream(rows: DataFrame, keys: list[str], order: list[str], place: str | None = None, mode: str = "append", arrival: bool = False, buckets: int = 16) -> DataFrame:
    """The current table of a stream of versions, the newest row of each key, in a Store: a batch writes about what it
    brings. With `arrival` a row of a later batch is newer than one of an earlier, whatever `order` says.

    With `place`, a shared folder, a later call goes on where this one stopped; a batch that is repeated gives the same.
    A stream without rows gives an empty table.
    """
    spark = rows.sparkSession
    place = place or f"{checkpoint_dir(spark)}/current-{uuid.uuid4().hex}"
    store = stored(rows, keys, order, place, arrival, buckets)

    def fold(batch: DataFrame, number: int) -> None:
        store.upsert(batch.withColumn("_batch", F.lit(number)) if arrival else batch, number)

    rows.writeStream.outputMode(mode).foreachBatch(fold).option("checkpointLocation", f"{place}/progress").trigger(availableNow=True).start().awaitTermination()
    return store.current().drop("_batch")


def stored(rows: DataFrame, keys: list[str], order: list[str], place: str, arrival: bool = False, buckets: int = 16) -> Store:
    """The store that upsert_stream keeps for such rows in `place`."""
    schema = rows.select("*", F.lit(0).alias("_batch")).schema if arrival else rows.schema
    return Store(rows.sparkSession, f"{place}/store", keys, ["_batch"] * arrival + order, schema, buckets)


def refresh_after(rows: DataFrame, refresh: Callable[[DataFrame, DataFrame], None], place: str, keys: list[str], order: list[str], buckets: int = 16) -> None:
    """Upserts a stream's rows into a Store in `place` and calls refresh(batch, touched) once after each batch that
    brought any: its rows, and the current rows of the buckets it touched, which are all that can have changed.

    One query runs its batches one after the other, so refreshes never overlap or queue; a repeated batch refreshes again.
    """
    store = stored(rows, keys, order, place, buckets=buckets)

    def accept(batch: DataFrame, number: int) -> None:
        if touched := store.upsert(batch, number):
            refresh(batch, store.current(touched))

    rows.writeStream.foreachBatch(accept).option("checkpointLocation", f"{place}/progress").trigger(availableNow=True).start().awaitTermination()
