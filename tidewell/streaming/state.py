"""State per key that is kept between batches: rows are folded in the order of their time, however they arrive.

A key holds what is settled, up to the watermark, and the rows after it, which later ones may still precede. What it
says after each batch is the settled state with the waiting rows folded on top, so it is right about all rows so far;
a timer settles the waiting rows of keys that get no more. A stream that is started again with the same folder goes on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OrderedFold(StatefulProcessor):
    """fold(state, row) over a key's rows (time in microseconds, order, value), by time, then order; say(state) is what
    the key gives, after the key itself. States and values are tuples of state_schema and value_schema; empty is the first.
    """

    def __init__(self, fold: Callable, empty: tuple, state_schema: str, value_schema: str, say: Callable, columns: list[str]):
        self.fold, self.empty, self.say, self.columns = fold, empty, say, columns
        self.state_schema, self.value_schema = state_schema, value_schema
        self.width = 3 + value_schema.count(",")  # time, order and values are a row's last columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", self.state_schema)
        self.waiting = handle.getListState("waiting", f"_t long, _o long, {self.value_schema}")

    def _settle(self, rows: list[tuple], until: int | None, new: list[tuple]) -> tuple[tuple, list[tuple]]:
        """The state with the rows up to `until` (milliseconds) folded in, and the rows that wait; new ones are stored."""
        state = tuple(self.settled.get()) if self.settled.exists() else self.empty
        at = 0
        while until is not None and at < len(rows) and rows[at][0] // 1000 <= until:
            state, at = self.fold(state, rows[at]), at + 1
        if at:
            self.settled.update(state)
            self.waiting.clear()
            if rows[at:]:
                self.waiting.put(rows[at:])
        elif new:
            self.waiting.appendList(new)
        return state, rows[at:]

    def _rows(self, new: list[tuple] = []) -> list[tuple]:
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        return sorted(rows + new, key=lambda r: (r[0], r[1] is None, r[1] or 0))

    def _timer(self, rows: list[tuple]) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if rows:
            self.handle.registerTimer(rows[-1][0] // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [tuple(None if pd.isna(x) else x for x in r) for pdf in rows for r in pdf.iloc[:, -self.width :].astype(object).itertuples(index=False, name=None)]
        now = timerValues.getCurrentWatermarkInMs()
        state, waiting = self._settle(self._rows(new), now if now and now > 0 else None, new)
        if now is not None and now >= 0:
            self._timer(waiting)
        for r in waiting:
            state = self.fold(state, r)
        yield pd.DataFrame([(*key, *self.say(state))], columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._settle(self._rows(), timerValues.getCurrentWatermarkInMs(), [])
        return iter(())

    def close(self) -> None:
        pass


def ordered(rows: DataFrame, key: str, time: str, order: str, values: dict[str, str], fold: Callable, empty: tuple, state_schema: str, say: Callable, out_schema: str, late: str) -> DataFrame:
    """The frame, streaming, of what each key says after every batch that brings it rows (mode update).

    values: the columns that fold sees after time and order, with their types. late bounds the state: a row that comes
    later than that after a newer one is left out, and so is one without a key or time. Start it within `rocks`.
    """
    cols = [F.col(c).cast(t).alias(f"_v_{c}") for c, t in values.items()]
    timed = rows.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late)
    timed = timed.select(key, "_at", F.unix_micros("_at").alias("_t"), F.col(order).cast("long").alias("_o"), *cols)
    names = [f.split()[0] for f in out_schema.split(", ")]
    made = OrderedFold(fold, empty, state_schema, ", ".join(f"_v_{c} {t}" for c, t in values.items()), say, names)
    return timed.groupBy(key).transformWithStateInPandas(made, out_schema, "Update", "EventTime")


@contextmanager
def rocks(spark: SparkSession):
    """Queries started within keep their state in RocksDB, on disk, with its changes in the checkpoint folder."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def lateness(spark: SparkSession, path: str, time: str = "ts") -> str:
    """How far a stored table's files go back behind those streamed before them, as a watermark's delay: with it no row
    of the table is late, in whatever order its files lie. Files are streamed by their time of change; those of one time
    in any order. One row a file is compared."""
    files = spark.read.parquet(path).select(F.unix_micros(F.col(time).cast("timestamp")).alias("t"), F.unix_millis("_metadata.file_modification_time").alias("m"), F.col("_metadata.file_path").alias("p"))
    each = files.groupBy("m", "p").agg(F.min("t").alias("first"), F.max("t").alias("last")).groupBy("m").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count(F.lit(1)).alias("n"))
    before = F.max("last").over(Window.orderBy("m").rowsBetween(Window.unboundedPreceding, -1))
    back = F.greatest(before, F.when(F.col("n") > 1, F.col("last"))) - F.col("first")
    most = each.select(back.alias("back")).agg(F.max("back")).first()[0]
    return f"{max(0, most or 0) // 1_000_000 + 1} seconds"
