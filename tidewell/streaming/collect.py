"""Collection runs: pages pass a schema gate in the stream, bad ones go to quarantine and stop it, and a ledger says how
each run ended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_RUNS = "run int, status string, code string, pages int, rows long"


class Drift(Exception):
    pass


class Cancelled(Exception):
    pass


class Collection:
    """place: a shared folder. A page is a micro-batch; it is taken if at least `least` of its rows are valid."""

    def __init__(self, spark: SparkSession, place: str, valid: Column, least: float = 0.5):
        self.spark, self.place, self.valid, self.least = spark, place, F.coalesce(valid, F.lit(False)), least

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).option("basePath", f"{self.place}/{name}").parquet(f"{self.place}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def runs(self) -> DataFrame:
        return self._read("runs", _RUNS).select("run", "status", "code", "pages", "rows")

    def taken(self, schema: str) -> DataFrame:
        """The rows of all pages taken, with the number of their page."""
        return self._read("rows", f"{schema}, page int")

    def quarantined(self, schema: str) -> DataFrame:
        """The rows of pages that were refused, bad and good ones, with _valid; a page that passes later leaves it."""
        return self._read("quarantine", f"{schema}, _valid boolean, page int").join(self._read("rows", "page int").distinct(), "page", "left_anti")

    def run(self, rows: DataFrame, cancelled: Callable[[], bool] = lambda: False, load: Callable[[DataFrame], DataFrame] = lambda come: come) -> str:
        """Reads the stream on from where the last run stopped; returns and stores the run's status: completed, partial (a
        page was refused after some were taken), failed (before any was), or cancelled. A refused page is not passed: its
        offset stays, and the next run begins with it. Columns page and _valid must not occur in rows. load gives the rows of
        what came, if the stream only announces pages: a page may then lie in many files, read by as many tasks."""
        seen = {"pages": 0, "rows": 0}

        def take(batch: DataFrame, number: int) -> None:
            if cancelled():
                raise Cancelled()
            batch = load(batch)
            told = batch.agg(F.count(F.lit(1)).alias("n"), F.count_if(self.valid).alias("ok")).first()
            if told["n"] and told["ok"] < self.least * told["n"]:
                batch.withColumn("_valid", self.valid).write.mode("overwrite").parquet(f"{self.place}/quarantine/page={number}")
                raise Drift(f"{told['n'] - told['ok']} of {told['n']} rows don't fit their schema")
            if told["n"]:
                batch.write.mode("overwrite").parquet(f"{self.place}/rows/page={number}")
                seen["pages"] += 1
                seen["rows"] += told["n"]

        status, code = "completed", None
        try:
            rows.writeStream.foreachBatch(take).option("checkpointLocation", f"{self.place}/progress").trigger(availableNow=True).start().awaitTermination()
        except StreamingQueryException as e:
            if "collect.Cancelled" in str(e):
                status, code = "cancelled", "CANCELLED"
            elif "collect.Drift" in str(e):
                status, code = "partial" if seen["pages"] else "failed", "SCHEMA_DRIFT"
            else:
                raise
        number = (self.runs().agg(F.max("run")).first()[0] or 0) + 1
        row = [(number, status, code, seen["pages"], seen["rows"])]
        self.spark.createDataFrame(row, _RUNS).coalesce(1).write.mode("overwrite").parquet(f"{self.place}/runs/r={number}")
        return status
