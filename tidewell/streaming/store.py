"""A table kept current by upserts on plain Parquet: batches are appended by key bucket and merged when they are read.

A batch writes its own newest rows, one folder a bucket, and then a manifest that says which folders are live; a bucket
with several of them is rewritten as one. So what a batch writes grows with the batch, a reader sees whole batches only,
and a batch that is repeated writes the same folders again. Everything goes through Spark, so any store will do.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewell.operators.silver import latest_by

_MANIFEST = "version int, bucket int, folder int"


class Store:
    """place: a shared folder; keys name a row; the row that is largest by `order` is the current one (a later batch wins
    at a tie only if it is larger by its other columns, so that the order of batches doesn't matter). removed: a column
    that is true where the key is gone."""

    def __init__(self, spark: SparkSession, place: str, keys: list[str], order: list[str], schema: StructType, buckets: int = 16, most: int = 4, removed: str | None = None):
        self.spark, self.place, self.keys, self.order, self.schema = spark, place, keys, order, schema
        self.buckets, self.most, self.removed = buckets, most, removed

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def live(self, before: int = 1 << 30) -> dict[int, list[int]]:
        """The live folders of each bucket by the last manifest below `before`: at most buckets x (most + 1) rows."""
        try:
            rows = self.spark.read.schema(_MANIFEST).json(f"{self.place}/manifest").where(F.col("version") < before)
            last = rows.agg(F.max("version")).first()[0]
            found = rows.where(F.col("version") == last).collect() if last is not None else []
        except AnalysisException:
            found = []
        out: dict[int, list[int]] = {}
        for r in sorted(found, key=lambda r: r["folder"]):
            if r["bucket"] >= 0:
                out.setdefault(r["bucket"], []).append(r["folder"])
        return out

    def _read(self, live: dict[int, list[int]]) -> DataFrame:
        paths = [f"{self.place}/rows/v={v}/b={b}" for b, vs in live.items() for v in vs]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in self.schema.names if c not in self.keys]
        return latest_by(rows, self.keys, [*self.order, *[c for c in rest if c not in self.order]]).select(*self.schema.names)

    def _put(self, rows: DataFrame, version: int) -> None:
        rows.withColumn("b", self.bucket()).repartition("b").write.mode("overwrite").partitionBy("b").parquet(f"{self.place}/rows/v={version}")

    def upsert(self, batch: DataFrame, number: int) -> list[int]:
        """Batch `number` (from 0, rising) folded in; the buckets that it touched. Versions 2n are batches, 2n + 1 what
        was merged after them. A batch without rows leaves no trace."""
        version, live = 2 * number, self.live(2 * number)
        self._put(self._newest(batch.select(*self.schema.names)), version)
        try:
            wrote = self.spark.read.schema("b int").parquet(f"{self.place}/rows/v={version}")
            touched = sorted(r["b"] for r in wrote.select("b").distinct().collect())  # buckets at most
        except AnalysisException:
            touched = []
        if not touched:
            return []
        for b in touched:
            live.setdefault(b, []).append(version)
        full = {b: live[b] for b in touched if len(live[b]) > self.most}
        if full:
            self._put(self._newest(self._read(full)), version + 1)
            live |= {b: [version + 1] for b in full}
        rows = [(version, b, v) for b, vs in live.items() for v in vs]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").json(f"{self.place}/manifest/m={version}")
        return touched

    def current(self, buckets: list[int] | None = None, before: int = 1 << 29) -> DataFrame:
        """The current rows; of some buckets only, if they are given; as they were before a batch."""
        live = self.live(2 * before)
        rows = self._newest(self._read(live if buckets is None else {b: live[b] for b in buckets if b in live}))
        return rows.where(~F.coalesce(F.col(self.removed), F.lit(False))) if self.removed else rows
