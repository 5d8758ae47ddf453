"""Imports: one pass routes a batch of records into raw rows, items, metric snapshots and merges, all of them or none.

Each output is written to a folder of its batch (items into a Store, so only touched buckets are written), and the
ledger's row of the batch last. Readers go by the ledger: a run that fails on the way leaves nothing to be seen, and the
next run takes its number and overwrites what it left.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.catalog import resolve_incoming
from tidewell.streaming.store import Store

from .graph import saved
from .ranks import numbered

_LEDGER = "batch int, rows long, failed long, fresh long, merged long, status string"
_KEYS = ["platform", "content_id", "canonical"]


class Imports:
    """place: a shared folder. texts keep what is there and are filled where null; metrics take what comes unless it is
    null; content_type is replaced only while it is unknown. Records have row_no, platform, content_id, canonical, title,
    text, content_type, the other texts and the metrics (long)."""

    def __init__(self, spark: SparkSession, place: str, metrics: list[str], texts: list[str] = ["title", "text"], buckets: int = 16):
        self.spark, self.place, self.metrics, self.texts = spark, place, metrics, texts
        fields = [f"{c} string" for c in [*_KEYS, *texts, "content_type"]] + [f"{m} long" for m in metrics]
        self.schema = f"item_id long, {', '.join(fields)}, first_batch int, last_batch int"
        self.store = Store(spark, f"{place}/items", ["item_id"], ["last_batch"], spark.createDataFrame([], self.schema).schema, buckets)

    def _stored(self, name: str, schema: str) -> DataFrame:
        done = [r["batch"] for r in self.batches().select("batch").collect()]  # a number a batch
        if not done:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.place}/{name}/{n}" for n in done])

    def batches(self) -> DataFrame:
        """The ledger: a row for each batch that was taken in whole."""
        try:
            return self.spark.read.schema(_LEDGER).option("basePath", f"{self.place}/ledger").json(f"{self.place}/ledger").select("batch", "rows", "failed", "fresh", "merged", "status")
        except AnalysisException:
            return self.spark.createDataFrame([], _LEDGER)

    def next_batch(self) -> int:
        last = self.batches().agg(F.max("batch")).first()[0]
        return 0 if last is None else last + 1

    def items(self) -> DataFrame:
        return self.store.current(before=self.next_batch())

    def raw(self) -> DataFrame:
        """Every record as it came, with what became of it; bad ones keep their payload and a note."""
        return self._stored("raw", "batch int, row_no long, payload string, status string, note string, item_id long")

    def snapshots(self) -> DataFrame:
        """The metrics of each valid record; within a batch those that repeat an item's are left out."""
        return self._stored("snapshots", f"batch int, row_no long, item_id long, {', '.join(f'{m} long' for m in self.metrics)}")

    def merges(self) -> DataFrame:
        """Records that went into an item that was there before them, and which of its empty texts they filled."""
        return self._stored("merges", "batch int, row_no long, item_id long, kind string, filled string")

    def run(self, incoming: DataFrame) -> int:
        """Takes in one batch and returns its number. Records of a batch go by row_no: the first of a new item is new,
        later ones are merged into it; ids of new items go on from the largest, in that order."""
        number = self.next_batch()
        existing = saved(self.store.current(before=number))
        payload = F.to_json(F.struct(*[F.col(f"`{c}`") for c in incoming.columns])).alias("payload")
        told = saved(resolve_incoming(existing, incoming.select("*", payload)))
        fresh = numbered(told.where("status = 'new'").select(F.col("row_no").alias("_lead")), ["_lead"])
        last = existing.agg(F.coalesce(F.max("item_id"), F.lit(-1)).alias("_last"))  # one row
        fresh = fresh.join(F.broadcast(last)).select("_lead", (F.col("_last") + 1 + F.col("_tw_g")).alias("_new"))
        rows = saved(told.join(fresh, F.col("leader") == F.col("_lead"), "left").withColumn("item_id", F.coalesce("target", "_new")).drop("_lead", "_new"))
        self._write(rows.select("row_no", "payload", "status", "note", "item_id"), "raw", number)
        good = rows.where("note is null")
        metrics = good.groupBy("item_id", *self.metrics).agg(F.min("row_no").alias("row_no"))
        self._write(metrics.select("row_no", "item_id", *self.metrics), "snapshots", number)

        known = existing.select(F.col("item_id").alias("_i"), *[F.col(c).alias(f"_{c}") for c in [*_KEYS, *self.texts, "content_type", *self.metrics, "first_batch"]])
        text = [*_KEYS, *self.texts]
        first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("row_no"))).alias(c) for c in text]
        kind = F.min_by("content_type", F.when(F.coalesce("content_type", F.lit("unknown")) != "unknown", F.col("row_no"))).alias("content_type")
        newest = [F.max_by(m, F.when(F.col(m).isNotNull(), F.col("row_no"))).alias(m) for m in self.metrics]
        who = [F.min(F.when(F.col(c).isNotNull(), F.col("row_no"))).alias(f"_by_{c}") for c in text]
        batch = saved(good.groupBy("item_id").agg(*first, kind, *newest, *who, F.min("row_no").alias("_first_row")).join(known, F.col("item_id") == F.col("_i"), "left"))
        kept = F.when(F.col("_content_type") != "unknown", F.col("_content_type"))
        items = batch.select("item_id", *[F.coalesce(f"_{c}", c).alias(c) for c in text], F.coalesce(kept, "content_type", F.lit("unknown")).alias("content_type"), *[F.coalesce(m, f"_{m}").alias(m) for m in self.metrics], F.coalesce("_first_batch", F.lit(number)).alias("first_batch"), F.lit(number).alias("last_batch"))
        self.store.upsert(items, number)

        gave = F.concat_ws(",", *[F.when(F.col(f"_{c}").isNull() & (F.col(f"_by_{c}") == F.col("row_no")), F.lit(c)) for c in text])
        later = good.where("status <> 'new'").select("row_no", "item_id", F.col("status").alias("kind"))
        marks = batch.select(F.col("item_id").alias("_m"), *[F.col(f"_{c}") for c in text], *[F.col(f"_by_{c}") for c in text])
        self._write(later.join(marks, F.col("item_id") == F.col("_m")).select("row_no", "item_id", "kind", gave.alias("filled")), "merges", number)

        status = F.when(F.col("failed") == 0, "completed").when(F.col("failed") == F.col("rows"), "failed").otherwise("partial")
        ledger = rows.agg(F.count(F.lit(1)).alias("rows"), F.count("note").alias("failed"), F.count_if(F.col("status") == "new").alias("fresh"), F.count_if(F.col("status").isin("merged", "duplicate")).alias("merged"))
        self._commit(ledger.select(F.lit(number).alias("batch"), "rows", "failed", "fresh", "merged", status.alias("status")), number)
        return number

    def _write(self, rows: DataFrame, name: str, number: int) -> None:
        rows.select(F.lit(number).alias("batch"), "*").write.mode("overwrite").parquet(f"{self.place}/{name}/{number}")

    def _commit(self, row: DataFrame, number: int) -> None:
        row.coalesce(1).write.mode("overwrite").json(f"{self.place}/ledger/m={number}")
