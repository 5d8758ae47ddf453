"""A stored token index that is kept up: segments of postings, tombstones, merges, and a registry of what is indexed.

An update writes one segment with the postings of the items it brings, by item, each file sorted by token, and tombstones for what these
items had in older segments; items that have not changed are left alone. When there are too many segments, the smallest
are merged and their tombstones go. A manifest, written last, names what is live, so a reader sees whole updates and an
update that is repeated writes the same again. Searches read the row groups of their tokens only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.search import tokens, words
from tidewell.streaming.store import Store

_MANIFEST = "version int, kind string, folder int, n long"


class Index:
    """place: a shared folder; fields: the text columns; key: the column that names an item; each: how many postings a
    task should sort at most."""

    def __init__(self, spark: SparkSession, place: str, fields: list[str], key: str = "item_id", most: int = 8, buckets: int = 16, each: int = 4_000_000):
        self.spark, self.place, self.fields, self.key, self.most, self.each = spark, place, fields, key, most, each
        kinds = spark.createDataFrame([], f"{key} long, segment int, size long, d1 long, d2 long, removed boolean").schema
        self.registry = Store(spark, f"{place}/registry", [key], ["segment"], kinds, buckets, removed="removed")

    def _manifest(self, before: int) -> tuple[dict[int, int], list[int]]:
        """({segment: postings}, [folders of tombstones]) by the last manifest below `before`; a row a folder."""
        try:
            rows = self.spark.read.schema(_MANIFEST).json(f"{self.place}/manifest").where(F.col("version") < before)
            last = rows.agg(F.max("version")).first()[0]
            found = rows.where(F.col("version") == last).collect() if last is not None else []
        except AnalysisException:
            found = []
        return {r["folder"]: r["n"] for r in found if r["kind"] == "segment"}, sorted(r["folder"] for r in found if r["kind"] == "graves")

    def _read(self, segments: list[int], graves: list[int]) -> DataFrame:
        """(key, segment, field, pos, token) of segments, without what their tombstones name."""
        if not segments:
            return self.spark.createDataFrame([], f"{self.key} long, segment int, field string, pos int, token string")
        rows = self.spark.read.schema(f"{self.key} long, segment int, field string, pos int, token string").parquet(*[f"{self.place}/postings/{s}" for s in segments])
        if graves:
            dead = self.spark.read.schema("g_key long, g_segment int").parquet(*[f"{self.place}/graves/{g}" for g in graves])
            rows = rows.join(dead, (F.col(self.key) == F.col("g_key")) & (F.col("segment") == F.col("g_segment")), "left_anti")
        return rows

    def _sorted(self, postings: DataFrame, segment: int, field: Column) -> DataFrame:
        """Postings in the order that files have them; what is the same in all rows isn't sorted with them."""
        rows = postings.withColumn("pos", F.col("pos").cast("int")).sortWithinPartitions("token", self.key)
        return rows.select(self.key, F.lit(segment).alias("segment"), field.alias("field"), "pos", "token")

    def _write(self, rows: DataFrame, segment: int) -> int:
        """Each task sorts what it has and writes a file of its own: a search looks into every file, by the statistics of
        its pages, and no posting is moved to another task. Returns the number of postings."""
        rows.write.mode("overwrite").parquet(f"{self.place}/postings/{segment}")
        return self.spark.read.parquet(f"{self.place}/postings/{segment}").count()

    def postings(self) -> DataFrame:
        """(key, field, pos, token) of all that is indexed; a filter on tokens reaches the files."""
        segments, graves = self._manifest(1 << 30)
        return self._read(sorted(segments), graves).drop("segment")

    def sizes(self) -> DataFrame:
        """(key, size): the number of tokens of every item, without reading postings."""
        return self.registry.current().select(self.key, "size")

    def update(self, docs: DataFrame, number: int, gone: DataFrame | None = None) -> None:
        """Update `number` (from 0, rising): items that are new or have other texts, and the keys of those that go.

        Items are told apart by two 64-bit hashes of their fields; an item that comes twice in one update counts once,
        its larger row. Segments 2n are updates, 2n + 1 what was merged after them.
        """
        segment, (segments, graves) = 2 * number, self._manifest(2 * number)
        taken = self._taken(docs, segment)
        known = self.registry.current(before=number).select(F.col(self.key).alias("_k"), F.col("segment").alias("_s"), F.col("d1").alias("_d1"), F.col("d2").alias("_d2"))
        told = taken.select(self.key, "d1", "d2", "size").join(known, F.col(self.key) == F.col("_k"), "left")
        changed = told.where(F.col("_k").isNull() | (F.col("d1") != F.col("_d1")) | (F.col("d2") != F.col("_d2")))
        place = f"{self.place}/changed/{segment}"
        changed.select(self.key, "d1", "d2", "size", F.col("_s").alias("was")).write.mode("overwrite").parquet(place)  # what the registry says now
        changed = self.spark.read.parquet(place)
        texts, have = taken.select(self.key, *self.fields), self.spark.read.parquet(f"{self.place}/taken/{segment}").rdd.getNumPartitions()
        if self.registry.live(2 * number):  # else all are new
            texts, have = texts.join(changed.select(F.col(self.key).alias("_c")), F.col(self.key) == F.col("_c"), "left_semi"), 1
        parts = -(-(changed.agg(F.sum("size")).first()[0] or 0) // self.each)
        if parts > have:
            texts = texts.repartition(parts, self.key)  # texts are smaller than the postings that a larger task would spill
        postings = [self._sorted(tokens(texts, [f], self.key).drop("field"), segment, F.lit(f)) for f in self.fields]
        wrote = self._write(reduce(DataFrame.union, postings), segment)
        dead = changed.where("was is not null").select(F.col(self.key).alias("g_key"), F.col("was").alias("g_segment"))
        if gone is not None:
            lost = gone.select(F.col(self.key).alias("_g")).distinct().join(known, F.col("_g") == F.col("_k")).select(F.col("_g").alias("g_key"), F.col("_s").alias("g_segment"))
            lost.write.mode("overwrite").parquet(f"{self.place}/lost/{segment}")
            lost = self.spark.read.parquet(f"{self.place}/lost/{segment}")
            dead = dead.union(lost)
        dead.write.mode("overwrite").parquet(f"{self.place}/graves/{segment}")
        rows = changed.select(self.key, F.lit(segment).alias("segment"), "size", "d1", "d2", F.lit(False).alias("removed"))
        if gone is not None:
            none = F.lit(None).cast("long")
            rows = rows.union(lost.select(F.col("g_key").alias(self.key), F.lit(segment), F.lit(0).cast("long"), none, none, F.lit(True)))
        if not self.spark.read.parquet(f"{self.place}/graves/{segment}").isEmpty():
            graves = [*graves, segment]
        segments[segment] = wrote
        if len(segments) > self.most:
            small, into = sorted(segments, key=lambda s: (segments[s], s))[: self.most], segment + 1
            n = self._write(self._sorted(self._read(small, graves).drop("segment"), into, F.col("field")), into)
            rows = self._moved(rows, number, small, into)
            segments = {s: k for s, k in segments.items() if s not in small} | {into: n}
            if graves:
                dead = self.spark.read.parquet(*[f"{self.place}/graves/{g}" for g in graves])
                dead.where(~F.col("g_segment").isin(small)).write.mode("overwrite").parquet(f"{self.place}/graves/{into}")
                graves = [into]
        self.registry.upsert(rows, number)
        out = [(segment, "segment", s, n) for s, n in segments.items()] + [(segment, "graves", g, 0) for g in graves]
        self.spark.createDataFrame(out, _MANIFEST).coalesce(1).write.mode("overwrite").json(f"{self.place}/manifest/m={segment}")

    def _taken(self, docs: DataFrame, segment: int) -> DataFrame:
        """(key, fields, d1, d2, size): the items of an update, written as they come, each once. Texts move to another task
        only where a key comes more than once."""
        digest = [F.xxhash64(*self.fields).alias("d1"), F.xxhash64(F.lit("second"), *self.fields).alias("d2")]
        size = sum((F.size(words(f)) for f in self.fields), F.lit(0)).cast("long").alias("size")
        place = f"{self.place}/taken/{segment}"
        docs.where(F.col(self.key).isNotNull()).select(self.key, *self.fields, *digest, size).write.mode("overwrite").parquet(place)
        taken = self.spark.read.parquet(place)
        twice = taken.groupBy(F.col(self.key).alias("_d")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_d")
        if twice.isEmpty():
            return taken
        same = F.col(self.key) == F.col("_d")
        larger = taken.join(twice, same, "left_semi").groupBy(self.key).agg(F.max(F.struct(*self.fields, "d1", "d2", "size")).alias("_t")).select(self.key, "_t.*")
        return taken.join(twice, same, "left_anti").unionByName(larger)

    def _moved(self, rows: DataFrame, number: int, small: list[int], into: int) -> DataFrame:
        """The registry's rows of an update and of the items whose postings were merged into another segment."""
        now = self.registry.current(before=number).unionByName(rows)
        now = now.groupBy(self.key).agg(F.max_by(F.struct("segment", "size", "d1", "d2", "removed"), "segment").alias("_r")).select(self.key, "_r.*")
        now = now.withColumn("segment", F.when(F.col("segment").isin(small) & ~F.col("removed"), F.lit(into)).otherwise(F.col("segment")))
        return now.where(F.col("segment") >= into - 1)

    def sync(self, docs: DataFrame, number: int) -> None:
        """An update to exactly these items: those that docs lack go."""
        here = docs.select(F.col(self.key).alias("_h")).where("_h is not null")
        gone = self.registry.current(before=number).select(self.key).join(here, F.col(self.key) == F.col("_h"), "left_anti")
        self.update(docs, number, gone)

    def off(self, items: int) -> bool:
        """Whether the index holds another number of items than it should, and so is to be rebuilt."""
        return self.registry.current().count() != items
