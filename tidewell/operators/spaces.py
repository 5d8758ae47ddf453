"""Vectors by space and version: spaces are never mixed, old versions stay, and one that comes back is live again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.streaming.store import Store

from .graph import saved

_VECTORS = "space_id string, item_id long, text_hash string, v array<float>, created_at long, updated_at long, superseded_at long, seq long"
_SPACES = "space_id string, provider string, model string, dimension int, builder string, activated long"


def space_id(provider: str, model: str, dimension: int, builder: str) -> str:
    if any(":" in part for part in (provider, model, builder)):
        raise ValueError("a part of a space's id holds a colon")
    return f"{provider}:{model}:{dimension}:{builder}"


class Spaces:
    """place: a shared folder. The registry of spaces is small; vectors are kept in a store, by buckets of item and space."""

    def __init__(self, spark: SparkSession, place: str, buckets: int = 16):
        self.spark = spark
        kinds = lambda s: spark.createDataFrame([], s).schema
        self.registry = Store(spark, f"{place}/spaces", ["space_id"], ["activated"], kinds(_SPACES), 1)
        self.vectors = Store(spark, f"{place}/vectors", ["space_id", "item_id", "text_hash"], ["seq"], kinds(_VECTORS), buckets)
        self._acts = self._writes = 0

    def ensure(self, provider: str, model: str, builder: str, sample: DataFrame | None = None, dimension: int = 0) -> str:
        """The id of a space, registered if it is new. A dimension that is not declared is that of the first vector of
        sample (v); a sample without one is an error."""
        if not dimension:
            first = sample.where("v is not null and size(v) > 0").select(F.size("v")).first() if sample is not None else None
            if first is None:
                raise ValueError("the dimension of the space is neither declared nor to be seen in a sample")
            dimension = first[0]
        at = space_id(provider, model, dimension, builder)
        if self.registry.current().where(F.col("space_id") == at).isEmpty():
            self._register([(at, provider, model, dimension, builder, 0)])
        return at

    def _register(self, rows: list[tuple]) -> None:
        self._acts = max([self._acts, *[v // 2 + 1 for vs in self.registry.live().values() for v in vs]])
        self.registry.upsert(self.spark.createDataFrame(rows, _SPACES), self._acts)

    def activate(self, at: str) -> None:
        """Makes a space the only active one."""
        spaces = {r["space_id"]: r for r in self.registry.current().collect()}
        row = spaces[at]
        self._register([(*tuple(row)[:-1], 1 + max(r["activated"] for r in spaces.values()))])

    def active(self) -> str | None:
        row = self.registry.current().where("activated > 0").orderBy(F.desc("activated")).first()
        return row["space_id"] if row else None

    def missing(self, at: str, items: DataFrame) -> DataFrame:
        """Items (item_id, text_hash) that have no live vector of that text in the space."""
        live = self.live(at).select(F.col("item_id").alias("_i"), F.col("text_hash").alias("_h"))
        return items.join(live, (F.col("item_id") == F.col("_i")) & (F.col("text_hash") == F.col("_h")), "left_anti")

    def live(self, at: str) -> DataFrame:
        return self.vectors.current().where((F.col("space_id") == at) & F.col("superseded_at").isNull())

    def all(self) -> DataFrame:
        """Every version of every vector: created_at, updated_at, and superseded_at unless it is live."""
        return self.vectors.current().drop("seq")

    def write(self, at: str, rows: DataFrame, now: int) -> None:
        """One batch of vectors (item_id, text_hash, v) of a space at a time `now`: a new text supersedes the item's live
        vector, a text seen before has its old row revived with the new vector. Of an item that comes twice the largest
        text_hash counts. Vectors of another length than the space's are an error, and nothing is written."""
        spaces = {r["space_id"]: r["dimension"] for r in self.registry.current().collect()}
        if at not in spaces:
            raise ValueError(f"no space {at}")
        batch = rows.where("item_id is not null and text_hash is not null").groupBy("item_id").agg(F.max(F.struct("text_hash", F.col("v").cast("array<float>").alias("v"))).alias("r")).select("item_id", "r.*")
        batch = saved(batch)
        if not batch.where(F.col("v").isNull() | (F.size("v") != spaces[at])).isEmpty():
            raise ValueError(f"vectors of another length than {spaces[at]}")
        number = max([self._writes, *[v // 2 + 1 for vs in self.vectors.live().values() for v in vs]])
        known = saved(self.vectors.current().where(F.col("space_id") == at))
        was = known.select(F.col("item_id").alias("_i"), F.col("text_hash").alias("_h"), F.col("created_at").alias("_c"))
        new = batch.join(was, (F.col("item_id") == F.col("_i")) & (F.col("text_hash") == F.col("_h")), "left")
        none = F.lit(None).cast("long")
        new = new.select(F.lit(at).alias("space_id"), "item_id", "text_hash", "v", F.coalesce("_c", F.lit(now)).cast("long").alias("created_at"), F.lit(now).cast("long").alias("updated_at"), none.alias("superseded_at"), F.lit(number).cast("long").alias("seq"))
        to = batch.select(F.col("item_id").alias("_i"), F.col("text_hash").alias("_h"))
        old = known.where("superseded_at is null").join(to, (F.col("item_id") == F.col("_i")) & (F.col("text_hash") != F.col("_h")), "left_semi")
        old = old.withColumn("superseded_at", F.lit(now).cast("long")).withColumn("seq", F.lit(number).cast("long"))
        self.vectors.upsert(new.unionByName(old), number)
        self._writes = number + 1
