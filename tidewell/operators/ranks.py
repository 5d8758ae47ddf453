"""Row numbers over a global order, without a window that gathers a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import saved

_BITS = 33  # monotonically_increasing_id: the task above, the row within it below
FEW = 1_000_000  # rows of a key that one task may order


def largest(df: DataFrame, keys: list[str]) -> int:
    """How many rows the most frequent keys have."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_tw_n")).agg(F.max("_tw_n")).first()[0] or 0


def places(keys: list[Column | str], by: Column) -> tuple[Column, Column, Column]:
    """(below, equal, known): how many rows of a row's keys have a smaller `by`, the same, and any. Null `by` count nowhere.

    These are windows a key, for keys of which none is large; any number of them over the same keys takes one shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(F.asc_nulls_last(by))
    below = (F.rank().over(w) - 1).cast("long")
    upto, known = (F.count(by).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.count(by).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return below, upto - below, known


def numbered(df: DataFrame, by: list[Column | str], into: str = "_tw_g", parts: int | None = None) -> DataFrame:
    """df, saved, with a dense row number from 0 in the order of `by`.

    Rows are dealt out by ranges of `by` and sorted within their tasks; each number is the row's place in its task plus
    the rows of the tasks before, of which there is one small row each. Equal rows may get their numbers in any order;
    end `by` with something that tells rows apart if one value may fill a task.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = saved(df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn(into, F.monotonically_increasing_id()))
    task = F.shiftright(into, _BITS)
    sizes = rows.groupBy(task.alias("_tw_task")).agg(F.count(F.lit(1)).alias("_tw_n"))
    before = F.coalesce(F.sum("_tw_n").over(Window.orderBy("_tw_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_tw_task", before.alias("_tw_before"))  # one row a task
    rows = rows.join(F.broadcast(starts), task == F.col("_tw_task"))
    return rows.withColumn(into, F.col("_tw_before") + F.col(into).bitwiseAND(F.lit((1 << _BITS) - 1))).drop("_tw_task", "_tw_before")


def running(counts: DataFrame, keys: list[str], by: str, weight: str, few: int = FEW, parts: int | None = None) -> DataFrame:
    """counts with _below, the sum of weight over the rows of the same keys before each in the order of `by` (nulls
    first), and _all, that over all rows of the keys. Rows that are equal in keys and `by` must not occur.

    counts is saved first. A few rows are ordered in a window a key. Of more, no task holds a key: rows are dealt out by
    ranges of keys and `by`, each task sums up its part of a key, and adds what earlier tasks have of it, which is one
    row for each task and key. The results are the same.
    """
    counts = saved(counts)
    if counts.count() <= few:
        w = Window.partitionBy(*keys)
        below = F.sum(weight).over(w.orderBy(F.asc_nulls_first(by)).rowsBetween(Window.unboundedPreceding, -1))
        return counts.withColumn("_below", F.coalesce(below, F.lit(0))).withColumn("_all", F.sum(weight).over(w))
    order = [F.asc_nulls_first(c) for c in [*keys, by]]
    n = parts or int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = saved(counts.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_tw_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_tw_task", F.shiftright("_tw_at", _BITS))
    each = rows.groupBy("_tw_task", *keys).agg(F.sum(weight).alias("_tw_sum"))
    w = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_tw_sum").over(w.orderBy("_tw_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = each.select(F.col("_tw_task").alias("_tw_t"), *[F.col(k).alias(f"_tw_k{i}") for i, k in enumerate(keys)], before.alias("_tw_before"), F.sum("_tw_sum").over(w).alias("_all"))
    here = Window.partitionBy("_tw_task", *keys).orderBy("_tw_at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_below", F.coalesce(F.sum(weight).over(here), F.lit(0)))
    same = F.col("_tw_task") == F.col("_tw_t")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_tw_k{i}"))
    rows = rows.join(each, same).withColumn("_below", F.col("_tw_before") + F.col("_below"))
    return rows.select(*counts.columns, "_below", "_all")
