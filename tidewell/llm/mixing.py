"""Mixing sources to target weights: tokens per source, a repetition rate each, whole and Bernoulli copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, apart, saved

#: Weights of the sources in code-point order, repeating; null comes last.
WEIGHTS = (5, 2, 1)


def words(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(seed: str, doc_id: Column) -> Column:
    """A number in [0, 1) that the seed and the id decide: 52 bits of an MD5."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, size).

    The sources share `share` of all words by weight; a target stops at `most` times its source's size and the
    excess is reshared by weight. A source is capped exactly if its size per weight is small, so in the order of
    size per weight the capped ones come first and running sums give each level at once. One row per source: the
    windows order what is already aggregated.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("w", pick).withColumn("cap", F.col("source_size") * F.lit(most))
    fill = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    per = per.withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    level = (F.col("total") * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    per = per.withColumn("level", level).withColumn("open", F.col("level") * F.col("w") <= F.col("cap"))
    # the first source that its share leaves uncapped sets the level of all after it
    first = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return per.select("source", "source_size", F.coalesce(first * F.col("w"), F.col("cap")).alias("target"))


def rated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", small: int = 20_000, **how) -> DataFrame:
    """docs with _tw_size, _tw_source_size, _tw_target and _tw_copies: how often the mix takes the row.

    A row is taken floor(rate) times and once more with probability rate - floor(rate), which the seed and its
    id alone decide; rate = target / source size. Null text has size 0, a null source is a source of its own,
    rows of one id and source share their draw, and an empty source (no words) takes nothing. The sources' table is
    broadcast if it has no more than `small` rows; beyond that texts are shuffled by source, where adaptive execution
    splits a hot one.
    """
    rows = docs.withColumn("_tw_size", words(text_col))
    per = targets(rows.select(F.col(source_col).alias("source"), F.col("_tw_size").alias("size")), **how)
    per = per.select(F.col("source").alias("_tw_source"), F.col("source_size").alias("_tw_source_size"), F.col("target").alias("_tw_target"))
    per = saved(per)
    per = F.broadcast(per) if per.count() <= small else per
    rate = F.coalesce(F.col("_tw_target") / F.nullif(F.col("_tw_source_size"), F.lit(0)), F.lit(0.0))
    extra = (draw(seed, F.col(id_col)) < rate - F.floor(rate)).cast("long")
    return rows.join(per, F.col(source_col).eqNullSafe(F.col("_tw_source"))).withColumn("_tw_copies", F.floor(rate) + extra).drop("_tw_source")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: docs with each row as often as it is taken, columns unchanged, whatever their names. Nulls, ties
    and empties as in rated; an empty table gives no rows."""
    own, (docs, at) = docs.columns, apart(docs)
    rows = rated(docs, at[id_col], at[text_col], at[source_col], **how).where("_tw_copies > 0")
    return rows.withColumn("_tw_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_tw_copies")))).select(*docs.columns).toDF(*own)


def mix_report(docs: DataFrame, **how) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken (words taken, copies counted)."""
    narrow = docs.select("doc_id", "source", "text")
    rows = rated(narrow, **how)
    return rows.select("doc_id", F.col("_tw_size").alias("size"), F.col("_tw_source_size").alias("source_size"), F.col("_tw_target").alias("target"), (F.col("_tw_size") * F.col("_tw_copies")).alias("taken"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w,
  source_size * CAST(2.0 AS DOUBLE) AS cap, sum(source_size) OVER () AS total FROM s),
l AS (SELECT *, (CAST(total AS DOUBLE) * CAST(1.5 AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, coalesce(first_value(CASE WHEN level * w <= cap THEN level END IGNORE NULLS)
  OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * w, cap) AS target FROM l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(t.target / nullif(t.source_size, 0), 0) AS rate,
  CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""
