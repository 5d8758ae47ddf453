"""Exact deduplication by two passes over a Bloom filter, in DataFrame functions only.

Pass one counts how often each Bloom cell is hit (cell numbers alone are shuffled, counted in part before) and keeps
the cells hit at least twice as bitmaps. Pass two tests every row: a row with a cell hit once is surely unique and
passes straight through; only the rest are shuffled and grouped by their full SHA-256. False positives of the filter
cost a shuffled row, never a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, apart, filter_bits, in_filter, key_cells, rekeyed, row_digest, saved


def normalised(text: Column | str) -> Column:
    """Each run of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")), BLANK, " ")


def text_sha(text: Column | str) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def repeated_cells(shas: DataFrame, sha: str, log2: int) -> DataFrame:
    """(page, bitmap): the Bloom cells that two or more rows hit; at most 2**log2 / 32768 rows of 4 KB."""
    cells = key_cells(F.xxhash64(sha), log2)  # one in each half, so that a row never hits a cell twice
    hit = shas.select(F.explode(F.array(*cells)).alias("cell")).groupBy("cell").count().where("count > 1")
    return hit.groupBy(F.floor(F.col("cell") / 32768).cast("long").alias("page")).agg(F.bitmap_construct_agg(F.col("cell") % 32768).alias("bitmap"))


def maybe_repeated(df: DataFrame, sha: str, cells: DataFrame, log2: int, flag: str) -> DataFrame:
    """df with flag: false only where no other row has the hash. cells is broadcast: 2**log2 bits, 128 MB at most."""
    return in_filter(df, F.xxhash64(sha), cells, log2, flag)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space became one space; null counts as empty. The
    row with the smallest id of a group stays; a null id comes after all others, and of rows that repeat both
    id and text exactly one stays. Extra columns of docs are not read. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_sha(text_col).alias("text_sha256"))
    rows = saved(rows.withColumn("_rid", F.monotonically_increasing_id()))  # a narrow copy: the texts are read once
    log2 = filter_bits(rows.count())
    rows = maybe_repeated(rows, "text_sha256", repeated_cells(rows, "text_sha256", log2), log2, "_maybe")
    alone = rows.where("not _maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    maybe = rows.where("_maybe").select("doc_id", "text_sha256", "_rid")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), F.col("_rid").alias("rid")))
    groups = maybe.groupBy(F.col("text_sha256").alias("_sha")).agg(first.alias("_first"), F.count(F.lit(1)).alias("group_size"))
    pairs = maybe.join(rekeyed(groups, "_sha"), F.col("text_sha256") == F.col("_sha"))
    return alone.union(pairs.select("doc_id", F.col("_first.id").alias("keep_id"), "group_size", (F.col("_rid") == F.col("_first.rid")).alias("kept"), "text_sha256"))


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row left of each group of equal texts (the smallest id's, as in exact_groups), all columns kept.

    Rows that the filter clears stay where they are; suspected rows are reduced to one per hash before they
    are shuffled. Rows equal in text and id are told apart by a hash of all their columns. Null and empty texts are one
    group; columns of any name and type stay; an empty table gives no rows.
    """
    own, (docs, at) = docs.columns, apart(docs)
    id_col, text_col, names = at[id_col], at[text_col], docs.columns
    shas = saved(docs.select(text_sha(text_col).alias("_tw_sha")))
    log2 = filter_bits(shas.count())
    cells = saved(repeated_cells(shas, "_tw_sha", log2))
    rows = maybe_repeated(docs.withColumn("_tw_sha", text_sha(text_col)), "_tw_sha", cells, log2, "_tw_maybe")
    order = F.struct(F.col(id_col).isNull().alias("no"), F.col(id_col).alias("id"), row_digest(docs).alias("h"))
    row = F.struct(*names)
    best = rows.where("_tw_maybe").groupBy("_tw_sha").agg(F.min_by(row, order).alias("_tw_row"))
    return rows.where("not _tw_maybe").select(*names).union(best.select(*[F.col("_tw_row").getField(c).alias(c) for c in names])).toDF(*own)


ORACLE = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS s FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY s) AS kept, s AS text_sha256 FROM n
"""
