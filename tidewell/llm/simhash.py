"""SimHash near-duplicates found by multi-index hashing.

A fingerprint is cut into two 32-bit segments. Two fingerprints at 3 or fewer differing bits differ in at most one
bit of one segment (pigeonhole), so each fingerprint looks up, per segment, its own value and the 32 values one bit
away, and the matches are verified over all 64 bits inside the join. Equal fingerprints are one class beforehand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import apart, bounded_batches, components, rekeyed, row_digest, saved, without

SHINGLE, DISTANCE, SEED = 3, 3, 42


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint of a text: a bit is set if set in over half the shingles' hashes.

    A-Z are lower-cased; words are split at ASCII white space; with fewer words than a shingle the whole
    sequence is hashed; no words (null, empty or blank text) give zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, n, 8192):  # so that a very long text needs no more memory than a short one
        part = [xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), SEED) for i in range(start, min(n, start + 8192))]
        bits = np.unpackbits(np.array(part, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


@F.pandas_udf(LongType())
def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([fingerprint(t) for t in batch], dtype="int64")


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): pairs of different fingerprints of the distinct column fp at `distance` (3 at most) or fewer bits."""
    if distance > 3:
        raise ValueError("two segments and balls of one bit reach three bits")
    low = F.lit(0xFFFFFFFF)
    both = F.array(F.col("fp").bitwiseAND(low), F.shiftrightunsigned("fp", 32).bitwiseOR(F.lit(1 << 32)))
    ball = F.array(*[F.lit(0)] + [F.lit(1 << i) for i in range(32)])
    tables = prints.select(F.col("fp").alias("b"), F.explode(both).alias("slot"))
    probes = prints.select(F.col("fp").alias("a"), F.explode(both).alias("at")).select("a", F.explode(F.transform(ball, lambda flip: F.col("at").bitwiseXOR(flip))).alias("at"))
    close = (F.col("at") == F.col("slot")) & (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    return probes.join(tables, close).select("a", "b")


def grouped(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, root, component_id) of the distinct fingerprints of rows (fp, doc_id); the smallest id reachable."""
    classes = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(classes.select("fp"), distance))
    classes = saved(classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"))
    best = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    return classes.join(best, "root").select("fp", "root", "component_id")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id.

    Null, empty and blank texts have fingerprint zero and link like any other. component_id is the smallest
    non-null id reachable. Extra columns are not read; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    rows = saved(docs.select(F.col(id_col).alias("doc_id"), _fingerprints(F.col(text_col)).alias("fp")))
    groups = rekeyed(grouped(rows, distance).select(F.col("fp").alias("_fp"), "component_id"), "_fp")
    out = rows.join(groups, F.col("fp") == F.col("_fp"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """docs with one row left of each group of linked fingerprints: the smallest id (null last, then a hash of the
    row). Columns are unchanged; only rows that may go are shuffled. Rows that are equal in all columns count as one.
    Null, empty and blank texts are one group; columns of any name and type stay; an empty table gives no rows."""
    bounded_batches(docs.sparkSession)
    own, (docs, at) = docs.columns, apart(docs)
    id_col, text_col = at[id_col], at[text_col]
    rows = saved(docs.select(F.col(id_col).alias("doc_id"), row_digest(docs).alias("digest"), _fingerprints(F.col(text_col)).alias("fp")))
    groups = rekeyed(grouped(rows, distance).select(F.col("fp").alias("_fp"), "root"), "_fp")
    order = F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), F.col("digest").alias("digest"))
    placed = saved(rows.join(groups, F.col("fp") == F.col("_fp")).groupBy("root", "doc_id", "digest").agg(F.count(F.lit(1)).alias("n")))
    best = placed.groupBy(F.col("root").alias("_root")).agg(F.min(order).getField("digest").alias("_digest"), F.sum("n").alias("_size"))
    out = placed.join(rekeyed(best.where("_size > 1"), "_root"), F.col("root") == F.col("_root"))
    return without(docs, out.select("digest", (F.col("digest") != F.col("_digest")).alias("drop"))).toDF(*own)
