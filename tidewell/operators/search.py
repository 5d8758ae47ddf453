"""Full-text search: a token table, phrases, prefixes, all-terms match and BM25 ranking."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def words(text: str) -> Column:
    """The tokens of a text column in order; a null text has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def tokens(docs: DataFrame, fields: list[str], key: str = "item_id") -> DataFrame:
    """(item_id, field, pos, token): lower-case runs of letters and digits, numbered within their field."""
    parts = [docs.select(key, F.lit(f).alias("field"), F.posexplode(words(f)).alias("pos", "token")) for f in fields]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def store(index: DataFrame, place: str, parts: int | None = None) -> DataFrame:
    """The token table written once in the order of tokens and read back: a search for some tokens then reads the few row
    groups that hold them, by their statistics. A token that fills many rows is spread over several parts by item."""
    spark, key = index.sparkSession, index.columns[0]
    many = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = index.repartitionByRange(many, "token", key).sortWithinPartitions("token", key)
    ordered.write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)


def matches(index: DataFrame, terms: list[str], key: str = "item_id") -> DataFrame:
    """(item_id): items that hold every term; a term that ends in * is a prefix, one with spaces a phrase."""
    singles, found = [t for t in terms if " " not in t], []
    if singles:
        which = F.array_compact(F.array(*[F.when(F.startswith("token", F.lit(t[:-1])) if t.endswith("*") else F.col("token") == t, F.lit(i)) for i, t in enumerate(singles)]))
        hit = index.withColumn("_terms", which).where(F.size("_terms") > 0).select(key, F.explode("_terms").alias("_t"))
        found.append(hit.groupBy(key).agg(F.count_distinct("_t").alias("_n")).where(F.col("_n") == len(singles)).select(key))
    for t in terms:
        if " " in t:
            found.append(phrase(index, t.split(), key).select(key).distinct())
    out = found[0]
    for f in found[1:]:
        out = out.join(f, key, "left_semi")
    return out


def phrase(index: DataFrame, words: list[str], key: str = "item_id") -> DataFrame:
    """(item_id, field, n): where the words stand one after the other. Each hit is moved to the phrase's start, so
    one aggregation finds the starts that all words agree on."""
    at = F.array_compact(F.array(*[F.when(F.col("token") == w, F.lit(i)) for i, w in enumerate(words)]))
    hits = index.where(F.col("token").isin(words)).select(key, "field", "pos", F.explode(at).alias("i"))
    starts = hits.groupBy(key, "field", (F.col("pos") - F.col("i")).alias("start")).agg(F.count_distinct("i").alias("k")).where(F.col("k") == len(words))
    return starts.groupBy(key, "field").agg(F.count(F.lit(1)).alias("n"))


def bm25(index: DataFrame, terms: list[str], k1: float = 1.2, b: float = 0.75, key: str = "item_id", sizes: DataFrame | None = None) -> DataFrame:
    """(item_id, score) of the items that hold any of the terms, all fields as one; larger is better. sizes: (item_id,
    size), each item's number of tokens, if it is stored; counted from the index otherwise."""
    sizes = index.groupBy(key).agg(F.count(F.lit(1)).alias("size")) if sizes is None else sizes.where("size > 0")
    tf = index.where(F.col("token").isin(terms)).groupBy(key, "token").agg(F.count(F.lit(1)).alias("tf"))
    all_ = sizes.agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean"))  # one row
    df = tf.groupBy(F.col("token").alias("_t")).agg(F.count(F.lit(1)).alias("df"))  # as many rows as terms
    j = tf.join(F.broadcast(df), F.col("token") == F.col("_t")).join(sizes, key).join(F.broadcast(all_))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    return j.groupBy(key).agg(F.sum(part).alias("score"))


def like(docs: DataFrame, text: str, fields: list[str]) -> DataFrame:
    """The plain way: rows with the text, in any case, in one of the fields."""
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(f)), F.lit(text.lower())), F.lit(False))
    return docs.where(hit)


def keywords(docs: DataFrame, group: str, words: str = "words", key: str = "item_id", top: int = 8) -> DataFrame:
    """(group, word, score): a group's best words by share of its documents times ln(1 + N / (1 + df)); ties by word."""
    each = docs.select(key, group, F.explode(F.array_distinct(words)).alias("word"))
    tf = each.groupBy(group, "word").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("word").agg(F.sum("tf").alias("df"))
    sizes = docs.groupBy(group).agg(F.count(F.lit(1)).alias("m"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))  # one row
    j = tf.join(df, "word").join(sizes, group).join(F.broadcast(n))
    score = F.floor(F.col("tf") / F.col("m") * F.log(1 + F.col("n") / (1 + F.col("df"))) * 1e6 + 0.5) / 1e6
    w = Window.partitionBy(group).orderBy(F.desc("score"), "word")
    return j.withColumn("score", score).withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).select(group, "word", "score", F.col("r").cast("long").alias("r"))


def snippet(text, terms: list[str], around: int = 30):
    """What stands around the first of the terms within its line, `around` characters at most on each side, with every
    term in brackets, in any case; empty if none is there."""
    one = "|".join(re.escape(t) for t in terms)
    text = F.col(text) if isinstance(text, str) else text
    before = F.length(F.regexp_extract(text, f"(?s)^.*?(?=(?i:{one}))", 0))  # one pass; the pattern below looks ahead from each place, so it gets what is near the first term only
    text = F.substring(text, F.greatest(F.lit(1), before - around + 1), F.lit(3 * around + max(len(t) for t in terms)))
    part = F.regexp_extract(text, f"[^\\n]{{0,{around}}}(?i:{one})[^\\n]{{0,{around}}}", 0)
    return F.regexp_replace(part, f"(?i)({one})", "[$1]")


def best_snippets(index: DataFrame, docs: DataFrame, terms: list[str], field: str, size: int = 20, key: str = "item_id") -> DataFrame:
    """(item_id, start, hits, snippet) of the items that hold any of the terms: the `size` tokens with the most different
    terms among them, the first of such windows, as they stand in the text, terms in brackets, cut ends as …

    Windows start at hits, which come from the index; texts are read for the items found only.
    """
    hits = index.where((F.col("field") == field) & F.col("token").isin(terms)).select(key, "pos", "token")
    ahead = Window.partitionBy(key).orderBy("pos").rangeBetween(0, size - 1)  # a text's hits
    seen = hits.select(key, "pos", F.size(F.collect_set("token").over(ahead)).alias("n"))
    best = seen.groupBy(F.col(key).alias("_k")).agg(F.max_by("pos", F.struct("n", -F.col("pos"))).alias("start"), F.max("n").alias("hits"))
    said = F.filter(F.split(F.col(field), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    rows = docs.select(key, field).join(best, F.col(key) == F.col("_k")).withColumn("_said", said)
    window = F.transform(F.slice("_said", F.col("start") + 1, size), lambda t: F.when(F.lower(t).isin(terms), F.concat(F.lit("["), t, F.lit("]"))).otherwise(t))
    cut = F.concat(F.when(F.col("start") > 0, "…").otherwise(""), F.array_join(window, " "), F.when(F.size("_said") > F.col("start") + size, "…").otherwise(""))
    return rows.select(key, "start", "hits", cut.alias("snippet"))


def search(index: DataFrame, docs: DataFrame, terms: list[str], fields: list[str], key: str = "item_id") -> DataFrame:
    """(item_id, mode): matches of the index (fts), or, if it has none, rows with the words as plain text (like)."""
    found = matches(index, terms, key).select(key, F.lit("fts").alias("mode"))
    some = found.select(F.lit(1).alias("_one")).limit(1)
    plain = like(docs, " ".join(t.rstrip("*") for t in terms), fields).select(key, F.lit("like").alias("mode"))
    return found.union(plain.join(F.broadcast(some), F.col("_one") == 1, "left_anti"))
