"""Language identification by nearest centroid over normalised TF-IDF vectors of byte n-grams.

A bounded sample of labelled texts is clustered per language (spherical k-means), so a language may have several
centroids. A text gets the language of the centroid of the largest cosine; one whose cosine is far below what the
sample's own texts reach is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .common import bounded_batches, id_crc

UNDETERMINED = "und"
#: ASCII bytes that aren't letters separate words; bytes of other scripts stay.
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def counts(text: str | None, dims: int) -> np.ndarray | None:
    """Hashed counts of the bigrams and trigrams of the lower-cased letters; None without any letter."""
    if not text or not any(map(str.isalpha, text)):
        return None
    raw = text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS)
    b = np.frombuffer(b" " + b" ".join(raw.split()) + b" ", dtype=np.uint8)
    out = np.zeros(dims, dtype=np.float64)
    for at in range(0, len(b), 1 << 20):  # bounded memory for any length; blocks overlap by two bytes
        part = b[at : at + (1 << 20) + 2].astype(np.uint32)
        two = (part[:-1] << np.uint32(8)) | part[1:]
        own = two if at + len(part) == len(b) else two[:-1]
        out += np.bincount((own * np.uint32(2654435761)) >> np.uint32(32 - (dims.bit_length() - 1)), minlength=dims)
        if len(part) > 2:
            three = (two[:-1] << np.uint32(8)) | part[2:]
            out += np.bincount((three * np.uint32(2246822519) + np.uint32(0x9E3779B9)) >> np.uint32(32 - (dims.bit_length() - 1)), minlength=dims)
    return out


@dataclass
class Centroids:
    languages: list[str]  # of each centroid
    vectors: np.ndarray
    idf: np.ndarray
    cutoff: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, cosine in 0..1, rejected). A text without letters, or no model: undetermined, 0."""
        tf = counts(text, len(self.idf))
        if tf is None or not self.languages:
            return UNDETERMINED, 0.0, True
        v = np.log1p(tf) * self.idf
        cosines = self.vectors @ v / (np.linalg.norm(v) or 1.0)
        best = int(cosines.argmax())
        score = float(min(1.0, max(0.0, cosines[best])))
        return self.languages[best], score, score < self.cutoff


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k unit centroids of unit rows by spherical k-means; starts are the rows furthest from those chosen."""
    centre = x.mean(axis=0)
    chosen = [int((x @ centre).argmax())]
    while len(chosen) < min(k, len(x)):
        chosen.append(int((x @ x[chosen].T).max(axis=1).argmin()))
    c = x[chosen].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (own == j).any():
                m = x[own == j].mean(axis=0)
                c[j] = m / (np.linalg.norm(m) or 1.0)
    return c


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dims: int = 4096, sample_rows: int = 4000, centroids: int = 4, most_languages: int = 200) -> Centroids:
    """Learns from about sample_rows texts with a non-null language, as many of each, chosen by a hash of the id.

    Only the sample's count vectors come to the driver: about sample_rows x dims numbers. If there are more different
    values of lang than most_languages, all texts are sampled at one rate, so that the bound holds for any column.
    """
    bounded_batches(docs.sparkSession)
    known = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    per = known.groupBy("lang").count()
    found, rows = (int(x or 0) for x in per.agg(F.count(F.lit(1)), F.sum("count")).first())
    if not found:
        return Centroids([], np.zeros((0, dims)), np.ones(dims), 0.0)
    draw = id_crc(F.concat(F.lit("lang"), F.coalesce(F.col("id").cast("string"), F.lit("")))) / F.lit(float(2**32))
    if found <= most_languages:
        each = sample_rows / found
        rates = {r["lang"]: each / r["count"] for r in per.where(F.col("count") > each).collect()}
        rate = F.coalesce(F.create_map(*[F.lit(x) for pair in sorted(rates.items()) for x in pair])[F.col("lang")], F.lit(1.0)) if rates else F.lit(1.0)
    else:  # a column of dirt rather than languages: all texts alike
        rate = F.lit(sample_rows / rows)
    picked = known.where(draw < rate)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(lang, c.astype(np.float32).tobytes()) for lang, c in zip(pdf["lang"], (counts(t, dims) for t in pdf["text"])) if c is not None]
            yield pd.DataFrame(rows, columns=["lang", "tf"])

    sample = picked.select("lang", "text").mapInPandas(vectors, "lang string, tf binary").toPandas()
    if not len(sample):
        return Centroids([], np.zeros((0, dims)), np.ones(dims), 0.0)
    sample = sample.sort_values(["lang", "tf"])  # one order whatever the partitions
    tf = np.stack([np.frombuffer(b, dtype=np.float32) for b in sample["tf"]])
    idf = (np.log((1 + len(tf)) / (1 + (tf > 0).sum(axis=0))) + 1).astype(np.float32)
    x = np.log1p(tf) * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    names, parts, best = [], [], []
    for lang in sorted(set(sample["lang"])):
        own = x[(sample["lang"] == lang).to_numpy()]
        if len(own):
            c = cluster(own, centroids)
            names += [lang] * len(c)
            parts.append(c)
            best.append((own @ c.T).max(axis=1))
    return Centroids(names, np.concatenate(parts).astype(np.float64), idf.astype(np.float64), 0.5 * float(np.quantile(np.concatenate(best), 0.01)))


def identify(text: Column, model: Centroids, spark) -> Column:
    """A struct (lang_pred, score, rejected) for each text; the model is some centroids, a bounded broadcast."""
    shared = spark.sparkContext.broadcast(model)
    schema = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())])

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([shared.value.predict(t) for t in batch], columns=["lang_pred", "score", "rejected"])

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, schema)(text)


def language_report(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score, rejected.

    Learns from rows whose crc32(doc_id as text) mod 4 is not 2. lang_pred is the nearest centroid's language, or
    und if the text is null or has no letter, or nothing could be learned; rejected marks texts further from every
    centroid than the rejection distance. Other columns are never inputs; an empty table gives no rows.
    """
    held = (id_crc("doc_id") % 4 == 2).alias("held_out")
    model = fit(docs.where(id_crc("doc_id") % 4 != 2))
    rows = docs.select("doc_id", held, identify(F.col("text"), model, docs.sparkSession).alias("said"))
    return rows.select("doc_id", "held_out", "said.lang_pred", "said.score", "said.rejected")
