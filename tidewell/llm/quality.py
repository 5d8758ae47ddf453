"""Quality classification by naive Bayes support vectors.

N-gram indicators (word unigrams and bigrams, and trigrams of token shapes with repetition marks) are scaled by the
classes' log-count ratios; a linear model of hinge loss is fitted to them by dual coordinate descent.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import apart, bounded_batches, id_crc

BITS = 18
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_MASK = np.uint64((1 << BITS) - 1)
_SEEN: dict[str, tuple[int, int]] = {}


def _token(t: str) -> tuple[int, int]:
    """A token's hash, and the hash of its shape: punctuation as it is, a word by case, digits and length."""
    if not (t[0].isalnum() or t[0] == "_"):
        shape = t[:4]
    else:
        case = "U" if t.isupper() else "l" if t.islower() else "C" if t[1:].islower() or len(t) == 1 else "d" if t.isdigit() else "m"
        shape = case + ("1" if len(t) == 1 else "s" if len(t) < 12 else "w" if len(t) < 24 else "x")
    return crc32(t.lower().encode("utf-8", "surrogatepass")), crc32(shape.encode("utf-8", "surrogatepass"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)


def features(text: str | None) -> np.ndarray:
    """Sorted ids of the n-gram indicators of a whole text; null and empty texts have none."""
    found: list[np.ndarray] = []
    tokens = _TOKEN.findall(text or "")
    if len(_SEEN) > 100_000:
        _SEEN.clear()
    for at in range(0, len(tokens), 100_000):
        pairs = []
        for t in tokens[max(0, at - 2) : at + 100_000]:
            p = _SEEN.get(t)
            if p is None:
                p = _SEEN[t] = _token(t)
            pairs.append(p)
        both = np.array(pairs, dtype=np.uint64)
        w, s = both[:, 0], both[:, 1]
        again = np.zeros(len(w), dtype=np.uint64)
        again[1:] |= (w[1:] == w[:-1]).astype(np.uint64)
        again[2:] |= (w[2:] == w[:-2]).astype(np.uint64) << np.uint64(1)
        s = s * np.uint64(4) + again
        found += [_mixed(w + (np.uint64(1) << np.uint64(40)))]
        if len(w) > 1:
            found.append(_mixed(w[:-1] * np.uint64(31) + w[1:] + (np.uint64(2) << np.uint64(40))))
        found.append(_mixed(s + (np.uint64(3) << np.uint64(40))))
        if len(w) > 2:
            found.append(_mixed((s[:-2] * np.uint64(1009) + s[1:-1]) * np.uint64(1009) + s[2:] + (np.uint64(4) << np.uint64(40))))
        if len(found) > 40:
            found = [np.unique(np.concatenate(found))]
    return np.unique(np.concatenate(found)).astype(np.int32) if found else np.zeros(0, np.int32)


@dataclass
class Model:
    """score(x) = 1 / (1 + exp(-(slope * margin + shift)))."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, ids: np.ndarray) -> float:
        margin = float(self.weights[ids].sum()) / max(1.0, len(ids) ** 0.5) + self.bias
        z = max(-500.0, min(500.0, self.slope * margin + self.shift))
        return 1.0 / (1.0 + float(np.exp(-z)))


def coordinate_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 20, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of min |w|^2/2 + sum cost * max(0, 1 - y w.x), x being scaled indicators and a constant 1.

    Each step solves the dual for one row alone, within 0 and its cost, keeping w up to date.
    """
    norm = [max(1.0, len(r) ** 0.5) for r in rows]
    xs = [scale[r] / n for r, n in zip(rows, norm)]
    square = np.array([float(x @ x) + 1.0 for x in xs])
    w, b, alpha, draw = np.zeros(len(scale)), 0.0, np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in draw.permutation(len(rows)):
            ids, x = rows[i], xs[i]
            g = y[i] * (float(w[ids] @ x) + b) - 1.0
            new = min(cost[i], max(0.0, alpha[i] - g / square[i]))
            step = (new - alpha[i]) * y[i]
            if step:
                w[ids] += step * x
                b += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w, b


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, smooth: float = 1.0, least: int = 3, cost: float = 1.0) -> Model:
    """The model of labelled indicator sets. With one class only, the score is that class; with none it is 1."""
    n, positive = 1 << BITS, int((labels == 1).sum())
    if positive in (0, len(labels)):
        return Model(np.zeros(n), 0.0, 0.0, 500.0 if positive or not len(labels) else -500.0)
    y = np.where(labels == 1, 1.0, -1.0)
    seen = [np.bincount(np.concatenate([r for r, l in zip(rows, labels) if l == k] or [np.zeros(0, np.int32)]), minlength=n) for k in (0, 1)]
    share = [(s + smooth) / (smooth + (labels == k).sum()) for k, s in enumerate(seen)]
    ratio = np.where(seen[0] + seen[1] >= least, np.log(share[1]) - np.log(share[0]), 0.0)
    weight = np.where(labels == 1, len(labels) / (2 * positive), len(labels) / (2 * (len(labels) - positive))) * cost
    part = np.arange(len(rows)) % 5 == 0  # a fifth tells how margins turn into probabilities
    a, b = coordinate_descent([r for r, p in zip(rows, part) if not p], ratio, y[~part], weight[~part])
    trial = Model(a * ratio, b, 1.0, 0.0)
    margins = np.array([float(trial.weights[r].sum()) / max(1.0, len(r) ** 0.5) + b for r, p in zip(rows, part) if p])
    slope, shift = calibrated(margins, y[part], weight[part])
    a, b = coordinate_descent(rows, ratio, y, weight)
    return Model(a * ratio, b, slope, shift)


def calibrated(margins: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of a logistic curve over margins, with softened targets, by Newton's method."""
    up, down = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    s = np.array([1.0, 0.0])
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ s, -500, 500)))
        grad = x.T @ (weight * (p - t)) + 1e-3 * (s - [1.0, 0.0])
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        move = np.linalg.solve(hess, grad)
        s = s - move * min(1.0, 5.0 / max(1e-9, float(np.abs(move).max())))
        if np.abs(move).max() < 1e-6:
            break
    return float(max(0.1, s[0])), float(s[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 8000) -> Model:
    """Learns from about sample_rows labelled documents, half of each class, chosen by a hash of the id.

    Several labels of one id count as the smallest. The sampled labels (no more than the parameter says) are
    broadcast; the documents' indicators, not their texts, come to the driver.
    """
    bounded_batches(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label_col).alias("label"))
    total = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    draw = id_crc(F.concat(F.lit("quality"), F.col("doc_id").cast("string")))
    share = F.when(F.col("label") == 1, F.lit(min(1.0, sample_rows / 2 / max(1, total.get(1, 0))))).otherwise(F.lit(min(1.0, sample_rows / 2 / max(1, total.get(0, 0)))))
    picked = known.where(F.col("label").isin(0, 1) & (draw < share * float(2**32))).select(F.col("doc_id").alias("_id"), F.col("label").cast("int").alias("label"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), F.col("id") == F.col("_id")).select("id", "label", "text")

    def indicators(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "label": pdf["label"], "ids": [features(t).tobytes() for t in pdf["text"]]})

    kind = dict(docs.dtypes)[id_col]
    sample = rows.mapInPandas(indicators, f"id {kind}, label int, ids binary").toPandas().sort_values(["id", "ids"])
    return fit_rows([np.frombuffer(b, dtype=np.int32) for b in sample["ids"]], sample["label"].to_numpy())


def quality_score(text: Column, model: Model, spark) -> Column:
    """The probability of label 1 for each text. The model has 2**18 weights: 2 MB broadcast."""
    shared = spark.sparkContext.broadcast(model)

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([shared.value.score(features(t)) for t in batch], dtype="float64")

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, DoubleType())(text)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(id_crc("doc_id") % 4 != 2)


def quality_report(docs: DataFrame, labels: DataFrame, keep_at: float = 0.7) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Learns from labelled rows whose crc32(doc_id as text) mod 4 is not 2. Null text counts as empty, which has a
    score too. Other columns are never inputs; an empty table gives no rows.
    """
    model = fit(training_rows(docs), labels)
    rows = docs.select("doc_id", (id_crc("doc_id") % 4 == 2).alias("held_out"), quality_score(F.col("text"), model, docs.sparkSession).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= keep_at).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, keep_at: float = 0.7) -> DataFrame:
    """docs without the rows whose score is under keep_at; columns unchanged, whatever their names.

    A null or empty text has a score like any other; rows that repeat stay or go together; labels of unknown or null
    ids, and null labels, are not used. With no labels, or of one class only, all rows get that class: 1 if there are
    none. An empty table gives no rows.
    """
    model, (rows, at) = fit(training_rows(docs), labels), apart(docs)
    scored = rows.withColumn("score", quality_score(F.col(at["text"]), model, docs.sparkSession))
    return scored.where(F.col("score") >= keep_at).drop("score").toDF(*docs.columns)
