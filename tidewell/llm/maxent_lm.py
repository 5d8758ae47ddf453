"""Language-model scoring with a hashed maximum-entropy model.

A word is drawn as class, then member of the class, each by a softmax whose scores add up hashed feature rows: the
word before, the two before, and the word before the last (a skip). The most frequent words are members themselves;
all others share members by their ending, and within such a member a word has its smoothed relative frequency. The
weights start at the unigrams' probabilities and are learnt by distributed gradient updates: every task runs over its own
documents from the same weights, and the tasks' updates are averaged by feature row. Counts cover the whole training
corpus; what they tell about rare words is joined to the documents, not broadcast. The number of feature rows grows with
the corpus up to a bound, as the weights are broadcast.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, bounded_batches, id_crc, saved

CLASSES, MEMBERS = 16, 32
ENDINGS = 128  # members that words of one ending share: the last 4 classes
TOP = CLASSES * MEMBERS - ENDINGS  # members that are words, the end of the text first
ROWS = (1 << 15, 1 << 18)  # the least and the most feature rows of members; those of classes are a quarter as many
TOKENS_A_ROW = 1 << 13
SMOOTH = 0.1
_START, _END = 0x51ED270B, 0x2545F491


def tokens(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def ending(word: Column) -> Column:
    """The shared member of a word, as ending_of says it of bytes."""
    return (F.crc32(F.right(word, F.lit(2)).cast("binary")) % ENDINGS).cast("int")


def ending_of(word: bytes) -> int:
    if word[-2:].isascii():  # two bytes are two characters then
        return zlib.crc32(word[-2:]) % ENDINGS
    return zlib.crc32(word.decode("utf-8", "surrogatepass")[-2:].encode("utf-8", "surrogatepass")) % ENDINGS


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, c) over all texts; JVM expressions with partial counts, so hot words don't meet in the shuffle."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = docs.select(F.explode(F.split(F.translate(F.coalesce(F.col(text_col), F.lit("")), upper, lower), BLANK)).alias("word"))
    return words.where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("c"))


@dataclass
class Lexicon:
    """The frequent words, at most a parameter's number: count, member and hash by word; and the totals."""

    index: dict[bytes, int]
    log_count: np.ndarray  # log10(c + SMOOTH); the last entry is the end of the text
    member: np.ndarray
    total: int
    distinct: int
    docs: int
    cut: int  # words of a smaller count are not in the index
    log_ending: np.ndarray  # log10 of what a shared member divides by
    hash: np.ndarray  # of the words by index; the last entry is the end of the text

    @property
    def log_all(self) -> float:
        return math.log10(self.total + SMOOTH * (self.distinct + 1))


def lexicon(counts: DataFrame, train_docs: int, most: int = 200_000) -> Lexicon:
    """The lexicon of (word, c): the words from that power of two on which at most `most` words reach."""
    total, distinct = (int(x or 0) for x in counts.agg(F.sum("c"), F.count("c")).first())
    sizes = {r["size"]: r["count"] for r in counts.groupBy(F.floor(F.log2("c")).cast("int").alias("size")).count().collect()}  # 63 rows at most
    cut, sofar = 1 << 62, 0
    for size in sorted(sizes, reverse=True):
        sofar += sizes[size]
        if sofar > most:
            break
        cut = 1 << size
    frequent = sorted(((-r["c"], r["word"].encode("utf-8", "surrogatepass")) for r in counts.where(F.col("c") >= cut).collect()))
    words = [w for _, w in frequent]
    own = {w: i + 1 for i, w in enumerate(words[: TOP - 1])}  # member 0 is the end
    member = np.array([own[w] if w in own else TOP + ending_of(w) for w in words] + [0], dtype=np.int32)
    log_count = np.array([math.log10(-c + SMOOTH) for c, _ in frequent] + [math.log10(train_docs + SMOOTH)])
    shared = np.zeros((2, ENDINGS))
    for r in counts.groupBy(ending(F.col("word")).alias("e")).agg(F.sum("c").alias("n"), F.count("c").alias("v")).collect():
        shared[:, r["e"]] = r["n"], r["v"]
    for (c, w) in frequent[: TOP - 1]:
        shared[0, ending_of(w)] += c
        shared[1, ending_of(w)] -= 1
    return Lexicon({w: i for i, w in enumerate(words)}, log_count, member, total + train_docs, distinct + (train_docs > 0), train_docs, cut, np.log10(shared[0] + SMOOTH * (shared[1] + 1)), np.array([zlib.crc32(w) for w in words] + [_END], dtype=np.uint32))


@dataclass
class Weights:
    of_class: np.ndarray  # feature rows of classes, and one more, their bias
    of_member: np.ndarray  # feature rows of members, and one more for each class, its members' bias

    @classmethod
    def start(cls, lex: Lexicon, rows: int | None = None) -> Weights:
        """No feature says anything yet; the biases give each member its share of the training tokens."""
        rows = rows or member_rows(lex.total)
        w = cls(np.zeros((rows // 4 + 1, CLASSES), np.float32), np.zeros((rows + CLASSES, MEMBERS), np.float32))
        share = np.full(CLASSES * MEMBERS, SMOOTH)
        own = lex.member < TOP
        share[lex.member[own]] = 10.0 ** lex.log_count[own]
        share[TOP:] = 10.0**lex.log_ending
        share = np.log(share.reshape(CLASSES, MEMBERS))
        top = share.max(axis=1, keepdims=True)
        w.of_class[-1] = (top + np.log(np.exp(share - top).sum(axis=1, keepdims=True))).ravel()
        w.of_class[-1] -= w.of_class[-1].max()
        w.of_member[rows:] = share - top
        return w


def member_rows(tokens: int) -> int:
    """A power of two: about one row per TOKENS_A_ROW tokens, within ROWS."""
    return max(ROWS[0], min(ROWS[1], 1 << max(0, tokens // TOKENS_A_ROW).bit_length()))


class Batch:
    """The tokens of some texts as arrays: member, hash, log count (nan for rare words), text and features."""

    def __init__(self, texts: list[list[bytes]], lex: Lexicon):
        flat = [w for words in texts for w in [*words, b""]]
        at = np.array([*map(lex.index.get, flat, itertools.repeat(-1))], dtype=np.int64)
        self.size = np.array([len(words) + 1 for words in texts])
        self.text = np.repeat(np.arange(len(texts)), self.size)
        at[np.cumsum(self.size) - 1] = len(lex.index)
        rare = np.flatnonzero(at == -1)
        self.hash = lex.hash[at]
        self.hash[rare] = [zlib.crc32(flat[i]) for i in rare]
        self.member = np.where(at >= 0, lex.member[at], 0)
        self.member[rare] = [TOP + ending_of(flat[i]) for i in rare]
        self.log_count = np.where(at >= 0, lex.log_count[at], np.nan)
        self.rare = rare
        self.flat = flat
        one, two = np.full(len(flat), _START, np.uint32), np.full(len(flat), _START, np.uint32)
        one[1:], two[2:] = self.hash[:-1], self.hash[:-2]
        first = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        one[first] = two[first] = _START
        two[(first + 1)[self.size > 1]] = _START
        self.features = np.stack([one * np.uint32(2654435761), (one * np.uint32(2246822519) ^ two) * np.uint32(3266489917) + np.uint32(1), two * np.uint32(668265263) + np.uint32(2)])


def _rows(w: Weights, features: np.ndarray, klass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that add up to the scores of classes, and those of the members of a class, by feature."""
    f = features ^ (features >> np.uint32(15))
    own = (f + klass.astype(np.uint32) * np.uint32(0x9E3779B1)) * np.uint32(2246822519)
    own ^= own >> np.uint32(13)
    return (f % np.uint32(len(w.of_class) - 1)).astype(np.int64), (own % np.uint32(len(w.of_member) - CLASSES)).astype(np.int64)


def _log_softmax(s: np.ndarray) -> np.ndarray:
    s = s - s.max(axis=1, keepdims=True)
    return s - np.log(np.exp(s).sum(axis=1, keepdims=True))


def _sums(w: Weights, rc: np.ndarray, rm: np.ndarray, klass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a = w.of_class.take(rc[0], axis=0)
    a += w.of_class.take(rc[1], axis=0)
    a += w.of_class.take(rc[2], axis=0)
    a += w.of_class[-1]
    b = w.of_member.take(rm[0], axis=0)
    b += w.of_member.take(rm[1], axis=0)
    b += w.of_member.take(rm[2], axis=0)
    b += w.of_member.take(len(w.of_member) - CLASSES + klass, axis=0)
    return a, b


def log10_members(w: Weights, batch: Batch, step: int = 16384) -> np.ndarray:
    """log10 of class times member for each token of a batch."""
    out = np.empty(len(batch.member))
    for at in range(0, len(out), step):
        m = batch.member[at : at + step]
        klass, row = m // MEMBERS, np.arange(len(m))
        rc, rm = _rows(w, batch.features[:, at : at + step], klass)
        a, b = (_log_softmax(x) for x in _sums(w, rc, rm, klass))
        out[at : at + step] = (a[row, klass] + b[row, m % MEMBERS]) / math.log(10)
    return out


def _sums_of_runs(x: np.ndarray, first: np.ndarray, n: np.ndarray, near: int = 8) -> np.ndarray:
    """The sums of runs of rows that begin at first and are n long. Most are short: their rows are added one place at a
    time for all runs together, and only what is left of the long ones run by run."""
    out = x[first]
    for k in range(1, near):
        more = np.flatnonzero(n > k)
        if not len(more):
            return out
        out[more] += x[first[more] + k]
    more = np.flatnonzero(n > near)
    if len(more):
        size = n[more] - near
        start = np.cumsum(size) - size
        out[more] += np.add.reduceat(x[np.repeat(first[more] + near - start, size) + np.arange(size.sum())], start, axis=0)
    return out


class Descent:
    """Gradient updates from given weights, scaled by what each row has seen (AdaGrad by row). The prior, a squared
    gradient that each row counts as seen, keeps rows of few tokens near their start."""

    def __init__(self, start: Weights, rate: float = 0.25, prior: float = 1.0):
        self.w, self.rate = Weights(start.of_class.copy(), start.of_member.copy()), rate
        self.past = [np.full(len(self.w.of_class), prior, np.float32), np.full(len(self.w.of_member), prior, np.float32)]
        self.seen = [np.zeros(len(self.w.of_class), np.float32), np.zeros(len(self.w.of_member), np.float32)]

    def _apply(self, k: int, table: np.ndarray, rows: np.ndarray, grad: np.ndarray) -> None:
        """An update of feature rows; grad goes round once per feature. Rows of 16 bits are sorted by radix, as are
        larger ones by their two halves."""
        order = np.argsort(rows.astype(np.uint16), kind="stable")
        if len(table) > (1 << 16) + CLASSES:
            order = order[np.argsort((rows[order] >> 16).astype(np.uint16), kind="stable")]
        rows = rows[order]
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        n = np.diff(np.concatenate([first, [len(rows)]]))
        self._move(k, table, rows[first], _sums_of_runs(grad.take(order % len(grad), axis=0), first, n), n)

    def _move(self, k: int, table: np.ndarray, own: np.ndarray, total: np.ndarray, n: np.ndarray) -> None:
        self.past[k][own] += np.einsum("ij,ij->i", total, total) / total.shape[1]
        table[own] -= self.rate * total / np.sqrt(self.past[k][own])[:, None]
        self.seen[k][own] += n

    def learn(self, batch: Batch, step: int = 4096) -> None:
        """One pass with every token as a target."""
        for at in range(0, len(batch.member), step):
            m = batch.member[at : at + step]
            klass, row = m // MEMBERS, np.arange(len(m))
            rc, rm = _rows(self.w, batch.features[:, at : at + step], klass)
            a, b = _sums(self.w, rc, rm, klass)
            for s, target in ((a, klass), (b, m % MEMBERS)):
                s -= s.max(axis=1, keepdims=True)
                np.exp(s, out=s)
                s /= s.sum(axis=1, keepdims=True)
                s[row, target] -= 1
            self._apply(0, self.w.of_class, rc.ravel(), a)
            self._apply(1, self.w.of_member, rm.ravel(), b)
            # a bias belongs to many tokens: summed without sorting
            self._move(0, self.w.of_class, np.array([len(self.w.of_class) - 1]), a.sum(axis=0, keepdims=True), np.array([len(m)]))
            n = np.bincount(klass, minlength=CLASSES)
            own = np.flatnonzero(n)
            self._move(1, self.w.of_member, len(self.w.of_member) - CLASSES + own, (np.arange(CLASSES)[:, None] == klass).astype(np.float32)[own] @ b, n[own])


BLOCK = 1024  # feature rows in a block of an update
TASK_TOKENS = 32  # times the member rows: a training task gets about so many tokens or more, if there are enough for every core


def train(docs: DataFrame, lex: Lexicon, text_col: str = "text", id_col: str = "doc_id", rounds: int = 2) -> Weights:
    """Weights after `rounds` distributed updates. A round runs over the documents that a hash gives it, so each is
    seen once, and every token of it is a target. Updates are averaged by feature row, weighted by use, in two steps
    of a bounded fan-in; the driver gets the averages, 2 to 18 MB as half floats. Small partitions share a task, so that the updates
    (as large for each task) stay small beside the texts."""
    spark = docs.sparkSession
    known, now = spark.sparkContext.broadcast(lex), Weights.start(lex)
    tasks = max(spark.sparkContext.defaultParallelism, -(-lex.total // (TASK_TOKENS * (len(now.of_member) - CLASSES))))
    groups = math.isqrt(tasks - 1) + 1
    rows = docs.select(F.col(text_col).alias("text"), id_crc(F.concat(F.lit("lm"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("h"))
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast(now)

        def update(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            d, used = Descent(sent.value), False
            for pdf in batches:
                for some, _ in _portions(pdf["text"]):
                    d.learn(Batch(some, known.value))
                    used = True
            if not used:
                return
            task = TaskContext.get().partitionId()
            for k, (table, start) in enumerate(((d.w.of_class, sent.value.of_class), (d.w.of_member, sent.value.of_member))):
                for at in range(0, len(table), BLOCK):
                    n = d.seen[k][at : at + BLOCK]
                    moved = (table[at : at + BLOCK] - start[at : at + BLOCK]).astype(np.float16)
                    yield pd.DataFrame({"k": [k], "at": [at], "task": [task], "n": [n.tobytes()], "moved": [moved.tobytes()]})

        schema = "k int, at int, task int, n binary, moved binary"

        def mean(pdf: pd.DataFrame) -> pd.DataFrame:
            n = np.stack([np.frombuffer(x, dtype=np.float32) for x in pdf["n"]])
            moved = sum((np.frombuffer(x, dtype=np.float16).reshape(len(k), -1) * k[:, None] for x, k in zip(pdf["moved"], n)), np.float32(0))
            all_ = n.sum(axis=0)
            return pd.DataFrame({"k": pdf["k"][:1], "at": pdf["at"][:1], "task": pdf["task"][:1] // groups, "n": [all_.tobytes()], "moved": [(moved / np.maximum(all_, 1)[:, None]).astype(np.float16).tobytes()]})

        parts = rows.where(F.col("h") % rounds == turn).select("text").coalesce(tasks).mapInPandas(update, schema)
        # groups of tasks first, as many as their square root, then one: no group holds more rows than that
        parts = parts.groupBy("k", "at", F.expr(f"task % {groups} as g")).applyInPandas(mean, schema)
        total = parts.groupBy("k", "at").applyInPandas(mean, schema).collect()
        now = Weights(now.of_class.copy(), now.of_member.copy())
        for r in total:
            table = (now.of_class, now.of_member)[r["k"]]
            moved = np.frombuffer(r["moved"], dtype=np.float16).astype(np.float32).reshape(-1, table.shape[1])
            table[r["at"] : r["at"] + len(moved)] += moved
    return now


def _portions(texts: pd.Series, most: int = 400_000) -> Iterator[tuple[list[list[bytes]], int]]:
    """Tokenised texts in portions of a bounded number of tokens; a longer text is a portion of its own."""
    some, size, first = [], 0, 0
    for i, t in enumerate(texts):
        words = tokens(t)
        if some and size + len(words) > most:
            yield some, first
            some, size, first = [], 0, i
        some.append(words)
        size += len(words) + 1
    if some:
        yield some, first


def score(rows: DataFrame, lex: Lexicon, weights: Weights, counts: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of rows (doc_id, text); ids may repeat or be null.

    Tasks score all but the rare words' counts, which are then joined by word; rare means below the lexicon's
    cut, so none of them is hot.
    """
    shared = rows.sparkSession.sparkContext.broadcast((lex, weights))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex, weights = shared.value
        for pdf in batches:
            for some, at in _portions(pdf["text"]):
                b = Batch(some, lex)
                model = log10_members(weights, b)
                other = b.member >= TOP  # within a shared member: relative frequency
                model[other] -= lex.log_ending[b.member[other] - TOP]
                counted = np.nan_to_num(b.log_count)
                model[other] += counted[other]
                rare: list[Counter] = [Counter() for _ in some]
                for i in b.rare:
                    rare[b.text[i]][b.flat[i]] += 1
                yield pd.DataFrame(
                    {
                        "id": pdf["id"].iloc[at : at + len(some)].to_numpy(),
                        "n_tokens": b.size,
                        "known": b.size - np.bincount(b.text[b.rare], minlength=len(some)) - (lex.docs == 0),
                        "base": np.bincount(b.text, weights=counted, minlength=len(some)) - b.size * lex.log_all,
                        "model": np.bincount(b.text, weights=model, minlength=len(some)),
                        "words": [[w.decode("utf-8", "surrogatepass") for w in r] for r in rare],
                        "times": [list(r.values()) for r in rare],
                    }
                )

    kind = "id string, n_tokens long, known long, base double, model double, words array<string>, times array<long>"
    as_text = rows.select(F.col("doc_id").cast("string").alias("id"), "text")  # pandas has no whole numbers with nulls
    said = as_text.mapInPandas(run, kind).withColumn("doc_id", F.col("id").cast(dict(rows.dtypes)["doc_id"]))
    said = saved(said.withColumn("rid", F.monotonically_increasing_id()))
    rare = said.select("rid", F.explode(F.arrays_zip("words", "times")).alias("x")).select("rid", F.col("x.words").alias("w"), F.col("x.times").alias("n"))
    rare = rare.join(counts.where(F.col("c") < lex.cut), F.col("w") == F.col("word"), "left")
    log_count = F.log10(F.coalesce(F.col("c"), F.lit(0)) + F.lit(SMOOTH))
    more = rare.groupBy(F.col("rid").alias("_rid")).agg(F.sum(F.col("n") * log_count).alias("logs"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("hits"))
    logs = F.coalesce("logs", F.lit(0.0))
    out = said.join(more, F.col("rid") == F.col("_rid"), "left")
    return out.select("doc_id", "n_tokens", (F.col("known") + F.coalesce("hits", F.lit(0))).alias("n_known"), (F.col("base") + logs).alias("base_score"), (F.col("model") + logs).alias("score"))


def lm_report(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows whose crc32(doc_id as text) mod 10 is not 0; a null text is the end alone. base_score is the
    smoothed unigram's, score the model's log10 probability of the text with its end. With nothing to learn from,
    train_tokens is 0 and all words are unknown. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    train_rows = docs.where(id_crc("doc_id") % 10 != 0).select("doc_id", "text")
    counts = saved(word_counts(train_rows))
    lex = lexicon(counts, train_rows.count())
    weights = train(train_rows, lex)
    said = score(docs.select("doc_id", "text"), lex, weights, counts)
    held = (id_crc("doc_id") % 10 == 0).alias("held_out")
    return said.select("doc_id", held, "n_tokens", "n_known", F.lit(lex.total).cast("long").alias("train_tokens"), "base_score", "score")
