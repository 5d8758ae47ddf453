"""Hard negatives by a multiway hyperplane tree with distance ranges.

Every inner node holds a few split points; a row goes down to the nearest one. A split point stores, for each sibling's
subtree, the smallest and largest distance to the rows there (over all rows). A search for the rows whose inner product
lies in a window is a search in an annulus: with one more coordinate that lifts all rows to the same length, distance
falls as the product rises. Siblings whose ranges, widened by the anchor's distance to the split point, miss the annulus
are left out; in the leaves that stay every product is computed, in whole numbers.

The tree is fitted on a bounded sample, all rows are placed in it. Anchors meet leaves in blocks: a slab of anchor
blocks of bounded size is broadcast at a time, leaves stay where they are.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, saved

#: Squared lengths from here on don't fit the arithmetic of scores.
TOO_LONG = 2.0**58
FAR = 1 << 60
SLAB_BYTES = 16 << 20


def _distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] + (points * points).sum(axis=1)[None, :] - 2 * (x @ points.T)
    return np.sqrt(np.maximum(d, 0.0))


class Tree:
    """Split points of all nodes. The children of a node are nodes (0 and up) or leaves (-1 - leaf)."""

    def __init__(self, sample: np.ndarray, long2: float, rows: int, leaf_rows: int = 2000, fan: int = 16, most_leaves: int = 4096, seed: int = 7):
        """sample: whole-number rows; long2: the largest squared length of all rows; rows: how many they are."""
        self.long2 = float(long2)
        x, rng = self.lifted(sample), np.random.default_rng(seed)
        each = rows / max(1, len(x))
        self.points: list[np.ndarray] = []
        self.children: list[list[int]] = []
        made, heap = [(-1, 0, np.arange(len(x)))], []  # leaves so far: (parent, place, members of the sample)
        heapq.heappush(heap, (-len(x), 0))
        leaves = 1
        while heap:
            size, k = heapq.heappop(heap)
            parent, place, members = made[k]
            fits = -size * each
            if fits <= leaf_rows or leaves + 1 >= most_leaves:
                continue
            points = self._spread(x[members], min(fan, max(2, math.ceil(fits / leaf_rows)), most_leaves - leaves + 1), rng)
            if len(points) < 2:
                continue  # all the same: the leaf is cut into blocks
            node = len(self.points)
            self.points.append(points)
            self.children.append([0] * len(points))
            if parent >= 0:
                self.children[parent][place] = node
            made[k] = (-1, 0, members[:0])
            near = _distances(x[members], points).argmin(axis=1)
            for j in range(len(points)):
                made.append((node, j, members[near == j]))
                heapq.heappush(heap, (-int((near == j).sum()), len(made) - 1))
            leaves += len(points) - 1
        is_node = {(p, j) for p, kids in enumerate(self.children) for j, c in enumerate(kids) if c > 0}
        self.paths: list[list[tuple[int, int]]] = []  # by leaf: (node, child) from the root on
        stack = [(0, [])] if self.points else []
        while stack:  # leaves are numbered in the tree's order, so that neighbours have near numbers
            node, path = stack.pop()
            for j in reversed(range(len(self.points[node]))):
                if (node, j) in is_node:
                    stack.append((self.children[node][j], path + [(node, j)]))
            for j in range(len(self.points[node])):
                if (node, j) not in is_node:
                    self.children[node][j] = -1 - len(self.paths)
                    self.paths.append(path + [(node, j)])
        if not self.points:
            self.paths = [[]]

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Rows with one more coordinate, so that all have the same length."""
        x = np.asarray(x, dtype=np.float64)
        return np.concatenate([x, np.sqrt(np.maximum(self.long2 - (x * x).sum(axis=1), 0.0))[:, None]], axis=1)

    @staticmethod
    def _spread(x: np.ndarray, m: int, rng: np.random.Generator) -> np.ndarray:
        """Up to m of the rows, far from each other: of 3 * m drawn ones, always the farthest from those taken."""
        some = x[rng.permutation(len(x))[: 3 * m]]
        took, far = [0], _distances(some, some[:1])[:, 0]
        while len(took) < min(m, len(some)) and far.max() > 1e-6 * (1 + np.abs(some).max()):
            took.append(int(far.argmax()))
            far = np.minimum(far, _distances(some, some[took[-1:]])[:, 0])
        return some[took]

    def leaf(self, rows: np.ndarray) -> np.ndarray:
        x, out = self.lifted(rows), np.zeros(len(rows), np.int64)
        stack = [(0, np.arange(len(x)))] if self.points else []
        while stack:
            node, some = stack.pop()
            near = _distances(x[some], self.points[node]).argmin(axis=1)
            for j, child in enumerate(self.children[node]):
                to = some[near == j]
                if child < 0:
                    out[to] = -1 - child
                elif len(to):
                    stack.append((child, to))
        return out

    def spans(self, rows: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest distances of a leaf's rows to the split points of all nodes above it."""
        x = self.lifted(rows)
        d = np.concatenate([_distances(x, self.points[node]) for node, _ in self.paths[leaf]], axis=1)
        return d.min(axis=0), d.max(axis=0)

    def learn(self, spans: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        """ranges[node]: for split point i and sibling j the least and largest distance, over the leaves below j."""
        self.ranges = [(np.full((len(p), len(p)), np.inf), np.full((len(p), len(p)), -np.inf)) for p in self.points]
        for leaf, (low, high) in spans.items():
            at = 0
            for node, j in self.paths[leaf]:
                m = len(self.points[node])
                lo, hi = self.ranges[node]
                lo[:, j] = np.minimum(lo[:, j], low[at : at + m])
                hi[:, j] = np.maximum(hi[:, j], high[at : at + m])
                at += m

    def visits(self, anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[int]:
        """Leaves that may hold a row whose product with an anchor is in one of its windows (a column each)."""
        if not self.points:
            return [0]
        q = np.concatenate([np.asarray(anchors, np.float64), np.zeros((len(anchors), 1))], axis=1)
        base = (q * q).sum(axis=1)[:, None] + self.long2
        near, far = np.sqrt(np.maximum(base - 2.0 * high, 0.0)), np.sqrt(np.maximum(base - 2.0 * low, 0.0))
        slack = 1e-6 * (1.0 + math.sqrt(self.long2))
        out, stack = [], [(0, low <= high)]
        while stack:
            node, alive = stack.pop()
            some = np.flatnonzero(alive.any(axis=1))
            d, (lo, hi) = _distances(q[some], self.points[node]), self.ranges[node]
            for j, child in enumerate(self.children[node]):
                least = np.maximum(d - hi[:, j], lo[:, j] - d).max(axis=1)[:, None] - slack
                most = (d + hi[:, j]).min(axis=1)[:, None] + slack
                on = np.zeros_like(alive)
                on[some] = alive[some] & (least <= far[some]) & (most >= near[some])
                if on.any():
                    out.append(-1 - child) if child < 0 else stack.append((child, on))
        return out


def _first(key_score: np.ndarray, ids: np.ndarray, mask: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's first k columns in mask by score falling, then id."""
    rows, cols = [], []
    full = mask.sum(axis=1)
    for r in np.flatnonzero(full):
        at = np.flatnonzero(mask[r])
        if len(at) > k:
            s = key_score[r, at]
            at = at[s >= np.partition(s, len(at) - k)[len(at) - k]]
        at = at[np.lexsort((ids[at], -key_score[r, at]))[:k]]
        rows.append(np.full(len(at), r))
        cols.append(at)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(cols)


def _matrix(flat, n: int) -> np.ndarray:
    return np.asarray(flat, dtype=np.int64).reshape(n, -1)


def _meet(k: int, same: bool, exact: bool):
    """Pairs of an anchor block and a leaf block: each anchor's first k rows in each window, of its label or others."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                a, x = _matrix(r.a_flat, len(r.a_id)), _matrix(r.flat, len(r.id))
                scores = (a.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64) if exact else a @ x.T
                ids, anchors = np.asarray(r.id), np.asarray(r.a_id)
                labels = np.asarray(r.a_label)[:, None] == np.asarray(r.label)[None, :]
                fit = labels & (anchors[:, None] != ids[None, :]) if same else ~labels
                low, high = _matrix(r.a_low, len(anchors)), _matrix(r.a_high, len(anchors))
                for w in range(low.shape[1]):
                    u, v = _first(scores, ids, fit & (scores >= low[:, w, None]) & (scores <= high[:, w, None]), k)
                    if len(u):
                        yield pd.DataFrame({"anchor": anchors[u], "w": np.full(len(u), w, np.int32), "id": ids[v], "score": scores[u, v]})

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """(anchor, w, place, id, score): the first k of each anchor and window."""
    order = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


class Index:
    """The tree with all rows in it: leaf blocks (leaf, id, label, flat) and anchors (anchor, label, v, leaf, ablk)."""

    def __init__(self, rows: DataFrame, every: int, sample_rows: int = 65_536, leaf_rows: int = 2000, block_rows: int = 4096, anchor_rows: int = 1024):
        """rows: (id, label, v), v of whole numbers and one length, squared lengths below TOO_LONG; saved."""
        self.spark = spark = rows.sparkSession
        norm = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x)
        about = rows.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("long2"), F.max(F.size("v")).alias("dim")).first()
        self.n, self.dim, long2 = about["n"], about["dim"] or 0, about["long2"] or 0.0
        self.exact = long2 < 2.0**53
        share = min(1.0, sample_rows / max(1, self.n))
        sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("v").toPandas()["v"]
        x = np.stack(sample.to_numpy()).astype(np.int64) if len(sample) else np.zeros((0, self.dim))
        self.tree = tree = Tree(x, long2, self.n, leaf_rows)
        held = spark.sparkContext.broadcast(tree)  # at most sample_rows points

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    yield pdf.assign(leaf=held.value.leaf(np.stack(pdf["v"].to_numpy())))

        def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for leaf, part in pdf.groupby("leaf"):
                    low, high = held.value.spans(np.stack(part["v"].to_numpy()), leaf)
                    yield pd.DataFrame({"leaf": leaf, "k": np.arange(len(low)), "low": low, "high": high})

        placed = saved(rows.mapInPandas(place, "id long, label long, v array<int>, leaf long"))
        if tree.points:
            found = placed.select("leaf", "v").mapInPandas(spans, "leaf long, k int, low double, high double").groupBy("leaf", "k").agg(F.min("low").alias("low"), F.max("high").alias("high"))
            table = found.orderBy("leaf", "k").toPandas()  # leaves x split points above them: bounded by the tree
            tree.learn({int(leaf): (p["low"].to_numpy(), p["high"].to_numpy()) for leaf, p in table.groupby("leaf")})
        self.held = spark.sparkContext.broadcast(tree)
        block_rows = max(64, min(block_rows, SLAB_BYTES // (8 * max(1, self.dim))))
        self.anchor_rows = max(64, min(anchor_rows, block_rows))
        sizes = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id") % every == 0).alias("anchors")).orderBy("leaf").toPandas()
        first, plan = 0, []
        for leaf, n, anchors in sizes.itertuples(index=False):  # anchors of neighbouring leaves share blocks
            plan.append((int(leaf), math.ceil(n / block_rows), first // self.anchor_rows, math.ceil(anchors / self.anchor_rows) or 1))
            first += int(anchors)
        self.ablocks = max((p[2] + p[3] for p in plan), default=0)
        cuts = F.broadcast(spark.createDataFrame(plan, "_leaf long, cuts int, first int, acuts int"))  # one row a leaf
        dealt = placed.join(cuts, F.col("leaf") == F.col("_leaf"))
        blk = F.pmod(F.xxhash64("id"), F.col("cuts"))
        packed = dealt.groupBy("leaf", blk.alias("blk")).agg(F.collect_list(F.struct("id", "label", "v")).alias("all"))
        self.blocks = saved(packed.select("leaf", F.col("all.id").alias("id"), F.col("all.label").alias("label"), F.flatten("all.v").alias("flat")))
        ablk = F.col("first") + F.pmod(F.xxhash64("id", F.lit(1)), F.col("acuts"))
        self.anchors = saved(dealt.where(F.col("id") % every == 0).select(F.col("id").alias("anchor"), "label", "v", "leaf", ablk.cast("long").alias("ablk")))

    def search(self, windows: DataFrame, k: int, same: bool, own: bool) -> DataFrame:
        """(anchor, w, place, id, score): the first k rows in each of windows (anchor, low, high), arrays of one length.

        own: looks in the leaf of the anchor alone; otherwise in every leaf that may hold such a row.
        """
        given = self.anchors.join(windows.select(F.col("anchor").alias("_a"), "low", "high"), F.col("anchor") == F.col("_a"))
        part = F.struct("anchor", "label", "v", "low", "high", "leaf")
        packed = given.groupBy("ablk").agg(F.collect_list(part).alias("all"))
        cols = [F.col("all.anchor").alias("a_id"), F.col("all.label").alias("a_label"), F.flatten("all.v").alias("a_flat"), F.flatten("all.low").alias("a_low"), F.flatten("all.high").alias("a_high"), F.array_distinct("all.leaf").alias("leaves")]
        packed = saved(packed.select("ablk", *cols))
        held = self.held

        def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    n = len(r.a_id)
                    to = held.value.visits(_matrix(r.a_flat, n), _matrix(r.a_low, n), _matrix(r.a_high, n))
                    yield pd.DataFrame({"v_ablk": r.ablk, "v_leaf": np.asarray(to, dtype=np.int64)})

        if own:
            to = packed.select(F.col("ablk").alias("v_ablk"), F.explode("leaves").alias("v_leaf"))
        else:
            to = packed.drop("leaves", "a_label").mapInPandas(visits, "v_ablk long, v_leaf long")
        to, packed = saved(to), packed.drop("leaves")
        slab = max(1, SLAB_BYTES // (self.anchor_rows * max(1, self.dim) * 8))
        found = None
        for at in range(0, max(1, self.ablocks), slab):  # a slab's anchors and their visits are bounded
            in_slab = lambda c: (F.col(c) >= at) & (F.col(c) < at + slab)  # noqa: B023, E731
            pairs = self.blocks.join(F.broadcast(to.where(in_slab("v_ablk"))), F.col("leaf") == F.col("v_leaf"))
            pairs = pairs.join(F.broadcast(packed.where(in_slab("ablk"))), F.col("v_ablk") == F.col("ablk"))
            got = pairs.select("id", "label", "flat", "a_id", "a_label", "a_flat", "a_low", "a_high").mapInPandas(_meet(k, same, self.exact), "anchor long, w int, id long, score long")
            got = _best(got, k)
            found = got if found is None else found.union(got)
        return saved(found)  # an anchor is in one slab


def usable(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = 256) -> DataFrame:
    """(id, label, v): the rows that take part, saved, one an id, components as floor(scale * x)."""
    vec = F.col("vec")
    finite = vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull()).where(F.coalesce(finite, F.lit(False)))
    norm = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + (F.abs(x) * scale + 1) * (F.abs(x) * scale + 1))
    rows = rows.where(norm < TOO_LONG).select("id", "label", F.transform("vec", lambda x: F.floor(x * scale).cast("int")).alias("v"))
    rows = saved(rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v"))
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("v") == (usual["d"] if usual else 0))


def mine(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, **how) -> DataFrame:
    """(anchor, positive, place of the positive, negative, rank, both scores) of rows (id, label, v) as from usable.

    Anchors are the ids that `every` divides. The first search, in each anchor's own leaf, gives a bound; the second is
    exact. Negatives score between low and high hundredths of the positive's score.
    """
    index = Index(rows, every, **how)
    arr = lambda c: F.array(c.cast("long"))
    all_of = index.anchors.select("anchor", arr(F.lit(-FAR)).alias("low"), arr(F.lit(FAR)).alias("high"))

    def bound(found: DataFrame, k: int) -> DataFrame:
        return found.where(F.col("place") == k).select(F.col("anchor").alias("_b"), "w", F.col("score").alias("least"))

    near = bound(index.search(all_of, positives, True, True), positives)
    from_there = all_of.join(near, F.col("anchor") == F.col("_b"), "left").select("anchor", arr(F.coalesce("least", F.lit(-FAR))).alias("low"), "high")
    pos = index.search(from_there, positives, True, False)
    # window w of an anchor belongs to its positive in place w + 1; one that is missing is empty
    per = pos.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "score"))).alias("p"))  # `positives` at most
    at_most = F.transform("p", lambda p: p["score"])
    filled = F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.get(F.col("hi"), i))
    lo = F.transform("hi", lambda s: F.when(s >= 0, F.call_function("div", s * low + (high - 1), F.lit(high).cast("long"))).otherwise(F.lit(FAR)))  # below zero it is empty
    wins = per.select("anchor", at_most.alias("hi")).select("anchor", filled.alias("hi"))
    wins = saved(wins.select("anchor", F.transform(lo, lambda x: F.coalesce(x, F.lit(FAR))).alias("low"), F.transform("hi", lambda s: F.coalesce(s, F.lit(-FAR))).alias("high")))
    near = bound(index.search(wins, negatives, False, True), negatives)
    near = near.groupBy(F.col("_b")).agg(F.map_from_entries(F.collect_list(F.struct("w", "least"))).alias("m"))
    closer = wins.join(near, F.col("anchor") == F.col("_b"), "left")
    closer = closer.select("anchor", F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("m", i), x))).alias("low"), "high")
    neg = index.search(closer, negatives, False, False)
    pos = pos.select(F.col("anchor").alias("_a"), F.col("place").alias("_p"), F.col("id").alias("positive"), F.col("score").alias("positive_score"))
    out = neg.join(pos, (F.col("anchor") == F.col("_a")) & (F.col("w") + 1 == F.col("_p")))
    return out.select("anchor", "positive", F.col("_p").alias("positive_place"), F.col("id").alias("negative"), F.col("place").alias("rank"), "positive_score", F.col("score").alias("negative_score"))


def negatives_report(table: DataFrame, **how) -> DataFrame:
    """One row per anchor, positive and negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows with a null id, label or vector, or with null or non-finite components, take no part; nor do vectors of another
    length than most rows have (the longer at a tie), nor those so long (squared length of 256 * x from 2**58 on) that a
    score would not fit. Rows that repeat an id count once, the least by label, then vector. Where 7 divides the id, the
    label becomes (label + 1) % 10. Ties go to the smaller id. A positive whose score is negative has an empty window;
    empty vectors score 0. Extra columns are not read; an empty table gives no rows.
    """
    spark = table.sparkSession
    bounded_batches(spark)
    label = F.col("label").cast("long")
    rows = table.select("vec_id", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), "embedding")
    got = mine(usable(rows), **how)
    return got.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int"), F.col("negative").alias("negative_id"), "positive_score", "negative_score")


ORACLE = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
