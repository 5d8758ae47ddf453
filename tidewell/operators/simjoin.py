"""Exact similarity joins and searches that leave out what a bound excludes.

Sparse vectors (hashed texts) meet by prefixes: features are ordered by how rare they are, and a vector's prefix are those
from which on its norm still reaches the threshold. The rarest feature that two vectors share lies in both prefixes if
their cosine reaches the threshold, since the product has nothing before it; so a join on prefix features loses no pair.

The nearest of each vector are found by comparing all pairs of blocks by one product of matrices, of short vectors that
can't be less alike (`near_pairs`).

Dense vectors meet by pivots: each belongs to the nearest one, which knows the largest distance of its vectors. By the
triangle inequality two pivots' vectors, or a pivot's and a query, are skipped if they can't be near enough.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import saved

_NONE = {"a": "int64", "b": "int64", "sim": "float64"}


def _unit(rows) -> np.ndarray:
    x = np.stack(list(rows)).astype(np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def dealt(n: Column, dim: Column, block: int) -> Column:
    """Into how many blocks n vectors are dealt: blocks of `block` rows up to 16 of them; beyond, blocks grow to a million
    numbers (and `block` rows at least), so that a row goes to few tasks and a task still holds little."""
    most = F.greatest(F.lit(block), F.floor(F.lit(1 << 20) / F.greatest(dim, F.lit(1))))
    return F.least(F.ceil(n / block), F.greatest(F.lit(16), F.ceil(n / most))).cast("int")


def best_of(found: pd.DataFrame, most: int) -> pd.DataFrame:
    """Pairs (a, b, sim) that are among the `most` best of one of their ends."""
    good = np.zeros(len(found), bool)
    for me, it in (("a", "b"), ("b", "a")):
        ranked = found.assign(row=np.arange(len(found))).sort_values([me, "sim", it], ascending=[True, False, True])
        good[ranked["row"].to_numpy()[ranked.groupby(me).cumcount().to_numpy() < most]] = True
    return found[good]


def forest(found: pd.DataFrame) -> pd.DataFrame:
    """As few pairs (a, b, sim) as join the same ids: each id with the smallest one it is joined to; sim is null."""
    names, at = np.unique(np.concatenate([found["a"], found["b"]]), return_inverse=True)
    x, y = at[: len(found)], at[len(found) :]
    root = np.arange(len(names))
    while len(x):  # roots fall to the smallest beside them until all pairs agree
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while (root != root[root]).any():
            root = root[root]
        differ = root[x] != root[y]
        x, y = x[differ], y[differ]
    keep = root != np.arange(len(names))
    return pd.DataFrame({"a": names[root[keep]], "b": names[keep], "sim": np.nan})


def kept(parts: Iterator[pd.DataFrame], fewer: Callable[[pd.DataFrame], pd.DataFrame] | None, many: int = 1_000_000) -> Iterator[pd.DataFrame]:
    """A task's pairs: as they come, or, if `fewer` says which ones are enough, these, with few more than `many` held."""
    held, n = [], 0
    for part in parts:
        if fewer is None:
            yield part
            continue
        held, n = [*held, part], n + len(part)
        if n > many:
            held = [fewer(pd.concat(held))]
            n = len(held[0])
            many = max(many, 2 * n)
    if n:
        yield fewer(pd.concat(held))


def prefixes(vectors: DataFrame, threshold: float) -> DataFrame:
    """(id, idx, val, key): unit vectors by their features that are not 0, numbered from the rarest on, a row for each key
    in the prefix. threshold is above 0; null and zero vectors have none. The order of features, one number for each
    dimension, comes to the driver."""
    rows = vectors.where("id is not null and v is not null").select("id", "v")
    seen = rows.select(F.explode(F.filter(F.sequence(F.lit(0), F.size("v") - 1), lambda i: F.get("v", i) != 0)).alias("d")).groupBy("d").count()
    order = {r["d"]: k for k, r in enumerate(sorted(seen.collect(), key=lambda r: (r["count"], r["d"])))}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, v in zip(pdf["id"], pdf["v"]):
                v = np.asarray(v, dtype=np.float64)
                at = np.flatnonzero(v)
                if not len(at):
                    continue
                idx = np.array([order[d] for d in at])
                by = np.argsort(idx)
                idx, val = idx[by], v[at][by] / np.linalg.norm(v)
                rest = np.sqrt(np.cumsum((val * val)[::-1])[::-1])  # the norm from each feature on
                out.append((i, idx.astype(np.int32), val, idx[rest >= threshold - 1e-9].astype(np.int32)))
            yield pd.DataFrame(out, columns=["id", "idx", "val", "keys"])

    made = rows.mapInPandas(run, "id long, idx array<int>, val array<double>, keys array<int>")
    return made.select("id", "idx", "val", F.explode("keys").alias("key"))


def compared(entries: DataFrame) -> DataFrame:
    """(pairs): how many pairs a join on prefixes compares, one row."""
    n = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.coalesce(F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("long")), F.lit(0)).alias("pairs"))


def sparse_edges(vectors: DataFrame, threshold: float, block: int = 1000, most: int | None = None) -> DataFrame:
    """(a, b, sim), a < b: all pairs of sparse vectors (id, v) with cosine >= threshold > 0, each once, none lost.

    A pair is given where its rarest common feature is the key. A frequent key is cut into blocks that meet two by two,
    so that a task holds two blocks, whatever is in a key. With `most`, a task gives only the best `most` of each row
    among its pairs: what is left out cannot be among the `most` best of either end.
    """
    rows = saved(prefixes(vectors, threshold))
    sizes = rows.groupBy(F.col("key").alias("_k")).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("idx")).alias("dim")).where("n > 1").select("_k", dealt(F.col("n"), F.col("dim") * 4, block).alias("n"))
    rows = rows.join(sizes, F.col("key") == F.col("_k")).withColumn("k", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("key", "id", "idx", "val", "k", F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"))

    def pairs(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        key, one = pdf["key"].iloc[0], pdf["i"].iloc[0] == pdf["j"].iloc[0]
        used, where = np.unique(np.concatenate(pdf["idx"].to_numpy()), return_inverse=True)
        x = np.zeros((len(pdf), len(used)))
        x[np.repeat(np.arange(len(pdf)), pdf["idx"].map(len)), where] = np.concatenate(pdf["val"].to_numpy())
        first, other = (np.flatnonzero(pdf["k"] == pdf[c]) for c in ("i", "j"))
        ids, y = pdf["id"].to_numpy(), x[other]
        for lo in range(0, len(first), 512):
            u, v = np.nonzero(x[first[lo : lo + 512]] @ y.T >= threshold)
            left, right = first[u + lo], other[v]
            keep = ids[left] < ids[right] if one else ids[left] != ids[right]
            left, right = left[keep], right[keep]
            for at in range(0, len(left), 4096):
                a, b = left[at : at + 4096], right[at : at + 4096]
                mine = used[((x[a] != 0) & (x[b] != 0)).argmax(axis=1)] == key
                a, b = a[mine], b[mine]
                yield pd.DataFrame({"a": np.minimum(ids[a], ids[b]), "b": np.maximum(ids[a], ids[b]), "sim": np.clip((x[a] * x[b]).sum(axis=1), -1, 1)})

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from kept(pairs(pd.concat(list(batches), ignore_index=True)), most and (lambda found: best_of(found, most)))

    meet.__annotations__ = {"batches": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    return rows.groupBy("key", "i", "j").applyInPandas(meet, "a long, b long, sim double")


class _Nearest:
    """The `most` best pairs of each of n vectors: by how far apart they are, 1 less the cosine to 12 digits, then by number,
    which rises for a vector from one add to the next. `low` is what a pair must reach to be among them; few more than
    `many` pairs are held, or twice what is to be kept."""

    def __init__(self, n: int, most: int, threshold: float, many: int):
        self.most, self.many, self.low = most, many, np.full(n, threshold)
        self.parts, self.held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0

    def add(self, me: np.ndarray, it: np.ndarray, sim: np.ndarray) -> None:
        good = sim >= self.low[me]
        self.parts.append((me[good], it[good], sim[good]))
        self.held += len(self.parts[-1][0])
        if self.held > self.many:
            self.many = max(self.many, 2 * len(self.best()[0]))

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(me, it, sim) by me, the best first."""
        me, it, sim = (np.concatenate(p) for p in zip(*self.parts))
        by = np.argsort(me << 42 | _far(sim), kind="stable")
        me, it, sim = me[by], it[by], sim[by]
        starts = np.flatnonzero(np.diff(me, prepend=-1))
        rank = np.arange(len(me)) - np.repeat(starts, np.diff(starts, append=len(me)))
        last = rank == self.most - 1
        self.low[me[last]] = np.maximum(self.low[me[last]], sim[last] - 1e-11)
        good = rank < self.most
        self.parts, self.held = [(me[good], it[good], sim[good])], int(good.sum())
        return self.parts[0]


def _far(sim: np.ndarray) -> np.ndarray:
    return np.rint((1 - sim) * 1e12).astype(np.int64)


def _set(hits: np.ndarray) -> np.ndarray:
    """The places of a few true values, eight at a time."""
    flat = hits.ravel()
    if flat.size % 8:
        return np.flatnonzero(flat)
    some = flat.reshape(-1, 8)
    rows = np.flatnonzero(flat.view(np.uint64))
    x, y = np.nonzero(some[rows])
    return rows[x] * 8 + y


def folded(unit: np.ndarray) -> np.ndarray:
    """Shorter vectors whose products are no smaller: the heaviest positions as they are, of each four others the norm."""
    dim = unit.shape[1]
    by = np.argsort(-np.einsum("ij,ij->j", unit, unit), kind="stable")
    own = dim // 16
    groups = max(1, -(-(dim - own) // 4))
    out = np.zeros((len(unit), own + groups), unit.dtype)
    for k, position in enumerate(by[own:]):
        out[:, own + k % groups] += unit[:, position] ** 2
    out[:, own:] = np.sqrt(out[:, own:])
    out[:, :own] = unit[:, by[:own]]
    return out


def near_pairs(vectors: DataFrame, threshold: float, most: int, sparse: bool = False, block: int = 2000) -> DataFrame:
    """(a, b, sim), a < b: the pairs of vectors (id, v) with cosine >= threshold that are among the `most` nearest of one
    of their ends, exactly; ties (to 12 digits) by id. Vectors hold finite numbers, not all 0; those of unlike lengths
    never meet. sparse: most numbers are 0, so that only the others travel and `folded` vectors exclude most pairs.

    All pairs are compared, by products of 512 by 2,048 vectors in single precision; what may reach the threshold and the
    worst of the `most` found so far is worked out in double precision. Rows are dealt into blocks, a task holds two: of
    `block` rows up to 8 blocks, beyond that of 8 million numbers and 131,072 rows at most, so that a row goes to few
    tasks. A task gives at most `most` others for each row.
    """
    d = F.size("v")
    rows = vectors.select("id", "v", d.alias("d"))
    n = rows.groupBy(F.col("d").alias("_d")).agg(F.count(F.lit(1)).alias("n"))
    full = F.greatest(F.lit(block), F.least(F.lit(1 << 17), F.floor(F.lit(1 << 23) / F.greatest(F.col("_d"), F.lit(1)))))
    n = n.select("_d", F.least(F.ceil(F.col("n") / block), F.greatest(F.lit(8), F.ceil(F.col("n") / full))).cast("int").alias("n"))
    at = F.filter(F.sequence(F.lit(0), F.col("d") - 1), lambda i: F.get("v", i) != 0) if sparse else F.lit(None).cast("array<int>")
    rows = rows.select("id", "d", at.alias("at"), (F.filter("v", lambda x: x != 0) if sparse else F.col("v")).alias("x"))
    n = saved(n)  # one row for each length
    tasks = n.agg(F.sum(F.col("n") * (F.col("n") + 1) / 2)).first()[0] or 1
    rows = rows.join(F.broadcast(n), F.col("d") == F.col("_d")).withColumn("k", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("d", "id", "at", "x", "k", F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"))

    def meet(t: pa.Table) -> pa.Table:
        d, i, j = (t.column(c)[0].as_py() for c in ("d", "i", "j"))
        ids, k, lists = t.column("id").to_numpy(), t.column("k").to_numpy(), t.column("x").combine_chunks()
        by = np.lexsort((ids, k))
        values, row = lists.flatten().to_numpy(zero_copy_only=False), np.empty(len(by), np.int64)
        row[by] = np.arange(len(by))
        x = np.zeros((len(by), d), values.dtype)
        if sparse:
            x[np.repeat(row, lists.value_lengths().to_numpy()), t.column("at").combine_chunks().flatten().to_numpy()] = values
        else:
            x[row] = values.reshape(len(by), d)
        ids, n = ids[by], int((k == i).sum())
        first, other = (0, n), (0, n) if i == j else (n, len(ids))
        if x.dtype == np.float64:
            x /= np.abs(x).max(axis=1, keepdims=True)  # squares neither vanish nor overflow
        norm = np.concatenate([np.sqrt(np.einsum("ij,ij->i", p, p)) for p in (x[at : at + 4096].astype(np.float64) for at in range(0, len(x), 4096))])
        short = np.concatenate([(x[at : at + 4096] / norm[at : at + 4096, None]).astype(np.float32) for at in range(0, len(x), 4096)])
        short = np.ascontiguousarray(folded(short)) if sparse and d >= 32 else short
        tiles = [(c, np.ascontiguousarray(short[c : min(c + 2048, other[1])].T)) for c in range(*other, 2048)]
        theirs, found, room, hits = _Nearest(len(ids), most, threshold, 1_000_000), [], np.empty(512 * 2048, np.float32), np.empty(512 * 2048, bool)
        for lo in range(*first, 512):
            some = short[lo : min(lo + 512, first[1])]
            mine = _Nearest(lo + len(some), most, threshold, 1024 * most)
            for c, tile in tiles:
                wide, all_ = tile.shape[1], len(some) * tile.shape[1]
                sim = np.matmul(some, tile, out=room[:all_].reshape(len(some), wide))
                least = mine.low[lo:].min() if i == j else min(mine.low[lo:].min(), theirs.low[c : c + wide].min())
                flat = _set(np.greater_equal(sim, np.float32(least - 1e-5), out=hits[:all_].reshape(len(some), wide)))
                may, u, v = room[flat] + 1e-5, flat // wide + lo, flat % wide + c
                good = (may >= mine.low[u]) & (u != v) if i == j else (may >= mine.low[u]) | (may >= theirs.low[v])
                u, v = u[good], v[good]
                for k in range(0, len(u), 4096):
                    a, b = u[k : k + 4096], v[k : k + 4096]
                    exact = np.clip(np.einsum("ij,ij->i", x[a].astype(np.float64), x[b].astype(np.float64)) / (norm[a] * norm[b]), -1, 1)
                    mine.add(a, b, exact)
                    if i != j:
                        theirs.add(b, a, exact)
            found.append(mine.best())
        me, it, sim = (np.concatenate(p) for p in zip(*found, theirs.best()))
        starts = np.flatnonzero(np.diff(me, prepend=-1))
        near = pa.StructArray.from_arrays([pa.array(_far(sim)), pa.array(ids[it]), pa.array(sim)], ["far", "other", "sim"])
        near = pa.ListArray.from_arrays(pa.array(np.append(starts, len(me)).astype(np.int32)), near)
        return pa.table({"id": ids[me[starts]], "near": near})

    rows = rows.repartition(min(4 * int(tasks), 4000), "d", "i", "j")  # few pairs of blocks share a task
    found = rows.groupBy("d", "i", "j").applyInArrow(meet, "id long, near array<struct<far: long, other: long, sim: double>>")
    near = found.groupBy("id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, most).alias("near"))  # `most` of each task it was in
    near = near.select("id", F.explode("near").alias("to")).select("id", "to.other", "to.sim")
    return near.groupBy(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).agg(F.max("sim").alias("sim"))


class Pivots:
    """Vectors (id, v) of one length stored by pivot in a shared folder: p and d, the nearest pivot and the distance of
    the unit vectors. At most `most` pivots, drawn by a hash, come to the driver, each with its largest distance."""

    def __init__(self, vectors: DataFrame, place: str, rows_each: int = 2000, most: int = 512):
        self.spark = vectors.sparkSession
        rows = vectors.where(F.col("v").isNotNull() & F.col("id").isNotNull() & F.exists("v", lambda x: x != 0)).select("id", F.col("v").cast("array<double>").alias("v"))
        n = rows.count()
        wanted = max(1, min(most, math.ceil(n / rows_each)))
        drawn = rows.orderBy(F.xxhash64("id"), "id").limit(wanted).toPandas()
        self.points = points = _unit(drawn["v"]) if len(drawn) else np.zeros((0, 1))

        def place_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    d = np.sqrt(np.maximum(0.0, 2 - 2 * (_unit(pdf["v"]) @ points.T)))
                    yield pdf.assign(p=d.argmin(axis=1).astype(np.int32), d=d.min(axis=1))

        rows.mapInPandas(place_rows, "id long, v array<double>, p int, d double").repartition("p").write.mode("overwrite").partitionBy("p").parquet(place)
        self.rows = self.spark.read.schema("id long, v array<double>, d double, p int").parquet(place) if n else rows.selectExpr("id", "v", "0D AS d", "0 AS p")
        far = {r["p"]: (r["far"], r["n"]) for r in self.rows.groupBy("p").agg(F.max("d").alias("far"), F.count(F.lit(1)).alias("n")).collect()}
        self.far = np.array([far.get(k, (-1.0, 0))[0] for k in range(len(points))])
        self.sizes = np.array([far.get(k, (-1.0, 0))[1] for k in range(len(points))], dtype=np.int64)

    def near(self, reach: float) -> list[tuple[int, int]]:
        """Pairs of pivots, p <= q, with vectors that may be as near as `reach`."""
        d = np.sqrt(np.maximum(0.0, 2 - 2 * (self.points @ self.points.T)))
        fits = (d - self.far[:, None] - self.far[None, :] <= reach + 1e-9) & (self.sizes[:, None] > 0) & (self.sizes[None, :] > 0)
        return [(int(p), int(q)) for p, q in zip(*np.nonzero(np.triu(fits)))]

    def bundles(self, block: int) -> list[tuple[int, int, int, int]]:
        """(pivot, pieces, piece, bundle): pivots dealt into bundles of `block` rows or little more, near ones together; a
        larger pivot is cut into pieces. As many rows as there are pivots and bundles."""
        d, left, chain = 1 - self.points @ self.points.T, set(np.flatnonzero(self.sizes > 0).tolist()), []
        while left:
            rest = sorted(left)
            chain.append(rest[int(d[chain[-1], rest].argmin())] if chain else rest[0])
            left.discard(chain[-1])
        out, bundle, held = [], 0, 0
        for p in chain:
            pieces = math.ceil(int(self.sizes[p]) / block)
            for k in range(pieces):
                n = int(self.sizes[p]) // pieces + 1
                if held and held + n > block:
                    bundle, held = bundle + 1, 0
                out.append((p, pieces, k, bundle))
                held += n
        return out

    def edges(self, threshold: float, block: int | None = None) -> DataFrame:
        """(a, b, sim), a < b: all pairs with cosine >= threshold, of pivots that may have some.

        A task has two bundles of pivots and compares those pivots of them that may be near, so a row goes to as many
        tasks as there are bundles with such pivots, and a task holds two bundles, whatever the table's size. Bundles have
        2,000 rows up to 16 of them; beyond, they grow to a million numbers.
        """
        n, dim = int(self.sizes.sum()), self.points.shape[1]
        block = block or max(2000, min(max(2000, (1 << 20) // dim), math.ceil(n / 16)))
        fits = set(self.near(math.sqrt(max(0.0, 2 - 2 * threshold))))
        made = self.bundles(block)
        held: dict[int, set[int]] = {}
        for p, _, _, bundle in made:
            held.setdefault(bundle, set()).add(p)
        meets = {b: [c for c in held if any((min(p, q), max(p, q)) in fits for p in held[b] for q in held[c])] for b in held}
        cut = self.spark.createDataFrame([(p, pieces, k, b, meets[b]) for p, pieces, k, b in made] or [(-1, 1, 0, -1, [])], "c int, n int, piece int, b int, meets array<int>")  # bounded by pivots and bundles
        same = (F.col("p") == F.col("c")) & (F.pmod(F.xxhash64("id"), F.col("n")) == F.col("piece"))
        rows = self.rows.join(F.broadcast(cut), same).withColumn("o", F.explode("meets"))
        rows = rows.select("id", "v", "p", "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))

        def pairs(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
            pdf = pdf.sort_values(["p", "id"], ignore_index=True)
            one = pdf["i"].iloc[0] == pdf["j"].iloc[0]
            first, other = (np.flatnonzero(pdf["b"] == pdf[c]) for c in ("i", "j"))
            x, ids, p = _unit(pdf["v"]), pdf["id"].to_numpy(), pdf["p"].to_numpy()
            there = np.unique(p[other])
            for mine in np.unique(p[first]):
                near = [q for q in there if (min(mine, q), max(mine, q)) in fits]
                to, rows_ = other[np.isin(p[other], near)], first[p[first] == mine]
                y = x[to].T
                for at in range(0, len(rows_) if len(to) else 0, 512):
                    from_ = rows_[at : at + 512]
                    sim = x[from_] @ y
                    u, v = np.nonzero(sim >= threshold)
                    a, b = ids[from_[u]], ids[to[v]]
                    keep = a < b if one else a != b
                    yield pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "sim": np.clip(sim[u, v][keep], -1, 1)})

        def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            yield from kept(pairs(pd.concat(list(batches), ignore_index=True)), None)

        meet.__annotations__ = {"batches": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
        return rows.groupBy("i", "j").applyInPandas(meet, "a long, b long, sim double")

    def nearest(self, queries: DataFrame, top: int = 10, block: int = 2000) -> DataFrame:
        """(q, id, sim, r, parts): the `top` most similar vectors of each query (q, qv), itself left out, ties (to nine
        digits) by id. A query's own pivot is searched first; its last similarity there says which other pivots may
        have better ones. parts is the number of pivots searched; the others' folders are not read for it."""
        points, far, sizes = self.points, self.far, self.sizes

        def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for q, v, least in zip(pdf["q"], pdf["qv"], pdf["least"]):
                    d = np.sqrt(np.maximum(0.0, 2 - 2 * (points @ _unit([v])[0])))
                    if least > 1:  # the first search
                        to = [int(np.where(sizes > 0, d, np.inf).argmin())] if sizes.any() else []
                    else:
                        reach = math.sqrt(max(0.0, 2 - 2 * (least - 1e-9)))
                        to = np.flatnonzero((d - far <= reach + 1e-9) & (sizes > 0)).tolist()
                    yield pd.DataFrame({"q": [q] * len(to), "qv": [v] * len(to), "p": np.array(to, np.int32), "parts": np.array([len(to)] * len(to), np.int32)})

        def best(mine: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            out = [pd.DataFrame({"q": [], "id": [], "sim": [], "parts": []}).astype({"q": "int64", "id": "int64", "sim": "float64", "parts": "int32"})]
            if len(mine) and len(asked):
                mine = mine.sort_values("id")
                x, ids = _unit(mine["v"]), mine["id"].to_numpy()
                sim = np.clip(_unit(asked["qv"]) @ x.T, -1, 1)
                sim[asked["q"].to_numpy()[:, None] == ids[None, :]] = -2
                k = np.argsort(-np.round(sim, 9), axis=1, kind="stable")[:, :top]
                row = np.repeat(np.arange(len(k)), k.shape[1])
                got = pd.DataFrame({"q": asked["q"].to_numpy()[row], "id": ids[k.ravel()], "sim": sim[row, k.ravel()], "parts": asked["parts"].to_numpy()[row]})
                out.append(got[got["sim"] > -2])
            return pd.concat(out)

        def search(asked: DataFrame) -> DataFrame:
            to = saved(asked.mapInPandas(visits, "q long, qv array<double>, p int, parts int"))
            read = [r["p"] for r in to.select("p").distinct().collect()]  # pivots at most
            cut = F.broadcast(self.spark.createDataFrame([(k, max(1, math.ceil(int(n) / block))) for k, n in enumerate(sizes)] or [(-1, 1)], "c int, n int"))
            rows = self.rows.where(F.col("p").isin(read)).join(cut, F.col("p") == F.col("c")).withColumn("k", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
            asked_ = to.join(cut, F.col("p") == F.col("c")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
            lots = asked_.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / F.max("n") / block).cast("int").alias("lots")).withColumnRenamed("p", "_p")  # queries go in blocks, too
            asked_ = asked_.join(lots, F.col("p") == F.col("_p")).withColumn("lot", F.pmod(F.xxhash64("q"), F.col("lots")).cast("int"))
            rows = rows.join(lots, F.col("p") == F.col("_p")).withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
            found = rows.select("id", "v", "p", "k", "lot").groupBy("p", "k", "lot").cogroup(asked_.select("q", "qv", "parts", "p", "k", "lot").groupBy("p", "k", "lot")).applyInPandas(best, "q long, id long, sim double, parts int")
            w = Window.partitionBy("q").orderBy(F.desc(F.round("sim", 9)), "id")
            return found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top)

        asked = saved(queries.where("q is not null and qv is not null").select(F.col("q").cast("long").alias("q"), F.col("qv").cast("array<double>").alias("qv")))
        first = search(asked.withColumn("least", F.lit(2.0)))
        bound = first.groupBy(F.col("q").alias("_q")).agg(F.max(F.when(F.col("r") == top, F.col("sim"))).alias("least"))
        again = asked.join(bound, F.col("q") == F.col("_q"), "left").select("q", "qv", F.coalesce("least", F.lit(-1.0)).alias("least"))  # too few there: all pivots
        return search(again)
