"""Embedding near-duplicates by lattice hashing.

Each table projects the unit vectors onto random orthonormal blocks of eight dimensions and decodes each block to
the nearest point of the E8 lattice; the points together name a cell. A vector lives in its own cell and visits
neighbouring ones (the next nearest points of each block). Vectors that meet are verified by cosine in double
precision, so no pair below the threshold links; every pair is counted once, in the first table and cell where it
can meet. Equal vectors are one class beforehand, and a crowded cell is cut into blocks that meet two by two.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, components, saved

THRESHOLD = 0.95


def _minimal() -> np.ndarray:
    """The 240 shortest vectors of E8: the steps to the neighbouring points."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    halves = np.array(list(itertools.product((0.5, -0.5), repeat=8)))
    return np.concatenate([np.array(out), halves[(halves < 0).sum(axis=1) % 2 == 0]])


STEPS = _minimal()


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest integer points of even coordinate sum."""
    near = np.rint(x)
    off = x - near
    worst, row = np.abs(off).argmax(axis=1), np.arange(len(x))
    odd = near.sum(axis=1) % 2 != 0
    near[row[odd], worst[odd]] += np.where(off[row, worst] >= 0, 1.0, -1.0)[odd]
    return near


def nearest(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row: of the even integer points and those moved by a half, the nearer one."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


class Tables:
    """The hash tables for vectors of one dimension; a seed decides the projections."""

    def __init__(self, dim: int, tables: int = 6, blocks: int = 2, probes: int = 3, scale: float = 4.5, seed: int = 1):
        rng, wide = np.random.default_rng([seed, dim]), 8 * blocks
        self.blocks, self.probes, self.tables = blocks, probes, tables
        self.maps = []
        for _ in range(tables):
            g = rng.normal(size=(max(dim, wide), wide))
            self.maps.append(np.linalg.qr(g)[0][:dim] * scale * np.sqrt(max(dim, wide) / 64))
        self.salts = rng.integers(1, 2**63, size=(tables, blocks, 8), dtype=np.uint64) | np.uint64(1)
        choices = itertools.product(range(probes + 1), repeat=blocks)
        self.moves = sorted((c for c in choices if sum(x > 0 for x in c) <= 2), key=lambda c: (sum(c), c))

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """(rows, tables, cells): hashes of the own cell, which comes first, and of those to visit."""
        out = np.zeros((len(unit), self.tables, len(self.moves)), dtype=np.int64)
        for t, m in enumerate(self.maps):
            parts = []
            for k in range(self.blocks):
                x = unit @ m[:, 8 * k : 8 * k + 8]
                own = nearest(x)
                step = np.argsort(-((x - own) @ STEPS.T), axis=1, kind="stable")[:, : self.probes]
                points = np.concatenate([own[:, None], own[:, None] + STEPS[step]], axis=1) * 2
                parts.append((points.astype(np.int64).astype(np.uint64) * self.salts[t, k]).sum(axis=2, dtype=np.uint64))
            for i, move in enumerate(self.moves):
                h = sum((parts[k][:, c] * np.uint64(2 * k + 3) for k, c in enumerate(move)), np.zeros(len(unit), np.uint64)) + np.uint64(t)
                h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
                out[:, t, i] = (h ^ (h >> np.uint64(29))).view(np.int64)
        return out


def _hash(classes: DataFrame, **how) -> DataFrame:
    """(cid, cell, own): where each class lives and what it visits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict[int, Tables] = {}
        for pdf in batches:
            size = pdf["vec"].map(len)
            for dim, part in pdf.groupby(size):
                x = np.stack(part["vec"].to_numpy())
                cells = made.setdefault(dim, Tables(dim, **how)).cells(x / np.linalg.norm(x, axis=1, keepdims=True))
                for at in range(0, len(part), 2048):
                    c = cells[at : at + 2048].reshape(-1, cells.shape[2])
                    yield pd.DataFrame({"cid": np.repeat(part["cid"].to_numpy()[at : at + 2048], cells.shape[1] * cells.shape[2]), "cell": c.ravel(), "own": np.tile(np.arange(cells.shape[2]) == 0, len(c))})

    return classes.select("cid", "vec").mapInPandas(run, "cid long, cell long, own boolean")


@functools.lru_cache(maxsize=8)
def _tables(dim: int, how: tuple) -> Tables:
    return Tables(dim, **dict(how))


def _links(g: dict[str, np.ndarray], threshold: float, how: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Of one block of a cell: (cid, smallest cid linked to, number of vectors linked to) of members with links."""
    cid, n, own, blk, x = g["cid"], g["n"], g["own"], g["blk"], g["vec"]
    norm = np.sqrt((x * x).sum(axis=1))
    unit = x / norm[:, None]
    us, vs = [], []
    for at in range(0, len(cid), 512):
        some = slice(at, at + 512)
        near = (unit[some] @ unit.T) >= threshold - 1e-9
        near &= (own[some, None] | own[None, :]) & (cid[some, None] < cid[None, :])
        if g["i"][0] != g["j"][0]:
            near &= blk[some, None] != blk[None, :]
        u, v = np.nonzero(near)
        us.append(u + at)
        vs.append(v)
    u, v = np.concatenate(us), np.concatenate(vs)
    if not len(u):
        return None
    cells, cell, keep = _tables(x.shape[1], how).cells(unit), g["cell"][0], []
    for at in range(0, len(u), 50_000):
        a, b = u[at : at + 50_000], v[at : at + 50_000]
        exact = (x[a] * x[b]).sum(axis=1) / (norm[a] * norm[b]) >= threshold
        at_a = (cells[a][:, :, :1] == cells[b]).any(axis=2)  # by table: b comes to where a lives
        at_b = (cells[b][:, :, :1] == cells[a]).any(axis=2)
        t, row = (at_a | at_b).argmax(axis=1), np.arange(len(a))
        keep.append(exact & (np.where(at_a[row, t], cells[a, t, 0], cells[b, t, 0]) == cell))
    kept = np.concatenate(keep)
    u, v = u[kept], v[kept]
    if not len(u):
        return None
    count = np.bincount(u, weights=n[v], minlength=len(cid)) + np.bincount(v, weights=n[u], minlength=len(cid))
    order = np.argsort(cid)
    rank = np.empty(len(cid), np.int64)
    rank[order] = np.arange(len(cid))  # labels by the order of cid, so that the smallest wins
    while True:
        least = rank.copy()
        np.minimum.at(least, u, rank[v])
        np.minimum.at(least, v, rank[u])
        least = np.minimum(least, least[order][least])
        if (least == rank).all():
            break
        rank = least
    some = count > 0
    return cid[some], cid[order[rank[some]]], count[some].astype(np.int64)


def _meet(threshold: float, how: tuple):
    """The work of a partition sorted by (cell, i, j): one block after the other, each as soon as it is complete."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = None
        for pdf in itertools.chain(batches, [None]):
            rows = left if pdf is None else pdf if left is None else pd.concat([left, pdf], ignore_index=True)
            if rows is None or not len(rows):
                continue
            keys = rows[["cell", "i", "j"]].to_numpy()
            first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
            ends = np.append(first[1:], len(rows))
            done = len(first) if pdf is None else len(first) - 1  # the last block may go on in the next batch
            left = rows.iloc[first[-1] :].reset_index(drop=True) if pdf is not None else None
            cols, out = {c: rows[c].to_numpy() for c in rows.columns}, []
            for a, b in zip(first[:done], ends[:done]):
                if b - a > 1:
                    _, once = np.unique(cols["cid"][a:b], return_index=True)
                    vecs = cols["vec"][a:b][once]
                    dims = np.array([len(v) for v in vecs])
                    for dim in np.unique(dims):  # vectors of different lengths never link
                        pick = once[dims == dim] + a
                        if len(pick) > 1:
                            g = {c: cols[c][pick] for c in cols if c != "vec"} | {"vec": np.stack(cols["vec"][pick])}
                            found = _links(g, threshold, how)
                            if found is not None:
                                out.append(found)
            if out:
                yield pd.DataFrame(dict(zip(("cid", "root", "n"), (np.concatenate(x) for x in zip(*out)))))

    return run


def linked(classes: DataFrame, threshold: float = THRESHOLD, block: int = 2000, **how) -> DataFrame:
    """(cid, root, n): links of classes (cid, vec, n) as found, block by block; n counts the vectors linked to.

    A cell of more than `block` records is cut into blocks; each pair of blocks meets in a task of its own.
    """
    hashed = saved(_hash(classes, **how))
    live = hashed.groupBy(F.col("cell").alias("_cell")).agg(F.count(F.lit(1)).alias("all"), F.max("own").alias("lived")).where("lived and all > 1")
    live = live.select("_cell", F.ceil(F.col("all") / block).cast("int").alias("blocks"))
    at = hashed.join(live, F.col("cell") == F.col("_cell")).select("cid", "cell", "own", "blocks")
    at = at.withColumn("blk", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    at = at.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    at = at.select("cid", "cell", "own", "blk", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"))
    vectors = classes.select(F.col("cid").alias("_cid"), "vec", "n")
    at = at.join(vectors, F.col("cid") == F.col("_cid")).drop("_cid")
    shuffled = at.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    return shuffled.mapInPandas(_meet(threshold, tuple(sorted(how.items()))), "cid long, root long, n long")


def plan(vectors: int) -> dict:
    """The tables, the same for any number of vectors, so that no link depends on it; crowded cells go by blocks."""
    return {"tables": 6, "blocks": 2}


def near_vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, **how) -> DataFrame:
    """One row per row of table: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing and are components
    of their own; so do vectors of different lengths. n_links counts all other vectors of cosine >= threshold,
    copies included. component_id is the smallest id reachable; kept marks the row that has it (each, if ids
    repeat). Extra columns are not read; an empty table gives no rows.
    """
    spark = table.sparkSession
    bounded_batches(spark)
    vec = F.col("vec")
    norm = F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x * x)
    fine = vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & (norm > 0) & (norm < float("inf"))
    rows = table.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).withColumn("fine", F.coalesce(fine, F.lit(False)))
    classes = rows.where("fine").groupBy("vec").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = saved(classes.withColumn("cid", F.monotonically_increasing_id()))
    found = saved(linked(classes, threshold, **(plan(classes.count()) | how)))
    roots = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy(F.col("cid").alias("_c")).agg(F.sum("n").alias("links"))
    placed = classes.join(roots, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid"))
    best = placed.groupBy(F.col("root").alias("_root")).agg(F.min("least").alias("component_id"))
    placed = placed.join(best, F.col("root") == F.col("_root")).join(counts, F.col("cid") == F.col("_c"), "left")
    placed = placed.select(F.col("vec").alias("_vec"), "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    good = rows.where("fine").join(placed, F.col("vec") == F.col("_vec")).select("vec_id", "n_links", "component_id")
    bad = rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.union(bad).select("vec_id", F.col("n_links").cast("long"), F.col("component_id").cast("long"), F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
