"""Nearest neighbours from vantage-point trees, one per shard, searched for blocks of queries.

A tree node holds a vantage point and splits the other points by their distance from it.
With the best k distances so far reaching to tau, a side whose points are all farther from
the query than tau by the triangle inequality is skipped. The bound is multiplied by
1 / factor: a factor of 1 is exact, smaller factors skip more and may miss neighbours.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Points in a shard and queries in a block, about; a task holds one of each.
SHARD, BLOCK, LEAF = 4096, 1024, 96
FACTOR = 0.8


class Tree:
    """Over distinct points (rows of float64). children: (vantage point, inner bounds, outer bounds, inner, outer) or a leaf's rows."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaf = points, leaf
        self.root = self.grow(np.arange(len(points)))

    def grow(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        spread = rows[:: max(1, len(rows) // 32)]
        far = distances(self.points[spread[:1]], self.points[rows])[0]
        chosen = rows[int(far.argmax())]
        rest = rows[rows != chosen]
        d = distances(self.points[chosen][None], self.points[rest])[0]
        order = np.argsort(d, kind="stable")
        rest, d, half = rest[order], d[order], len(rest) // 2
        return chosen, (d[0], d[half - 1]), (d[half], d[-1]), self.grow(rest[:half]), self.grow(rest[half:])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean, from differences in double precision, some rows at a time."""
    out = np.empty((len(a), len(b)))
    step = max(1, 4_000_000 // max(1, b.size))
    for i in range(0, len(a), step):
        d = a[i : i + step, None, :] - b[None]
        out[i : i + step] = np.sqrt(np.einsum("ijk,ijk->ij", d, d))
    return out


class Search:
    """The k nearest of a tree's points for many queries together. A point stands for `copies` ids that share its vector."""

    def __init__(self, tree: Tree, ids: list[np.ndarray], queries: np.ndarray, query_ids: np.ndarray, k: int, factor: float):
        self.tree, self.ids, self.queries, self.query_ids, self.k, self.factor = tree, ids, queries, query_ids, k, factor
        self.found: list[list[tuple[float, int]]] = [[] for _ in queries]
        self.tau = np.full(len(queries), np.inf)
        if len(queries):
            self.visit(tree.root, np.arange(len(queries)))

    def offer(self, active: np.ndarray, rows: np.ndarray, d: np.ndarray) -> None:
        for a, q in enumerate(active.tolist()):
            near = np.flatnonzero(d[a] <= self.tau[q])
            if len(near):
                mine = self.found[q]
                mine += [(float(d[a, j]), int(i)) for j in near for i in self.ids[rows[j]] if i != self.query_ids[q]]
                mine.sort()
                del mine[self.k :]
                if len(mine) == self.k:
                    self.tau[q] = mine[-1][0]

    def visit(self, node, active: np.ndarray) -> None:
        if not len(active):
            return
        if isinstance(node, np.ndarray):
            if len(node):
                self.offer(active, node, distances(self.queries[active], self.tree.points[node]))
            return
        chosen, inner, outer, inside, outside = node
        d = distances(self.queries[active], self.tree.points[chosen][None])
        self.offer(active, np.array([chosen]), d)
        d = d[:, 0]
        sides = [(inside, inner), (outside, outer)]
        first = d > (inner[1] + outer[0]) / 2
        for turn in (0, 1):
            for side in (0, 1):
                child, (low, high) = sides[side]
                mine = (first == bool(side)) if turn == 0 else (first != bool(side))
                gap = np.maximum(np.maximum(low - d, d - high), 0.0)
                self.visit(child, active[mine & (gap <= self.factor * self.tau[active] * (1 + 1e-12))])


def _clean(vectors: DataFrame) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.coalesce(ok, F.lit(False)))


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, factor: float = FACTOR, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by `every`, its k nearest other rows (all, if
    fewer), by distance and then vec_id.

    Vectors that are null, zero, or hold null or non-finite components take no part, neither do rows without vec_id. Vectors
    of different lengths aren't compared. Rows with a vec_id twice are both candidates; a query's own vec_id never is.
    Of several vectors under a query's vec_id the smallest asks, so there is one result for each. An empty table gives an empty
    result, and other columns are ignored. Rows go to shards by a hash of vec_id, so copies of one vector
    spread; in a shard they are one point with many ids, of which the k + 1 smallest suffice. Each block of queries meets
    each shard in one group.
    """
    clean = _clean(vectors)
    size = clean.count()
    shards = max(1, -(-size // shard))
    queries = clean.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-queries.count() // block))
    h = F.xxhash64("vec_id")
    places = F.sequence(F.lit(0), F.lit(shards - 1))
    base = clean.withColumn("shard", F.pmod(h, F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(places))

    def search(points: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for width, mine in some.groupby(some["v"].map(len)):
            own = points[points["v"].map(len) == width].sort_values("vec_id", kind="stable")
            if not len(own):
                continue
            matrix = np.stack(own["v"].to_list()).astype(np.float64)
            distinct, of = np.unique(matrix, axis=0, return_inverse=True)
            order = np.argsort(of.reshape(-1), kind="stable")
            ids = [x[: k + 1] for x in np.split(own["vec_id"].to_numpy()[order], np.cumsum(np.bincount(of.reshape(-1)))[:-1])]
            asked_ids = mine["vec_id"].to_numpy()
            found = Search(Tree(distinct), ids, np.stack(mine["v"].to_list()).astype(np.float64), asked_ids, k, factor).found
            rows += [(q, i, d) for q, near in zip(asked_ids.tolist(), found, strict=True) for d, i in near]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = base.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
