"""Exact top-k by inner product from a bit-sliced index.

Every component of a vector is quantised to a whole number. A shard of rows holds, for each
component, its values above the shard's least as bitmaps: one bitmap for each binary digit, one
bit for each row. A query's score is a sum of bitmaps shifted by the digits of the query's
weights; a negative weight takes the complement. The sums are made with full adders on whole
bitmaps, three to two, so the result is a bit-sliced number too. The top rows are chosen from
its most significant slice downward; the rows that are still equal after the last slice have
equal scores, and those with the smallest ids fill what is left.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

#: Distinct rows in a shard and queries in a block, about; a task holds one of each. Bytes of bitmaps added at a time.
SHARD, BLOCK, BUDGET = 32_768, 1024, 2 << 20
SCALE = 64
_INDEX = "width int, shard int, ids array<long>, copies array<long>, least array<long>, digits array<int>, slices binary"


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, q array<long>) with floor(scale * component), of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # So large that sums of products of that many components stay below 2^62.
    most = F.floor(F.sqrt(F.lit(float(1 << 60)) / F.greatest(F.size(v), F.lit(1)))).cast("double")
    q = F.transform(v, lambda x: F.floor(F.greatest(-most, F.least(most, x * float(scale)))))
    return vectors.where(F.coalesce(ok, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), q.alias("q"))


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as bitmaps of 64-bit words."""
    padded = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), dtype=bool)
    padded[:, : bits.shape[1]] = bits
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def build(shard: pd.DataFrame) -> pd.DataFrame:
    """One row of the index from a shard's rows (width, shard, vec_id, q, copies)."""
    shard = shard.sort_values("vec_id", kind="stable")
    values = np.array(shard["q"].to_list(), dtype=np.int64).reshape(len(shard), -1)
    least = values.min(axis=0)
    above = (values - least).T
    digits = [int(x).bit_length() for x in above.max(axis=1)] if above.size else []
    planes = [packed((row[None] >> np.arange(n)[:, None]) & 1 > 0) for row, n in zip(above, digits, strict=True) if n]
    one = {"width": values.shape[1], "shard": shard["shard"].iloc[0], "ids": shard["vec_id"].tolist(), "copies": shard["copies"].tolist(), "least": least.tolist(), "digits": digits, "slices": b"".join(p.tobytes() for p in planes)}
    return pd.DataFrame([one])


class Slices:
    """An index row, ready to be searched."""

    def __init__(self, row):
        self.ids, self.copies = (np.asarray(row[c], dtype=np.int64) for c in ("ids", "copies"))
        self.least, digits = np.asarray(row["least"], dtype=np.int64), np.asarray(row["digits"], dtype=np.int64)
        words, total = -(-len(self.ids) // 64), int(digits.sum())
        self.valid = packed(np.ones((1, len(self.ids)), dtype=bool))[0]
        own = np.frombuffer(row["slices"], dtype=np.uint64).reshape(total, words)
        # The bitmaps, their complements, and one without rows to fill up with.
        self.planes, self.total = np.concatenate([own, ~own, np.zeros((1, words), dtype=np.uint64)]), total
        self.of = np.repeat(np.arange(len(digits)), digits)
        self.place = np.arange(total) - np.repeat(np.cumsum(digits) - digits, digits)
        self.full = (1 << digits) - 1

    def scores(self, weights: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """For some queries (rows of weights): the slices of the scores, each (queries, words), least significant first, and what
        has to be added to every score of a query."""
        size, sign = np.abs(weights), weights < 0
        extra = np.where(sign, -size * (self.full + self.least), size * self.least).sum(axis=1)
        tops = int(size.max(initial=0)).bit_length()
        out, carried, level = [], [], 0
        last = int(self.place.max(initial=-1)) + tops
        while level < last or carried:
            pairs = [(b, np.flatnonzero(self.place == level - b)) for b in range(tops)]
            pairs = [(b, at) for b, at in pairs if len(at)]
            here = list(carried)
            if pairs:
                source = np.concatenate([at for _, at in pairs])
                digit = np.repeat([b for b, _ in pairs], [len(at) for _, at in pairs])
                on = (size[:, self.of[source]] >> digit) & 1 > 0
                most = int(on.sum(axis=1).max(initial=0))
                if most:
                    first = np.argsort(~on, axis=1, kind="stable")[:, :most]
                    picked = source[first] + np.where(np.take_along_axis(sign[:, self.of[source]], first, 1), self.total, 0)
                    here.append(self.planes[np.where(np.take_along_axis(on, first, 1), picked, 2 * self.total)])
            carried = []
            if here:
                x = np.concatenate(here, axis=1)
                while x.shape[1] > 1:
                    third = x.shape[1] // 3
                    if third:
                        a, b, c = x[:, :third], x[:, third : 2 * third], x[:, 2 * third : 3 * third]
                        half = a ^ b
                        carried.append((a & b) | (half & c))
                        x = np.concatenate([half ^ c, x[:, 3 * third :]], axis=1)
                    else:
                        carried.append(x[:, :1] & x[:, 1:])
                        x = x[:, :1] ^ x[:, 1:]
                out.append(x[:, 0])
            else:
                out.append(np.zeros((len(weights), len(self.valid)), dtype=np.uint64))
            level += 1
        return out, extra

    def top(self, asked: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of each query's k best rows (ties to the first rows) but those with its own id."""
        slices, extra = self.scores(weights)
        left = np.repeat(self.valid[None], len(asked), axis=0)
        low, high = np.searchsorted(self.ids, asked), np.searchsorted(self.ids, asked, side="right")
        for q in np.flatnonzero(high > low):
            own = np.zeros((1, len(self.valid) * 64), dtype=bool)
            own[0, low[q] : high[q]] = True
            left[q] &= ~packed(own)[0]
        sure = np.zeros_like(left)
        for part in reversed(slices):
            ones = left & part
            both = sure | ones
            n = np.bitwise_count(both).sum(axis=1, dtype=np.int64)[:, None]
            left = np.where(n > k, ones, np.where(n == k, np.uint64(0), left & ~part))
            sure = np.where(n > k, sure, both)
        flags = lambda x: np.unpackbits(x.view(np.uint8), axis=1, bitorder="little")
        tied, room = flags(left), k - np.bitwise_count(sure).sum(axis=1, dtype=np.int64)
        tied &= np.cumsum(tied, axis=1, dtype=np.int64) <= room[:, None]
        query, row = np.nonzero(flags(sure) | tied)
        score = extra[query].copy()
        for level, part in enumerate(slices):
            score += ((part[query, row >> 6] >> (row & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << level
        return query, row, score


def index(vectors: DataFrame, shard: int = SHARD) -> DataFrame:
    """The bit-sliced index of quantised rows (vec_id, q), settled: a row for each shard. Equal rows are one with a number of
    copies, so what is repeated fills no shard."""
    each = settle(vectors.groupBy("vec_id", "q").agg(F.count("*").alias("copies")), "quantised")
    shards = max(1, -(-each.count() // shard))
    placed = each.select(F.size("q").alias("width"), F.pmod(F.xxhash64("vec_id", "q"), F.lit(shards)).cast("int").alias("shard"), "vec_id", "q", "copies")
    return settle(placed.groupBy("width", "shard").applyInPandas(build, _INDEX), "bit-sliced")


def top_scores(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = SCALE, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vec_id divisible by `every`, the k rows with the highest inner product (all, if
    fewer), ties to the smaller vec_id.

    Components are floor(scale * component), at most the root of 2^60 over their number (beyond that they stay there).
    Vectors that are null or hold null or non-finite components take no part, neither do rows without vec_id; zero and empty
    vectors do. Vectors of different lengths have no inner product. Rows that repeat another are candidates as often as they
    stand there; none of a query's own vec_id is a candidate. Of several vectors under a query's vec_id the smallest asks.
    An empty table gives an empty result; other columns are ignored.

    The index is built once. A block of queries goes to each shard, and a shard answers with k rows a query.
    """
    rows = quantised(vectors, scale)
    indexed = index(rows, shard)
    asked = settle(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("q").alias("q")), "asked")
    blocks = max(1, -(-asked.count() // block))
    asked = asked.select(F.size("q").alias("width"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), "vec_id", "q")
    places = indexed.select(F.col("width").alias("width"), F.col("shard").alias("shard"))
    spread = indexed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # As many shards as the index has rows, so this table has one row for some SHARD vectors.
    told = asked.join(F.broadcast(places), "width")

    def search(shards: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(shards) and len(queries):
            one = Slices(shards.iloc[0])
            ids, weights = queries["vec_id"].to_numpy(), np.array(queries["q"].to_list(), dtype=np.int64).reshape(len(queries), -1)
            step = max(1, BUDGET // max(1, one.planes.nbytes // 8))
            for a in range(0, len(ids), step):
                query, row, score = one.top(ids[a : a + step], weights[a : a + step], k)
                found.append(pd.DataFrame({"query_id": ids[a : a + step][query], "vec_id": one.ids[row], "score": score, "copies": one.copies[row]}))
        return pd.concat(found) if found else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query_id", "vec_id", "score", "copies")})

    keys = ("width", "shard", "block")
    found = spread.groupBy(*keys).cogroup(told.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score long, copies long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)
    copies = best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int"))))
    ranked = copies.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("nth", "copy")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
