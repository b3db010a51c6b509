"""Approximate nearest neighbours by collision-counting hashing.

Vectors are projected onto random lines, and each line keeps its projections in a sorted array. A query's
window on every line is centred at the query's own projection and grows with a radius (virtual
rehashing: no array is ever built anew). A vector collides with the query on a line when it lies in
the window; one that collides on enough lines is verified by its distance in double precision. The
search ends when enough verified vectors lie within the radius, or when all have been verified.

Scale: vectors are dealt into shards of bounded size by a hash of their id, each with its own sorted
arrays; the queries, a stated set, meet the shards in blocks. Each pair of shard and block returns its
nearest, and those are ranked per query. No task holds more than a shard and a block.

Defined results: vectors that are null, zero, of another length than most, or that hold a null or
non-finite component take no part, nor do rows without an id; ties go to the smaller id; a query finds
every row but those of its own id; rows that repeat an id are candidates each, and one query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LINES = 64
WIDTH = 2.7  # of a window at radius 1: a vector at the radius collides with chance 0.82
SHARE = 0.715  # of the lines on which a verified vector collides, at least
START = 0.35  # first radius, by the vectors' spread
GROWTH = 1.15
SHARD = 8192
BLOCK = 1024


class CollisionIndex:
    def __init__(self, vectors: np.ndarray, ids: np.ndarray, lines: int = LINES, seed: int = 11):
        self.x, self.ids = vectors, ids
        self.a = np.random.Generator(np.random.PCG64(seed)).normal(size=(vectors.shape[1], lines))
        p = vectors @ self.a
        # all lines' sorted arrays in one, each line shifted past the one before, so that one search meets all windows
        order = np.argsort(p, axis=0, kind="stable").T
        self.shift = np.arange(lines) * (4 * float(np.abs(p).max(initial=1.0)) + 1e6 * np.finfo(float).eps)
        self.order = order.ravel()
        self.sorted = (np.take_along_axis(p.T, order, 1) + self.shift[:, None]).ravel()
        centre = vectors.mean(0)
        self.scale = float(np.sqrt(((vectors - centre) ** 2).sum(1).mean())) or 1.0
        self.need = int(np.ceil(SHARE * lines))

    def search(self, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the ``k`` nearest found, nearest first."""
        n, lines = len(self.x), len(self.shift)
        hits, done = np.zeros(n, np.int64), self.ids == own
        p = q @ self.a
        edge = np.arange(lines) * n  # windows stay within their line
        left = right = np.clip(np.searchsorted(self.sorted, p + self.shift), edge, edge + n)
        left_n = int((~done).sum())
        found, dist, radius = np.zeros(0, np.int64), np.zeros(0), START * self.scale
        while len(found) < left_n:
            half = WIDTH / 2 * radius
            lo = np.minimum(np.clip(np.searchsorted(self.sorted, p - half + self.shift), edge, edge + n), left)
            hi = np.maximum(np.clip(np.searchsorted(self.sorted, p + half + self.shift), edge, edge + n), right)
            fresh = [self.order[i:j] for i, j in zip(lo.tolist(), left.tolist(), strict=True) if i < j] + [self.order[i:j] for i, j in zip(right.tolist(), hi.tolist(), strict=True) if i < j]
            left, right = lo, hi
            if fresh:
                hits += np.bincount(np.concatenate(fresh), minlength=n)
                new = np.flatnonzero((hits >= self.need) & ~done)
                if len(new):
                    done[new] = True
                    found = np.concatenate([found, new])
                    dist = np.concatenate([dist, np.sqrt(((self.x[new] - q) ** 2).sum(1))])
            if (dist <= radius).sum() >= k:
                break
            radius *= GROWTH
        best = np.lexsort((self.ids[found], dist))[:k]
        return self.ids[found[best]], dist[best]


def _search(k: int):
    def run(key: tuple, shard: pa.Table, queries: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if shard.num_rows and queries.num_rows:
            def matrix(t: pa.Table) -> np.ndarray:
                flat = t.column("vector").combine_chunks()
                return np.asarray(flat.flatten(), np.float64).reshape(t.num_rows, -1)

            index = CollisionIndex(matrix(shard), shard.column("vec_id").to_numpy())
            for qid, q in zip(queries.column("vec_id").to_pylist(), matrix(queries), strict=True):
                ids, dist = index.search(q, qid, k)
                out[0].extend([qid] * len(ids))
                out[1].extend(ids.tolist())
                out[2].extend(dist.tolist())
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    return run


def usable_vectors(rows: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vector) as doubles, of the vectors that take part."""
    v = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).filter("vec_id is not null and size(vector) > 0")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.filter(F.coalesce(finite, F.lit(False)) & F.exists("vector", lambda x: x != 0))
    common = v.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return v.filter(F.size("vector") == (common["d"] if common else 0))


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean distance); both inputs have vec_id and vector."""
    shards = max(1, -(-rows.count() // SHARD))
    asked = queries.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    blocks = max(1, -(-asked.count() // BLOCK))
    side = rows.select("vec_id", "vector", F.expr(f"pmod(xxhash64(vec_id, vector), {shards})").alias("shard"))
    side = side.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    block = asked.select("vec_id", "vector", F.expr(f"int(pmod(xxhash64(vec_id), {blocks}))").alias("block"))
    block = block.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    near = side.groupBy("shard", "block").cogroup(block.groupBy("shard", "block")).applyInArrow(_search(k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
