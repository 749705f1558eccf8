"""Approximate nearest neighbours by collision-counting hashing, Euclidean distance.

Each vector has one number in each of PROJECTIONS random directions. A block of vectors keeps
one sorted array for each direction. A query's window in a direction is centred on its own
number there; virtual rehashing widens all windows by RATIO at a time, so each widening only
adds ranks on both sides. A vector collides in a direction once the window has its rank, and
is verified (its exact distance computed) once it has collided in THRESHOLD directions. A
query stops in a block when its TOP-th verified distance, projected with slack, lies within
its windows, or when every vector is verified.

Stated queries meet all vectors, in blocks: queries are cut into chunks and every block meets
every chunk by an equi-join on their numbers, so a task holds one block and one chunk, both
of bounded size, and only each block's TOP for each query are merged. All vectors are indexed.

Null vectors, zero vectors, those with null or non-finite components and those with another
number of components than the queries' most frequent take no part. Ties go to the smaller id.
A query's own id is no candidate of it. Rows that repeat an id are candidates of their own; queries that
share an id are one query, of which the nearest to any of its vectors are told. An empty table gives an
empty result.

The method's work grows with queries times vectors, as a window of a projection holds a share of all
numbers, not a number of them: with queries a fixed share of the rows, with the square of the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP, PROJECTIONS, THRESHOLD, RATIO, SEED = 10, 48, 34, 1.3, 7
SLACK = 0.15  # of the TOP-th distance, how far the windows must reach in each direction
BLOCK, CHUNK = 16384, 16384  # vectors, and queries that they meet in one task: some 16 MB of either at 128 components


def usable(vector: Column) -> Column:
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vector, lambda x: x != 0)


def directions(dim: int, seed: int = SEED, n: int = PROJECTIONS) -> np.ndarray:
    """Unit directions, orthogonal within every dim of them, so that windows are in units of distance."""
    rng = np.random.default_rng(seed)
    parts = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-n // dim))]
    return np.concatenate(parts, axis=1)[:, :n]


class Block:
    """Vectors with a sorted array for each direction."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.a = directions(x.shape[1])
        p = x @ self.a
        self.order = np.argsort(p, axis=0, kind="stable").T.astype(np.int32)
        # the sorted arrays stand one behind the other, far enough apart to be searched as one
        self.gap = 4 * float(np.abs(p).max()) + 4.0
        self.shift = np.arange(p.shape[1]) * self.gap
        self.flat = (np.take_along_axis(p, self.order.T, axis=0).T + self.shift[:, None]).ravel()
        self.ranks = self.order.ravel()
        spread = np.median(np.abs(p - np.median(p, axis=0)))
        self.first = max(float(spread) * 0.25, 1e-12)
        self.last = self.gap / 2

    def search(self, q: np.ndarray, own: int, top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the nearest found, nearest first."""
        n, m = len(self.ids), len(self.shift)
        at = q @ self.a + self.shift
        limit = self.last + float(np.abs(q @ self.a).max())  # beyond it every window has every vector
        edges = np.arange(m) * n
        count, seen = np.zeros(n, np.int32), np.zeros(n, bool)
        lo = np.clip(np.searchsorted(self.flat, at), edges, edges + n)
        hi = lo.copy()
        found, distance = np.zeros(0, np.int64), np.zeros(0)
        half = self.first
        need = min(THRESHOLD, m)
        while True:
            a = np.minimum(lo, np.clip(np.searchsorted(self.flat, at - half, "left"), edges, edges + n))
            b = np.maximum(hi, np.clip(np.searchsorted(self.flat, at + half, "right"), edges, edges + n))
            new = [self.ranks[i:j] for i, j in zip(np.append(a, hi).tolist(), np.append(lo, b).tolist())]
            lo, hi = a, b
            count += np.bincount(np.concatenate(new), minlength=n).astype(np.int32)
            hits = np.flatnonzero((count >= need) & ~seen)
            seen[hits] = True
            hits = hits[self.ids[hits] != own]
            if len(hits):
                d = np.sqrt(((self.x[hits] - q) ** 2).sum(axis=1))
                found, distance = np.append(found, hits), np.append(distance, d)
                order = np.lexsort((self.ids[found], distance))[:top]
                found, distance = found[order], distance[order]
            if (len(found) == top and half >= SLACK * distance[-1]) or half > limit:
                return self.ids[found], distance
            half *= RATIO


def searched(pairs: pa.Table, top: int) -> pa.Table:
    """One block's vectors and one chunk of queries: each query's nearest in the block."""
    is_query = pairs["query"].to_numpy().astype(bool)
    ids = pairs["id"].to_numpy()
    flat = pairs["v"].combine_chunks()
    width = len(flat.flatten()) // max(1, len(flat))
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), width)
    order = np.argsort(ids[~is_query], kind="stable")
    out: list[list] = [[], [], []]
    if len(order):
        block = Block(ids[~is_query][order], x[~is_query][order])
        for i, q in zip(ids[is_query].tolist(), x[is_query]):
            found, distance = block.search(q, i, top)
            out[0] += [i] * len(found)
            out[1] += found.tolist()
            out[2] += distance.tolist()
    return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})


def nearest(vectors: DataFrame, queries: Column, vec_id: str = "vec_id", embedding: str = "embedding", top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: the top nearest found of every query, all candidates if fewer.

    queries: which of the vectors' rows are queries (rows that repeat an id are one query if their vectors are equal).
    """
    good = vectors.where(F.col(vec_id).isNotNull() & usable(F.col(embedding))).select(F.col(vec_id).cast("bigint").alias("id"), F.col(embedding).cast("array<double>").alias("v"), queries.alias("q"))
    sizes = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.sum(F.col("q").cast("int")).alias("nq")).collect()  # a row for each length of vectors
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    best = max(sizes, key=lambda r: (r["nq"] or 0, r["n"]))
    good = good.where(F.size("v") == best["d"])
    blocks, chunks = -(-best["n"] // BLOCK), max(1, -(-(best["nq"] or 0) // CHUNK))
    number = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = good.select("id", "v", F.lit(False).alias("query"), number(blocks).alias("b"), all_of(chunks).alias("c"))
    asked = good.where("q").select("id", "v").distinct().select("id", "v", F.lit(True).alias("query"), all_of(blocks).alias("b"), number(chunks).alias("c"))
    met = data.unionByName(asked).groupBy("b", "c").applyInArrow(lambda t: searched(t.select(["id", "v", "query"]), top), "query_id bigint, vec_id bigint, score double")
    rank = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return met.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
