"""A vector index: rows stand in cells around coarse centres, and a search reads the files of the nearest cells only.

Centres are those of spherical k-means on a sample of at most SAMPLE rows (those of the smallest hash of id); every row is indexed, in the cell of its
nearest centre, ties to the lower number. There are about the square root of the rows' number of cells, MOST_CELLS at most, so the
centres have a bounded size. A cell is a folder, a large one of several files. With as many probes as cells the search is exact.

Null vectors, zero vectors and those with null or non-finite components, or with another number of components than most have, are not in the index.
Rows that share an id are rows of their own. Nearness is by cosine to nine digits; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import settle

SAMPLE, MOST_CELLS, ROUNDS, SEED = 65_536, 4096, 12, 5
MOST_QUERIES = 4096  # that are broadcast; more meet the rows by a join on cells
ASKED = 64  # queries whose cells are found at a time


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """id, v: vectors of length one."""
    v = F.col(embedding).cast("array<double>")
    sound = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return vectors.where(sound).select(F.col(vec_id).alias("id"), v.alias("v")).withColumn("_l", length).select("id", F.transform("v", lambda x: x / F.col("_l")).alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column, all of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def centres_of(x: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means; a centre without rows begins anew at the row that is farthest from its own."""
    rng = np.random.default_rng(SEED)
    centre = x[np.sort(rng.permutation(len(x))[:cells])]
    for _ in range(ROUNDS):
        near = x @ centre.T
        own, best = near.argmax(axis=1), near.max(axis=1)
        sums = np.zeros_like(centre)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=len(centre)) == 0)
        sums[empty] = x[np.argsort(best, kind="stable")[: len(empty)]]
        far = np.linalg.norm(sums, axis=1, keepdims=True)
        centre = np.where(far > 1e-12, sums / np.maximum(far, 1e-12), centre)
    return centre


def build(vectors: DataFrame, path: str, vec_id: str = "vec_id", embedding: str = "embedding", cells: int | None = None) -> int:
    """Writes the index of all usable vectors to ``path``; how many cells it has."""
    spark = vectors.sparkSession
    rows = settle(usable(vectors, vec_id, embedding), "unit")
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    width, n = (sizes[0]["d"], sizes[0]["count"]) if sizes else (0, 0)
    rows = rows.where(F.size("v") == width)
    cells = max(1, min(MOST_CELLS, n, cells or round(n**0.5)))
    sample = matrix(rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()["v"]) if n else np.zeros((1, 1))
    centre = centres_of(sample, cells)
    shared = spark.sparkContext.broadcast(centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = (matrix(b.column(1)) @ shared.value.T).argmax(axis=1) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.astype(np.int32))], names=["id", "v", "cell"])

    kind = rows.schema["id"].dataType.simpleString()
    placed = rows.mapInArrow(run, f"id {kind}, v array<double>, cell int")
    placed.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
    spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centre)], "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    return len(centre)


def index_of(spark: SparkSession, path: str) -> tuple[np.ndarray, DataFrame]:
    """The centres, and the rows with their cells."""
    centres = spark.read.parquet(f"{path}/centres").orderBy("cell").toArrow()  # MOST_CELLS rows at most
    return matrix(centres["centre"]), spark.read.schema("id bigint, v array<double>, cell int").parquet(f"{path}/cells")


def best(candidates: DataFrame, top: int) -> DataFrame:
    rank = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return candidates.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top).select("query_id", "rank", "id", "score")


def search(spark: SparkSession, path: str, queries: DataFrame, top: int = 10, probes: int = 8, query_id: str = "vec_id", embedding: str = "embedding", itself: bool = True) -> DataFrame:
    """query_id, rank, id, score: the top rows of each query by cosine among those of its ``probes`` nearest cells. itself: may a row of the query's id be found?"""
    centre, rows = index_of(spark, path)
    asked = settle(usable(queries, query_id, embedding).where(F.size("v") == centre.shape[1]).distinct(), "queries")
    probes = min(probes, len(centre))
    shared = spark.sparkContext.broadcast(centre)

    def nearest(q: np.ndarray) -> np.ndarray:
        return np.argsort(-(q @ shared.value.T), axis=1, kind="stable")[:, :probes].astype(np.int32)

    def nearest_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, ASKED):
                part = b.slice(i, ASKED)
                cells = nearest(matrix(part.column(1)))
                at = np.repeat(np.arange(part.num_rows), probes)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), part.column(1).take(pa.array(at)), pa.array(cells.ravel())], names=["query_id", "q", "cell"])

    if asked.count() > MOST_QUERIES:
        met = asked.mapInArrow(nearest_cells, "query_id bigint, q array<double>, cell int")
        met = rows.join(met, "cell").where(F.lit(itself) | (F.col("id") != F.col("query_id")))
        return best(met.select("query_id", "id", F.aggregate(F.zip_with("v", "q", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x).alias("score")), top)
    found = asked.toArrow()  # a row a query, whatever the number of cells
    ids, q = found["id"].to_numpy(), matrix(found["v"]) if found.num_rows else np.zeros((0, centre.shape[1]))
    every = probes == len(centre)  # then each cell is every query's
    cells = np.zeros((0, probes), np.int32) if every else nearest(q)
    if not every:
        rows = rows.where(F.col("cell").isin(np.unique(cells).tolist()))
    wanted = spark.sparkContext.broadcast((ids, q, cells))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The task's top rows for each query."""
        ids, q, cells = wanted.value
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            own, x, cell = b.column(0).to_numpy(), matrix(b.column(1)) if b.num_rows else None, b.column(2).to_numpy()
            for c in np.unique(cell).tolist():
                few = np.flatnonzero(cell == c)
                for k in range(len(ids)) if every else np.flatnonzero((cells == c).any(axis=1)):
                    i, score = own[few], x[few] @ q[k]
                    if not itself:
                        i, score = i[i != ids[k]], score[i != ids[k]]
                    had = held.get(ids[k], (np.zeros(0, np.int64), np.zeros(0)))
                    i, score = np.append(had[0], i), np.append(had[1], score)
                    keep = np.lexsort((i, -np.round(score, 9)))[:top]
                    held[ids[k]] = i[keep], score[keep]
        n = [len(i) for i, _ in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(list(held), np.int64), n)), pa.array(np.concatenate([i for i, _ in held.values()] or [np.zeros(0, np.int64)])), pa.array(np.concatenate([s for _, s in held.values()] or [np.zeros(0)]))], names=["query_id", "id", "score"])

    return best(rows.mapInArrow(scan, "query_id bigint, id bigint, score double"), top)
