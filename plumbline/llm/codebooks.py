"""Vectors as short codes: each part of a vector is the number of its nearest codebook entry.

Components become whole numbers, floor(SCALE * x), so that sums and distances are exact in any order. A
codebook of each part position starts as that part of the ENTRIES vectors of the smallest ids. Each of
ROUNDS rounds broadcasts the codebooks, each as a kd-tree, finds every part's nearest entry by branch and bound,
and replaces each entry by the floor of the mean of its parts; entries without parts stay. The search visits a node
whose bound equals the best distance so far too, so that of equally near entries the one of the lowest
number is found. Tasks send one row of sums for each entry; these are added by Spark, and 4 x 256 rows of
sums reach the driver in each round.

Vectors that are null or hold a null or non-finite component take no part and have no row. Neither have those with another number of
components than most vectors have (of equally frequent ones the largest). If the parts' number doesn't divide
it, zeros stand behind the last components. A whole number beyond 2**27 either way counts as 2**27, so that
all sums fit. Rows that share a vec_id are vectors of their own, in the order of their components where ids are equal;
null ids come last. Rows without a label are one group of label_error. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle
from .kernel import packed

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
LEAF = 8
LARGEST = 1 << 27
EXACT = 1 << 22  # below this, products of whole numbers are exact as floats


class KdTree:
    """The entries of one codebook; nodes are boxes around their entries, split in half along the widest side."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray | tuple[int, int]]] = []
        if len(entries):
            self._add(np.arange(len(entries)))

    def _add(self, members: np.ndarray) -> int:
        at, x = len(self.nodes), self.entries[members]
        low, high = x.min(axis=0), x.max(axis=0)
        self.nodes.append((low, high, members))
        if len(members) > LEAF and (high > low).any():
            order = members[np.argsort(x[:, np.argmax(high - low)], kind="stable")]
            half = len(order) // 2
            self.nodes[at] = low, high, (self._add(np.sort(order[:half])), self._add(np.sort(order[half:])))
        return at

    def bounds(self, node: int, x: np.ndarray) -> np.ndarray:
        """Squared distances to the node's box: no entry in it is nearer."""
        low, high, _ = self.nodes[node]
        out = np.maximum(np.maximum(low - x, x - high), 0)
        return (out * out).sum(axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number and squared distance of each row's nearest entry, ties to the lower number."""
        best = np.full(len(x), np.iinfo(np.int64).max)
        found = np.full(len(x), len(self.entries))
        if len(x):
            self._visit(0, np.arange(len(x)), x, best, found)
        return found, best

    def _visit(self, node: int, rows: np.ndarray, x: np.ndarray, best: np.ndarray, found: np.ndarray) -> None:
        inside = self.nodes[node][2]
        if isinstance(inside, np.ndarray):
            d = squared(x[rows], self.entries[inside])
            k = d.argmin(axis=1)  # the first of equals, and members ascend
            d, k = d[np.arange(len(rows)), k], inside[k]
            better = (d < best[rows]) | ((d == best[rows]) & (k < found[rows]))
            best[rows[better]], found[rows[better]] = d[better], k[better]
            return
        left, right = (self.bounds(child, x[rows]) for child in inside)
        turn = right < left
        for near, far, bound, own in ((inside[0], inside[1], right, ~turn), (inside[1], inside[0], left, turn)):
            some = rows[own]
            if len(some):
                self._visit(near, some, x, best, found)
                still = bound[own] <= best[some]  # a bound that equals the best may hide a lower number
                if still.any():
                    self._visit(far, some[still], x, best, found)


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all entries."""
    if max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)) < EXACT:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(axis=1) for e in entries], axis=1)


def usable(vector: Column) -> Column:
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (vec_id, label, v): components as packed whole numbers."""
    for b in batches:
        v = b.column(2)
        x = np.floor(v.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
        x = np.clip(x, -LARGEST, LARGEST).astype(np.int32)
        per = np.diff(v.offsets.to_numpy()) if b.num_rows else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), packed(x, per)], names=["vec_id", "label", "v"])


def rows_of(column: pa.Array, width: int, parts: int) -> np.ndarray:
    """The parts of all vectors, zeros behind the last components: row, part, position."""
    x = np.frombuffer(b"".join(column.to_pylist()), np.int32).astype(np.int64).reshape(len(column), width)
    each = -(-width // parts)
    out = np.zeros((len(column), parts * each), np.int64)
    out[:, :width] = x
    return out.reshape(len(column), parts, each)


def sums(trees, width: int, parts: int):
    """For mapInArrow over v: the task's sums and counts for each entry that any part is nearest to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = trees.value
        entries, each = len(own[0].entries), -(-width // parts)
        total = np.zeros((parts, entries, each + 1), np.int64)
        for b in batches:
            x = rows_of(b.column(0), width, parts)
            for p, tree in enumerate(own):
                k, _ = tree.nearest(x[:, p])
                total[p, :, 0] += np.bincount(k, minlength=entries)
                np.add.at(total[p, :, 1:], k, x[:, p])
        p, k = np.nonzero(total[:, :, 0])
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(k.astype(np.int32)), *map(pa.array, total[p, k].T.copy())], names=["part", "entry", "n", *[f"s{i}" for i in range(each)]])

    return run


def coded(trees, width: int, parts: int):
    """For mapInArrow over (vec_id, label, v): code and error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = trees.value
        digits = max(2, len(f"{len(own[0].entries) - 1:x}"))
        for b in batches:
            x = rows_of(b.column(2), width, parts)
            found = [tree.nearest(x[:, p]) for p, tree in enumerate(own)]
            codes = ["".join(f"{k:0{digits}x}" for k in row) for row in np.stack([k for k, _ in found], axis=1).tolist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(codes, pa.string()), pa.array(np.sum([d for _, d in found], axis=0, dtype=np.int64))], names=["vec_id", "label", "code", "error"])

    return run


def codebooks_of(vectors: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """part, entry, position: the codebooks after all rounds; vectors has packed whole numbers."""
    spark, each = vectors.sparkSession, -(-width // parts)
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").toArrow()["v"].combine_chunks()
    books = np.ascontiguousarray(rows_of(first, width, parts).transpose(1, 0, 2))
    columns = ["n", *[f"s{i}" for i in range(each)]]
    for _ in range(rounds):
        trees = spark.sparkContext.broadcast([KdTree(book) for book in books])
        found = vectors.select("v").mapInArrow(sums(trees, width, parts), "part int, entry int, " + ", ".join(f"{c} bigint" for c in columns))
        total = found.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()  # parts x entries rows at most
        part, entry, n = (total[c].to_numpy() for c in ("part", "entry", "n"))
        for i in range(each):
            books[part, entry, i] = total[f"s{i}"].to_numpy() // n
        trees.unpersist()
    return books


def compress(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each vector that takes part."""
    spark, ids, labels = vectors.sparkSession, vectors.schema[vec_id].dataType.simpleString(), vectors.schema[label].dataType.simpleString()
    good = vectors.where(usable(F.col(embedding))).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("v"))
    sizes = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], f"vec_id {ids}, code string, error bigint, label_error bigint, codebooks_sha256 string")
    width = sizes[0]["d"]
    ints = settle(good.where(F.size("v") == width).mapInArrow(whole, f"vec_id {ids}, label {labels}, v binary"), "whole")
    books = codebooks_of(ints, width, parts, entries, rounds)
    trees = spark.sparkContext.broadcast([KdTree(book) for book in books])
    found = settle(ints.mapInArrow(coded(trees, width, parts), f"vec_id {ids}, label {labels}, code string, error bigint"), "coded")
    by_label = found.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return found.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
