"""Connected components of links, in rounds that never leave the executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

LINKS = "u bigint, v bigint"


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links u-v and the smallest node each reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, label = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if np.array_equal(before, label) and np.array_equal(label[a], label[b]):
            break
    return nodes, nodes[label]


def stars(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """Links that join the same nodes, at most one for each node: from it to its root."""
    nodes, root = roots(u, v)
    far = nodes != root
    return pa.RecordBatch.from_arrays([pa.array(nodes[far], pa.int64()), pa.array(root[far], pa.int64())], names=["u", "v"])


def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest in place of every million links."""
    u, v, n = [], [], 0
    for batch in batches:
        u.append(batch.column(0).to_numpy())
        v.append(batch.column(1).to_numpy())
        n += batch.num_rows
        if n >= 1_000_000:
            star = stars(np.concatenate(u), np.concatenate(v))
            u, v, n = [star.column(0).to_numpy()], [star.column(1).to_numpy()], star.num_rows
            if n >= 500_000:
                yield star
                u, v, n = [], [], 0
    if n:
        yield stars(np.concatenate(u), np.concatenate(v))


def components(links: DataFrame) -> DataFrame:
    """(u, v): each linked node but the roots, and the smallest node it reaches.

    links: u, v bigint without nulls; loops and repeats are harmless. Rounds of large stars
    (every larger neighbour is tied to the smallest one) and small stars (every smaller one
    is) until nothing changes; their number grows with the logarithm of the longest path.
    A node's neighbours are only ever reduced by min, which combines before the shuffle.
    """
    links = settle(links.where("u <> v").mapInArrow(thinned, LINKS), "links")
    mark = None
    while True:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = settle(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        row = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("bigint"))).first()
        if tuple(row) == mark:
            return links
        mark = tuple(row)
