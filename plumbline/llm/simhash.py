"""SimHash near-duplicates: pigeonhole blocks, then Hamming verification.

A fingerprint's 64 bits are cut into seven blocks. Two fingerprints that differ in at most
four bits agree on three blocks at least, so they meet under one of the 35 keys made of
three blocks, each some 27 bits wide. Those who meet are verified, and of the links found
in a bucket only a forest is kept, as only what is reachable counts. A bucket larger than
CHUNK is cut into chunks, whose pairs are compared in tasks of their own.

Null text is as empty text: fingerprint zero. Rows that share a doc_id are documents of
their own; a null doc_id never becomes a component's name unless all its rows have none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_hash, settle
from .components import LINKS, components, stars
from .kernel import Texts, blocks, joined_words

SEED, SHINGLE, BITS, BLOCKS = 42, 4, 4, 7
CHUNK = 4096
SLICE = 1 << 15  # shingles hashed together


def fingerprints_of(column: pa.Array) -> np.ndarray:
    """64-bit fingerprints of texts: a bit is set where over half the shingles' hashes have it.

    Shingles are hashed SLICE at a time and their bits added up, so that a long text needs no
    more memory for its hashes than a short one.
    """
    texts = Texts(column, lower=True)
    data, starts, ends = joined_words(texts)
    n = texts.counts
    shingles = np.where(n > 0, np.maximum(n - SHINGLE + 1, 1), 0)
    edge = np.append(0, np.cumsum(shingles))
    buf, digest = data.tobytes(), xxhash.xxh64_intdigest
    sums = np.zeros((texts.n, 64), np.int64)
    for i in range(0, int(edge[-1]), SLICE):
        at = np.arange(i, min(i + SLICE, int(edge[-1])))
        text = np.searchsorted(edge, at, "right") - 1
        first = texts.ptr[text] + at - edge[text]
        last = np.minimum(first + SHINGLE, texts.ptr[text + 1]) - 1
        h = np.fromiter((digest(buf[a:b], SEED) for a, b in zip(starts[first].tolist(), ends[last].tolist())), np.uint64, len(first))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        new = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        sums[text[new]] += np.add.reduceat(bits, new, axis=0, dtype=np.int32)
    return np.packbits(2 * sums > shingles[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row (tells apart rows of one doc_id), fp bigint; one row for each of docs."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, 2):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fingerprints_of(b.column(2)).view(np.int64))], names=["doc_id", "row", "fp"])

    return docs.select(F.col(doc_id).alias("doc_id"), row_hash(F.col(text)).alias("row"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, row bigint, fp bigint")


def block_masks(parts: int = BLOCKS, bits: int = BITS) -> list[int]:
    """Masks of every choice of parts - bits blocks, as signed 64-bit numbers."""
    edges = [64 * k // parts for k in range(parts + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    masks = [sum(x) for x in combinations(block, parts - bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= BITS  # of signed numbers it would count the bits of the absolute value


def within(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Close pairs with equal keys; keys ascend."""
    u, v = [], []
    at, k = np.arange(len(key)), 0
    while True:
        k += 1
        at = at[: np.searchsorted(at, len(key) - k)]
        at = at[key[at] == key[at + k]]
        if not len(at):
            break
        hit = at[near(fp[at], fp[at + k])]
        u.append(fp[hit])
        v.append(fp[hit + k])
    return (np.concatenate(u), np.concatenate(v)) if u else (fp[:0], fp[:0])


def across(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Close pairs of two chunks."""
    u, v = [], []
    for i in range(0, len(a), 256):
        x, y = np.nonzero(near(a[i : i + 256, None], b[None, :]))
        u.append(a[i + x])
        v.append(b[y])
    return np.concatenate(u), np.concatenate(v)


OUT = f"{LINKS}, key bigint, chunk int, fps binary"


def _links(star: pa.RecordBatch) -> pa.RecordBatch:
    n = star.num_rows
    return pa.RecordBatch.from_arrays([*star.columns, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=["u", "v", "key", "chunk", "fps"])


def _chunk(key: int, k: int, fps: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([key], pa.int64()), pa.array([k], pa.int32()), pa.array([fps.tobytes()], pa.binary())], names=["u", "v", "key", "chunk", "fps"])


def bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, fp) sorted by both: forests of close pairs, and the chunks of large buckets."""
    key, fp, cut = np.zeros(0, np.int64), np.zeros(0, np.int64), {}  # cut: chunks made so far of the bucket that is being read

    def chunks(of: int, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(fps), CHUNK):
            part = fps[i : i + CHUNK]
            u, v = within(np.zeros(len(part), np.int64), part)
            if len(u):
                yield _links(stars(u, v))
            yield _chunk(of, cut.get(of, 0), part)
            cut[of] = cut.get(of, 0) + 1

    def ended(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(first, len(key)))
        large = (size > CHUNK) | np.isin(key[first], list(cut))
        for i in np.flatnonzero(large):
            yield from chunks(int(key[first[i]]), fp[first[i] : first[i] + size[i]])
        rest = ~np.repeat(large, size)
        u, v = within(key[rest], fp[rest])
        if len(u):
            yield _links(stars(u, v))
        cut.clear()

    for batch in batches:
        if not batch.num_rows:
            continue
        key, fp = np.append(key, batch.column(0).to_numpy()), np.append(fp, batch.column(1).to_numpy())
        edge = int(np.searchsorted(key, key[-1]))  # the last bucket may go on in the next batch
        if edge:
            yield from ended(key[:edge], fp[:edge])
            key, fp = key[edge:], fp[edge:]
        if (whole := len(key) // CHUNK * CHUNK) >= 16 * CHUNK:
            yield from chunks(int(key[0]), fp[:whole])
            key, fp = key[whole:], fp[whole:]
    if len(key):
        yield from ended(key, fp)


def chunk_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in zip(batch.column(0), batch.column(1)):
            u, v = across(np.frombuffer(a.as_buffer(), np.int64), np.frombuffer(b.as_buffer(), np.int64))
            if len(u):
                yield stars(u, v)


def links(fps: DataFrame) -> DataFrame:
    """(u, v) that join all fingerprints within BITS of each other; fps: fp bigint, distinct."""
    masks = F.array(*[F.lit(m) for m in block_masks()])
    keyed = fps.select("fp", F.posexplode(masks).alias("k", "m")).select(F.xxhash64("k", F.col("fp").bitwiseAND(F.col("m"))).alias("key"), "fp")
    found = settle(keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(bucket_links, OUT), "buckets")
    chunks = found.where("chunk is not null").select("key", "chunk", "fps")
    pairs = chunks.alias("a").join(chunks.alias("b"), F.expr("a.key = b.key and a.chunk < b.chunk")).select(F.xxhash64("a.key", "a.chunk", "b.chunk").alias("deal"), "a.fps", F.col("b.fps").alias("other"))
    pairs = pairs.repartition("deal").select("fps", "other")  # a bucket's pairs of chunks are compared in many tasks
    return found.where("chunk is null").select("u", "v").union(pairs.mapInArrow(chunk_links, LINKS))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row, fp, component_id: the smallest doc_id reached over links, one row per document.

    Exact copies share a fingerprint and so are one node; ties go to the smallest doc_id.
    An empty table gives an empty result.
    """
    fps = settle(fingerprints(docs, doc_id, text), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    root = components(links(nodes.select("fp")))
    named = nodes.join(root, F.col("fp") == F.col("u"), "left").select("fp", "least", F.coalesce("v", "fp").alias("root"))
    of_root = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = named.join(of_root, "root").select("fp", "component_id")
    return fps.join(of_fp, "fp").select("doc_id", "row", "fp", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without near-duplicates: of each component the row with its smallest doc_id stays.

    Of rows that share that doc_id and are in the same component, one stays. Rows without a
    doc_id have no name to be kept under: all of them stay.
    """
    found = near_duplicates(docs, doc_id, text)
    best = found.where("doc_id = component_id").groupBy("doc_id", "component_id").agg(F.min("row").alias("row"))
    keep = best.select(F.col("doc_id").alias("_i"), F.col("row").alias("_r")).distinct()
    marked = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_i"), row_hash(F.col(text)).alias("_r"), F.struct("*").alias("_d"))
    kept = marked.join(keep, ["_i", "_r"], "left_semi").groupBy("_i", "_r").agg(F.first("_d").alias("_d"))
    return kept.select("_d.*").union(docs.where(F.col(doc_id).isNull()))
