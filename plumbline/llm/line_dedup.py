"""Line dedup: three-line windows that occur earlier in the corpus are cut out.

A document's lines are its \\n-split lines; those without a word separate nothing and are
passed over. Every three consecutive lines left are a window of the lines' exact bytes. A
line goes if any window that covers it also starts earlier (smaller doc_id, or same document
and earlier line). Windows are judged on the input. Documents of fewer than three such lines,
empty and null texts stay as they are; an empty table gives an empty result.

Rows that share a doc_id are ordered by a hash of their text, fully equal ones are simultaneous.
A null doc_id comes first, and so does the smallest 64-bit number, which is read as null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import Texts, blocks, hash_spans, per_text
from .repeats import LOWEST, keyed, kept_bytes, parts_for, removed_items, repeated_spans, with_spans

WINDOW = 3


def full_lines(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and ptr of the lines that have a word."""
    starts, ends, ptr = texts.lines()
    full = np.searchsorted(texts.starts, starts) < np.searchsorted(texts.starts, ends)
    return starts[full], ends[full], np.append(0, np.cumsum(full))[ptr]


def line_items(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, ptr = full_lines(texts)
    return hash_spans(texts.data, starts, ends, 0), hash_spans(texts.data, starts, ends, 1), ptr


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    rows = keyed(docs, doc_id, text)
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return repeated_spans(rows, line_items, window, parts_for(total))


def _cut(b: pa.RecordBatch, text: pa.Array, spans: pa.Array) -> tuple[Texts, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    texts = Texts(text)
    starts, ends, ptr = full_lines(texts)
    gone = removed_items(spans, ptr)
    data, at = kept_bytes(texts.data, starts, ends, ~gone, ptr, 10)
    return texts, gone, ptr, data, at


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with the repeated lines cut out of their texts; other texts, and other columns, unchanged."""
    found = repeated_lines(docs, doc_id, text, window)
    rows = docs.select(F.struct("*").alias("_d"), F.coalesce(F.col(doc_id).cast("bigint"), F.lit(LOWEST)).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("row"), F.col(text).alias("_t"))
    joined = with_spans(rows, found).select("_d", "_t", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, 1):
            hit = b.column(2).is_valid()
            some = b.filter(hit)
            if not some.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.nulls(b.num_rows, pa.string())], names=["_d", "_new"])
                continue
            _, _, _, data, at = _cut(some, some.column(1), some.column(2))
            new = pa.Array.from_buffers(pa.string(), some.num_rows, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])
            place = np.cumsum(hit.to_numpy(zero_copy_only=False)) - 1
            yield pa.RecordBatch.from_arrays([b.column(0), new.take(pa.array(place, mask=~hit.to_numpy(zero_copy_only=False)))], names=["_d", "_new"])

    cut = joined.mapInArrow(run, joined.select("_d").schema.add("_new", "string"))
    return cut.select(*[F.coalesce("_new", F.col(f"_d.`{c}`")).alias(c) if c == text else F.col(f"_d.`{c}`") for c in docs.columns])


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_lines (with a word), n_removed, kept_sha256 of the kept ones joined by \\n."""
    found = repeated_lines(docs, doc_id, text, window)
    joined = with_spans(keyed(docs, doc_id, text), found).select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, 1):
            _, gone, ptr, data, at = _cut(b, b.column(1), b.column(2))
            yield digest_rows(b.column(0), np.diff(ptr), per_text(gone, ptr), data, at, "n_lines")

    return joined.mapInArrow(run, "doc_id bigint, n_lines bigint, n_removed bigint, kept_sha256 string")


def digest_rows(doc_id: pa.Array, n: np.ndarray, gone: np.ndarray, data: np.ndarray, at: np.ndarray, name: str) -> pa.RecordBatch:
    buf = memoryview(np.ascontiguousarray(data))
    sha = [hashlib.sha256(buf[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
    ids = doc_id.to_numpy()
    return pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == LOWEST), pa.array(n.astype(np.int64)), pa.array(gone.astype(np.int64)), pa.array(sha, pa.string())], names=["doc_id", name, "n_removed", "kept_sha256"])
