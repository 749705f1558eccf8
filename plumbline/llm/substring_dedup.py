"""Substring dedup: words in 20-word windows that occur earlier are cut out.

First pass: each partition sketches its windows (count-min, two rows of cells) and the
sketches are merged. A window is counted under its rarest-hash ten-word gram (of its eleven
grams the one with the smallest hash, the leftmost of equals), which two equal windows choose
alike, and each place of such a gram counts once. A window's count is thus never more than
its gram's, nor that more than any of its cells: estimates are too high at times, never too
low, and no repeated window is lost. Second pass: only windows estimated repeated are grouped
exactly, by 96-bit hashes.

The merged sketch is one bit a cell (is the count two or more?). Its width follows the input
up to MOST_CELLS, which bounds what is broadcast; beyond that more windows reach the exact
pass, and the result is the same.

Rows that share a doc_id are ordered by a hash of their text, fully equal ones are
simultaneous; a null doc_id comes first, and so does the smallest 64-bit number, which is read as
null; null and empty texts have no words; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import Texts, blocks, hash_windows, packed, per_text, window_starts
from .line_dedup import digest_rows
from .repeats import keyed, kept_bytes, parts_for, removed_items, repeated_spans, with_spans

WINDOW, GRAM = 20, 10
ROWS = 2
MOST_CELLS = 1 << 28  # a row: 2 x 32 MB are broadcast at most
SHARD = 1 << 20  # cells that are merged together


def word_items(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return texts.hashes(0), texts.hashes(1), texts.ptr


def chosen_grams(words: np.ndarray, start: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """For each window the place of its gram of the smallest hash, and that hash."""
    if not len(start):
        return start, np.zeros(0, np.uint64)
    lo, hi = start[0], start[-1] + window
    grams = hash_windows(words, np.arange(lo, hi - gram + 1), gram, 2)
    view = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1)
    place = np.empty(len(start), np.int64)
    for i in range(0, len(start), 1 << 16):
        s = start[i : i + (1 << 16)] - lo
        rows = view[s[0] : s[-1] + 1]
        best = rows[:, 0].copy()
        at = np.zeros(len(rows), np.int64)
        for k in range(1, rows.shape[1]):
            less = rows[:, k] < best
            best[less], at[less] = rows[less, k], k
        place[i : i + len(s)] = s + at[s - s[0]]
    return place + lo, grams[place]


def cells_of(h: np.ndarray, row: int, cells: int) -> np.ndarray:
    return ((h >> np.uint64(32 * row)) & np.uint64(cells - 1)).astype(np.int64)


def sketcher(cells: int, window: int, gram: int):
    """For mapInArrow: sparse sketches of blocks, a row for each shard of each row of cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, 0, 16 << 20):
            texts = Texts(b.column(0))
            place, h = chosen_grams(texts.hashes(0), window_starts(texts.ptr, window), window, gram)
            h = h[np.append(True, place[1:] != place[:-1])] if len(h) else h
            for row in range(ROWS):
                cell, n = np.unique(cells_of(h, row, cells), return_counts=True)
                edges = np.searchsorted(cell, np.arange(0, cells + 1, min(SHARD, cells)))
                some = np.flatnonzero(np.diff(edges))
                counts = np.diff(edges)[some]
                at = (cell % SHARD).astype(np.uint32) | (n > 1).astype(np.uint32) << np.uint32(31)
                yield pa.RecordBatch.from_arrays([pa.array((some * ROWS + row).astype(np.int32)), packed(at, counts)], names=["shard", "cells"])

    return run


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up sparse sketches of each shard: a bit for each cell whose count is two or more."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for b in batches:
        for shard, cells in zip(b.column(0).to_pylist(), b.column(1)):
            once, twice = held.setdefault(shard, (np.zeros(SHARD, bool), np.zeros(SHARD, bool)))
            x = np.frombuffer(cells.as_buffer(), np.uint32)
            at = x & np.uint32(0x7FFFFFFF)
            twice[at[once[at] | (x >> np.uint32(31) > 0)]] = True
            once[at] = True
    for shard, (_, twice) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([np.packbits(twice).tobytes()], pa.binary())], names=["shard", "bits"])


def sketch(docs: DataFrame, total_bytes: int, text: str = "text", window: int = WINDOW, gram: int = GRAM) -> tuple[int, list[np.ndarray]]:
    """Cells in a row, and the rows' bits; at most ROWS * MOST_CELLS / 8 bytes reach the driver."""
    cells = min(MOST_CELLS, max(1 << 16, 1 << int(total_bytes // 4).bit_length()))
    rows = [np.zeros(max(cells, SHARD) // 8, np.uint8) for _ in range(ROWS)]
    parts = docs.select(text).mapInArrow(sketcher(cells, window, gram), "shard int, cells binary")
    for shard, bits in parts.repartition("shard").mapInArrow(merged, "shard int, bits binary").toLocalIterator():
        rows[shard % ROWS][shard // ROWS * SHARD // 8 : (shard // ROWS + 1) * SHARD // 8] = np.frombuffer(bits, np.uint8)
    return cells, rows


def sieve(shared, cells: int, window: int, gram: int):
    """The Wanted of repeats.py: windows whose gram's every cell has a count of two or more."""

    def make():
        rows = shared.value

        def wanted(words: np.ndarray, start: np.ndarray) -> np.ndarray:
            place, h = chosen_grams(words, start, window, gram)
            ok = np.ones(len(h), bool)
            for row, bits in enumerate(rows):
                cell = cells_of(h, row, cells)
                ok &= bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1 > 0
            return ok

        return wanted

    return make


def repeated_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    spark = docs.sparkSession
    gram = max(1, window // 2)
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    cells, rows = sketch(docs, total, text, window, gram)
    shared = spark.sparkContext.broadcast(rows)
    return repeated_spans(keyed(docs, doc_id, text), word_items, window, parts_for(total), sieve(shared, cells, window, gram))


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of the kept words joined by one space."""
    found = repeated_words(docs, doc_id, text, window)
    joined = with_spans(keyed(docs, doc_id, text), found).select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, 1):
            texts = Texts(b.column(1))
            gone = removed_items(b.column(2), texts.ptr)
            data, at = kept_bytes(texts.data, texts.starts, texts.ends, ~gone, texts.ptr, 32)
            yield digest_rows(b.column(0), texts.counts, per_text(gone, texts.ptr), data, at, "n_words")

    return joined.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")
