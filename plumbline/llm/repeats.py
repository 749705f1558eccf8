"""Windows that occur earlier: the engine of line dedup and substring dedup.

A document is a run of items (lines or words). A window is ``size`` consecutive items; the
items of every window whose sequence also starts earlier are marked. Earlier means a smaller
(doc_id, row, position), so rows that share a doc_id are ordered by a hash of their text and
fully equal rows are simultaneous. A null doc_id comes first. Windows are judged on the input.

Windows travel as packed arrays, one row for each block of text and hash range, so that a
shuffle moves few rows. In a block only the first occurrence of a window travels: later ones
are known to be repeated there. A hot window thus counts once for each block, and no range
holds more than its share of the hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_hash, settle
from .kernel import Texts, blocks, hash_windows, packed, ragged, unpacked, window_starts

MOST_TASKS = 50_000
BITS_EACH, MOST_BITS = 16, 1 << 29  # of the bitmap of documents with spans: 64 MB at most
SENT = 4 << 20  # bytes of text whose windows are packed together
LOWEST = -(1 << 63)  # stands for a null doc_id
PACKED = "r int, docs binary, doc binary, at binary, h binary, g binary"
SPANS = "doc_id bigint, row bigint, spans binary"

#: texts -> (first hashes, second hashes, ptr) of their items
Items = Callable[[Texts], tuple[np.ndarray, np.ndarray, np.ndarray]]
#: makes, once for each task: (first hashes, window starts) -> which of the windows may be repeated
Wanted = Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]]


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(LOWEST)).alias("doc_id"), row_hash(F.col(text)).alias("row"), F.col(text).alias("text"))


def spread(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Which of so many equal ranges each hash is in."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """True where a row differs from the row above it."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _ranks(docs: np.ndarray) -> np.ndarray:
    """Dense ranks of the rows (doc_id, row)."""
    order = np.lexsort((docs[:, 1], docs[:, 0]))
    out = np.empty(len(docs), np.int64)
    out[order] = np.cumsum(_runs(docs[order, 0], docs[order, 1]))
    return out


def _packed(r: np.ndarray, docs: np.ndarray, doc: np.ndarray, at: np.ndarray, h: np.ndarray | None = None, g: np.ndarray | None = None) -> pa.RecordBatch:
    """A row for each value of r, with the keys of the documents that it has and arrays by window."""
    order = np.lexsort((at, doc, r))
    r, doc, at = r[order], doc[order], at[order]
    first = np.flatnonzero(_runs(r))
    counts = np.diff(np.append(first, len(r)))
    new = _runs(r, doc)
    group = np.repeat(np.arange(len(first)), counts)
    have = np.bincount(group[new], minlength=len(first))
    local = np.cumsum(new) - 1 - np.repeat(np.cumsum(have) - have, counts)
    none = pa.nulls(len(first), pa.binary())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(r[first].astype(np.int32)),
            packed(docs[doc[new]].reshape(-1), have * 2),
            packed(local.astype(np.int32), counts),
            packed(at.astype(np.int32), counts),
            none if h is None else packed(h[order], counts),
            none if g is None else packed(g[order], counts),
        ],
        names=["r", "docs", "doc", "at", "h", "g"],
    )


def _later(h: np.ndarray, g: np.ndarray, rank: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by window and occurrence; there, which begin a window and which aren't its first occurrence."""
    order = np.lexsort((at, rank, g, h))
    new = _runs(h[order], g[order])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    rank, at = rank[order], at[order]
    return order, new, (rank != rank[lead]) | (at != at[lead])


def _by_doc(docs: np.ndarray, doc: np.ndarray, at: np.ndarray, parts: int) -> pa.RecordBatch:
    code = docs[:, 0].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ docs[:, 1].view(np.uint64)
    return _packed(spread(code * np.uint64(0xD6E8FEB86659FD93), parts)[doc], docs, doc, at)


def emitter(items: Items, size: int, parts: int, wanted: Wanted | None):
    """For mapInArrow over keyed(): packed windows, and without hashes the starts known to be repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = wanted() if wanted else None
        for b in blocks(batches, 2, SENT):
            texts = Texts(b.column(2))
            docs = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], axis=1)
            one, two, ptr = items(texts)
            start = window_starts(ptr, size)
            if sieve is not None and len(start):
                start = start[sieve(one, start)]
            if not len(start):
                continue
            h, g = hash_windows(one, start, size, 2), (hash_windows(two, start, size, 3) >> np.uint64(32)).astype(np.uint32)
            doc = np.searchsorted(ptr, start, "right") - 1
            at = start - ptr[doc]
            order, new, later = _later(h, g, _ranks(docs)[doc], at)
            if later.any():
                yield _packed(spread(h[order[later]], parts), docs, doc[order[later]], at[order[later]])
            first = order[new]
            yield _packed(spread(h[first], parts), docs, doc[first], at[first], h[first], g[first])

    return run


def _whole(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """docs, doc and at of all rows, with doc an index into docs."""
    docs = unpacked(table["docs"], np.int64).reshape(-1, 2)
    counts = np.array([len(x.as_buffer()) // 4 for x in table["at"]], np.int64)
    have = np.array([len(x.as_buffer()) // 16 for x in table["docs"]], np.int64)
    return docs, unpacked(table["doc"], np.int32) + np.repeat(np.cumsum(have) - have, counts), unpacked(table["at"], np.int32)


def repeats(parts: int):
    """For applyInArrow by r: of each window all occurrences but the first, packed by document."""

    def run(table: pa.Table) -> pa.Table:
        out = []
        known = table.filter(table["h"].is_null())
        if known.num_rows:
            out.append(_by_doc(*_whole(known), parts))
        table = table.filter(table["h"].is_valid())
        if table.num_rows:
            docs, doc, at = _whole(table)
            order, _, later = _later(unpacked(table["h"], np.uint64), unpacked(table["g"], np.uint32), _ranks(docs)[doc], at)
            if later.any():
                out.append(_by_doc(docs, doc[order[later]], at[order[later]], parts))
        if not out:
            return pa.table({"r": pa.array([], pa.int32()), **{k: pa.array([], pa.binary()) for k in ("docs", "doc", "at", "h", "g")}})
        return pa.Table.from_batches(out)

    return run


def spans(size: int):
    """For applyInArrow by r: each document's covered items as merged [start, end) pairs."""

    def run(table: pa.Table) -> pa.Table:
        docs, doc, at = _whole(table)
        rank = _ranks(docs)[doc]
        order = np.lexsort((at, rank))
        doc, at, rank = doc[order], at[order].astype(np.int64), rank[order]
        new_doc = _runs(rank)
        begin = new_doc.copy()
        begin[1:] |= at[1:] > at[:-1] + size
        stop = np.append(begin[1:], True)
        pairs = np.stack([at[begin], at[stop] + size], axis=1).astype(np.int32)
        counts = np.bincount(np.cumsum(new_doc)[begin] - 1)
        key = docs[doc[new_doc]]
        return pa.table({"doc_id": key[:, 0], "row": key[:, 1], "spans": packed(pairs.reshape(-1), counts * 2)})

    return run


def repeated_spans(docs: DataFrame, items: Items, size: int, parts: int, wanted: Wanted | None = None) -> DataFrame:
    """doc_id, row, spans (packed int32 pairs of item numbers) of the documents that have repeated windows; docs: as keyed() gives."""
    windows = docs.mapInArrow(emitter(items, size, parts, wanted), PACKED)
    later = windows.repartition(tasks_for(parts), "r").groupBy("r").applyInArrow(repeats(parts), PACKED)
    return later.repartition(tasks_for(parts), "r").groupBy("r").applyInArrow(spans(size), SPANS)


def with_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs (doc_id, row and others) with their spans, null where they have none; found: as repeated_spans() gives.

    Only documents that may have spans are shuffled to meet them: a bitmap of the hashes of found's keys, of BITS_EACH bits a key
    and MOST_BITS in all, tells most others apart where they are read. Beyond that size more of them are shuffled, and the result is the same.
    """
    found = settle(found, "spans")
    bits = min(MOST_BITS, max(1 << 16, 1 << (BITS_EACH * found.count()).bit_length()))
    place = F.pmod(F.xxhash64("doc_id", "row"), F.lit(bits)) + 1
    maps = settle(found.groupBy(F.bitmap_bucket_number(place).alias("_b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_m")), "bitmap")
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("_m", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    maybe = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    # at most MOST_BITS / 8 bytes are broadcast
    marked = docs.join(F.broadcast(maps), F.bitmap_bucket_number(place) == F.col("_b"), "left").withColumn("_maybe", maybe).drop("_b", "_m")
    met = marked.where("_maybe").drop("_maybe").join(found, ["doc_id", "row"], "left").select(*docs.columns, "spans")
    return marked.where("not _maybe").select(*docs.columns, F.lit(None).cast("binary").alias("spans")).union(met)


def removed_items(column: pa.Array, ptr: np.ndarray) -> np.ndarray:
    """Which items the spans of their texts (null: none) cover."""
    n = int(ptr[-1]) if len(ptr) else 0
    counts = np.array([len(x.as_buffer()) // 8 if x.is_valid else 0 for x in column], np.int64)
    pairs = unpacked(column, np.int32).reshape(-1, 2) + np.repeat(ptr[:-1], counts)[:, None]
    edge = np.bincount(pairs[:, 0], minlength=n + 1) - np.bincount(pairs[:, 1], minlength=n + 1)
    return np.cumsum(edge)[:n] > 0


def kept_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kept: np.ndarray, ptr: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
    """The kept items of all texts, those of a text joined by one byte ``by``; and where each text begins."""
    counts = np.add.reduceat(np.append(kept, False).astype(np.int64), np.minimum(ptr[:-1], len(kept))) if len(ptr) > 1 else np.zeros(0, np.int64)
    counts = np.where(np.diff(ptr) > 0, counts, 0)
    first, size = starts[kept], (ends - starts)[kept] + 1
    out = np.append(data, np.uint8(by))[ragged(first, size)]
    stops = np.cumsum(size)
    out[stops - 1] = by
    keep = np.ones(len(out), bool)
    tail = np.cumsum(counts)[counts > 0] - 1
    keep[stops[tail] - 1] = False  # none after a text's last item
    sums = np.append(0, np.cumsum(size))
    lengths = sums[np.cumsum(counts)] - sums[np.cumsum(counts) - counts] - (counts > 0)
    return out[keep], np.append(0, np.cumsum(lengths))


def parts_for(total_bytes: int, each: int = 8 << 20) -> int:
    """Hash ranges for so much text: each gets what some ``each`` bytes of it have to send."""
    return total_bytes // each + 1


def tasks_for(parts: int) -> int:
    """Tasks for so many hash ranges: about one for each, so that a task reads no more as the input grows. Beyond MOST_TASKS each takes several in turn."""
    return min(parts, MOST_TASKS)
