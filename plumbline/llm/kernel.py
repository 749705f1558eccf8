"""Vectorised text kernels over Arrow buffers.

Everything works on the UTF-8 bytes of a whole Arrow string column at once: words are
maximal runs of bytes outside ``\\x20\\x09-\\x0D``, found without making Python strings.
Hashes are 64-bit polynomial sums of random byte values, finished by a mixer; two
independent families are offered where 128 bits are wanted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text handled together; temporaries are some thirty times as large.
BLOCK = 1 << 20
#: Bytes, or items, that are summed up together; the kept tables of powers are as long.
SEGMENT = 1 << 18


def _family(seed: int) -> tuple[np.ndarray, int, int]:
    rng = np.random.default_rng(seed)
    table = rng.integers(1, 2**64, 256, dtype=U64, endpoint=False) | U64(1)
    base = int(rng.integers(2**40, 2**63)) // 8 * 8 + 5  # of the largest order modulo 2**64
    return table, base, pow(base, -1, 2**64)


FAMILIES = [_family(k) for k in (11, 12, 13, 14)]
_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(family: int, n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of a family's base (or of its inverse) modulo 2**64."""
    had = _powers.get((family, inverse))
    if had is None or len(had) < n:
        size = max(SEGMENT + 1, n)
        out = np.full(size, FAMILIES[family][1 + inverse], U64)
        out[0] = 1
        had = np.multiply.accumulate(out)
        if size == SEGMENT + 1:  # tables for longer words aren't kept
            _powers[family, inverse] = had
    return had[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(31))) * U64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> U64(29))) * U64(0xBF58476D1CE4E5B9)
    return h ^ (h >> U64(32))


def _sums(values: np.ndarray, family: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(family, len(values)), out=out[1:])
    return out


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    """Hashes of the byte ranges; starts and ends ascend."""
    out, table, i, n = np.empty(len(starts), U64), FAMILIES[family][0], 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SEGMENT, "right")))
        at = starts[i]
        sums = _sums(table[data[at : ends[j - 1]]], family)
        a, b = starts[i:j] - at, ends[i:j] - at
        out[i:j] = mix((sums[b] - sums[a]) * powers(family, len(sums), True)[a])
        i = j
    return out


def hash_windows(items: np.ndarray, first: np.ndarray, size: int, family: int = 2) -> np.ndarray:
    """Hashes of the runs of ``size`` items that start at ``first`` (ascending)."""
    out, i, n, most = np.empty(len(first), U64), 0, len(first), SEGMENT // 2
    while i < n:
        j = max(i + 1, int(np.searchsorted(first, first[i] + most, "right")))
        at = first[i]
        sums = _sums(items[at : first[j - 1] + size], family)
        a = first[i:j] - at
        out[i:j] = mix((sums[a + size] - sums[a]) * powers(family, len(sums), True)[a])
        i = j
    return out


class Texts:
    """The bytes of a block of texts and where its words stand.

    data: all bytes; offsets: of the texts; starts, ends: of the words; ptr: the words of
    text i are ptr[i] to ptr[i + 1].
    """

    def __init__(self, column: pa.Array, lower: bool = False):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if column.null_count:
            column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
        wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
        _, offsets, data = column.buffers()
        n = len(column)
        if n:
            at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
        else:
            at = np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
        self.data, self.offsets, self.n = (LOWER[raw] if lower else raw), at - at[0], n
        self._words()

    def _words(self) -> None:
        data, offsets = self.data, self.offsets
        space = SPACE[data]
        opens, closes = np.ones(len(data), bool), np.ones(len(data), bool)
        opens[1:], closes[:-1] = space[:-1], space[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        opens[edges], closes[edges - 1] = True, True
        self.space = space
        self.starts, self.ends = np.flatnonzero(opens & ~space), np.flatnonzero(closes & ~space) + 1
        self.ptr = np.searchsorted(self.starts, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    def text_of(self) -> np.ndarray:
        """The index of each word's text."""
        return np.repeat(np.arange(self.n), self.counts)

    def hashes(self, family: int = 0) -> np.ndarray:
        return hash_spans(self.data, self.starts, self.ends, family)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the \\n-split lines of all texts, and ptr as for words."""
        breaks = np.flatnonzero(self.data == 10)
        starts = np.sort(np.concatenate([self.offsets[:-1], breaks + 1]), kind="stable")
        text_ends = self.offsets[1:]
        ends = np.sort(np.concatenate([text_ends, breaks]), kind="stable")
        per = np.searchsorted(breaks, self.offsets)
        return starts, ends, np.concatenate([[0], np.cumsum(np.diff(per) + 1)]).astype(np.int64)


def window_starts(ptr: np.ndarray, size: int) -> np.ndarray:
    """Starts of all runs of ``size`` items that lie within one text, ascending."""
    counts = np.maximum(np.diff(ptr) - size + 1, 0)
    return ragged(ptr[:-1], counts)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... (counts[i] of them), for all i in turn."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(starts - before, counts)


def per_text(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sums of the values of each text. Those of floats don't depend on the texts beside it."""
    if values.dtype.kind == "f":
        out, some = np.zeros(len(ptr) - 1), ptr[1:] > ptr[:-1]
        if some.any():
            out[some] = np.add.reduceat(values[: ptr[-1]], ptr[:-1][some], dtype=np.float64)
        return out
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[ptr[1:]] - sums[ptr[:-1]]


def covered(first: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n items lie in a run of ``size`` that starts at one of ``first``."""
    edge = np.bincount(first, minlength=n + 1) - np.bincount(first + size, minlength=n + 1)
    return np.cumsum(edge)[:n] > 0


def blocks(batches: Iterator[pa.RecordBatch], column: int, limit: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Batches cut, or joined, to some ``limit`` bytes of the text column; a longer text stands alone."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(column)
        wide = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
        at = np.frombuffer(text.buffers()[1], np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        i = 0
        while i < len(text):
            j = max(i + 1, int(np.searchsorted(at, at[i] + limit - size, "right")) - 1)
            held.append(batch.slice(i, min(j, len(text)) - i))
            size += int(at[min(j, len(text))] - at[i])
            i = j
            if size >= limit or i < len(text):
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.concat_batches(held)


def packed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column whose row i holds counts[i] of the values, in turn."""
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts * values.dtype.itemsize, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def joined_words(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words, each followed by one space, and where each starts and ends there."""
    edges = texts.offsets[1:]
    space = np.insert(texts.space, edges, True)  # each text gets a space behind it
    keep = ~space
    keep[1:] |= keep[:-1].copy()
    out = np.insert(texts.data, edges, np.uint8(32))[keep]
    out[space[keep]] = 32
    size = texts.ends - texts.starts
    ends = np.cumsum(size + 1) - 1
    return out, ends - size, ends


def unpacked(column: pa.Array, dtype: type) -> np.ndarray:
    """The values of all rows of a packed column, in turn."""
    parts = [np.frombuffer(x.as_buffer(), dtype) for x in column if x.is_valid]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)
