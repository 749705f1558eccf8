"""Best-fit packing of whole documents into sequences of at most 2048 tokens.

Only documents longer than a sequence are cut, into full pieces and one last piece. Full
pieces are sequences by themselves. The rest are dealt at random into groups, and each group
is packed online in bounded space: a fixed number of open bins stand in a bitset keyed by
free space, a piece goes to the open bin that it leaves fullest, and where all are open and
none fits, the fullest closes first.

Ids are those of the tokenizer file, id 0 ends a document. Words repeat, so each block of
text tokenizes only words that its worker hasn't met: plain ones through the same merges run
by a faster engine, with ids that equal the tokenizer's; all others by the tokenizer itself.
A null text is as an empty one: one piece that holds only the end. Rows that share a doc_id, or are
equal in all columns, are documents of their own. Pieces of one length are packed in the order of their
ids' checksum. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import settle
from .kernel import Texts, blocks, ragged

SIZE, OPEN = 2048, 256
GROUP = 16384  # pieces packed together, about
MARK = "\x01"  # ends a word for the faster engine
PLAIN = regex.compile(r"[\x21-\x7e¡-¬®-ÿ]+")
MOST_WORDS = 3_000_000  # a worker's memory of words


class WordIds:
    """Ids of single words, remembered in a table sorted by hash; bounded by MOST_WORDS."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        back = {c: b for b, c in _byte_letters().items()}
        suffix = spec["model"]["end_of_word_suffix"]
        ranks = {}
        for token, i in spec["model"]["vocab"].items():
            body, end = (token[: -len(suffix)], MARK.encode()) if token.endswith(suffix) else (token, b"")
            if all(c in back for c in body):
                ranks.setdefault(bytes(back[c] for c in body) + end, i)
        self.fast = tiktoken.Encoding("plain", pat_str=rf"[^{MARK}\n]+{MARK}|\n", mergeable_ranks=ranks, special_tokens={})
        self.line = self.fast.encode_single_token(b"\n")  # words have none, so it can part them
        self.clear()

    def clear(self) -> None:
        self.hashes, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def encode(self, words: list[str]) -> list[np.ndarray | list[int]]:
        out: list = [None] * len(words)
        plain = [i for i, w in enumerate(words) if PLAIN.fullmatch(w) and "<|" not in w]
        odd = sorted(set(range(len(words))).difference(plain))
        if plain:
            ids = np.array(self.fast.encode_ordinary(self.pieces.sub(rf"\g<0>{MARK}", "\n".join([words[i] for i in plain]).lower()) + "\n"), np.uint32)
            stops = np.flatnonzero(ids == self.line)
            begin = 0
            for i, stop in zip(plain, stops.tolist()):
                out[i] = ids[begin:stop]
                begin = stop + 1
        for i, e in zip(odd, self.tokenizer.encode_batch([words[i] for i in odd], add_special_tokens=False)):
            out[i] = np.array(e.ids, np.uint32)
        return out

    def of(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts' words in turn, and how many each word has."""
        h = texts.hashes(0)
        distinct, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        new = np.flatnonzero(~np.isin(distinct, self.hashes, assume_unique=True))
        if len(new):
            if len(self.hashes) + len(new) > MOST_WORDS:
                self.clear()
                new = np.arange(len(distinct))
            buf = texts.data.tobytes()
            at = first[new]
            found = self.encode([buf[a:b].decode("utf-8", "replace") for a, b in zip(texts.starts[at].tolist(), texts.ends[at].tolist())])
            n = np.array([len(x) for x in found], np.int64)
            begin = len(self.ids) + np.cumsum(n) - n
            self.ids = np.concatenate([self.ids, *found]).astype(np.uint32)
            hashes = np.append(self.hashes, distinct[new])
            order = np.argsort(hashes, kind="stable")
            self.hashes, self.at, self.n = hashes[order], np.append(self.at, begin)[order], np.append(self.n, n)[order]
        spot = np.searchsorted(self.hashes, distinct)[inverse]
        counts = self.n[spot]
        return self.ids[ragged(self.at[spot], counts)], counts


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies spell bytes: printable ones as themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


_made: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _made:
        _made[path] = WordIds(path)
    return _made[path]


PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint"


def piecer(path: str, size: int):
    """For mapInArrow over (doc_id, text): a row for each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, 1):
            texts = Texts(b.column(1))
            ids, per_word = word_ids(path).of(texts)
            sums = np.append(0, np.cumsum(per_word))
            edge = sums[texts.ptr] + np.arange(texts.n + 1)  # with an end for each text before
            full = np.zeros(int(edge[-1]), np.uint32)
            ends = edge[1:] - 1
            body = np.ones(len(full), bool)
            body[ends] = False
            full[body] = ids
            total = np.diff(edge)
            pieces = -(-total // size)
            piece = ragged(np.zeros(texts.n, np.int64), pieces)
            doc = np.repeat(np.arange(texts.n), pieces)
            start = piece * size
            length = np.minimum(total[doc] - start, size)
            buf, at = memoryview(full.astype("<u4")).cast("B"), (edge[:-1][doc] + start) * 4
            crc = [zlib.crc32(buf[a : a + n]) for a, n in zip(at.tolist(), (length * 4).tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def best_fit(lengths: list[int], size: int = SIZE, most_open: int = OPEN) -> tuple[list[int], list[int]]:
    """For each length its bin and its offset there. Bit s of the set: some open bin has s free places."""
    free_set, n_open, bins, used = 0, 0, 0, []
    by_free: list[list[int]] = [[] for _ in range(size + 1)]
    to, offsets = [], []
    for n in lengths:
        fits = free_set >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1  # the least free space that takes it
            k = by_free[free].pop()
            if not by_free[free]:
                free_set ^= 1 << free
        else:
            if n_open == most_open:  # the fullest closes
                least = (free_set & -free_set).bit_length() - 1
                by_free[least].pop()
                if not by_free[least]:
                    free_set ^= 1 << least
                n_open -= 1
            k, free = bins, size
            bins += 1
            used.append(0)
            n_open += 1
        to.append(k)
        offsets.append(used[k])
        used[k] += n
        left = free - n
        if left:
            by_free[left].append(k)
            free_set |= 1 << left
        else:
            n_open -= 1
    return to, offsets


def pack(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, most_open: int = OPEN) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    sequence_id: group and number in it, or for full pieces a number of their own, negative.
    Only rows of lengths are shuffled. The groups' number follows the pieces' number, so that
    the share left open in a group's last bins stays as small at every size.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    pieces = settle(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(piecer(path, size), f"doc_id {kind}, {PIECES}"), "pieces")
    whole = pieces.where(F.col("length") == size).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("bigint"))
    rest = pieces.where(F.col("length") < size)
    groups = max(1, rest.count() // GROUP)
    # by place in the written table: equal rows are dealt to all groups alike
    rest = rest.withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(unpack_order(table), kind="stable")
        table = table.take(pa.array(order))
        to, offsets = best_fit(table["length"].to_pylist(), size, most_open)
        g = table["g"][0].as_py()
        return table.drop_columns(["g"]).append_column("sequence_id", pa.array(np.array(to, np.int64) + (g << 32))).append_column("offset", pa.array(offsets, pa.int64()))

    packed = rest.groupBy("g").applyInArrow(run, f"doc_id {kind}, {PIECES}, sequence_id bigint, offset bigint")
    return whole.unionByName(packed)


def unpack_order(table: pa.Table) -> np.ndarray:
    """A random order of a group's pieces by their ids; pieces of equal ids stay in the order they arrive in."""
    return table["ids_crc32"].to_numpy() * 2654435761 % 4294967291
