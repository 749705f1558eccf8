"""Which tokens of two tokenizers stand for the same bytes, and how often two ids are linked in the whole corpus.

Each text is cut by both tokenizers into tokens with byte ranges of the same string, a space and
the text. Bytes where a token of both ends cut them into groups; links are pairs of tokens, one of
each side, whose ranges end together, or with ``links="overlaps"`` whose ranges overlap.

A worker holds an in-memory DuckDB. Texts are cut where no token of either side can cross: before a
space that follows something other than white space. Such units repeat, so the interval tables of a
block hold only units that the worker hasn't met. ASOF joins find the first and the last token of B
that a token of A overlaps, a range join expands what lies between, and window sums over the ends
that both have number the groups. Texts are then counts of units. Each task's counts of pairs are
merged by Spark. Pairs with at least one in FREQUENT of all links, FREQUENT at most, are broadcast to score the
documents; the others are joined by pair, so none of these is hot.

A null or empty text, and one whose tokens' bytes differ from space and text (one with U+2581, which is as
a space to B), has no tokens: zeros and an empty digest. Rows that share a doc_id, or are equal in all
columns, are documents of their own, and each counts. An empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle
from .kernel import blocks, packed, unpacked
from .packing import _byte_letters

FREQUENT = 200_000
MOST_UNITS = 200_000  # a worker's memory of units
BLOCK = 2 << 20  # bytes of text worked on together
MARK = "▁"  # a space in the pieces of B
#: Fixed value: how a byte-level vocabulary cuts a text before its merges.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CUT = re.compile(r"(?<=\S) ")

#: Tokens a and b of all units in turn, with ends in the bytes of all.
CROSSINGS = """
CREATE OR REPLACE TEMP TABLE crossings AS
WITH spans AS (SELECT a.i, a.id, a.e, first.i AS lo, last.i AS hi FROM a ASOF JOIN b first ON a.s >= first.s ASOF JOIN b last ON a.e > last.s),
ranges AS (SELECT i, id, e, unnest(range(lo, hi + 1)) AS j FROM spans)
SELECT r.i, b.i AS j, r.id AS a, b.id AS b, r.e, r.e = b.e AS together FROM ranges r JOIN b ON b.i = r.j"""
GROUPS = """
SELECT sum(1) OVER w AS g, e, i - lag(i, 1, -1) OVER w AS n_a, j - lag(j, 1, -1) OVER w AS n_b FROM crossings WHERE together WINDOW w AS (ORDER BY i) ORDER BY g"""


class Vocabulary:
    """Ids of a space and a text, and the bytes that each id stands for."""

    def __init__(self, path: str):
        if path.endswith(".json"):
            back = {c: b for b, c in _byte_letters().items()}
            spec = json.load(open(path, encoding="utf-8"))
            entries, special = spec["model"]["vocab"], {x["id"] for x in spec["added_tokens"]}
            self.bytes = [b""] * (max(entries.values()) + 1)
            for token, i in entries.items():
                self.bytes[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
            fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks={x: i for i, x in enumerate(self.bytes) if i not in special}, special_tokens={})
            self.encode = lambda text: fast.encode_ordinary(" " + text)
            self.encode_all = lambda units: self.encode(" ".join(units))
        else:
            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.bytes = [bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(map(pieces.id_to_piece, range(pieces.get_piece_size())))]
            if any(b" " in x.lstrip(b" ") for x in self.bytes):
                raise ValueError("a piece has a space within, so that texts can't be cut at spaces")
            space = pieces.piece_to_id(MARK)
            self.encode = lambda text: pieces.encode(text, num_threads=1) if text else [space]
            self.encode_all = lambda units: [i for ids in pieces.encode([" ".join(units[k : k + 256]) for k in range(0, len(units), 256)], num_threads=1) for i in ids]
        self.names = list(map(str, range(len(self.bytes))))
        self.sizes = np.array([len(x) for x in self.bytes], np.int64)

    def intervals(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For one unit, or units that end in something other than white space: ids of all, how many each has, and which have no tokens as their bytes differ."""
        n = np.array([len(x.encode()) + 1 for x in units], np.int64)
        ids = np.array(self.encode_all(units) if len(units) > 1 else self.encode(units[0]), np.int64)
        if b"".join([self.bytes[i] for i in ids.tolist()]) == (" " + " ".join(units)).encode():
            at = np.searchsorted(np.cumsum(self.sizes[ids]), np.append(0, np.cumsum(n)), "left")
            at[1:] += 1
            return ids, np.diff(at), np.zeros(len(units), bool)
        each = [self.encode(x) for x in units]
        bad = np.array([b"".join([self.bytes[i] for i in e]) != (" " + x).encode() for e, x in zip(each, units)])
        each = [[] if x else e for e, x in zip(each, bad)]
        return np.array([i for e in each for i in e], np.int64), np.array([len(e) for e in each], np.int64), bad


class Aligner:
    """Units met so far, their groups and links."""

    def __init__(self, path_a: str, path_b: str, links: str):
        self.a, self.b, self.links = Vocabulary(path_a), Vocabulary(path_b), links
        self.width = len(self.b.bytes)
        self.db = duckdb.connect(":memory:")
        self.db.execute("SET threads = 1; SET memory_limit = '2GB'; SET temp_directory = ''")
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.counts, self.groups = np.zeros((0, 3), np.int64), []
        self.bad = np.zeros(0, bool)
        self.db.execute("CREATE OR REPLACE TABLE links (u INTEGER, pair BIGINT, n BIGINT)")

    def _intervals(self, vocabulary: Vocabulary, plain: list[str], odd: list[str]) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        """Tokens of all units, where each unit's bytes end, and which units have no tokens."""
        ids, n, bad = vocabulary.intervals(plain) if plain else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        for x in odd:  # white space at a text's end, which would meet the next unit's space
            more, k, wrong = vocabulary.intervals([x])
            ids, n, bad = np.append(ids, more), np.append(n, k), np.append(bad, wrong)
        ends = np.cumsum(vocabulary.sizes[ids])
        return pa.table({"i": np.arange(len(ids), dtype=np.int32), "id": ids.astype(np.int32), "s": (ends - vocabulary.sizes[ids]).astype(np.int32), "e": ends.astype(np.int32)}), np.append(0, ends)[np.cumsum(n)], bad

    def meet(self, new: list[str]) -> None:
        plain, odd = [x for x in new if x and not x[-1].isspace()], [x for x in new if not x or x[-1].isspace()]
        a, stops, bad_a = self._intervals(self.a, plain, odd)
        b, _, bad_b = self._intervals(self.b, plain, odd)
        if (bad_a != bad_b).any():  # tokens of both sides or of neither
            good = [x for x, wrong in zip([*plain, *odd], bad_a | bad_b) if not wrong]
            self.meet(good)
            wrong = sorted(set(new).difference(good))
            self.known.update(zip(wrong, range(len(self.known), len(self.known) + len(wrong))))
            self.counts, self.groups, self.bad = np.pad(self.counts, ((0, len(wrong)), (0, 0))), [*self.groups, *[""] * len(wrong)], np.append(self.bad, np.ones(len(wrong), bool))
            return
        base = len(self.known)
        self.known.update(zip([*plain, *odd], range(base, base + len(new))))
        self.db.register("a", a)
        self.db.register("b", b)
        self.db.execute(CROSSINGS)
        links = self.db.sql(f"SELECT e, a::BIGINT * {self.width} + b AS pair FROM crossings" + " WHERE together" * (self.links == "ends")).to_arrow_table()
        self.db.register("more", pa.table({"u": base + np.searchsorted(stops, links["e"].to_numpy()), "pair": links["pair"]}))
        self.db.execute("INSERT INTO links SELECT u, pair, count(*) FROM more GROUP BY ALL" if self.links != "ends" else "INSERT INTO links SELECT u, pair, 1 FROM more")
        met = self.db.sql(GROUPS).to_arrow_table()
        e, n_a, n_b = (met[c].to_numpy() for c in ("e", "n_a", "n_b"))
        at = np.searchsorted(stops, e)
        more = [np.bincount(at, x, len(new)).astype(np.int64) for x in (n_a, n_b, np.ones(len(at)))]
        ids_a, ids_b = ([v.names[k] for k in x["id"].to_numpy().tolist()] for v, x in ((self.a, a), (self.b, b)))
        i, j, groups = 0, 0, []
        for n, m in zip(n_a.tolist(), n_b.tolist()):
            groups.append(f"{ids_a[i] if n == 1 else ','.join(ids_a[i : i + n])}|{ids_b[j] if m == 1 else ','.join(ids_b[j : j + m])}")
            i, j = i + n, j + m
        edge = np.append(0, np.cumsum(more[2])).tolist()
        self.groups += [";".join(groups[i:j]) for i, j in zip(edge, edge[1:])]
        self.counts = np.concatenate([self.counts, np.stack(more, axis=1)])
        self.bad = np.append(self.bad, bad_a)

    def documents(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], pa.Table]:
        """For each text n_a, n_b, n_groups and a digest of its groups; and the pairs (d, pair, n) of all."""
        split = [[] if not t or MARK in t else CUT.split(t) for t in texts]
        new = set().union(*split).difference(self.known)
        if len(self.known) + len(new) > MOST_UNITS:
            self.clear()
            new = set().union(*split)
        some, size = [], 0
        for x in sorted(new):  # a long text's units BLOCK characters at a time, so that the tables stay small
            some.append(x)
            size += len(x) + 1
            if size >= BLOCK:
                self.meet(some)
                some, size = [], 0
        if some:
            self.meet(some)
        size = np.array([len(s) for s in split], np.int64)
        u = np.array(list(map(self.known.__getitem__, chain.from_iterable(split))), np.int64)
        d = np.repeat(np.arange(len(texts)), size)
        wrong = np.bincount(d, self.bad[u], len(texts)) > 0
        sums = np.stack([np.bincount(d, self.counts[u, k], len(texts)).astype(np.int64) for k in range(3)], axis=1)
        sums[wrong] = 0
        groups = list(map(self.groups.__getitem__, u.tolist()))
        edge = np.append(0, np.cumsum(size)).tolist()
        digests = ["" if bad or i == j else hashlib.sha256(";".join(groups[i:j]).encode()).hexdigest() for i, j, bad in zip(edge, edge[1:], wrong.tolist())]
        self.db.register("occurs", pa.table({"d": d[~wrong[d]], "u": u[~wrong[d]]}))
        pairs = self.db.sql("WITH o AS (SELECT d, u, count(*) AS k FROM occurs GROUP BY d, u) SELECT d, pair, sum(k * n)::BIGINT AS n FROM o JOIN links USING (u) GROUP BY d, pair ORDER BY d, pair").to_arrow_table()
        return sums, digests, pairs


_made: dict[tuple[str, str, str], Aligner] = {}


def aligner(*how: str) -> Aligner:
    if how not in _made:
        _made[how] = Aligner(*how)
    return _made[how]


COUNTS = "n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string"


def aligned(path_a: str, path_b: str, links: str):
    """For mapInArrow over (doc_id, text): a row for each document with its pairs packed; at the end one for each pair of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, names, kind = aligner(path_a, path_b, links), None, pa.int64()
        total = np.zeros(0, np.int64), np.zeros(0, np.int64)
        names = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "counts", "pair", "n"]
        for b in blocks(batches, 1, BLOCK):
            kind = b.column(0).type
            sums, digests, found = own.documents(b.column(1).to_pylist())
            d, pair, n = (found[c].to_numpy() for c in ("d", "pair", "n"))
            per = np.bincount(d, minlength=b.num_rows)
            rows, none = b.num_rows, pa.nulls(b.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(sums[:, k]) for k in range(3)], pa.array(digests), packed(pair.astype(np.int64), per), packed(n.astype(np.int64), per), none, none], names=names)
            total = summed(np.append(total[0], pair), np.append(total[1], n))
        rows, none = len(total[0]), pa.nulls
        for i in range(0, rows, 65536):
            m = min(65536, rows - i)
            yield pa.RecordBatch.from_arrays([none(m, kind), none(m, pa.int64()), none(m, pa.int64()), none(m, pa.int64()), none(m, pa.string()), none(m, pa.binary()), none(m, pa.binary()), pa.array(total[0][i : i + m]), pa.array(total[1][i : i + m])], names=names)

    return run


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(at, n, len(distinct)).astype(np.int64)


def lookup(frequent):
    """For mapInArrow over (row, doc_id, n_a, n_b, n_groups, groups_sha256, pairs, counts): sums over the frequent pairs, and the others as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = frequent.value
        for b in batches:
            per = np.array([len(x) // 8 for x in b.column("pairs").to_pylist()], np.int64)
            doc = np.repeat(np.arange(b.num_rows), per)
            pair, n = unpacked(b.column("pairs"), np.int64), unpacked(b.column("counts"), np.int64)
            at = np.minimum(np.searchsorted(keys, pair), max(0, len(keys) - 1))
            known = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
            sums = [np.zeros(b.num_rows, np.int64) for _ in range(3)]
            np.add.at(sums[0], doc, n)
            np.add.at(sums[1], doc[known], (n * best[at])[known] if len(keys) else n[known])
            np.add.at(sums[2], doc[known], (n * counts[at])[known] if len(keys) else n[known])
            offsets = np.append(0, np.cumsum(np.bincount(doc[~known], minlength=b.num_rows))).astype(np.int32)
            others = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x[~known])) for x in (pair, n)]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in range(6)], *map(pa.array, sums), *others], names=[*b.schema.names[:6], "n_links", "n_best", "count_sum", "pair", "n"])

    return run


def pair_counts(found: DataFrame, width: int) -> DataFrame:
    """pair, count, best: how many links of the corpus have the pair of ids, and is that the most that its B id has?"""
    pairs = settle(found.where("pair is not null").groupBy("pair").agg(F.sum("n").alias("count")), "pairs")
    most = pairs.groupBy((F.col("pair") % width).alias("b")).agg(F.max("count").alias("most"))  # a row for each id of B at most
    return settle(pairs.join(F.broadcast(most), F.col("pair") % width == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "pairs")


def align(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", links: str = "ends", frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document.

    n_best: links whose pair's count is the highest of its B id, ties included; count_sum: the counts of all links' pairs together.
    """
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    found = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(aligned(path_a, path_b, links), f"doc_id {kind}, {COUNTS}, pairs binary, counts binary, pair bigint, n bigint")
    found = settle(found, "aligned")
    pairs = pair_counts(found, len(Vocabulary(path_b).bytes))
    total = pairs.agg(F.sum("count")).first()[0] or 0
    is_frequent = F.col("count") * frequent >= total
    table = pairs.where(is_frequent).orderBy("pair").toArrow()  # ``frequent`` rows at most
    shared = spark.sparkContext.broadcast((table["pair"].to_numpy(), table["count"].to_numpy(), table["best"].to_numpy(zero_copy_only=False)))
    rows = found.where("pair is null").select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "counts")
    scored = settle(rows.mapInArrow(lookup(shared), f"row bigint, doc_id {kind}, {COUNTS}, n_links bigint, n_best bigint, count_sum bigint, pair array<bigint>, n array<bigint>"), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("pair", "n")).alias("x")).select("row", "x.*").join(pairs.where(~is_frequent), "pair")
    rare = rare.groupBy("row").agg(F.sum(F.col("n") * F.col("best").cast("bigint")).alias("more_best"), F.sum(F.col("n") * F.col("count")).alias("more"))
    plus = lambda c, more: (F.col(c) + F.coalesce(more, F.lit(0))).alias(c)
    return scored.join(rare, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", plus("n_best", "more_best"), plus("count_sum", "more"), "groups_sha256")
