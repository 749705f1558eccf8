"""Language-model scores: a word unigram base, and a causal self-attention model on subwords.

Base. Word counts of all training documents are gathered in packed arrays by hash range (one
row for each block of text and range), merged, and written. Words with at least one in
FREQUENT of all training tokens, at most FREQUENT of them, are broadcast; what else a document
has goes to the hash range of its words, where each document's part of the sum is made, and
the parts are added up by block of documents. No word's count depends on a sample, and a hot word never
travels once for each document.

Model. Texts (A-Z in lower case) are ids of a public subword vocabulary, each word with a space
before it, then one end. The SYMBOLS - 1 commonest ids are symbols, all others share one, within
which smoothed counts tell them apart. One causal self-attention head looks from each id back
over the ids before it (products of symbol tables and a bias by distance) and its output, with a
row for the symbol just before, is a softmax over EXPERTS: p(id | before) is the mixture of what
the experts say follows that symbol, so the probabilities of all continuations sum to one. The
experts are smoothed pair counts of groups of training texts (k-means over their symbols, ROUNDS rounds
over all texts at most). Counts of ids, the groups' centres and pair counts are gathered from all training
documents: texts are tokenized once, each task adds up what it reads, and what it found is merged by range,
so that the driver gets a number an id, a centre's symbol, a pair and expert, however large the input is. k-means begins at
sums over the texts in which each of the commonest ANCHORS symbols stands out most.
The attention is trained in numpy by Adam on the mixture's log likelihood of every window of every training document, once each: a
hash of a document (doc_id and text) says in which of TURNS steps its windows are met, tasks add up the
gradients of all windows of a step, and the driver moves the weights. All sums are of whole numbers, each text's or window's part
rounded by itself, and nothing depends on how the input is cut into tasks or blocks: the same documents give the
same scores on any cluster. No query or key grows beyond a length of LONGEST, so that weights never overflow. Texts are cut into windows
of CONTEXT ids that overlap: only the last STRIDE of a window are scored, so each token is scored
once and, but for a text's start, sees CONTEXT - STRIDE tokens at least. Windows are scored in
batches with a mask.

A null text is as an empty one (only its end is scored). A null doc_id is held out. Rows that
share a doc_id are documents of their own. Without training text the base is that of counts all zero and the
model gives all ids the same probability.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_hash, settle
from .kernel import Texts, blocks, mix, packed, per_text, ragged, unpacked
from .repeats import tasks_for

SYMBOLS, EXPERTS = 1024, 6
CONTEXT, STRIDE, KEY = 40, 28, 8
SAID = 8  # numbers that a place says: of each expert, a one, and nothing up to a whole vector of them
TURNS, BATCH, RATE, SEED = 16, 256, 0.2, 3
LONGEST = 40**0.5  # of queries and keys: their products stay within what exp() of 32-bit floats can take
ANCHORS, ROUNDS, FINE, GRAIN = 64, 1, 1 << 24, 1 << 16  # of k-means: cells that it begins at, rounds over all texts; steps in a unit of a centre's and of a gradient's sum
PAIRS, RANGES = (SYMBOLS + 1) * SYMBOLS * EXPERTS, 256  # pair counts, and the ranges they are merged in
PIECES, FAN = 8, 64  # rows that a task's part of a sum is cut into, and parts that are added up together
BACK_OFF = 30.0  # pairs' worth of an expert's symbol counts in its pair counts
FREQUENT = 400_000
MOST_WORDS = 1_000_000  # a worker's memory of words
BLOCK, IN_TASK = 8 << 20, 16 << 20  # bytes of text: whose words make one range, and whose ids one task meets


# -- base ------------------------------------------------------------------------------------


def ranged(h: np.ndarray, parts: int) -> np.ndarray:
    """Where the ranges begin in ascending hashes, parts + 1 numbers."""
    edges = ((np.arange(1, parts, dtype=np.uint64) << np.uint64(32)) + np.uint64(parts - 1)) // np.uint64(parts) << np.uint64(32)
    return np.concatenate([[0], np.searchsorted(h, edges), [len(h)]])


def word_counts(parts: int):
    """For mapInArrow over texts: words' hashes and counts of each block, a row for each range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, 0, 4 << 20):
            h, n = np.unique(Texts(b.column(0), lower=True).hashes(0), return_counts=True)
            counts = np.diff(ranged(h, parts))
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), packed(h, counts[some]), packed(n.astype(np.uint32), counts[some])], names=["r", "h", "n"])

    return run


def merged_counts(table: pa.Table) -> pa.Table:
    h, n = unpacked(table["h"], np.uint64), unpacked(table["n"], np.uint32)
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order].astype(np.int64)
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    n = np.add.reduceat(n, first)
    return pa.table({"r": table["r"].slice(0, 1), "h": pa.array([h[first].tobytes()], pa.binary()), "n": pa.array([n.tobytes()], pa.binary()), "words": pa.array([len(first)], pa.int64()), "tokens": pa.array([int(n.sum())], pa.int64())})


@dataclass
class Base:
    """N, V, the end's count, and the frequent words' hashes (ascending) with log10(c + 0.1)."""

    tokens: int
    distinct: int
    ends: int
    hashes: np.ndarray
    logs: np.ndarray

    @property
    def norm(self) -> float:
        return float(np.log10(self.tokens + 0.1 * (self.distinct + 1)))


def frequent_only(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, n = unpacked(b.column(0), np.uint64), unpacked(b.column(1), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([h[n >= least].tobytes()], pa.binary()), pa.array([n[n >= least].tobytes()], pa.binary())], names=["h", "n"])

    return run


def base_of(counts: DataFrame, ends: int) -> Base:
    total = counts.agg(F.sum("words").alias("v"), F.sum("tokens").alias("n")).first()
    tokens = (total["n"] or 0) + ends
    found = counts.select("h", "n").mapInArrow(frequent_only(max(1, tokens // FREQUENT)), "h binary, n binary").collect()
    h = np.concatenate([np.frombuffer(r["h"], np.uint64) for r in found] or [np.zeros(0, np.uint64)])
    n = np.concatenate([np.frombuffer(r["n"], np.int64) for r in found] or [np.zeros(0, np.int64)])
    order = np.argsort(h)
    return Base(tokens, (total["v"] or 0) + (ends > 0), ends, h[order], np.log10(n[order] + 0.1))


# -- model -----------------------------------------------------------------------------------


def distinct_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """np.unique() with index and inverse; only the distinct hashes are sorted."""
    found = pa.array(h).dictionary_encode()
    at, distinct = found.indices.to_numpy(), found.dictionary.to_numpy()
    first = np.flatnonzero(np.diff(np.maximum.accumulate(at), prepend=-1))  # they are numbered as they first come
    order = np.argsort(distinct)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return distinct[order], first[order], rank[at]


class Subwords:
    """Ids of words, remembered by hash; 0 .. n - 1, and n for the end."""

    def __init__(self, path: str, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb"))}
        self.encoding = tiktoken.Encoding("subwords", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 1
        self.lengths = np.zeros(self.size, np.int64)
        for token, i in ranks.items():
            self.lengths[i] = len(token)
        self.clear()

    def clear(self) -> None:
        self.hashes, self.at, self.n, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _new(self, texts: Texts, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at these places one after the other, and how many each has. Each is read as text of its own after a space."""
        starts, size = texts.starts[at], (texts.ends - texts.starts)[at]
        edges = np.cumsum(size + 1)
        joined_ = np.full(int(edges[-1]), 32, np.uint8)
        body = np.ones(len(joined_), bool)
        body[edges - size - 1] = False
        joined_[body] = texts.data[ragged(starts, size)]
        raw = joined_.tobytes()
        text = raw.decode("utf-8", "replace")
        ids = np.array(self.encoding.encode_ordinary(text), np.int32)
        # where a word's bytes end a token must end, as the pattern parts words at spaces
        stops = np.cumsum(self.lengths[ids])
        last = np.searchsorted(stops, edges)
        whole = stops[-1] == len(raw) and ("\ufffd" not in text or text.encode() == raw)
        if not whole or not np.array_equal(stops[np.minimum(last, len(stops) - 1)], edges):  # odd bytes, or the pattern joined words over odd spaces
            each = [self.encoding.encode_ordinary(" " + texts.word(i).decode("utf-8", "replace")) for i in at.tolist()]
            return np.array([i for x in each for i in x], np.int32), np.array([len(x) for x in each], np.int64)
        return ids, np.diff(np.append(-1, last))

    def of(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the words in turn, how many each has; and the distinct words' hashes, inverse, counts' index of a first place."""
        distinct, first, inverse = distinct_of(texts.hashes(0))
        spot = np.searchsorted(self.hashes, distinct)
        new = np.flatnonzero(self.hashes[np.minimum(spot, len(self.hashes) - 1)] != distinct) if len(self.hashes) else np.arange(len(distinct))
        if len(new):
            if len(self.hashes) + len(new) > MOST_WORDS:
                self.clear()
                new = np.arange(len(distinct))
            ids, n = self._new(texts, first[new])
            begin = len(self.ids) + np.cumsum(n) - n
            self.ids = np.append(self.ids, ids)
            hashes = np.append(self.hashes, distinct[new])
            order = np.argsort(hashes, kind="stable")
            self.hashes, self.at, self.n = hashes[order], np.append(self.at, begin)[order], np.append(self.n, n)[order]
        spot = np.searchsorted(self.hashes, distinct)[inverse]
        n = self.n[spot]
        return self.ids[ragged(self.at[spot], n)], n, distinct, inverse, first


_made: dict[tuple[str, str], Subwords] = {}


def subwords(path: str, pattern: str) -> Subwords:
    if (path, pattern) not in _made:
        _made[path, pattern] = Subwords(path, pattern)
    return _made[path, pattern]


def id_stream(ids: np.ndarray, per_word: np.ndarray, ptr: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' ids, each with its end; and where each text begins."""
    edge = np.append(0, np.cumsum(per_word))[ptr] + np.arange(len(ptr))
    out = np.full(int(edge[-1]), end, np.int32)
    body = np.ones(len(out), bool)
    body[edge[1:] - 1] = False
    out[body] = ids
    return out, edge


GAP = np.arange(CONTEXT - STRIDE, CONTEXT)[:, None] - np.arange(CONTEXT)[None, :]  # from each scored place back to each place


@dataclass
class Model:
    symbol: np.ndarray  # id -> symbol; one more, the last, stands before a text
    inner: np.ndarray  # id -> log p(id | symbol)
    pairs: np.ndarray  # symbol before, symbol, expert: p
    q: np.ndarray  # symbol, KEY
    k: np.ndarray  # symbol, KEY
    v: np.ndarray  # symbol, expert: what seeing it says
    prior: np.ndarray  # symbol before, expert
    distance: np.ndarray  # CONTEXT

    def scores(self, stream: np.ndarray, edge: np.ndarray, batch: int = BATCH) -> np.ndarray:
        """log10 probability of each text."""
        target = self.symbol[stream]
        before = symbols_before(target, edge)
        out = self.inner[stream].astype(np.float64)
        heads = Heads(self.q, self.k, self.v, self.prior, self.distance)
        parts = windows(edge)
        for i in range(0, len(parts[0]), batch):
            at, there = places(*(part[i : i + batch] for part in parts))
            seen = heads.seen(before, at, there)
            where = at[:, CONTEXT - STRIDE :].ravel().take(seen.scored)
            p = seen.following(self.pairs, target.take(where))
            p *= seen.gate
            out[where] += np.log(p.sum(axis=0) / seen.gate.sum(axis=0))
        return per_text(out, edge) / np.log(10)


def windows(edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first scored token of each window, how many before it are seen, and how many are scored."""
    n = np.diff(edge)
    pieces = -(-n // STRIDE)
    text, k = np.repeat(np.arange(len(n)), pieces), ragged(np.zeros(len(n), np.int64), pieces)
    return edge[:-1][text] + k * STRIDE, np.minimum(k * STRIDE, CONTEXT - STRIDE), np.minimum(STRIDE, n[text] - k * STRIDE)


def places(first: np.ndarray, behind: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each window, and which of them are in it."""
    at = first[:, None] + np.arange(CONTEXT)[None, :] - (CONTEXT - STRIDE)
    return at, (at >= (first - behind)[:, None]) & (at < (first + ahead)[:, None])


@dataclass
class Seen:
    """What the attention makes of some windows: their symbols, the queries, what the places hold, unscaled weights, and of the scored places (which they are) their symbols and, a row for each expert, what was said, the weights' sum and the gate before it is scaled."""

    x: np.ndarray
    q: np.ndarray
    holds: np.ndarray
    weight: np.ndarray
    scored: np.ndarray
    own: np.ndarray
    said: np.ndarray
    total: np.ndarray
    gate: np.ndarray

    def following(self, pairs: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of the scored places what each expert says of the symbol there, a row for each expert."""
        return np.ascontiguousarray(pairs.reshape(-1, pairs.shape[2]).take(self.own * np.int64(pairs.shape[1]) + target, axis=0).T)


class Heads:
    """The attention's tables as windows meet them.

    A place holds its key, what it says, and a one that adds up to the softmax's denominator; the symbol
    after the last is that of places outside the window, which say nothing.
    """

    def __init__(self, q: np.ndarray, k: np.ndarray, v: np.ndarray, prior: np.ndarray, distance: np.ndarray):
        self.q, self.prior, self.nothing = q, np.ascontiguousarray(prior.T), len(q)
        self.holds = np.zeros((len(q) + 1, KEY + SAID), np.float32)
        self.holds[:-1, :KEY], self.holds[:-1, KEY : KEY + EXPERTS], self.holds[:-1, KEY + EXPERTS] = k, v, 1
        self.near = np.where(GAP >= 0, np.exp(distance[np.maximum(GAP, 0)]), 0).astype(np.float32)

    def seen(self, before: np.ndarray, at: np.ndarray, there: np.ndarray) -> Seen:
        """Of the places of some windows and which of them are in it."""
        x = np.where(there, before.take(at, mode="clip"), self.nothing)
        own = np.minimum(x[:, CONTEXT - STRIDE :], self.nothing - 1)
        q, holds = self.q.take(own, axis=0), self.holds.take(x, axis=0)
        weight = q @ holds[:, :, :KEY].transpose(0, 2, 1)
        for i in range(0, STRIDE, STRIDE // 4):  # what comes later isn't seen, so that most of it needs no exp()
            part = weight[:, i : i + STRIDE // 4, : CONTEXT - STRIDE + i + STRIDE // 4]
            np.exp(part, out=part)
        weight *= self.near
        scored = np.flatnonzero(there[:, CONTEXT - STRIDE :].ravel())
        own = own.ravel().take(scored)
        said = np.ascontiguousarray((weight @ holds[:, :, KEY:]).reshape(-1, SAID).take(scored, axis=0).T)
        total = np.maximum(said[EXPERTS], 1e-30)
        said = said[:EXPERTS]
        said /= total
        gate = said + self.prior.take(own, axis=1)
        gate -= gate.max(axis=0)
        np.exp(gate, out=gate)
        return Seen(x, q, holds, weight, scored, own, said, total, gate)


def symbols_of(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of counts of ids: each id's symbol and its log p(id | symbol)."""
    n = n + 0.02
    rank = np.empty(len(n), np.int64)
    rank[np.argsort(-n, kind="stable")] = np.arange(len(n))
    symbol = np.minimum(rank, SYMBOLS - 1).astype(np.int32)
    return symbol, np.log(n / np.bincount(symbol, n)[symbol])


def directions(target: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Roots of the shares of symbols in each text: rows of length one."""
    n, size = len(edge) - 1, np.diff(edge)
    x = np.bincount(np.repeat(np.arange(n) * SYMBOLS, size) + target, minlength=n * SYMBOLS).reshape(n, SYMBOLS).astype(np.float32)
    np.sqrt(x, out=x)
    x /= np.sqrt(np.maximum(size, 1)).astype(np.float32)[:, None]
    return x


def moved(sums: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Centres of texts that add up to sums; one without texts stays."""
    far = np.linalg.norm(sums, axis=1, keepdims=True)
    return np.where(far > 0, sums / np.maximum(far, 1e-12), centre)


def fixed(x: np.ndarray, own: np.ndarray, groups: int) -> np.ndarray:
    """Sums of each group's directions in whole numbers, which don't depend on order."""
    doc, symbol = np.nonzero(x)
    return np.bincount(own[doc] * x.shape[1] + symbol, np.rint(x[doc, symbol] * np.float32(FINE)), groups * x.shape[1]).reshape(groups, -1).astype(np.int64)


def anchored(x: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """For each of the commonest symbols the sum of the directions of texts in which it exceeds its share in all texts by the largest factor; and how many these are."""
    own = (x[:, :ANCHORS] / np.maximum(shares[:ANCHORS], 1e-9)).argmax(axis=1)
    return np.append(fixed(x, own, ANCHORS), np.bincount(own, minlength=ANCHORS)[:, None], axis=1)


def centres_of(sums: np.ndarray) -> np.ndarray:
    """k-means of the anchors' cells by angle; later centres begin at cells that are large and far from earlier ones."""
    sums, n = sums[:, :-1].astype(np.float64), sums[:, -1]
    if not n.any():
        return np.zeros((EXPERTS, SYMBOLS))
    x = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    centre = [sums.sum(axis=0) / max(np.linalg.norm(sums.sum(axis=0)), 1e-12)]
    for _ in range(EXPERTS - 1):
        centre.append(x[((1 - (x @ np.array(centre).T).max(axis=1)) * n).argmax()])
    centre = np.array(centre)
    for _ in range(20):
        own = (x @ centre.T).argmax(axis=1)
        centre = moved(np.array([sums[own == g].sum(axis=0) for g in range(EXPERTS)]), centre)
    return centre


def pair_cells(target: np.ndarray, edge: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Of each token its place among the pair counts: symbol before, symbol, expert."""
    return (symbols_before(target, edge) * np.int64(SYMBOLS) + target) * EXPERTS + np.repeat(group, np.diff(edge))


def symbols_before(target: np.ndarray, edge: np.ndarray) -> np.ndarray:
    before = np.append(SYMBOLS, target[:-1])[: len(target)]
    before[edge[:-1][np.diff(edge) > 0]] = SYMBOLS
    return before


def joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' ids, and where each begins."""
    return np.concatenate(texts) if texts else np.zeros(0, np.int32), np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)


def fit(texts: list[np.ndarray], size: int, turns: list[int] | None = None) -> Model:
    """texts: ids of each, its end last; size: ids there are, the end included; turns: the step in which each is met, else they take turns."""
    stream, edge = joined(texts)
    symbol, inner = symbols_of(np.bincount(stream, minlength=size))
    target, x = symbol[stream], directions(symbol[stream], edge)
    centre = centres_of(anchored(x, shares_of(symbol, np.bincount(stream, minlength=size)))).astype(np.float32)
    for _ in range(ROUNDS):
        centre = moved(fixed(x, (x @ centre.T).argmax(axis=1), EXPERTS).astype(np.float64), centre).astype(np.float32)
    counts = np.bincount(pair_cells(target, edge, (x @ centre.T).argmax(axis=1)), minlength=PAIRS)

    def turn(t: int, steps: Steps) -> np.ndarray:
        stream, edge = joined([x for k, x in enumerate(texts) if (turns[k] if turns else k % TURNS) == t])
        return gradients(symbol[stream], edge, steps.weights(), steps.pairs)

    return trained(turn, symbol, inner, *tables(counts, min(size, SYMBOLS)))


def tables(counts: np.ndarray, used: int = SYMBOLS) -> tuple[np.ndarray, np.ndarray]:
    """Of pair counts: p(symbol | symbol before, expert), and p(symbol | expert). used: how many symbols stand for an id."""
    counts = counts.reshape(SYMBOLS + 1, SYMBOLS, EXPERTS)
    pairs = np.empty((SYMBOLS + 1, SYMBOLS, EXPERTS), np.float32)
    single = np.empty((SYMBOLS, EXPERTS))
    of = counts.sum(axis=0)
    every = (of.sum(axis=1) + np.where(np.arange(SYMBOLS) < used, 0.1, 0)) / (of.sum() + 0.1 * used)
    for g in range(EXPERTS):
        single[:, g] = (of[:, g] + 50 * every) / (of[:, g].sum() + 50)
        c = counts[:, :, g]
        pairs[:, :, g] = (c + BACK_OFF * single[:, g]) / (c.sum(axis=1, keepdims=True) + BACK_OFF)
    return pairs, single


WEIGHTS = {"q": (SYMBOLS + 1, KEY), "k": (SYMBOLS + 1, KEY), "v": (SYMBOLS + 1, EXPERTS), "prior": (SYMBOLS + 1, EXPERTS), "distance": (CONTEXT,)}


def first_weights(single: np.ndarray) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(SEED)
    p = {name: rng.normal(0, 0.1, shape) if name in "qk" else np.zeros(shape) for name, shape in WEIGHTS.items()}
    log = np.log(np.maximum(single, 1e-12))
    p["v"][:-1] = 3 * (log - log.mean(axis=1, keepdims=True))  # what a symbol says of the experts at first
    return p


class Steps:
    """Adam on the mixture's log likelihood."""

    def __init__(self, p: dict[str, np.ndarray], pairs: np.ndarray):
        self.p, self.pairs, self.t = {name: np.array(x, np.float64) for name, x in p.items()}, pairs, 0
        self.m, self.v = ({name: np.zeros_like(x) for name, x in self.p.items()} for _ in range(2))

    def weights(self) -> dict[str, np.ndarray]:
        return {name: x.astype(np.float32) for name, x in self.p.items()}

    def step(self, sums: np.ndarray, rate: float) -> None:
        """sums: as gradients() gives, of all windows of the step; without any the weights stay."""
        if not len(sums) or not sums[-1]:
            return
        at, flat = 0, sums[:-1] / (GRAIN * sums[-1])
        self.t += 1
        for name, shape in WEIGHTS.items():
            g = flat[at : at + int(np.prod(shape))].reshape(shape)
            at += g.size
            self.m[name] = 0.9 * self.m[name] + 0.1 * g
            self.v[name] = 0.98 * self.v[name] + 0.02 * g**2
            self.p[name] -= rate * (self.m[name] / (1 - 0.9**self.t)) / (np.sqrt(self.v[name] / (1 - 0.98**self.t)) + 1e-9)
        for name in "qk":
            self.p[name] *= np.minimum(1.0, LONGEST / np.maximum(np.linalg.norm(self.p[name], axis=1, keepdims=True), 1e-12))


def scattered(at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The sums of each symbol's rows of values, rounded to whole steps."""
    columns = np.ascontiguousarray(values.reshape(-1, values.shape[-1]).T)
    columns *= np.float32(GRAIN)
    np.rint(columns, out=columns)
    return np.stack([np.bincount(at, c, SYMBOLS + 2)[: SYMBOLS + 1] for c in columns], axis=1)


def gradient(heads: Heads, pairs: np.ndarray, target: np.ndarray, before: np.ndarray, at: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Of some windows: the gradients of all weights one after the other, in whole numbers, and how many tokens are scored.

    target, before: of each token its symbol and the one before it; at, there: the places of the windows and which of them are in it.
    """
    seen = heads.seen(before, at, there)
    seen.gate /= seen.gate.sum(axis=0)
    after = seen.following(pairs, target.take(at[:, CONTEXT - STRIDE :].ravel().take(seen.scored)))
    after *= seen.gate
    after /= after.sum(axis=0)
    dz = seen.gate - after
    # divided by the weights' sum here, so that no weight has to be; what all places share goes with the ones that they hold
    back = np.zeros((len(at) * STRIDE, SAID), np.float32)
    back[seen.scored, :EXPERTS] = (dz / seen.total).T
    back[seen.scored, EXPERTS] = -(dz * seen.said).sum(axis=0) / seen.total
    back = back.reshape(len(at), STRIDE, SAID)
    dw = back @ seen.holds[:, :, KEY:].transpose(0, 2, 1)
    dw *= seen.weight
    own, x = np.minimum(seen.x[:, CONTEXT - STRIDE :], SYMBOLS).ravel(), seen.x.ravel()
    g = {"q": scattered(own, dw @ seen.holds[:, :, :KEY]), "k": scattered(x, dw.transpose(0, 2, 1) @ seen.q), "v": scattered(x, (seen.weight.transpose(0, 2, 1) @ back)[:, :, :EXPERTS]), "prior": scattered(seen.own, dz.T)}
    dw *= np.float32(GRAIN)
    by_gap = np.where(GAP >= 0, np.rint(dw, out=dw).astype(np.float64).sum(axis=0), 0)
    g["distance"] = np.bincount(np.maximum(GAP, 0).ravel(), by_gap.ravel(), CONTEXT)
    return np.append(np.concatenate([g[name].ravel() for name in WEIGHTS]), len(seen.scored)).astype(np.int64)


def gradients(target: np.ndarray, edge: np.ndarray, p: dict[str, np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """The sums of gradient() over all windows of some texts."""
    before, parts, heads = symbols_before(target, edge), windows(edge), Heads(**p)
    out = np.zeros(sum(int(np.prod(shape)) for shape in WEIGHTS.values()) + 1, np.int64)
    for i in range(0, len(parts[0]), BATCH):
        out += gradient(heads, pairs, target, before, *places(*(part[i : i + BATCH] for part in parts)))
    return out


def trained(turn, symbol: np.ndarray, inner: np.ndarray, pairs: np.ndarray, single: np.ndarray) -> Model:
    """The experts of tables(), and the attention after TURNS steps. turn: from a step's number and the weights so far to its gradients()."""
    steps = Steps(first_weights(single), pairs)
    for t in range(TURNS):
        steps.step(turn(t, steps), RATE * (1 - t / TURNS))
    return Model(symbol, inner.astype(np.float32), pairs, **steps.weights())


def shares_of(symbol: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Roots of the symbols' shares in all texts."""
    return np.sqrt(np.bincount(symbol, n, SYMBOLS) / max(1, n.sum()))


# -- sums over all training texts ------------------------------------------------------------

BLOCK_OF_IDS = "ids binary, lengths binary"
SUM = "r int, s int, x binary"


def id_texts(batch: pa.RecordBatch, kind: type) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and edges of texts, block by block. batch: BLOCK_OF_IDS."""
    for ids, size in zip(batch.column(0), batch.column(1)):
        yield np.frombuffer(ids.as_buffer(), kind), np.append(0, np.cumsum(np.frombuffer(size.as_buffer(), np.int32), dtype=np.int64))


def group() -> int:
    """Which group of FAN tasks adds up first what this task has found."""
    task = TaskContext.get()
    return (task.partitionId() if task else 0) // FAN


def in_pieces(x: np.ndarray) -> pa.RecordBatch:
    """One task's part of a sum, cut into PIECES rows."""
    return pa.RecordBatch.from_arrays([pa.array(np.arange(PIECES, dtype=np.int32)), pa.array(np.full(PIECES, group(), np.int32)), pa.array([p.tobytes() for p in np.array_split(x, PIECES)], pa.binary())], names=["r", "s", "x"])


def added_up(parts: DataFrame, add, shape: str, tasks: int) -> list:
    """The tasks' parts (r, s and others) added up FAN at a time until there is one for each r. add: from a table of one r and s to one row, whose s is the next group."""
    parts = parts.groupBy("r", "s").applyInArrow(add, shape)
    while tasks > FAN:
        tasks = -(-tasks // FAN)
        parts = parts.groupBy("r", "s").applyInArrow(add, shape)
    return parts.collect()


def total_of(parts: DataFrame, tasks: int) -> np.ndarray:
    """The sum of all tasks' parts (SUM), whole numbers. PIECES rows reach the driver."""

    def add(table: pa.Table) -> pa.Table:
        x = sum(np.frombuffer(x.as_buffer(), np.int64) for x in table["x"])
        return pa.table({"r": table["r"].slice(0, 1), "s": pa.array([table["s"][0].as_py() // FAN], pa.int32()), "x": pa.array([x.tobytes()], pa.binary())})

    rows = added_up(parts, add, SUM, tasks)
    return np.concatenate([np.frombuffer(r["x"], np.int64) for r in sorted(rows, key=lambda r: r["r"])]) if rows else np.zeros(0, np.int64)


def summed_over(texts: DataFrame, kind: type, size: int, part) -> np.ndarray:
    """The sum of part(ids, edges) over all blocks of texts (BLOCK_OF_IDS): ``size`` whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for b in batches:
            for stream, edge in id_texts(b, kind):
                n += part(stream, edge)
        yield in_pieces(n)

    found = total_of(texts.mapInArrow(run, SUM), texts.rdd.getNumPartitions())
    return found if len(found) else np.zeros(size, np.int64)


def gathered(texts: DataFrame, kind: type, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """symbol, inner and pair counts, of all texts to learn from (BLOCK_OF_IDS)."""
    n = summed_over(texts, kind, size, lambda stream, edge: np.bincount(stream, minlength=size))
    symbol, inner = symbols_of(n)
    shares = shares_of(symbol, n)
    cells = summed_over(texts, kind, ANCHORS * (SYMBOLS + 1), lambda stream, edge: anchored(directions(symbol[stream], edge), shares).ravel())
    centre = centres_of(cells.reshape(ANCHORS, SYMBOLS + 1)).astype(np.float32)

    def moved_by(stream: np.ndarray, edge: np.ndarray) -> np.ndarray:
        x = directions(symbol[stream], edge)
        return fixed(x, (x @ centre.T).argmax(axis=1), EXPERTS).ravel()

    for _ in range(ROUNDS):
        sums = summed_over(texts, kind, EXPERTS * SYMBOLS, moved_by)
        centre = moved(sums.reshape(EXPERTS, SYMBOLS).astype(np.float64), centre).astype(np.float32)
    width = -(-PAIRS // RANGES)

    def pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, tokens = np.zeros(RANGES * width, np.int32), 0

        def found() -> Iterator[pa.RecordBatch]:
            for r in range(RANGES):
                part = n[r * width : (r + 1) * width]
                cell = np.flatnonzero(part)
                if len(cell):
                    yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([group()], pa.int32()), pa.array([cell.astype(np.int32).tobytes()], pa.binary()), pa.array([part[cell].astype(np.int64).tobytes()], pa.binary())], names=["r", "s", "cell", "n"])
            n[:] = 0

        for b in batches:
            for stream, edge in id_texts(b, kind):
                target = symbol[stream]
                np.add.at(n, pair_cells(target, edge, (directions(target, edge) @ centre.T).argmax(axis=1)), np.int32(1))
                tokens += len(stream)
                if tokens > 1 << 30:  # before a count could overflow
                    yield from found()
                    tokens = 0
        yield from found()

    def merged(table: pa.Table) -> pa.Table:
        n = np.zeros(width, np.int64)
        for cell, more in zip(table["cell"], table["n"]):
            n[np.frombuffer(cell.as_buffer(), np.int32)] += np.frombuffer(more.as_buffer(), np.int64)
        cell = np.flatnonzero(n)
        return pa.table({"r": table["r"].slice(0, 1), "s": pa.array([table["s"][0].as_py() // FAN], pa.int32()), "cell": pa.array([cell.astype(np.int32).tobytes()], pa.binary()), "n": pa.array([n[cell].tobytes()], pa.binary())})

    shape = "r int, s int, cell binary, n binary"
    counts = np.zeros(RANGES * width, np.int64)
    for r in added_up(texts.mapInArrow(pair_counts, shape), merged, shape, texts.rdd.getNumPartitions()):  # PAIRS numbers at most
        counts[np.frombuffer(r["cell"], np.int32) + r["r"] * width] = np.frombuffer(r["n"], np.int64)
    return symbol, inner, counts[:PAIRS]


def learnt(texts: DataFrame, kind: type, size: int, tasks: int) -> Model:
    """The model of all texts to learn from: BLOCK_OF_IDS, turn. tasks: how many at most meet them all."""
    symbol, inner, counts = gathered(texts.select("ids", "lengths").coalesce(tasks), kind, size)
    spark = texts.sparkSession
    pairs, single = tables(counts, min(size, SYMBOLS))
    shared = spark.sparkContext.broadcast((symbol, pairs))
    n = sum(int(np.prod(shape)) for shape in WEIGHTS.values()) + 1

    def turn(t: int, steps: Steps) -> np.ndarray:
        weights = spark.sparkContext.broadcast(steps.weights())

        def part(stream: np.ndarray, edge: np.ndarray) -> np.ndarray:
            symbol, pairs = shared.value
            return gradients(symbol[stream], edge, weights.value, pairs)

        found = summed_over(texts.where(F.col("turn") == t).select("ids", "lengths"), kind, n, part)
        weights.unpersist()
        return found

    return trained(turn, symbol, inner, pairs, single)


# -- both ------------------------------------------------------------------------------------

PARTS = f"r int, block bigint, doc binary, h binary, tf binary, whole binary, {BLOCK_OF_IDS}, turn int"
SUMS = "block bigint, doc binary, known binary, base binary, model binary, whole binary"
HELD_OUT, NO_IDS = TURNS, TURNS + 1  # turns of ids that are scored only, and of all other rows
WHOLE = np.dtype([("id", "<i8"), ("null", "?"), ("row", "<i8"), ("n", "<i8"), ("known", "<i8"), ("base", "<f8"), ("model", "<f8")])


def preparer(base, path: str, pattern: str, parts: int, kind: type):
    """For mapInArrow over (doc_id, null, row, learn, text): of each block what is known here, its ids by turn, and its rarer words by range."""
    names = ["r", "block", "doc", "h", "tf", "whole", "ids", "lengths", "turn"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, words = base.value, subwords(path, pattern)
        for b in blocks(batches, 4):
            texts = Texts(b.column(4), lower=True)
            out, per_word, distinct, inverse, _ = words.of(texts)
            stream, edge = id_stream(out, per_word, texts.ptr, words.size)
            spot = np.minimum(np.searchsorted(known.hashes, distinct), max(0, len(known.hashes) - 1))
            hot = known.hashes[spot] == distinct if len(known.hashes) else np.zeros(len(distinct), bool)
            log = np.where(hot, known.logs[spot], 0.0) if len(known.hashes) else np.zeros(len(distinct))
            whole = np.zeros(texts.n, WHOLE)
            whole["id"], whole["null"], whole["row"] = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy()
            whole["n"] = texts.counts + 1
            whole["known"] = per_text(hot[inverse], texts.ptr) + (known.ends > 0)
            whole["base"] = per_text(log[inverse], texts.ptr) + np.log10(known.ends + 0.1)
            # by content, so that a task run again names its blocks alike; equal blocks are told by their number
            name = xxhash.xxh64_intdigest(whole["id"].tobytes() + whole["row"].tobytes()) - (1 << 63)
            none = pa.nulls(1, pa.binary())
            at = int(np.uint64(name + (1 << 63)) % np.uint64(parts))
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([name], pa.int64()), none, none, none, pa.array([whole.tobytes()], pa.binary()), none, none, pa.array([NO_IDS], pa.int32())], names=names)
            # by content too, so that each step meets the same texts however they are cut into blocks
            own = mix(whole["id"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ whole["row"].astype(np.uint64)) % np.uint64(TURNS)
            learn = b.column(3).to_numpy(zero_copy_only=False).astype(bool) & ~whole["null"]
            turns, size, ids = np.where(learn, own.astype(np.int64), HELD_OUT), np.diff(edge), stream.astype(kind)
            for t in np.unique(turns).tolist():
                doc = np.flatnonzero(turns == t)
                columns = [pa.array([x.tobytes()], pa.binary()) for x in (ids[ragged(edge[:-1][doc], size[doc])], size[doc].astype(np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([name], pa.int64()), pa.array([doc.astype(np.int32).tobytes()], pa.binary()), none, none, none, *columns, pa.array([t], pa.int32())], names=names)
            rare = np.flatnonzero(~hot[inverse])
            pair, tf = np.unique(inverse[rare] * np.int64(texts.n) + texts.text_of()[rare], return_counts=True)
            if not len(pair):
                continue
            h, doc = distinct[pair // texts.n], (pair % texts.n).astype(np.int32)
            counts = np.diff(ranged(h, parts))
            some = np.flatnonzero(counts)
            columns = [pa.array(some.astype(np.int32)), pa.array(np.full(len(some), name), pa.int64()), packed(doc, counts[some]), packed(h, counts[some]), packed(tf.astype(np.uint32), counts[some])]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.nulls(len(some), pa.binary())] * 3, pa.array(np.full(len(some), NO_IDS, np.int32))], names=names)

    return run


def scorer(model, kind: type):
    """For mapInArrow over (ids, lengths, block, doc): the model's scores of the block's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm = model.value
        for b in batches:
            found = pa.array([lm.scores(ids, edge).tobytes() for ids, edge in id_texts(b, kind)], pa.binary())
            none = pa.nulls(b.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(3), none, none, found, none], names=["block", "doc", "known", "base", "model", "whole"])

    return run


def looked_up(left: pa.Table, right: pa.Table) -> pa.Table:
    """For cogrouped applyInArrow by range: what the range's words add to each document of each block."""
    h, c = unpacked(right["h"], np.uint64), unpacked(right["n"], np.int64)
    log, out = np.log10(np.append(c, 0) + 0.1), {k: [] for k in ("doc", "known", "base")}
    for k in range(left.num_rows):
        if not left["h"][k].is_valid:
            for x in out.values():
                x.append(None)
            continue
        doc, w, tf = (np.frombuffer(left[name][k].as_buffer(), t) for name, t in (("doc", np.int32), ("h", np.uint64), ("tf", np.uint32)))
        spot = np.searchsorted(h, w)
        spot[spot == len(h)] = 0
        spot = np.where(h[spot] == w, spot, len(h)) if len(h) else np.zeros(len(w), np.int64)
        have = np.unique(doc)
        out["doc"].append(have.tobytes())
        out["known"].append(np.bincount(doc, tf * (spot < len(h)))[have].astype(np.int64).tobytes())
        out["base"].append(np.bincount(doc, tf * log[spot])[have].tobytes())
    return pa.table({"block": left["block"], **{k: pa.array(x, pa.binary()) for k, x in out.items()}, "model": pa.nulls(left.num_rows, pa.binary()), "whole": left["whole"]})


def summed(table: pa.Table) -> pa.Table:
    """For applyInArrow by block. Equal blocks (times of them) add to the same sums alike."""
    whole = table.filter(table["whole"].is_valid())["whole"]
    times = len(whole)
    rows = np.frombuffer(whole[0].as_buffer(), WHOLE).copy()
    for kind, names in (("known", {"known": np.int64, "base": np.float64}), ("model", {"model": np.float64})):
        part = table.filter(table[kind].is_valid())
        doc = unpacked(part["doc"], np.int32)
        for name, dtype in names.items():
            sums = np.bincount(doc, unpacked(part[name], dtype), len(rows))
            rows[name] += sums.astype(np.int64) // times if dtype is np.int64 else sums / times
    rows = np.tile(rows, times)
    return pa.table({"doc_id": pa.array(rows["id"].copy(), mask=rows["null"].copy()), **{to: rows[name].copy() for to, name in (("n_tokens", "n"), ("n_known", "known"), ("base", "base"), ("score", "model"))}})


def score(docs: DataFrame, learn: Column, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score: a row for each of docs. learn: which rows to learn from."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text)).alias("bytes"), F.sum(F.when(learn, 1).otherwise(0)).alias("n")).first()
    parts, n = (total["bytes"] or 0) // BLOCK + 1, total["n"] or 0
    tasks = tasks_for(parts)
    counts = settle(docs.where(learn).select(text).mapInArrow(word_counts(parts), "r int, h binary, n binary").repartition(tasks, "r").groupBy("r").applyInArrow(merged_counts, "r int, h binary, n binary, words bigint, tokens bigint"), "counts")
    base = base_of(counts, n)
    shared = spark.sparkContext.broadcast(base)

    size = subwords(path, pattern).size + 1
    kind = np.uint16 if size <= 1 << 16 else np.int32
    ids = F.coalesce(F.col(doc_id).cast("bigint"), F.lit(0).cast("bigint"))
    rows = docs.select(ids.alias("doc_id"), F.col(doc_id).isNull().alias("null"), row_hash(F.col(text)).alias("row"), F.coalesce(learn, F.lit(False)).alias("learn"), text)
    sent = settle(rows.mapInArrow(preparer(shared, path, pattern, parts, kind), PARTS), "blocks", by="turn")
    # a turn's files are small: of all turns some are met in one task
    wide = max(2 * spark.sparkContext.defaultParallelism, (total["bytes"] or 0) // IN_TASK + 1)
    lm = spark.sparkContext.broadcast(learnt(sent.where(F.col("turn") < TURNS).select("ids", "lengths", "turn"), kind, size, wide))

    scored = sent.where(F.col("turn") <= HELD_OUT).select("ids", "lengths", "block", "doc").coalesce(wide).mapInArrow(scorer(lm, kind), SUMS)
    sent = sent.where(F.col("turn") == NO_IDS).select("r", "block", "doc", "h", "tf", "whole").repartition(tasks, "r")
    sums = sent.groupBy("r").cogroup(counts.select("r", "h", "n").repartition(tasks, "r").groupBy("r")).applyInArrow(looked_up, SUMS).unionByName(scored)
    done = sums.repartition(tasks, "block").groupBy("block").applyInArrow(summed, "doc_id bigint, n_tokens bigint, n_known bigint, base double, score double")
    return done.select("doc_id", "n_tokens", "n_known", F.lit(base.tokens).cast("bigint").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(base.norm)).alias("base_score"), "score")
