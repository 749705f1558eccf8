"""Language identification by spans: script ranges, letter trigrams, and Viterbi over words.

Each word's letters name a script by their code points' range; only languages whose training
texts use that script are candidates for it. A word's score in a language is the sum over its
letters of the log probability of the letter with both its neighbours (lower case; the word's
edge and anything but a letter is one symbol), in hashed tables with add-ALPHA smoothing.
Viterbi finds the labels of all words that maximise the sum of scores less SWITCH for every
change of language; runs of one label are the spans. Scores are whole numbers of 1/UNIT, whose
sums don't depend on their order. So long texts are decoded in stretches of SPAN words side by
side, each from every label it may begin with, and the stretches are joined by what they add up
to: the labels are exactly those of one pass over the whole text.

The tables are learned from at most SAMPLE documents of each language (those of the smallest
hash of doc_id). A document's language is the one whose spans have most letters in scripts that
a learned language uses, and its score their share of all letters, so a text in a script that
none uses has score 0; ties go to the language that sorts first. A text that is null or
has no letter, or a table without anything to learn from, gives ``und`` and 0. Rows that share
a doc_id are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernel import Texts, blocks, per_text, ragged

SAMPLE, ALPHA, SWITCH, BITS = 400, 0.05, 12.0, 17
UNIT = 1024  # steps of a score of one
SPAN = 1024  # words decoded one after the other; of no effect on the labels
NEVER = -(1 << 60)
MARGIN = 3
LEAST_SHARE = 0.005  # of a language's letters, for a script to count as its own
TOP_CODE = 0x32000
# Unicode ranges of scripts (fixed values): first code point, last code point
SCRIPTS = {
    "Latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "Armenian": [(0x530, 0x58F)],
    "Hebrew": [(0x590, 0x5FF)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "Devanagari": [(0x900, 0x97F)],
    "Bengali": [(0x980, 0x9FF)],
    "Tamil": [(0xB80, 0xBFF)],
    "Thai": [(0xE00, 0xE7F)],
    "Georgian": [(0x10A0, 0x10FF)],
    "Hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "Kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "Han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x31FFF)],
}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    script = np.zeros(TOP_CODE, np.uint8)
    for k, ranges in enumerate(SCRIPTS.values(), 1):
        for a, b in ranges:
            script[a : b + 1] = k
    lower = np.zeros(TOP_CODE, np.uint32)  # of letters, in lower case; of anything else 0
    for c in range(TOP_CODE):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            lower[c] = ord(low) if len(low) == 1 else c
    return script, lower


SCRIPT, LETTER = _tables()
KINDS = len(SCRIPTS) + 1


@dataclass
class Words:
    """Distinct words of a block: trigram buckets by letter, letters and main script of each, and where they occur."""

    bucket: np.ndarray
    ptr: np.ndarray
    script: np.ndarray
    inverse: np.ndarray

    @property
    def letters(self) -> np.ndarray:
        return np.diff(self.ptr)


def distinct_words(texts: Texts) -> Words:
    _, first, inverse = np.unique(texts.hashes(0), return_index=True, return_inverse=True)
    starts, size = texts.starts[first], (texts.ends - texts.starts)[first]
    joined = np.append(texts.data, np.uint8(32))[ragged(starts, size + 1)]
    stops = np.cumsum(size + 1)
    if len(stops):
        joined[stops - 1] = 32
    codes = np.frombuffer(joined.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    codes = np.where(codes < TOP_CODE, codes, 0)
    edge = np.flatnonzero(codes == 32) + 1  # a word has no space of its own
    low = LETTER[codes]
    around = np.concatenate([[0], low, [0]]).astype(np.uint64)
    tri = (around[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (around[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (around[2:] * np.uint64(0x165667B19E3779F9))
    tri = ((tri ^ (tri >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int32)
    letter = low > 0
    count = np.append(0, np.cumsum(letter))
    ptr = count[np.append(0, edge)] if len(edge) else np.zeros(1, np.int64)
    kind = SCRIPT[codes[letter]]
    word = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    votes = np.bincount(word * KINDS + kind, minlength=(len(ptr) - 1) * KINDS).reshape(-1, KINDS) if len(word) else np.zeros((len(ptr) - 1, KINDS), int)
    return Words(tri[letter], ptr, votes.argmax(axis=1), inverse)


@dataclass
class Model:
    names: list[str]
    logs: np.ndarray  # bucket, language
    uses: np.ndarray  # script, language

    def known(self, w: Words) -> np.ndarray:
        """Which of the distinct words have letters, in a script that a language uses."""
        return self.uses.any(axis=1)[w.script] & (w.letters > 0)

    def emissions(self, w: Words) -> np.ndarray:
        """Score of each distinct word in each language, in units; words not known say nothing."""
        score = np.stack([per_text(self.logs[w.bucket, k].astype(np.float64), w.ptr) for k in range(len(self.names))], axis=1)
        score = np.where(self.uses[w.script], score, score - 1000.0)
        return np.where(self.known(w)[:, None], np.rint(score * UNIT), 0).astype(np.int64)


@dataclass
class Stretches:
    """Runs of words, the longest first, that are stepped through side by side."""

    score: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    switch: int

    def __post_init__(self) -> None:
        self.order = np.argsort(-self.size, kind="stable")
        begin, size = self.begin[self.order], self.size[self.order]
        steps = int(size[0]) if len(size) else 0
        active = np.searchsorted(-size, -np.arange(steps), "left")  # runs longer than each step
        self.at = lambda t: begin[: active[t]] + t
        self.steps = steps

    def forward(self, enter: np.ndarray, stay: np.ndarray | None = None, top: np.ndarray | None = None) -> np.ndarray:
        """Best sums by label after each run, from those before it. stay, top: get each word's choices."""
        v = enter[self.order]
        for t in range(self.steps):
            at = self.at(t)
            a = len(at)
            best = v[:a].argmax(axis=1)
            jump = v[np.arange(a), best] - self.switch
            keep = v[:a] >= jump[:, None]
            if stay is not None:
                stay[at], top[at] = keep, best
            v[:a] = np.where(keep, v[:a], jump[:, None]) + self.score[at]
        out = np.empty_like(v)
        out[self.order] = v
        return out

    def backward(self, last: np.ndarray, stay: np.ndarray, top: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
        """The labels before each run, from the runs' last ones (a row for each run). label: gets each word's."""
        now = last[self.order]
        for t in range(self.steps - 1, -1, -1):
            at = self.at(t)
            a = len(at)
            if label is not None:
                label[at] = now[:a, 0]
            now[:a] = np.where(stay[at[:, None], now[:a]], now[:a], top[at][:, None])
        out = np.empty_like(now)
        out[self.order] = now
        return out


def viterbi(score: np.ndarray, ptr: np.ndarray, switch: int = int(SWITCH * UNIT), span: int = SPAN) -> np.ndarray:
    """The labels of the words of texts ptr[i]:ptr[i + 1] of the largest sum of scores (whole numbers).

    Ties: a label is kept rather than changed, and the smaller label is taken.
    """
    n, k = np.diff(ptr), score.shape[1]
    pieces = -(-n // span)
    nth = ragged(np.zeros(len(n), np.int64), pieces)
    text = np.repeat(np.arange(len(n)), pieces)
    begin = ptr[:-1][text] + nth * span
    size = np.minimum(ptr[1:][text] - begin, span)
    enter = np.zeros((len(begin), k), np.int64)
    go_on = np.flatnonzero(nth + 1 < pieces[text])
    if len(go_on):  # what a stretch adds from each label to each other
        one = np.where(np.eye(k, dtype=bool), 0, NEVER)
        adds = Stretches(score, np.repeat(begin[go_on], k), np.repeat(size[go_on], k), switch).forward(np.tile(one, (len(go_on), 1))).reshape(-1, k, k)
        for i, add in zip(go_on.tolist(), adds):
            enter[i + 1] = (enter[i][:, None] + add).max(axis=0)
    stay, top = np.zeros(score.shape, bool), np.zeros(len(score), np.int16)
    runs = Stretches(score, begin, size, switch)
    last = runs.forward(enter, stay, top).argmax(axis=1).astype(np.int16)
    if len(go_on):
        before = np.zeros((len(begin), k), np.int16)
        behind = go_on + 1
        before[behind] = Stretches(score, begin[behind], size[behind], switch).backward(np.tile(np.arange(k, dtype=np.int16), (len(behind), 1)), stay, top)
        for i in go_on[::-1].tolist():
            last[i] = before[i + 1, last[i + 1]]
    label = np.zeros(len(score), np.int16)
    runs.backward(last[:, None], stay, top, label)
    return label


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (lang, text): trigram and script counts of each block and language, sparse."""
    for b in blocks(batches, 1):
        lang = np.array(b.column(0).to_pylist(), object)
        for name in sorted(set(lang)):
            w = distinct_words(Texts(b.column(1).filter(pa.array(lang == name))))
            times = np.bincount(w.inverse, minlength=len(w.ptr) - 1)
            x = np.bincount(w.bucket, np.repeat(times, w.letters), 1 << BITS)
            s = np.bincount(w.script, times * w.letters, KINDS)
            some = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([some.astype(np.int32).tobytes()], pa.binary()), pa.array([x[some].tobytes()], pa.binary()), pa.array([s.tobytes()], pa.binary())], names=["lang", "bucket", "n", "scripts"])


def train(docs: DataFrame, learn: Column, lang: str = "lang", doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    """learn: which rows to learn from. Only counts of at most ``sample`` documents a language reach the driver."""
    rows = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull())
    # only rows whose hash is among the smallest, about MARGIN times as many as are wanted, are ranked;
    # the shares are a row a language, as many as the model has columns
    share = F.least(F.lit(1.0), F.lit(float(MARGIN * sample)) / F.count("*"))
    most = rows.groupBy(F.col(lang).alias("_l")).agg(share.alias("_s"))
    met = rows.select(lang, doc_id).join(F.broadcast(most), F.col(lang) == F.col("_l")).where((F.xxhash64(doc_id) / F.lit(2.0**64) + 0.5) <= F.col("_s"))
    first = Window.partitionBy(lang).orderBy(F.xxhash64(doc_id), doc_id)
    chosen = met.withColumn("n", F.row_number().over(first)).where(F.col("n") <= sample).select(F.col(doc_id).alias("_i")).distinct()
    few = chosen.count() <= 200_000  # else too many languages for a broadcast
    picked = rows.join(F.broadcast(chosen) if few else chosen, F.col(doc_id) == F.col("_i"), "left_semi").select(lang, text)
    found = picked.mapInArrow(counted, "lang string, bucket binary, n binary, scripts binary").collect()
    names = sorted({r["lang"] for r in found})
    x, s = np.full((1 << BITS, len(names)), ALPHA), np.zeros((KINDS, len(names)))
    for r in found:
        k = names.index(r["lang"])
        x[np.frombuffer(r["bucket"], np.int32), k] += np.frombuffer(r["n"])
        s[:, k] += np.frombuffer(r["scripts"])
    return Model(names, np.log(x / x.sum(axis=0)).astype(np.float32), s > LEAST_SHARE * np.maximum(s.sum(axis=0), 1))


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, n_spans: a row for each of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = len(m.names)
        names = pa.array([*m.names, "und"])
        for b in blocks(batches, 1):
            texts = Texts(b.column(1))
            best, share, spans = np.full(texts.n, k), np.zeros(texts.n), np.zeros(texts.n, np.int64)
            if k and len(texts.starts):
                w = distinct_words(texts)
                label = viterbi(m.emissions(w)[w.inverse], texts.ptr)
                doc = texts.text_of()
                letters = per_text(w.letters[w.inverse], texts.ptr)
                sums = np.bincount(doc * k + label, (w.letters * m.known(w))[w.inverse], texts.n * k).reshape(-1, k)
                some = letters > 0
                best = np.where(some, sums.argmax(axis=1), k)
                share = sums.max(axis=1) / np.maximum(letters, 1)
                new = np.append(True, (label[1:] != label[:-1]) | (doc[1:] != doc[:-1]))
                spans = np.where(some, per_text(new, texts.ptr), 0)
            yield pa.RecordBatch.from_arrays([b.column(0), names.take(pa.array(best)), pa.array(share), pa.array(spans)], names=["doc_id", "lang_pred", "score", "n_spans"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, n_spans bigint")
