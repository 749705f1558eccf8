"""Quality rules: base counts, then a calibrated n-gram logistic regression.

Base counts need no model. A document fails the base rules if it has fewer than MIN_WORDS
words or more than a fifth of its words stand in five-word windows found twice or more in it.

The model is a logistic regression over hashed word and character n-grams (words, word pairs,
trigrams of code points, none across two texts), each kind as shares of its own total, so that
length plays no part and a text's result doesn't depend on what it is read with. It is
fitted on labelled rows, at most SAMPLE of them (those of the smallest hash of doc_id, as far as
their texts have SAMPLE_BYTES together; their n-grams alone reach the driver), and its margin is calibrated by Platt's method on every
fourth of them, which the weights don't see. Documents are scored in Arrow batches: kept if
the probability reaches KEEP.

Null and empty texts have no words: all counts are zero and the base rules fail. Without
usable labels, or with one class only, every document that passes the base rules is kept at
the prior. Labels that repeat a doc_id are averaged, a half counts as good; null ones are
left out. Rows that share a doc_id are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import Texts, blocks, covered, hash_spans, hash_windows, mix, per_text, window_starts

MIN_WORDS, MOST_REPEATED = 10, 20
SAMPLE, KEEP, BITS = 4000, 0.5, 16
SAMPLE_BYTES = 64 << 20  # of the sample's texts; what they send to the driver is some three times as much at most
KINDS = 3  # words, word pairs, trigrams of code points
SCALE = 30.0
CONTINUED = np.zeros(256, bool)
CONTINUED[0x80:0xC0] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9]  # one for each place in a trigram


def repeats_in_text(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of items with hashes h: has the text it again, or before? has it it before?"""
    key = mix(h ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice, later = np.zeros(len(h), bool), np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    later[order[1:][same]] = True
    return twice, later


def base_counts(texts: Texts, words: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    data, at = texts.data, texts.offsets
    starts, ends, ptr = texts.lines()
    full = np.searchsorted(texts.starts, starts) < np.searchsorted(texts.starts, ends)
    line_doc = np.repeat(np.arange(texts.n), np.diff(ptr))[full]
    _, later = repeats_in_text(hash_spans(data, starts[full], ends[full], 1), line_doc)
    window = window_starts(texts.ptr, 5)
    twice, _ = repeats_in_text(hash_windows(words, window, 5), np.searchsorted(texts.ptr, window, "right") - 1)
    return {
        "n_words": texts.counts,
        "word_chars": per_text(~(texts.space | CONTINUED[data]), at),
        "n_symbols": per_text(SYMBOL[data], at),
        "n_dup_lines": np.bincount(line_doc[later], minlength=texts.n),
        "n_repeat_words": per_text(covered(window[twice], 5, len(words)), texts.ptr),
    }


def ngrams(texts: Texts, words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind the buckets of all n-grams and ptr by text."""
    shift = np.uint64(64 - BITS)
    pair = window_starts(texts.ptr, 2)
    pairs = hash_windows(words, pair, 2)
    pair_ptr = np.append(0, np.cumsum(np.maximum(texts.counts - 1, 0)))
    chars, char_ptr = code_points(texts)
    tri = window_starts(char_ptr, 3)
    mixed = np.zeros(len(chars), np.uint64)
    for k, odd in enumerate(ODD):
        mixed[: max(0, len(chars) - 2)] ^= chars[k : len(chars) - 2 + k].astype(np.uint64) * np.uint64(odd)
    tris = (mix(mixed[tri]) >> shift).astype(np.int32)
    tri_ptr = np.append(0, np.cumsum(np.maximum(np.diff(char_ptr) - 2, 0)))
    return [((words >> shift).astype(np.int32), texts.ptr), ((pairs >> shift).astype(np.int32), pair_ptr), (tris, tri_ptr)]


def code_points(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each character as one number, and ptr by text."""
    lead = ~CONTINUED[texts.data]
    lead[texts.offsets[:-1][np.diff(texts.offsets) > 0]] = True
    at = np.flatnonzero(lead)
    size = np.diff(np.append(at, len(texts.data)))
    data = np.append(texts.data, np.zeros(3, np.uint8))
    chars = np.zeros(len(at), np.uint32)
    for k in range(4):
        chars |= np.where(size > k, data[at + k], 0).astype(np.uint32) << np.uint32(8 * k)
    return chars, np.searchsorted(at, texts.offsets)


def margins(texts: Texts, words: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    out = np.full(texts.n, bias)
    for kind, (bucket, ptr) in enumerate(ngrams(texts, words)):
        n = np.diff(ptr)
        out += SCALE * per_text(weights[kind][bucket].astype(np.float64), ptr) / np.maximum(n, 1)
    return out


FEATURES = "y int, bucket binary, share binary"


def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (y, text): distinct buckets of each text and their scaled shares."""
    for b in blocks(batches, 1):
        texts = Texts(b.column(1))
        kinds = ngrams(texts, texts.hashes(0))
        buckets, shares = [], []
        for i in range(texts.n):
            at, x = [], []
            for kind, (bucket, ptr) in enumerate(kinds):
                u, n = np.unique(bucket[ptr[i] : ptr[i + 1]], return_counts=True)
                at.append(u + (kind << BITS))
                x.append(SCALE * n / max(1, ptr[i + 1] - ptr[i]))
            buckets.append(np.concatenate(at).astype(np.int32).tobytes())
            shares.append(np.concatenate(x).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(buckets, pa.binary()), pa.array(shares, pa.binary())], names=["y", "bucket", "share"])


def fit(rows: list[tuple[int, bytes, bytes]], steps: int = 150, rate: float = 0.05, penalty: float = 1e-5) -> dict:
    """Weights by Adam on three quarters of the rows, calibration a, b by Newton on the rest."""
    y = np.array([r[0] for r in rows], np.float64)
    held = np.arange(len(rows)) % 4 == 3
    model = {"weights": np.zeros((KINDS, 1 << BITS), np.float32), "bias": 0.0, "a": 1.0, "b": 0.0}
    if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        model["b"] = 4.0  # nothing to tell the classes apart by: all pass
        return model
    bucket = [np.frombuffer(r[1], np.int32) for r in rows]
    share = [np.frombuffer(r[2], np.float32) for r in rows]
    size = np.array([len(b) for b in bucket])
    ptr = np.append(0, np.cumsum(size))
    bucket, share = np.concatenate(bucket), np.concatenate(share)
    w, bias, m, v = np.zeros(KINDS << BITS), 0.0, np.zeros((KINDS << BITS) + 1), np.zeros((KINDS << BITS) + 1)
    train = ~held
    for t in range(1, steps + 1):
        z = per_text(share * w[bucket], ptr) + bias
        miss = np.where(train, 1 / (1 + np.exp(-z)) - y, 0) / train.sum()
        g = np.append(np.bincount(bucket, share * np.repeat(miss, size), len(w)) + penalty * w, miss.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    z = (per_text(share * w[bucket], ptr) + bias)[held]
    good, bad = y[held].sum(), (1 - y[held]).sum()
    target = np.where(y[held] > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * z + b)))
        s = np.maximum(p * (1 - p), 1e-9)
        ga, gb = ((p - target) * z).sum() + 1e-3 * (a - 1), (p - target).sum()
        h = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-9]])
        da, db = np.linalg.solve(h, [ga, gb])
        step = min(1.0, 2.0 / max(abs(da), abs(db), 1e-12))
        a, b = a - step * da, b - step * db
    return model | {"weights": w.reshape(KINDS, -1).astype(np.float32), "bias": float(bias), "a": float(a), "b": float(b)}


def labelled(labels: DataFrame, label: str = "quality") -> DataFrame:
    return labels.where(f"doc_id is not null and `{label}` is not null").groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> dict:
    """The model of at most ``sample`` labelled rows, those of the smallest hashes, as far as their texts have ``most_bytes`` together; equal rows count once."""
    chosen = labelled(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.xxhash64("doc_id").alias("h"), F.xxhash64("doc_id", "text").alias("o"), "y", "text")
    keys = rows.groupBy("h", "o").agg(F.max(F.coalesce(F.octet_length("text"), F.lit(0))).alias("n")).orderBy("h", "o").limit(sample).collect()
    fits = int(np.searchsorted(np.cumsum([k["n"] for k in keys]), most_bytes, "right"))
    few = docs.sparkSession.createDataFrame([(k["o"],) for k in keys[: max(fits, 1)]], "o bigint")
    texts = rows.join(F.broadcast(few), "o", "left_semi").dropDuplicates(["o"]).select("y", "text")
    found = [tuple(r) for r in texts.mapInArrow(featured, FEATURES).collect()]
    found.sort(key=lambda r: (len(r[1]), r[1:], r[0]))
    return fit(found)


SCORES = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, p_good double"


def judge(docs: DataFrame, labels: DataFrame, keep: float = KEEP, sample: int = SAMPLE) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and p_good; a row for each of docs (doc_id, text)."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in blocks(batches, 1):
            texts = Texts(b.column(1))
            words = texts.hashes(0)
            x = base_counts(texts, words)
            z = margins(texts, words, m["weights"], m["bias"])
            p = 1 / (1 + np.exp(-np.clip(m["a"] * z + m["b"], -50, 50)))
            failed = (x["n_words"] < MIN_WORDS) | (100 * x["n_repeat_words"] > MOST_REPEATED * x["n_words"])
            columns = [b.column(0), *[pa.array(c.astype(np.int64)) for c in x.values()], pa.array(failed), pa.array(~failed & (p >= keep)), pa.array(p)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *x, "base_failed", "kept", "p_good"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, SCORES)
