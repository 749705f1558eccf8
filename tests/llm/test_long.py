"""One text of several blocks (over 4 MB) among others, through every operator that reads texts."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from test_dedup import brute, lines, words
from test_scores import TOKENS, base_of, check_packing, pattern

from plumbline.llm import langid, line_dedup, lm_scoring, mixing, packing, quality_classifier, quality_rules, queries, simhash, substring_dedup


@pytest.fixture(scope="module")
def long(spark):
    rng = np.random.default_rng(9)
    syllables = ["ta", "re", "mo", "li", "én", "ka", "so", "vu", "ß", "qi"]
    word = lambda: "".join(syllables[k] for k in rng.integers(0, 10, rng.integers(1, 5)))
    vocabulary = [word() for _ in range(4000)]
    pick = lambda n: " ".join(vocabulary[k] for k in rng.integers(0, 4000, n))
    shared = "\n".join(pick(9) for _ in range(8))
    whole = "\n".join([pick(12) for _ in range(60_000)] + [shared] + [pick(12) for _ in range(500)])
    assert len(whole.encode()) > 4 << 20
    rows = [(1, pick(80), "en"), (2, "x\n" + shared, "en"), (3, whole, "en"), (4, shared + "\ny", "fr"), (5, None, "fr"), (6, pick(300), "fr")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("source", F.lit("s")).repartition(2).persist()


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_dedups(long):
    assert Counter(tuple(r) for r in substring_dedup.report(long).collect()) == brute(long, words, b" ", 20)
    assert Counter(tuple(r) for r in line_dedup.report(long).collect()) == brute(long, lines, b"\n", 3)


def test_fingerprint(long):
    t = texts(long)[3]
    w = t.encode().lower().split()
    h = np.array([xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(len(w) - 3)], np.uint64)
    want = sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h))
    assert {r.doc_id: np.int64(r.fp).view(np.uint64) for r in simhash.near_duplicates(long).collect()}[3] == want


def test_packing(long):
    check_packing(packing.pack(long, queries.tokenizer_path()).collect(), list(texts(long).values()))


def test_rules_classifier_and_sizes(spark, long):
    labels = spark.createDataFrame([(1, 1), (2, 0), (6, 1)], "doc_id bigint, quality int")
    got = {r.doc_id: tuple(r)[:7] for r in quality_rules.judge(long, labels).collect()}
    assert got == {i: (i, *base_of(t)) for i, t in texts(long).items()}
    assert quality_classifier.report(long, labels, *queries.site()).count() == 6
    assert {r.doc_id: r.n for r in long.select("doc_id", mixing.words(F.col("text")).alias("n")).collect()} == {i: len((t or "").encode().split()) for i, t in texts(long).items()}


def test_spans(long):
    model = langid.train(long, F.lit(True))
    got = {r.doc_id: (r.lang_pred, r.n_spans) for r in langid.identify(long, model).collect()}
    assert got[5] == ("und", 0) and got[3][0] in model.names and got[3][1] >= 1


def test_language_model_base(long):
    t = texts(long)
    split = lambda x: [*(x or "").encode().lower().split(), None]
    train = [i for i in t if zlib.crc32(str(i).encode()) % 10]
    c = Counter(w for i in train for w in split(t[i]))
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in lm_scoring.score(long, queries.remainder("doc_id", 10) != 0, TOKENS, pattern()).collect()}
    for i in t:
        want = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in split(t[i]))
        assert (got[i].n_tokens, got[i].n_known) == (len(split(t[i])), sum(c[w] > 0 for w in split(t[i])))
        assert abs(got[i].base_score - want) < 1e-6 * max(1, abs(want)) and got[i].score < 0
