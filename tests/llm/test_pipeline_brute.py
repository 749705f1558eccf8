"""The pipeline's rows against plain Python, stage by stage, on whole small tables."""

import hashlib
from collections import Counter

import pytest
from test_dedup import LOW, fingerprint
from test_mixing_pipeline import brute_mix, brute_plan
from test_scores import brute_classifier, check_packing

import corpus_pipeline
from plumbline.llm import quality_classifier, quality_rules, queries


def brute_lines(rows):
    """Texts of (doc_id, hash, text, rest) without later occurrences of three-line windows; texts that lose none stay as they are."""
    full = lambda t: [x for x in (t or "").encode().split(b"\n") if x.split()]
    key = lambda r: (LOW if r[0] is None else r[0], r[1])
    first = {}
    for r in rows:
        w = full(r[2])
        for k in range(len(w) - 2):
            first[tuple(w[k : k + 3])] = min(first.get(tuple(w[k : k + 3]), (key(r), k)), (key(r), k))
    out = []
    for r in rows:
        w = full(r[2])
        gone = [False] * len(w)
        for k in range(len(w) - 2):
            if first[tuple(w[k : k + 3])] < (key(r), k):
                gone[k : k + 3] = [True] * 3
        out.append((r[0], b"\n".join(x for x, g in zip(w, gone) if not g).decode() if any(gone) else r[2], r[3]))
    return out


def brute_near(rows):
    """Of rows (doc_id, text, rest) with ids of their own the one of the smallest id in each component of fingerprints within four bits."""
    fps = [fingerprint(t) for _, t, _ in rows]
    label = list(range(len(rows)))
    while True:
        new = [min(label[j] for j in range(len(rows)) if (fps[i] ^ fps[j]).bit_count() <= 4) for i in range(len(rows))]
        if new == label:
            break
        label = new
    least = {k: min(r[0] for r, x in zip(rows, label) if x == k) for k in set(label)}
    return [r for r, k in zip(rows, label) if r[0] == least[k]]


def hashes(spark, rows):
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    return {r.doc_id: (r.h, r.m) for r in df.selectExpr("doc_id", "xxhash64(coalesce(text, '')) h", "md5(coalesce(text, '')) m").collect()}


@pytest.fixture(scope="module")
def wanted(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    y = {r.doc_id: r.y for r in quality_rules.labelled(labels).collect()}
    p = dict(brute_classifier([(r.doc_id, r.text, r.source, r.lang) for r in docs], y))
    kept = [(r.doc_id, r.text, (r.lang, r.source)) for r in docs if p[r.doc_id] >= quality_classifier.KEEP]
    h = hashes(spark, kept)
    cut = brute_lines([(i, h[i][0], t, rest) for i, t, rest in kept])
    near = brute_near(cut)
    h = hashes(spark, near)
    domain = lambda s: "d" + str("0123456789abcdef".index(hashlib.md5((s or "").encode()).hexdigest()[0]) // 4)
    sizes = [(i, h[i][1], domain(source), lang, source, len((t or "").encode().split())) for i, t, (lang, source) in near]
    leaves = Counter()
    for s in sizes:
        if s[5]:
            leaves[s[2:5]] += s[5]
    weights = {(a, b): c for a, b, c in queries.WEIGHTS}
    shares = brute_plan(leaves, sum(leaves.values()) * corpus_pipeline.BUDGET, weights, 1)
    taken = {k[0] for k in brute_mix(sizes, {k: int(v + 1e-6) for k, v in shares.items()})}
    return [r for r in near if r[0] in taken]


def test_run_equals_brute_force(spark, sf, wanted):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == {i for i, _, _ in wanted}
    check_packing(rows, [t for _, t, _ in wanted])

