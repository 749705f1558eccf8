import hashlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from plumbline.llm import components, line_dedup, simhash, substring_dedup
from plumbline.llm.kernel import Texts, blocks, hash_spans, hash_windows

LOW = -(2**63)


def collected(df):
    """(doc_id, text) in the order of occurrence: doc_id, then the row's hash."""
    rows = df.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) h").collect()
    return sorted(((LOW if r.doc_id is None else r.doc_id, r.h, r.text or "") for r in rows), key=lambda r: r[:2])


def brute(df, split, join, size):
    """Counter of (doc_id, items, removed, sha) by a dictionary of first occurrences."""
    rows, first = collected(df), {}
    for i, h, t in rows:
        w = split(t)
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            first[key] = min(first.get(key, (i, h, k)), (i, h, k))
    out = Counter()
    for i, h, t in rows:
        w = split(t)
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < (i, h, k):
                gone[k : k + size] = [True] * size
        kept = join.join(x for x, g in zip(w, gone) if not g)
        out[None if i == LOW else i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


def words(t):
    return t.encode().split()


def lines(t):
    return [x for x in t.encode().split(b"\n") if x.split()]


@pytest.mark.parametrize("table", ["edge", "docs", "none"])
def test_substring_dedup_equals_brute_force(table, request):
    df = request.getfixturevalue(table)
    got = Counter(tuple(r) for r in substring_dedup.report(df).collect())
    assert got == brute(df, words, b" ", 20)


@pytest.mark.parametrize("table", ["edge", "docs", "none"])
def test_line_dedup_equals_brute_force(table, request):
    df = request.getfixturevalue(table)
    got = Counter(tuple(r) for r in line_dedup.report(df).collect())
    assert got == brute(df, lines, b"\n", 3)


def test_deduplicated_keeps_columns_and_other_texts(edge):
    out = line_dedup.deduplicated(edge)
    assert out.columns == edge.columns and out.count() == edge.count()
    before, after = {r.doc_id: r.text for r in edge.collect() if r.doc_id in (3, 4, 6, 8)}, {r.doc_id: r.text for r in out.collect() if r.doc_id in (3, 4, 6, 8)}
    assert before == after
    assert {r.text for r in out.collect() if r.doc_id == 9} >= {"intro\nend"}


def fingerprint(t):
    w = (t or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


@pytest.mark.parametrize("table", ["edge", "docs"])
def test_simhash_equals_brute_force(table, request):
    rows = simhash.near_duplicates(request.getfixturevalue(table)).collect()
    texts = collected(request.getfixturevalue(table))
    want = sorted((i, h, np.uint64(fingerprint(t))) for i, h, t in texts)
    got = sorted((LOW if r.doc_id is None else r.doc_id, r.row, np.int64(r.fp).view(np.uint64)) for r in rows)
    assert [g[2] for g in got] == [w[2] for w in want]
    fps = np.array([w[2] for w in want], np.uint64)
    label = np.arange(len(fps))
    near = [np.flatnonzero(np.bitwise_count(f ^ fps) <= 4) for f in fps]
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            break
        label = new
    ids = np.array([w[0] for w in want])
    least = {k: min((i for i in ids[label == k] if i != LOW), default=None) for k in set(label)}
    assert Counter((w[0], least[k]) for w, k in zip(want, label)) == Counter((LOW if r.doc_id is None else r.doc_id, r.component_id) for r in rows)


def test_simhash_of_nothing(none):
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.one_of_each(none).columns == none.columns


def test_one_of_each_keeps_one_row_of_a_component(edge):
    out = simhash.one_of_each(edge)
    assert out.columns == edge.columns
    kept = Counter(r.doc_id for r in out.collect())
    assert kept[18] == 0 or kept[18] == 1
    assert kept[None] == 2  # rows without a name stay


def test_large_buckets_are_cut_without_losing_links(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(simhash, "CHUNK", 8)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**40, 300)
    key = np.sort(rng.integers(0, 4, 300))
    fp = np.array([b if i % 3 else base[0] ^ (1 << int(rng.integers(0, 40))) for i, b in enumerate(base)], np.int64)
    order = np.lexsort((fp, key))
    key, fp = key[order], fp[order]
    batches = [pa.RecordBatch.from_arrays([pa.array(key[i : i + 37]), pa.array(fp[i : i + 37])], names=["key", "fp"]) for i in range(0, 300, 37)]
    links, chunks = [], {}
    for b in simhash.bucket_links(iter(batches)):
        for r in b.to_pylist():
            if r["u"] is None:
                chunks[r["key"], r["chunk"]] = np.frombuffer(r["fps"], np.int64)
            else:
                links.append((r["u"], r["v"]))
    for (k, a), x in chunks.items():
        for (q, b), y in chunks.items():
            if k == q and a < b:
                links += list(zip(*(z.tolist() for z in simhash.across(x, y))))
    want = [(int(fp[i]), int(fp[j])) for i in range(300) for j in range(i) if key[i] == key[j] and simhash.near(fp[i : i + 1], fp[j : j + 1])[0] and fp[i] != fp[j]]
    nodes = lambda e: dict(zip(*(x.tolist() for x in components.roots(np.array([a for a, _ in e]), np.array([b for _, b in e])))))
    got, expected = nodes(links), nodes(want)
    assert {n: got[n] for n in expected} == expected


def test_components_of_long_chains(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7), (101, 100)]
    got = {r.u: r.v for r in components.components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_masks_meet_every_close_pair():
    rng = np.random.default_rng(0)
    masks = np.array(simhash.block_masks(), np.int64).view(np.uint64)
    for _ in range(300):
        flips = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert ((masks & np.uint64(flips)) == 0).any()


def test_kernel_words_and_hashes():
    import pyarrow as pa

    texts = ["a  bb\tc", None, "", "ä x\n", "bb"]
    t = Texts(pa.array(texts))
    assert [t.word(i) for i in range(len(t.starts))] == [w for x in texts for w in (x or "").encode().split()]
    h = t.hashes()
    assert h[1] == h[-1] and len(set(h.tolist())) == len(h) - 1
    assert (hash_spans(t.data, t.starts, t.ends) == h).all()
    items = np.array([1, 2, 3, 1, 2, 3], np.uint64)
    w = hash_windows(items, np.array([0, 1, 3]), 3)
    assert w[0] == w[2] != w[1]


def test_blocks_keep_all_rows():
    import pyarrow as pa

    b = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (0, 5, 100, 3, 0, 50, 50, 1)])], names=["t"])
    out = [r for p in blocks(iter([b, b.slice(0, 0), b]), 0, 60) for r in p.column(0).to_pylist()]
    assert out == b.column(0).to_pylist() * 2
