"""Codes of vectors against plain Python; the tree's search against all distances."""

import hashlib
import math
import random

import numpy as np
import pytest

from plumbline.llm.codebooks import KdTree, compress

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, error string"


def brute(rows, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // 4
    part = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], np.int32).tobytes()))[:entries]
    books = [[part(v, p) for _, v, _ in first] for p in range(4)]
    near = lambda x, p: min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(4):
            of = {}
            for _, v, _ in kept:
                of.setdefault(near(part(v, p), p)[1], []).append(part(v, p))
            for k, xs in of.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    out = []
    for i, v, label in kept:
        found = [near(part(v, p), p) for p in range(4)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
    by = {}
    for _, _, e, label in out:
        by[label] = by.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted([(i, c, e, by[label], digest) for i, c, e, label in out], key=str)


def vectors(n, seed=1, coarse=False):
    rng = random.Random(seed)
    x = lambda: rng.randrange(-2, 3) / 1024 if coarse else rng.gauss(0, 0.2)
    rows = [(rng.randrange(n * 2), [float(np.float32(x())) for _ in range(8)], rng.choice([None, 1, 2])) for _ in range(n)]
    odd = [(1, None, 1), (2, [1.0] * 7 + [None], 1), (3, [1.0] * 7 + [float("nan")], 2), (4, [float("inf")] + [0.0] * 7, 2), (0, [0.0] * 8, 1), (0, [0.0] * 8, 1), (None, [0.5] * 8, None), rows[0]]
    return rows + odd


@pytest.mark.parametrize("n,coarse,entries", [(120, False, 16), (120, True, 16), (40, False, 256)])
def test_equals_plain_python(spark, n, coarse, entries):
    rows = vectors(n, coarse=coarse)
    table = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(3)
    got = compress(table, entries=entries)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, entries)


@pytest.mark.parametrize("size", [1, 3, 40, 10_000_000])
def test_tree_finds_the_lowest_of_the_nearest(size):
    rng = np.random.default_rng(size)
    entries = rng.integers(-size, size, (256, 5))
    entries[200:] = entries[:56]  # equal entries under higher numbers
    x = rng.integers(-size, size, (500, 5))
    d = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
    found, best = KdTree(entries).nearest(x)
    assert (found == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def test_tree_passes_over_far_nodes():
    rng = np.random.default_rng(0)
    tree = KdTree(np.sort(rng.integers(0, 10**6, (256, 2)), axis=0))
    seen = []
    visit = tree._visit
    tree._visit = lambda node, rows, *rest: (seen.append((node, len(rows))), visit(node, rows, *rest))
    tree.nearest(rng.integers(0, 10**6, (1000, 2)))
    leaves = sum(n for node, n in seen if isinstance(tree.nodes[node][2], np.ndarray))
    assert leaves < 1000 * 32 / 4


def test_odd_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert compress(none).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and compress(none).count() == 0
    mixed = [(1, [1.0, 2.0, 3.0], 1), (2, [1.0, 2.5, 3.0], 1), (3, [0.0], 1), (4, [1e30, -1e30, 0.0], 1), (5, [], 1)]
    got = {r.vec_id: r for r in compress(spark.createDataFrame([(*r, "", "") for r in mixed], SCHEMA)).collect()}
    assert set(got) == {1, 2, 4} and got[1].code == "00000000" and got[1].error == 0
    empty = compress(spark.createDataFrame([(1, [], 1, "", "")], SCHEMA)).collect()
    assert [(r.vec_id, r.error) for r in empty] == [(1, 0)]
