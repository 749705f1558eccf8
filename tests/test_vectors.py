"""The vector index against all cosines."""

import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import retrieval
from plumbline.sources import vectors

SCHEMA = "vec_id bigint, embedding array<float>"


def exact(rows, queries, top, itself=True):
    unit = {i: np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) for i, v in rows}
    out = {}
    for q in queries:
        s = sorted((-round(float(unit[q] @ v), 9), i) for i, v in unit.items() if itself or i != q)
        out[q] = [i for _, i in s[:top]]
    return out


def of(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r.id)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(12, 16))
    x = [centre[k % 12] + 0.6 * rng.normal(size=16) for k in range(1500)]
    return [(k, [float(c) for c in v]) for k, v in enumerate(x)] + [(2000 + k, [float(c) for c in x[3]]) for k in range(12)]


@pytest.mark.parametrize("most", [4096, 3])
def test_all_cells_are_exact_and_a_tenth_finds_most(spark, tmp_path, rows, most, monkeypatch):
    monkeypatch.setattr(vectors, "MOST_QUERIES", most)
    at = str(tmp_path / "x")
    odd = [(3000, None), (3001, [0.0] * 16), (3002, [1.0] * 15 + [None]), (3003, [float("nan")] * 16), (3004, [1.0, 2.0])]
    df = spark.createDataFrame([*rows, *odd], SCHEMA).repartition(3)
    cells = vectors.build(df, at)
    assert cells == round(len(rows) ** 0.5)
    asked, want = [i for i, _ in rows if i % 50 == 0], None
    queries = df.where(F.col("vec_id") % 50 == 0)
    for itself in (True, False):
        want = exact(rows, asked, 10, itself)
        got = of(vectors.search(spark, at, queries, 10, cells, itself=itself))
        assert {i: got[i] for i in want} == want and set(got) == set(want)
    few = of(vectors.search(spark, at, queries, 10, -(-cells // 10), itself=False))
    assert sum(len(set(few[i]) & set(want[i])) for i in want) / (10 * len(want)) >= 0.9


def test_other_cells_are_not_read(spark, tmp_path, rows):
    at = str(tmp_path / "x")
    df = spark.createDataFrame(rows, SCHEMA)
    cells = vectors.build(df, at)
    queries = df.where("vec_id = 7")
    before = of(vectors.search(spark, at, queries, 5, 4))
    centre, _ = vectors.index_of(spark, at)
    q = np.array(rows[7][1])
    near = set(np.argsort(-(centre @ q), kind="stable")[:4].tolist())
    for k in set(range(cells)) - near:
        shutil.rmtree(tmp_path / "x" / "cells" / f"cell={k}", ignore_errors=True)
    assert of(vectors.search(spark, at, queries, 5, 4)) == before and before[7][0] == 7


def test_few_and_none(spark, tmp_path):
    two = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], SCHEMA)
    vectors.build(two, str(tmp_path / "two"))
    assert of(vectors.search(spark, str(tmp_path / "two"), two, 10, 9)) == {1: [1, 2], 2: [2, 1]}
    vectors.build(two.limit(0), str(tmp_path / "none"))
    assert vectors.search(spark, str(tmp_path / "none"), two, 10, 9).count() == 0


def test_search_sends_a_row_a_query(spark, tmp_path, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    rng = np.random.default_rng(8)
    v = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(300)], "vec_id bigint, embedding array<double>")
    cells, sent, read = vectors.build(v, str(tmp_path)), [], DataFrame.toArrow
    monkeypatch.setattr(DataFrame, "toArrow", lambda df: sent.append(read(df).num_rows) or read(df))
    found = vectors.search(spark, str(tmp_path), v.where("vec_id % 10 = 0"), 3, cells, itself=False)
    assert cells > 8 and sorted(sent) == sorted([cells, 30]) and found.count() == 90


def test_similar_pairs_hold_the_best_of_each_slice(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(i, f"l{i % 3}", [1.0, *[float(x) for x in rng.integers(-2, 3, 3)]]) for i in range(60)]  # many ties
    df = spark.createDataFrame(rows, "vec_id bigint, label string, embedding array<double>")
    found = lambda: {(r.a, r.b, round(r.sim, 9)) for r in retrieval.similar_pairs(df, "label", 0.1, 2, blocks=2).collect()}
    whole = found()
    monkeypatch.setattr(retrieval, "ROWS", 5)
    assert found() == whole and len(whole) > 60
