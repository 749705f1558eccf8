"""Every query with SQL equals it on the smallest tables, row for row."""

import math

import duckdb
import pytest

from plumbline import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def norm(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else v + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, con, sf, name):
    rel = con.execute(queries.SQL[name])
    columns = [c[0] for c in rel.description]
    want = sorted((tuple(map(norm, r)) for r in rel.fetchall()), key=str)
    out = queries.QUERIES[name](spark, sf)
    assert sorted(out.columns) == sorted(columns)
    assert sorted((tuple(map(norm, r)) for r in out.select(columns).collect()), key=str) == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0
