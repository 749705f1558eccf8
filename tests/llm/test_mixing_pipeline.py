from collections import Counter, defaultdict
from hashlib import md5

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import mixing, queries
from plumbline.llm.common import settle


def fill(budget, caps, weights):
    """Water-filling by repeated rounds."""
    share, open_ = dict.fromkeys(caps, 0.0), set(caps)
    left = min(budget, sum(caps.values()))
    while left > 1e-9 and open_:
        total = sum(weights[k] for k in open_)
        step = {k: min(caps[k] - share[k], left * weights[k] / total) for k in open_}
        for k, s in step.items():
            share[k] += s
        left -= sum(step.values())
        open_ = {k for k in open_ if caps[k] - share[k] > 1e-9}
    return share


def brute_plan(leaves, budget, weights, epochs):
    def go(prefix, budget):
        depth = len(prefix)
        if depth == 3:
            return {prefix: budget}
        caps = defaultdict(float)
        for leaf, n in leaves.items():
            if leaf[:depth] == prefix:
                caps[leaf[: depth + 1]] += n * epochs
        share = fill(budget, caps, {k: weights.get((mixing.LEVELS[depth], k[-1]), 1.0) for k in caps})
        return {k: v for c in caps for k, v in go(c, share[c]).items()}

    return go((), budget)


def test_plan_equals_water_filling(spark):
    leaves = {("a", "en", "s1"): 100, ("a", "en", "s2"): 1000, ("a", "fr", "s1"): 50, ("b", "en", "s3"): 5000, ("b", None, "s4"): 10, (None, "de", "s5"): 700}
    weights = [("domain", "a", 3.0), ("domain", "b", 1.0), ("language", "fr", 5.0), ("source", "s2", 2.0)]
    df = spark.createDataFrame([(*k, v) for k, v in leaves.items()], "domain string, language string, source string, tokens bigint")
    w = spark.createDataFrame(weights, "level string, name string, weight double")
    for budget in (100.0, 3000.0, 9000.0, 1e6):
        got = {(r.domain, r.language, r.source): r.share for r in mixing.plan(df, budget, w, 2).collect()}
        want = brute_plan(leaves, min(budget, 2.0 * sum(leaves.values())), {(a, b): c for a, b, c in weights}, 2)
        assert {k: pytest.approx(v, abs=1.01) for k, v in want.items()} == got


def brute_mix(sizes, shares):
    out = Counter()
    for leaf, share in shares.items():
        docs = [s for s in sizes if s[2:5] == leaf and s[5] > 0]
        total = sum(s[5] for s in docs)
        epoch, left = 0, share
        while docs and left > 0:
            key = lambda s: md5(f"{mixing.SEED}:{epoch}:{'' if s[0] is None else s[0]}:{s[1]}".encode()).hexdigest()  # noqa: B023, E731
            for s in docs if left >= total else sorted(docs, key=key):
                n = min(s[5], left)
                if n <= 0:
                    break
                out[s[0], s[1], epoch, n] += 1
                left -= n
            epoch += 1
    return out


@pytest.mark.parametrize("table", ["edge", "docs"])
def test_mixture_equals_brute_force(spark, table, request):
    sizes = settle(queries.tree(request.getfixturevalue(table)))
    leaves = settle(mixing.plan(mixing.leaves_of(sizes), F.col("all_tokens"), queries.weights(spark)))
    got = Counter((r.doc_id, r.row, r.epoch, r.tokens_taken) for r in mixing.mixed(sizes, leaves).collect())
    shares = {(r.domain, r.language, r.source): r.share for r in leaves.collect()}
    assert got == brute_mix([tuple(r) for r in sizes.collect()], shares)


def test_mixture_of_nothing(spark, none):
    sizes = queries.tree(none)
    assert mixing.mixed(sizes, mixing.plan(mixing.leaves_of(sizes), 100.0)).count() == 0


def test_words(spark, edge):
    for r in edge.select("text", mixing.words(F.col("text")).alias("n")).collect():
        assert r.n == len((r.text or "").encode().split())


def test_oracles_match(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        rel = con.execute(sql)
        columns = [c[0] for c in rel.description]
        got = queries.queries()[name](spark, sf).select(columns).collect()
        assert Counter(tuple(r) for r in got) == Counter(rel.fetchall()), name


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = settle(stage(spark, docs, sf))
        if k < 4:
            assert out.columns == columns, name
            assert {r.doc_id for r in out.select("doc_id").collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}
        if k == 0:
            good = [i for i, q in labels.items() if q]
            kept = {r.doc_id for r in out.collect()}
            assert len(kept & set(good)) > 0.95 * len(good)
        if k == 2:
            from plumbline.llm.simhash import near_duplicates

            found = near_duplicates(docs)
            assert {r.doc_id for r in out.collect()} == {r.component_id for r in found.collect()}
        docs = out
        counts.append(out.count())
    assert counts[0] > counts[1] > 0 and counts[2] == counts[1] and counts[3] <= counts[2] and counts[4] <= counts[3]
    assert corpus_pipeline.run(spark, sf).count() == counts[5]


@pytest.mark.parametrize("table", ["edge", "none"])
def test_pipeline_on_odd_tables(spark, sf, table, request):
    docs = request.getfixturevalue(table)
    for _, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, sf))
    assert "sequence_id" in docs.columns
