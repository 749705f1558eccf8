import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import queries_more
from plumbline.operators import causal
from plumbline.plans import contract, dag
from plumbline.queries import DAG

COVARIATES = ["complexity", "expedited", "backlog", "tenure"]


@pytest.fixture(scope="module")
def history(spark):
    return causal.simulated_history(spark, 900).persist()


def test_known_truth(history):
    naive = causal.naive_effect(history, "hours_to_resolution", "assisted").first().effect
    r = causal.iptw(history, "hours_to_resolution", "assisted", COVARIATES)
    m = causal.psm(history, "hours_to_resolution", "assisted", COVARIATES, "case_id")
    assert naive > 5
    assert abs(r["estimate"] + 9) < 12 and r["low"] < r["estimate"] < r["high"]
    assert m["low"] < -9 < m["high"] and m["worst"] < 0.3 and m["n_treated"] + m["n_unmatched"] > 0


def test_logistic_equals_newton(history):
    rows = history.select("assisted", *COVARIATES).collect()
    x = np.array([[1.0, *r[1:]] for r in rows], float)
    y = np.array([r[0] for r in rows], float)
    b = np.zeros(5)
    for _ in range(40):
        p = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p))
    assert np.allclose(causal.logistic(history, "assisted", COVARIATES), b, atol=1e-6)


def test_cluster_errors(history):
    rows = history.select("hours_to_resolution", "assisted", "operator").collect()
    x, y, g = np.array([[1.0, r[1]] for r in rows]), np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
    inv = np.linalg.inv(x.T @ x)
    b = inv @ x.T @ y
    s = np.array([(x[g == k] * (y - x @ b)[g == k, None]).sum(axis=0) for k in np.unique(g)])
    n, k = len(y), len(s)
    want = np.sqrt(np.diag(inv @ s.T @ s @ inv) * (k / (k - 1)) * ((n - 1) / (n - 2)))
    fit = causal.least_squares(history, "hours_to_resolution", {"assisted": F.col("assisted")}, cluster="operator")
    assert np.allclose([fit["coef"]["intercept"], fit["coef"]["assisted"]], b) and np.allclose(list(fit["se"].values()), want)


def test_panel(history):
    assert causal.did(history.drop("adopter"), "hours_to_resolution") is None
    assert causal.did(history.where("post = 1"), "hours_to_resolution") is None
    assert causal.did(history, "hours_to_resolution", COVARIATES)["se"] > 0


def test_matching(spark):
    df = spark.createDataFrame([(1, 1, 0.50), (2, 1, 0.52), (3, 0, 0.51), (4, 0, 0.56), (5, 0, 0.10)], "id int, t int, propensity double")
    again = {r.treated: r.control for r in causal.matched_with_replacement(df, "t", "id", caliper=0.5).collect()}
    once = {r.treated: r.control for r in causal.matched_without_replacement(df, "t", "id", caliper=0.5).collect()}
    assert again == {1: 3, 2: 3} and sorted(once.values()) == [3, 4]


@pytest.mark.parametrize("ranges", [1, 5, 64])
def test_nearest_equals_brute_force(spark, ranges):
    rng = np.random.default_rng(ranges)
    rows = [(i, int(rng.random() < 0.4), round(float(rng.random()), 2)) for i in range(300)]  # many ties
    df = spark.createDataFrame(rows, "id int, t int, s double")
    got = {(r.treated, r.control, round(r.gap, 9)) for r in causal._nearest(df, "t", "id", "s", 0.05, ranges).collect()}
    want = set()
    for i, t, s in rows:
        if t:
            gap, c = min((abs(s - x), k) for k, u, x in rows if not u)
            if gap <= 0.05:
                want.add((i, c, round(gap, 9)))
    assert got == want


def test_nearest_without_an_arm(spark):
    df = spark.createDataFrame([(1, 1, 0.5)], "id int, t int, s double")
    assert causal._nearest(df, "t", "id", "s", 1.0, 4).count() == 0
    assert causal._nearest(df.limit(0), "t", "id", "s", 1.0, 4).count() == 0


def test_mahalanobis_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(causal, "SIDE", 16)
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.random() < 0.5), float(rng.random()), float(rng.normal()), float(rng.normal() * 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, t int, propensity double, a double, b double")
    got = {(r.treated, r.control) for r in causal.matched_with_replacement(df, "t", "id", caliper=0.3, mahalanobis=["a", "b"]).collect()}
    x = np.array([r[3:] for r in rows])
    inv = np.linalg.inv(np.cov(x.T))
    width = 0.3 * np.std([r[2] for r in rows], ddof=1)
    want = set()
    for i, t, s, *_ in rows:
        near = [((x[i] - x[k]) @ inv @ (x[i] - x[k]), k) for k, u, p, *_ in rows if not u and abs(p - s) <= width]
        if t and near:
            want.add((i, min(near)[1]))
    assert got == want


def test_parted_arms_do_not_converge(spark):
    df = spark.createDataFrame([(i, int(i > 10), float(i)) for i in range(20)], "id int, t int, a double")
    with pytest.raises(ValueError, match="converge"):
        causal.logistic(df, "t", ["a"], steps=8)


@pytest.mark.parametrize("few", [3, 10_000])
def test_quantiles_equal_numpy(spark, monkeypatch, few):
    monkeypatch.setattr(causal, "FEW", few)
    rng = np.random.default_rng(few)
    for x in (rng.normal(size=500), np.repeat([1.0, 1e9, -3.0], [200, 5, 40]), np.full(30, 7.0), np.array([2.0])):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
        assert np.allclose(causal.quantiles(df, "x", [0, 0.01, 0.5, 0.99, 1]), np.quantile(x, [0, 0.01, 0.5, 0.99, 1]))
    assert causal.quantiles(df.where("x is null"), "x", [0.5]) == [None]


def test_overlap_failure(history):
    bad = history.withColumn("assisted", (F.col("complexity") > 5).cast("int")).persist()
    scored = causal.with_propensity(bad, "assisted", ["backlog"])
    assert causal.overlap(scored, "assisted").first().outside >= 0
    sharp = bad.withColumn("propensity", F.when(F.col("assisted") == 1, 0.95).otherwise(0.05))
    assert not causal.overlap(sharp, "assisted").first().ok


def test_diagram():
    assert dag.adjustment_set(DAG, "assisted", "hours") == ("complexity", "expedited", "backlog", "tenure", "sdoh")
    assert len(dag.backdoor_paths(DAG, "assisted", "hours")) == 5
    assert dag.adjustment_set((("x", "c"), ("y", "c")), "x", "y") == ()
    check = dag.model_check(DAG, "assisted", "hours", ["complexity", "citation"])
    assert check["mediators"] == ["citation"] and not check["ok"] and "sdoh" in check["missing"]
    assert dag.roles(DAG, "assisted", "hours")["citation"] == "mediator"


def test_roi():
    r = causal.roi(-14.5, 2.0, 4200, 62, 90000)
    assert r["saved"] == (-2.0, 14.5) or r["saved"] == [-2.0, 14.5]
    assert r["crosses_zero"] and r["break_even"] == pytest.approx(90000 / (4200 * 62))


def test_contracts(tmp_path):
    p = tmp_path / "c.yml"
    p.write_text("contract: x\n")
    with pytest.raises(ValueError, match="lacks"):
        contract.load_contract(str(p))
    p.write_text("plans:\n- {plan_id: a, name: A, domain: d, tier: 1, fetcher: site}\n- {plan_id: a, name: A, domain: d, tier: 1, fetcher: site}\n")
    with pytest.raises(ValueError, match="duplicate"):
        contract.load_registry(str(p))
    p.write_text("plans:\n- {plan_id: a, name: A, domain: d, tier: 1, fetcher: site}\n- {plan_id: b, name: B, domain: d, tier: 1, fetcher: fax}\n")
    reg = contract.load_registry(str(p))
    assert set(contract.fetchable(reg, {"site"})) == {"a"}
    for named in (["b"], ["zz"]):
        with pytest.raises(ValueError):
            contract.fetchable(reg, {"site"}, named)
    assert contract.preconditions(0.05, 2)["met"] and contract.preconditions(0.2, 9)["failed"] == ["balance", "overlap"]


def test_analysis_is_withheld(history):
    costs = {"cases": 4200, "rate": 62, "cost": 90000}
    run = lambda df: contract.run_analysis(df.withColumn("hours", F.col("hours_to_resolution")), DAG, "hours", "assisted", "case_id", ["case_id", "operator"], costs, -9.0, calipers=(0.25,))
    assert run(history.limit(5))["withheld"]
    assert "preconditions" in run(history)


def test_cases_from_a_cohort(spark):
    rows = [(f"m{i}", i % 7, i % 5, i % 2, int(i % 6 == 0)) for i in range(60)]
    cohort = spark.createDataFrame(rows, "member_id string, conditions int, encounters int, sdoh_flags int, urgent_condition int")
    df = causal.simulated_from_cohort(cohort, 500)
    r = df.agg(F.count("*").alias("n"), F.countDistinct("member_id").alias("m"), F.avg("assisted").alias("a"), F.min("hours_to_resolution").alias("h")).first()
    assert r.n == 500 and r.m > 40 and 0.02 < r.a < 0.9 and r.h >= 2
    with pytest.raises(ValueError, match="empty"):
        causal.simulated_from_cohort(cohort.where("conditions > 99"), 5)


@pytest.mark.parametrize("near", [None, ["a", "b"]])
def test_rounds_of_few_equal_rounds_of_spark(spark, monkeypatch, near):
    rng = np.random.default_rng(2)
    rows = [(int(i), int(rng.random() < 0.45), round(float(rng.random()), 2), round(float(rng.normal()), 1), float(rng.integers(3))) for i in rng.permutation(150)]  # many ties, scarce controls
    df = spark.createDataFrame(rows, "id int, t int, propensity double, a double, b double")
    match = lambda: {tuple(r) for r in causal.matched_without_replacement(df, "t", "id", caliper=0.4, mahalanobis=near).select("treated", "control", F.round("gap", 9)).collect()}
    jobs, few = [], causal.settle
    monkeypatch.setattr(causal, "settle", lambda *a: (jobs.append(1), few(*a))[1])
    found, settled = match(), len(jobs)
    monkeypatch.setattr(causal, "EACH", -1)
    assert found == match() and len(found) > 20 and settled == 1 < len(jobs) - settled  # EACH rows take one group, however many rounds


def test_rounds_by_distance_look_again(monkeypatch):
    rng = np.random.default_rng(3)
    arms = [rng.random(120), rng.integers(0, 5, (120, 2)).astype(float), rng.random(60), rng.integers(0, 5, (60, 2)).astype(float)]
    want = [x.tolist() for x in causal._rounds_by_distance(*arms, 0.4)]
    monkeypatch.setattr(causal, "NEAREST", 3)
    assert [x.tolist() for x in causal._rounds_by_distance(*arms, 0.4)] == want and len(want[0]) > 30


@pytest.mark.parametrize("digits", [12, 1])
@pytest.mark.parametrize("by_score", [True, False])
def test_rows_alike_go_through_rounds_together(monkeypatch, digits, by_score):
    rng, copies, rounds, winners = np.random.default_rng(5), 9, [], causal._winners
    monkeypatch.setattr(causal, "LEAF", 16)
    monkeypatch.setattr(causal, "NEAREST", 4)
    monkeypatch.setattr(causal, "_winners", lambda *a: (rounds.append(1), winners(*a))[1])
    one = [np.round(rng.random(s), digits) for s in (40, (40, 2), 24, (24, 2))]
    for arms in (one, [np.concatenate([x] * copies) for x in one]):
        ts, tx, cs, cx = arms
        got = causal._rounds_by_score(ts, cs, 0.3) if by_score else causal._rounds_by_distance(*arms, 0.3)
        rounds.append(0)
        apart = np.abs(ts[:, None] - cs[None])
        far = np.where(apart <= 0.3, apart if by_score else np.sqrt(((tx[:, None] - cx[None]) ** 2).sum(axis=2)), np.inf)
        want, left, free = set(), list(range(len(ts))), np.ones(len(cs), bool)
        while True:
            named = {}
            for t in left:
                d = np.where(free, far[t], np.inf)
                if np.isfinite(d.min()):
                    named.setdefault(int(d.argmin()), []).append((float(d.min()), t))
            if not named:
                break
            for c, names in named.items():
                gap, t = min(names)
                want.add((t, c, gap))
                left.remove(t)
                free[c] = False
        assert set(zip(*[x.tolist() for x in got])) == want and len(want) > 20
    at = rounds.index(0)
    if digits > 1:  # places apart: as many rounds for all copies as for one
        assert sum(rounds[:at]) == sum(rounds[at:])


def test_rounds_of_many_rows_are_one_group(spark, monkeypatch):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, int(rng.random() < 0.45), float(rng.random())) for i in range(150)], "id int, t int, propensity double")
    jobs, settle = [], causal.settle
    monkeypatch.setattr(causal, "settle", lambda *a: (jobs.append(1), settle(*a))[1])
    want = {tuple(r) for r in causal.matched_without_replacement(df, "t", "id", caliper=0.4).collect()}
    monkeypatch.setattr(causal, "EACH", 10)
    assert {tuple(r) for r in causal.matched_without_replacement(df, "t", "id", caliper=0.4).collect()} == want and len(jobs) == 2


def test_the_query_tries_all_calipers(spark, sf, monkeypatch):
    tried = []
    for name in ("matched_with_replacement", "matched_without_replacement"):
        match = getattr(causal, name)
        monkeypatch.setattr(causal, name, lambda *a, match=match, **k: (tried.append((k["mahalanobis"] is not None, k["caliper"])), match(*a, **k))[1])
    assert queries_more.psm(spark, sf).first().n > 0
    assert sorted(tried) == sorted((far, c) for far in (False, True) for c in (0.5, 0.25, 0.2, 0.1, 0.05))
