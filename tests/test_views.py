import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline import config
from plumbline.operators import graph, views


def test_settings(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("# x\nexport A=1\nB='two'\nC=maybe\n")
    s = config.settings(str(tmp_path / ".env"))
    monkeypatch.setenv("B", "three")
    assert (s.number("A", 5), s.text("B"), s.flag("A"), s.flag("C", True), s.number("Z", 2)) == (1, "three", True, True, 2)
    assert config.dotenv(str(tmp_path / "none")) == {}


def test_retrieval_layers(spark):
    v = spark.createDataFrame([(1, "doc:a", [1.0, 0.0]), (2, "doc:b", [0.0, 1.0])], "vec_id bigint, doc string, embedding array<double>")
    e = spark.createDataFrame([("doc:a", "apl:1", "implements"), ("doc:c", "apl:1", "implements")], "source string, target string, relationship_type string")
    got = {(r.id, r.layer, r.hops) for r in views.retrieve(v, e, [1.0, 0.1], "doc", 1).collect()}
    assert got == {("doc:a", "seed", 0), ("apl:1", "graph", 1), ("doc:c", "graph", 2)}


def test_small_world_report(spark):
    ring = [(f"{min(a, b):03d}", f"{max(a, b):03d}") for a in range(30) for b in ((a + 1) % 30, (a + 2) % 30)]
    r = views.small_world(spark.createDataFrame(ring, "a string, b string"), spark, 2)
    assert r["reach"] == 1.0 and r["clustering"] == pytest.approx(0.5) and r["sigma"] > 1 and r["components"] == 1


def test_small_world_unmeasured(spark):
    ring = [(f"{min(a, b):02d}", f"{max(a, b):02d}") for a in range(8) for b in ((a + 1) % 8, (a + 2) % 8)]
    r = views.small_world(spark.createDataFrame(ring, "a string, b string").coalesce(1), spark, 1, most_pairs=5)
    assert r["sigma"] is None and r["verdict"] == "not measured"


def test_graph_files(spark, tmp_path):
    n = spark.createDataFrame([("plan:a", "plan", "a", "A"), ("doc:1", "document", "a", "one"), ("apl:1", "apl", "state", "APL 31-407: Rides (supersedes one)"), ("apl:2", "apl", "state", "L2")], "id string, kind string, plan_id string, label string")
    e = spark.createDataFrame([("doc:1", "apl:1", "implements", 1.0), ("apl:2", "apl:1", "supersedes", 3.0)], "source string, target string, relationship_type string, weight double")
    views.write_graph(n, e, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "edges")).where("relationship_type = 'supersedes'").count() == 1
    views.write_currency(graph.citation_status(n, e), n, str(tmp_path))
    assert spark.read.csv(str(tmp_path / "by_letter"), header=True).first()["subject"] == "Rides"
    assert {r.part for r in views.graph_view(n, e).collect()} == {"counts", "plans", "chains", "reach"}
    chains = graph.longest_chains(e.where("relationship_type = 'supersedes'"))
    assert views.chains_of(chains, F.lit("26-407"), 2020, 2030).count() == 1


def test_ask(spark):
    chunks = spark.createDataFrame([("c1", "APL 31-407", 6, "timetables are posted where drivers rest " * 8)], "chunk_id string, policy_number string, page int, text string")
    log = []
    assert views.ask("should we grant the ride?", chunks, lambda q, p: "", log.append)["refused"]
    r = views.ask("Where are timetables posted?", chunks, lambda q, p: "APL 31-407 page 6, and page 9", log.append)
    assert r["unverified"] == 1 and not r["uncited"] and [x["event_type"] for x in log][-1] == "assistance.answered"


def test_intake_and_reading(spark):
    t = dt.datetime(2024, 1, 1)
    events = spark.createDataFrame([("a", "case.created", t)], "case_id string, event_type string, occurred_at timestamp")
    cases = spark.createDataFrame([("a", 5.0, 1, 2.0, 0), ("b", 5.0, 1, 2.0, 0)], "case_id string, complexity double, expedited int, tenure double, sdoh int")
    payload = {r.case_id: r.payload for r in views.intake(cases, events).collect()}
    assert '"backlog":1' in payload["a"] and '"backlog":0' in payload["b"]
    assert "withheld" in views.interpretation({"withheld": True, "ready": {"message": "too few cases"}})
    m = {"estimate": -9.0, "low": -12.0, "high": -6.0, "p": 0.01, "worst": 0.04, "n": 80, "n_unmatched": 2, "caliper": 0.2, "mahalanobis": True, "replacement": True, "covariates": ["tenure"]}
    text = views.interpretation({"naive": 10.0, "ready": {"cases": 90}, "estimates": {"psm": m, "did": {**m, "estimate": -8.0}}}, true_effect=-9.0)
    assert "other sign" in text and "with replacement" in text and "Difference in differences" in text and "is within" in text
