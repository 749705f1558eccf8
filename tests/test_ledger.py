import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import ledger

T0 = dt.datetime(2024, 1, 1)


def event(kind, case="c1", actor="n", kind_of="human", why="because", **more):
    return {"case_id": case, "event_type": kind, "actor": actor, "actor_kind": kind_of, "rationale": why, "occurred_at": T0, "occurred_at_iso": "2024-01-01T00:00:00.000", **more}


def chain(*events):
    out = []
    for e in events:
        out.append(ledger.appended(out[-1] if out else None, e))
    return out


def frame(spark, rows):
    names = [c.split()[0] for c in ledger.LEDGER.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ledger.LEDGER)


@pytest.mark.parametrize("by", [None, "case_id"])
def test_chain_and_tampering(spark, by):
    rows = chain(event("case.created"), event("evidence.retrieved", kind_of="machine"), event("operator.confirmed"), event("gate.answered", gate_id="ACK"))
    key = F.col(by) if by else None
    r = ledger.verify(frame(spark, rows), by=key).first()
    assert (r.ok, r.n, r.broken_at) == (True, 4, None)
    rows[2]["payload"] = '{"x": 1}'
    r = ledger.verify(frame(spark, rows), by=key).first()
    assert (r.ok, r.broken_at, r.why) == (False, 3, "digest")
    rows[1]["hash"] = "0"
    r = ledger.verify(frame(spark, rows), by=key).first()
    assert (r.ok, r.broken_at) == (False, 2)


@pytest.mark.parametrize("bad", [{"kind_of": "machine"}, {"why": None}, {"why": "  "}])
def test_guards(spark, bad):
    with pytest.raises(ledger.Refused):
        ledger.appended(None, event("disposition.recorded", **bad))
    rows = [{**event("disposition.recorded", **bad), "seq": 1, "event_id": "e"}]
    assert ledger.violations(frame(spark, rows)).count() == 1
    with pytest.raises(ledger.Refused):
        ledger.appended(None, event("gate.answered"), conflicts=1)


def test_corrections(spark):
    rows = chain(event("case.created", event_id="a"), event("correction.recorded", supersedes="a", event_id="b"))
    assert [r.event_id for r in ledger.current(frame(spark, rows)).collect()] == ["b"]


def test_gates(spark):
    cases = spark.createDataFrame([("c1", T0, False)], "case_id string, received timestamp, expedited boolean")
    now = F.lit("2024-01-11 00:00:00").cast("timestamp")
    get = lambda rows: {r.gate_id: (r.status, r.remaining) for r in ledger.gate_status(cases, ledger.gates(spark), frame(spark, rows), now).collect()}
    got = get(chain(event("case.created")))
    assert got["ACK"][0] == "breached" and got["CLASSIFY"] == ("open", None) and got["RESOLVE_STANDARD"] == ("open", 480.0) and "RESOLVE_EXPEDITED" not in got
    assert get(chain(event("case.created"), event("gate.answered", gate_id="ACK")))["ACK"][0] == "met"


def test_independence(spark):
    chart = spark.createDataFrame([("low", "n"), ("n", "top"), ("other", "top")], "person string, boss string")
    above = ledger.supervisors(chart)
    rows = [{**event("prior_decision.attested", case="c1", subject_ref="s"), "event_id": "p", "seq": 1}, {**event("gate.answered", case="c1", actor="other", subject_ref="s"), "event_id": "own", "seq": 2}]
    asked = spark.createDataFrame([("c1", a, "s") for a in ("n", "low", "top", "other")], "case_id string, actor string, subject_ref string")
    found = ledger.conflicts(asked, frame(spark, rows), above)
    verdict = {r.actor: (r.clear, r.statement) for r in ledger.independence(asked, found).collect()}
    assert {a: v[0] for a, v in verdict.items()} == {"n": False, "low": False, "top": True, "other": True}
    assert "reports (directly or indirectly) to n" in verdict["low"][1]


def test_supervisors_stop_on_cycles(spark):
    chart = spark.createDataFrame([("a", "b"), ("b", "a")], "person string, boss string")
    assert {(r.person, r.above) for r in ledger.supervisors(chart).collect()} == {("a", "b"), ("b", "a")}


def test_numbered_has_no_gaps(spark):
    df = spark.createDataFrame([(5,), (900_000,), (7,), (250_001,)], "seq bigint")
    assert [(r.seq, r._n) for r in ledger.numbered(df, "seq").orderBy("seq").collect()] == [(5, 1), (7, 2), (250_001, 3), (900_000, 4)]


def test_backlog_and_readiness(spark):
    day = lambda n: T0 + dt.timedelta(days=n)
    e = spark.createDataFrame([("a", "case.created", day(0)), ("b", "case.created", day(1)), ("a", "disposition.recorded", day(2))], "case_id string, event_type string, occurred_at timestamp")
    assert [r.open for r in ledger.backlog(e).orderBy("at").collect()] == [1, 2, 1]
    cases = spark.createDataFrame([(f"c{i}", f"o{i % 10}", None) for i in range(40)], "case_id string, operator string, sdoh double")
    assert ledger.readiness(cases, ["case_id", "sdoh"])["message"] == "defects: sdoh"
    assert ledger.readiness(cases, ["case_id", "sdoh"], ["sdoh"])["message"] == "known limits: sdoh"
    assert ledger.readiness(cases.limit(5), ["case_id"])["message"].startswith("too few cases")
    assert ledger.readiness(cases, ["case_id"])["satisfiable"]


def test_two_writers_of_a_durable_ledger(spark, tmp_path):
    one, two = ledger.Ledger(spark, str(tmp_path / "l")), ledger.Ledger(spark, str(tmp_path / "l"))
    assert one.last() is None
    a = one.append(event("case.created"))
    b = two.append(event("evidence.retrieved", case="c2", kind_of="machine"))
    # the first writer still believes its own event to be the last
    last, calls = one.last, []

    def stale():
        calls.append(1)
        return a if len(calls) == 1 else last()

    one.last = stale
    c = one.append(event("operator.confirmed"))
    assert (b["prev_hash"], c["prev_hash"], c["seq"], len(calls)) == (a["hash"], b["hash"], 3, 2)
    assert ledger.verify(two.events()).first()["ok"] and two.events("c2").count() == 1
    with pytest.raises(ledger.Refused):
        one.append(event("disposition.recorded", why=""))


def test_a_file_left_empty_is_no_event(spark, tmp_path):
    """As a writer leaves that dies between making and filling a file."""
    one = ledger.Ledger(spark, str(tmp_path / "l"))
    first = one.append(event("case.created"))
    path = tmp_path / "l" / f"{0:09d}" / f"{first['seq'] + 1:012d}.json"
    path.write_text("")
    second = ledger.Ledger(spark, str(tmp_path / "l")).append(event("case.created"))
    assert second["seq"] == first["seq"] + 1 and second["prev_hash"] == first["hash"]
    assert one.events().count() == 2 and not list((tmp_path / "l.aside").glob("[0-9a-f]*"))


def test_a_number_is_taken_once(spark, tmp_path):
    from plumbline.files import Taken, put

    at = str(tmp_path / "f" / "x.json")
    put(spark, "one", at, str(tmp_path / "aside"))
    with pytest.raises(Taken):
        put(spark, "two", at, str(tmp_path / "aside"))
    assert open(at).read() == "one"
    put(spark, "three", at, str(tmp_path / "aside"), overwrite=True)
    assert open(at).read() == "three"


def test_long_chains_equal_a_fold(spark):
    import hashlib

    rows = [(k, f"c{k % 3}" if k % 7 else None, f"p{k}") for k in range(600)]
    e = spark.createDataFrame(rows, "seq bigint, case_id string, payload string")
    for f in ledger.FIELDS[1:]:
        if f not in e.columns:
            e = e.withColumn(f, F.lit(None).cast("string"))
    got = {r.seq: (r.prev_hash, r.hash) for r in ledger.chained(e.repartition(4), "case_id").collect()}
    last = {}
    for k, c, p in rows:
        body = "\x1f".join({"case_id": c or "", "payload": p}.get(f, "") for f in ledger.FIELDS[1:])
        want = hashlib.sha256(f"{last.get(c, '')}\x1f{body}".encode()).hexdigest()
        assert got[k] == (last.get(c, ""), want)
        last[c] = want


def test_conflicting_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]
    asked = [(pick(1, 2, 3, None), pick("a", "b", "c"), pick("s", "t", "", None)) for _ in range(60)]
    kinds = ("prior_decision.attested", "disposition.recorded", "case.created")
    made = [(f"e{k}", pick(1, 2, 3, 4, None), pick("s", "t", None), pick("a", "b", "c", "boss", None), pick(*kinds)) for k in range(80)]
    over = [("a", "boss"), ("b", "c"), ("b", "boss")]
    want = set()
    for case, actor, subject in asked:
        for e, on_case, on_subject, by, kind in made:
            same, about = case is not None and case == on_case, bool(subject) and subject == on_subject
            other = case is not None and on_case is not None and case != on_case
            met = (same or about) if kind == kinds[0] else about and other and kind in ledger.INDEPENDENT
            if met and (actor == by or (actor, by) in over):
                want.add((case, actor, e))
    a = spark.createDataFrame(asked, "case_id int, actor string, subject_ref string")
    e = spark.createDataFrame(made * 2, "event_id string, case_id int, subject_ref string, actor string, event_type string")
    above = spark.createDataFrame(over, "person string, above string")
    assert sorted(map(str, want)) == sorted(str((r.case_id, r.actor, r.event_id)) for r in ledger.conflicts(a, e, above).collect())
    pairs = ledger.conflicting(a, e, above)
    assert sorted({str((c, x)) for c, _, x in want}) == sorted(str(tuple(r)) for r in pairs.collect())
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "on_subject" in plan and not any("Join" in line and "by" not in line for line in plan.splitlines() if "on_subject" in line)  # each join is on who made it
