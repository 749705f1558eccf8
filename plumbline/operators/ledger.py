"""The event ledger: digests, verification, operative events, gates, independence, backlog, cases."""

from __future__ import annotations

import hashlib
import json
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..files import Taken, put
from ..functions.text import clock_seconds, iso_ms, tolerant_number
from ..session import settle, small
from .causal import quantiles

# The fields of a digest in their order, and the events that count.
FIELDS = [
    "prev_hash", "event_id", "case_id", "subject_ref", "occurred_at_iso", "actor", "actor_kind", "event_type", "gate_id",
    "rationale", "authority", "framework_version", "payload", "supersedes",
]
CONSEQUENTIAL = ["operator.confirmed", "gate.answered", "disposition.recorded", "notice.issued", "correction.recorded"]
INDEPENDENT = ["disposition.recorded", "gate.answered"]
GATES = [
    ("ACK", "Acknowledge receipt", "5 calendar days"),
    ("RESOLVE_STANDARD", "Resolve the case", "30 calendar days"),
    ("RESOLVE_EXPEDITED", "Resolve the expedited case", "72 hours"),
    ("CLASSIFY", "Classify at intake", "at intake"),
]
LEDGER = (
    "seq bigint, event_id string, case_id string, subject_ref string, occurred_at timestamp, occurred_at_iso string, actor string, actor_kind string, "
    "event_type string, gate_id string, rationale string, authority string, framework_version string, payload string, supersedes string, prev_hash string, hash string"
)


def digest(prev: Column, none: str = "") -> Column:
    """SHA-256 of the fields joined by U+001F; nulls as empty, but ``supersedes`` as ``none`` (older ledgers hashed the text NA)."""
    parts = [F.coalesce(prev, F.lit(""))] + [F.coalesce(F.col(f).cast("string"), F.lit(none if f == "supersedes" else "")) for f in FIELDS[1:]]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def digest_of(event: dict, prev: str, none: str = "") -> str:
    values = [prev] + [event.get(f) if event.get(f) is not None else (none if f == "supersedes" else "") for f in FIELDS[1:]]
    return hashlib.sha256("\x1f".join(map(str, values)).encode()).hexdigest()


class Refused(ValueError):
    """An append that the rules forbid."""


def appended(last: dict | None, event: dict, conflicts: int = 0) -> dict:
    """The next event of a ledger, checked and chained to the last one."""
    kind = event["event_type"]
    if kind in CONSEQUENTIAL:
        if event.get("actor_kind") != "human":
            raise Refused(f"{kind} needs a human actor")
        if not (event.get("rationale") or "").strip():
            raise Refused(f"{kind} needs a rationale")
    if kind in INDEPENDENT and conflicts:
        raise Refused(f"{kind}: the actor isn't independent")
    prev = last["hash"] if last else ""
    e = {"event_id": str(uuid.uuid4()), "payload": "{}", **event, "seq": (last["seq"] if last else 0) + 1, "prev_hash": prev}
    if isinstance(e["payload"], dict):
        e["payload"] = json.dumps(e["payload"])
    return e | {"hash": digest_of(e, prev)}


def violations(events: DataFrame) -> DataFrame:
    """Events that break the guards of appending, with why; for batches that came another way."""
    of = F.col("event_type").isin(CONSEQUENTIAL)
    why = F.when(of & ~F.coalesce(F.col("actor_kind") == "human", F.lit(False)), "machine actor").when(of & (F.trim(F.coalesce("rationale", F.lit(""))) == ""), "no rationale")
    return events.withColumn("why", why).where("why is not null")


def verify(events: DataFrame, none: str = "", by: Column | None = None) -> DataFrame:
    """ok, n, broken_at, why (a row for each ledger): the first event that doesn't chain or whose digest differs.

    Digests are of stored values, so all events are checked at once; only the link to the event
    before needs an order. by: what tells ledgers apart (else all events are one ledger and the
    links are looked up by a join on the number of the event before, not by one global window).
    """
    recomputed = digest(F.col("prev_hash"), none) != F.col("hash")
    if by is not None:
        w = Window.partitionBy(by).orderBy("seq")
        linked = events.withColumn("_g", by).withColumn("_prev", F.lag("hash", 1, "").over(w))
    else:
        rank = numbered(events, "seq")
        before = rank.select((F.col("_n") + 1).alias("_n"), F.col("hash").alias("_prev"))
        linked = rank.join(before, "_n", "left").withColumn("_prev", F.coalesce("_prev", F.lit(""))).withColumn("_g", F.lit(0))
    why = F.when(F.col("prev_hash") != F.col("_prev"), "link").when(recomputed, "digest")
    bad = linked.withColumn("_why", why)
    first = F.min(F.when(F.col("_why").isNotNull(), F.struct("seq", "_why")))
    return bad.groupBy("_g").agg(F.count("*").alias("n"), first.alias("f")).select(F.col("_g").alias("ledger"), F.col("f").isNull().alias("ok"), "n", F.col("f.seq").alias("broken_at"), F.col("f._why").alias("why"))


def numbered(df: DataFrame, order: str, each: int = 100_000) -> DataFrame:
    """_n: consecutive numbers in an order, without a global window: numbers within ranges, plus what the ranges before hold."""
    r = df.withColumn("_r", F.floor(F.col(order) / each))
    sizes = r.groupBy("_r").agg(F.count("*").alias("_c"))
    starts = sizes.withColumn("_s", F.sum("_c").over(Window.orderBy("_r")) - F.col("_c")).drop("_c")  # a row for each range
    within = r.withColumn("_k", F.row_number().over(Window.partitionBy("_r").orderBy(order)))
    return within.join(starts, "_r").withColumn("_n", F.col("_s") + F.col("_k")).drop("_r", "_s", "_k")


def current(events: DataFrame) -> DataFrame:
    """Events that no event supersedes."""
    gone = events.where("supersedes is not null and supersedes <> ''").select(F.col("supersedes").alias("event_id")).distinct()
    return events.join(gone, "event_id", "left_anti")


def gates(spark) -> DataFrame:
    g = spark.createDataFrame(GATES, "gate_id string, obligation string, clock string")
    return g.withColumn("seconds", clock_seconds(F.col("clock")))


def gate_status(cases: DataFrame, gate: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """case_id, gate_id, due, remaining, status. cases: case_id, received, expedited. Operative events answer gates."""
    each = cases.crossJoin(F.broadcast(gate)).where(F.col("gate_id") != F.when(F.col("expedited"), "RESOLVE_STANDARD").otherwise("RESOLVE_EXPEDITED"))  # four gates
    met = current(events).where(F.col("event_type").isin("gate.answered", "disposition.recorded") & F.col("gate_id").isNotNull()).select("case_id", "gate_id").distinct().withColumn("met", F.lit(True))
    out = each.join(met, ["case_id", "gate_id"], "left").withColumn("met", F.coalesce("met", F.lit(False)))
    due = F.timestamp_micros(F.unix_micros("received") + (F.coalesce("seconds", F.lit(0.0)) * 1e6).cast("bigint"))
    left = F.when(F.col("seconds").isNotNull(), (F.unix_micros(due) - F.unix_micros(now)) / 3.6e9)
    status = F.when(F.col("met"), "met").when(F.col("seconds").isNull(), "open").when(left < 0, "breached").when(left < 24, "due soon").otherwise("open")
    return out.select("case_id", "gate_id", due.alias("due"), left.alias("remaining"), status.alias("status"), F.col("seconds").isNull().alias("clockless")).orderBy("case_id", "clockless", "due", "gate_id")


def case_status(status: DataFrame) -> DataFrame:
    """The gravest status of each case."""
    rank = F.when(F.col("status") == "breached", 3).when(F.col("status") == "due soon", 2).when(F.col("status") == "met", 0).otherwise(1)
    top = status.groupBy("case_id").agg(F.max(rank).alias("r"))
    return top.select("case_id", F.element_at(F.array(*map(F.lit, ["all met", "open", "due soon", "breached"])), F.col("r") + 1).alias("status"))


def supervisors(reports_to: DataFrame, most: int = 12) -> DataFrame:
    """person, above, hops: everybody over a person, at most ``most`` steps; a cycle ends at the person. reports_to: person, boss."""
    out, reach = reports_to.select("person", F.col("boss").alias("above"), F.lit(1).alias("hops")).distinct(), 1
    while reach < most:  # each round doubles how far is seen
        a, b = out.alias("a"), small(out).alias("b")
        far = a.join(b, F.col("a.above") == F.col("b.person")).select("a.person", "b.above", (F.col("a.hops") + F.col("b.hops")).alias("hops")).where((F.col("hops") <= most) & (F.col("person") != F.col("above")))
        out, reach = settle(out.unionByName(far).groupBy("person", "above").agg(F.min("hops").alias("hops"))), reach * 2
    return out


def conflicts(requests: DataFrame, events: DataFrame, above: DataFrame) -> DataFrame:
    """case_id, actor, event_id, why: decisions that disqualify an actor from a case.

    requests: case_id, actor, subject_ref. Attested decisions count on the same case or subject,
    determinations only on another case of the same subject; without a subject only attested
    ones on the case. It conflicts if the actor, or anyone above, made it.
    """
    out = _met(requests.select("case_id", "subject_ref", "actor"), events, above, "actor")
    why = F.when(F.col("actor") == F.col("by"), "actor made this determination").otherwise(F.concat(F.lit("actor reports (directly or indirectly) to "), F.col("by")))
    return out.select("case_id", "actor", "event_id", why.alias("why"))


def conflicting(requests: DataFrame, events: DataFrame, above: DataFrame) -> DataFrame:
    """case_id, event_id of all conflicts(), once each, whoever the actors are. An event_id is one event's; what comes out may be as many rows as cases times events, and isn't shuffled."""
    return _met(requests.select("case_id", "subject_ref", "actor"), events, above).select("case_id", "event_id")


def _met(requests: DataFrame, events: DataFrame, above: DataFrame, *kept: str) -> DataFrame:
    """Requests beside the events that disqualify them, once each: who made an event is part of the join's keys, so only conflicts come out of it."""
    e = events.select("event_id", F.col("case_id").alias("on_case"), F.col("subject_ref").alias("on_subject"), F.col("actor").alias("by"), "event_type").distinct()
    over = above.select(F.col("person").alias("actor"), F.col("above").alias("by")).distinct()
    asked = requests.select("case_id", "subject_ref", "actor", F.col("actor").alias("by")).unionByName(requests.join(over, "actor").select("case_id", "subject_ref", "actor", "by"))
    has = F.length(F.coalesce("subject_ref", F.lit(""))) > 0
    attested, here = F.col("event_type") == "prior_decision.attested", F.coalesce(F.col("on_case") == F.col("case_id"), F.lit(False))
    on_case = asked.select("case_id", "by", *kept).distinct().join(e.where(attested).withColumnRenamed("on_case", "case_id"), ["case_id", "by"])
    on_subject = asked.where(has).select("case_id", F.col("subject_ref").alias("on_subject"), "by", *kept).distinct()
    on_subject = on_subject.join(e.where(attested | F.col("event_type").isin(INDEPENDENT)), ["on_subject", "by"]).where(F.when(attested, ~here).otherwise(F.col("on_case") != F.col("case_id")))
    columns = ["case_id", "by", *kept, "event_id"]
    return on_case.select(*columns).unionByName(on_subject.select(*columns))


def independence(requests: DataFrame, found: DataFrame, chart_loaded: bool = True) -> DataFrame:
    """case_id, actor, clear, statement."""
    why = found.groupBy("case_id", "actor").agg(F.concat_ws("; ", F.array_sort(F.collect_set("why"))).alias("why"))
    ok = "Independent: no prior determination by this actor or anyone they report to" if chart_loaded else "No conflicting prior determination on record; reporting lines not configured, so subordinate status was not evaluated"
    out = requests.select("case_id", "actor").distinct().join(why, ["case_id", "actor"], "left")
    return out.select("case_id", "actor", F.col("why").isNull().alias("clear"), F.coalesce(F.concat(F.lit("Not independent: "), F.col("why")), F.lit(ok)).alias("statement"))


def backlog(events: DataFrame, bucket: str = "day") -> DataFrame:
    """at, opened, closed, open: cases in the queue at the end of each bucket.

    A case opens with its first event of creation and closes with its first disposition. Sums
    by bucket come first; the running sum is over buckets, never over events.
    """
    first = events.groupBy("case_id").agg(F.min(F.when(F.col("event_type") == "case.created", F.col("occurred_at"))).alias("o"), F.min(F.when(F.col("event_type") == "disposition.recorded", F.col("occurred_at"))).alias("c")).where("o is not null")
    moves = first.select(F.explode(F.array(F.struct(F.col("o").alias("t"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.greatest("o", "c").alias("t"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("m"), "c")
    moves = moves.where("m.up = 1 or c is not null").select(F.date_trunc(bucket, "m.t").alias("at"), "m.up", "m.down")
    sums = moves.groupBy("at").agg(F.sum("up").alias("opened"), F.sum("down").alias("closed"))
    return sums.withColumn("open", F.sum(F.col("opened") - F.col("closed")).over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def case_outcomes(events: DataFrame) -> DataFrame:
    """One row a case: opened_at, first disposition, assisted (ever, and before it), resolved, hours, value of the opening's payload."""
    first = lambda kind, what: F.min(F.when(F.col("event_type") == kind, what))
    at = F.col("occurred_at")
    opening = F.min(F.when(F.col("event_type") == "case.created", F.struct("seq", "payload")))
    g = events.groupBy("case_id").agg(
        first("case.created", at).alias("opened_at"), first("disposition.recorded", at).alias("disposed_at"), first("assistance.requested", at).alias("assisted_at"), opening.alias("opening"),
    ).where("opened_at is not null")
    hours = (F.unix_micros("disposed_at") - F.unix_micros("opened_at")) / 3.6e9
    return g.select(
        "case_id", "opened_at", F.col("assisted_at").isNotNull().cast("int").alias("assisted_any"),
        F.coalesce(F.col("assisted_at") < F.col("disposed_at"), F.lit(False)).cast("int").alias("assisted_before"),
        F.col("disposed_at").isNotNull().cast("int").alias("resolved"), hours.alias("hours_to_resolution"), tolerant_number(F.col("opening.payload"), "$.k").alias("k"),
    )


def rollout_panel(cases: DataFrame, events: DataFrame, actor: str = "actor") -> DataFrame:
    """cases (case_id, actor, opened_at) with adopter and post: the actor's first use, or for others the median first use, came before."""
    used = events.where("event_type = 'assistance.requested'").groupBy(F.col(actor).alias("_a")).agg(F.min("occurred_at").alias("first_use"))
    used = settle(used, "used")
    middle = quantiles(used.select(F.unix_micros("first_use").alias("t")), "t", [0.5])[0]
    common = F.timestamp_micros(F.lit(None if middle is None else int(middle)).cast("bigint"))
    out = cases.join(used, F.col(actor) == F.col("_a"), "left").withColumn("common", common).drop("_a")
    return out.withColumn("adopter", F.col("first_use").isNotNull().cast("int")).withColumn("post", F.coalesce(F.col("opened_at") >= F.col("common"), F.lit(False)).cast("int"))


def readiness(cases: DataFrame, required: list[str], known_limits: list[str] = (), least_cases: int = 30, least_actors: int = 10, actor: str = "operator") -> dict:
    """satisfiable, defects, limits, cases, actors and the message of highest priority."""
    have = [c for c in required if c in cases.columns]
    row = cases.agg(F.count("*").alias("_n"), *([F.countDistinct(actor).alias("_a")] if actor in cases.columns else []), *[F.count(c).alias(f"_c_{c}") for c in have]).first()
    missing = [c for c in required if c not in have]
    empty = [c for c in have if row["_n"] and not row[f"_c_{c}"]]
    bad = missing + empty
    defects, limits = [c for c in bad if c not in known_limits], [c for c in bad if c in known_limits]
    actors = row["_a"] if actor in cases.columns else 0
    if defects:
        message = "defects: " + ", ".join(defects)
    elif limits:
        message = "known limits: " + ", ".join(limits)
    elif row["_n"] < least_cases:
        message = f"too few cases: {row['_n']} of {least_cases}"
    elif actors < least_actors:
        message = f"too few operators: {actors} of {least_actors}"
    else:
        message = "satisfiable"
    return {"satisfiable": message == "satisfiable", "defects": defects, "limits": limits, "cases": row["_n"], "actors": actors, "message": message}


def chained(events: DataFrame, by: str, none: str = "") -> DataFrame:
    """events (FIELDS but prev_hash, and seq) with prev_hash and hash: a chain for each value of ``by``, in the order of seq.

    A chain is a fold over its events, so each is made in one task, event by event as they come in order: a ledger's length takes time there but no memory.
    """
    body = F.concat_ws("\x1f", *[F.coalesce(F.col(f).cast("string"), F.lit(none if f == "supersedes" else "")) for f in FIELDS[1:]])
    rows = events.select("seq", *[c for c in events.columns if c not in ("seq", "prev_hash", "hash")]).withColumn("_body", body).repartition(by).sortWithinPartitions(by, "seq")
    shape = T.StructType([*rows.drop("_body").schema.fields, T.StructField("prev_hash", T.StringType()), T.StructField("hash", T.StringType())])

    def run(batches):
        last, prev = object(), ""
        for b in batches:
            before, after = [], []
            for key, text in zip(b.column(b.schema.get_field_index(by)).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                prev = prev if key == last else ""
                before.append(prev)
                last, prev = key, hashlib.sha256(f"{prev}\x1f{text}".encode()).hexdigest()
                after.append(prev)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(before, pa.string()), pa.array(after, pa.string())], names=[*b.schema.names[:-1], "prev_hash", "hash"])

    return rows.mapInArrow(run, shape)


class Ledger:
    """A durable ledger in a folder that all its users share: one file an event, which appears whole under its number, and only if no other writer took that."""

    EACH = 1000  # events in a folder

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._at(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at(path))

    def _at(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def last(self) -> dict | None:
        """The newest event; only the newest folders are listed. An empty file, left by a writer that died before files were renamed, is no event and is removed."""
        for folder in sorted((x.getPath().getName() for x in self._fs.listStatus(self._at(self.path))), reverse=True):
            for f in sorted(self._fs.listStatus(self._at(f"{self.path}/{folder}")), key=lambda x: x.getPath().getName(), reverse=True):
                if f.getLen():
                    return json.loads(self.spark.read.text(f.getPath().toString(), wholetext=True).first()[0])
                self._fs.delete(f.getPath(), False)
        return None

    def append(self, event: dict, conflicts: int = 0, tries: int = 5) -> dict:
        """Checks, chains and writes an event; if another writer was faster it is chained anew to what that one wrote."""
        for _ in range(tries):
            e = appended(self.last(), event, conflicts)
            try:
                put(self.spark, json.dumps(e, default=lambda t: t.isoformat()), f"{self.path}/{e['seq'] // self.EACH:09d}/{e['seq']:012d}.json", f"{self.path}.aside")
            except Taken:
                continue
            return e
        raise Refused("no number was free")

    def events(self, case_id: str | None = None) -> DataFrame:
        """All events in order, or those of one case."""
        e = self.spark.read.schema(LEDGER).option("recursiveFileLookup", "true").json(self.path)
        return (e if case_id is None else e.where(F.col("case_id") == case_id)).orderBy("seq")


def queue_at_arrival(events: DataFrame) -> DataFrame:
    """case_id, opened_at, queue: cases open when each arrived, itself among them, less those disposed of by then. Sums by day first, then within a day."""
    first = events.groupBy("case_id").agg(F.min(F.when(F.col("event_type") == "case.created", F.col("occurred_at"))).alias("o"), F.min(F.when(F.col("event_type") == "disposition.recorded", F.col("occurred_at"))).alias("c")).where("o is not null")
    up = first.select("case_id", F.col("o").alias("t"), F.lit(1).alias("d"))
    down = first.where("c is not null").select("case_id", F.greatest("o", "c").alias("t"), F.lit(-1).alias("d"))
    moves = up.unionByName(down).withColumn("day", F.to_date("t"))
    days = moves.groupBy("day").agg(F.sum("d").alias("n"))
    before = days.withColumn("before", F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).drop("n")  # a row a day
    within = F.sum("d").over(Window.partitionBy("day").orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return moves.withColumn("w", within).where("d = 1").join(before, "day").select("case_id", F.col("t").alias("opened_at"), (F.col("before") + F.col("w")).cast("bigint").alias("queue"))


def arrival_fraction(cases: DataFrame, at: str = "opened_at") -> DataFrame:
    """cases with ``fraction``: how far into the whole span each arrived, from 0 to 1."""
    us = F.unix_micros(at)
    span = cases.agg(F.min(us).alias("_lo"), F.max(us).alias("_hi"))
    return cases.crossJoin(F.broadcast(span)).withColumn("fraction", (us - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0))).drop("_lo", "_hi")  # one row


def prior_decisions(events: DataFrame) -> DataFrame:
    """case_id, event_id, actor, occurred_at of attested prior decisions, for display."""
    return current(events).where("event_type = 'prior_decision.attested'").select("case_id", "event_id", "actor", "occurred_at")


def open_gates(status: DataFrame) -> DataFrame:
    """Gates still to be answered: neither met nor the classification."""
    return status.where("status <> 'met' and gate_id <> 'CLASSIFY'")


def classified(events: DataFrame) -> DataFrame:
    """case_id of cases whose classification an operator has confirmed."""
    return current(events).where("event_type = 'operator.confirmed' and gate_id = 'CLASSIFY'").select("case_id").distinct()


def with_iso(events: DataFrame) -> DataFrame:
    return events.withColumn("occurred_at_iso", iso_ms(F.col("occurred_at")))
