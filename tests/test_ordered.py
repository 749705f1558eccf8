"""Chains of a stream whose events come out of order, over many batches."""

import datetime as dt
import random

from pyspark.sql import functions as F

from plumbline.operators import ledger
from plumbline.streaming import events as streams


def test_ledgers_share_states():
    """What is read and written of the state is by group of ledgers, not by ledger; what waits is linked once, in order."""
    import pandas as pd

    calls = []

    class Listed:
        def __init__(self):
            self.rows = []

        def get(self):
            calls.append("get")
            return iter(self.rows)

        def put(self, rows):
            calls.append("put")
            self.rows = list(rows)

        def appendList(self, rows):
            calls.append("append")
            self.rows += rows

        def clear(self):
            calls.append("clear")
            self.rows = []

    class Handle:
        def getListState(self, name, schema):
            return Listed()

        def registerTimer(self, at):
            calls.append("timer")

    class Now:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    links, rows = streams.OrderedLinks(), [(f"c{k % 50}", 1_000_000 * (200 - k), k, f"b{k}") for k in range(200)]
    links.init(Handle())
    frames = iter([pd.DataFrame(rows, columns=["ledger", "us", "seq", "body"])])
    assert list(links.handleInputRows((0,), frames, Now(0))) == []
    got = [r for ms in (100_000, 300_000, 300_000) for f in links.handleExpiredTimer((0,), Now(ms), None) for r in f.itertuples(index=False)]
    assert [r.seq for r in got] == list(range(199, -1, -1))
    for c in {r.ledger for r in got}:
        own = [r for r in got if r.ledger == c]
        assert [r.number for r in own] == [1, 2, 3, 4] and [r.prev_hash for r in own] == ["", *[r.hash for r in own[:-1]]]
    assert len(calls) < 15


def test_shuffled_files_give_the_batch_chain(spark, tmp_path):
    rng, t0 = random.Random(1), dt.datetime(2024, 1, 1)
    rows = [(k, f"c{rng.randrange(4)}", f"p{k}", t0 + dt.timedelta(minutes=20 * (k // 2))) for k in range(200)]  # two at a time
    comes = sorted(rows, key=lambda r: r[0] + rng.uniform(0, 30))  # up to five hours late
    schema = "seq bigint, case_id string, payload string, occurred_at timestamp"

    def full(df):
        for f in ledger.FIELDS[1:]:
            df = df if f in df.columns else df.withColumn(f, F.lit(None).cast("string"))
        return df

    end = (10_000, "end", "p", t0 + dt.timedelta(days=99))
    for k in range(0, 201, 67):
        part = [*comes, end][k : k + 67]
        full(spark.createDataFrame(part, schema)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(full(spark.createDataFrame([], schema)).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("occurred_at", "12 hours")
    before = spark.conf.get(streams.ROCKS[0])
    try:
        got = {r.seq: (r.case_id, r.number, r.prev_hash, r.hash) for r in streams.replayed(streams.ordered_chain(stream), str(tmp_path), "append").collect()}
    finally:
        spark.conf.set(streams.ROCKS[0], before)
    want = {r.seq: (r.case_id, r.prev_hash, r.hash) for r in ledger.chained(full(spark.createDataFrame(rows, schema)), "case_id").collect()}
    assert {k: (c, p, h) for k, (c, _, p, h) in got.items()} == want
    for c in {r[1] for r in rows}:
        assert [n for _, n in sorted((k, v[1]) for k, v in got.items() if v[0] == c)] == list(range(1, 1 + sum(r[1] == c for r in rows)))
