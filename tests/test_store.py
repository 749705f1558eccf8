"""The versioned store: editions replace each other, whatever fails and whenever."""

import logging
import re

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from plumbline import queries_store
from plumbline.session import settle
from plumbline.sources import store as S
from plumbline.sources.store import Conflict, Store, ingest
from plumbline.streaming import events as streams


class Stop(logging.Handler):
    """Raises at the first step of a kind that the store logs."""

    def __init__(self, at):
        super().__init__()
        self.at = at

    def emit(self, record):
        if re.search(self.at, record.getMessage()):
            raise KeyboardInterrupt(record.getMessage())  # as if the driver had died: no handler of the run sees it


def docs(spark, texts):
    return spark.createDataFrame([(o, t) for o, t in texts.items()], "origin string, text string").withColumn("hash", F.md5("text"))


def words(part):
    return part.select("origin", F.explode(F.split("text", " ")).alias("word")).where("word <> ''")


def held(store, version=None):
    return sorted(map(tuple, store.rows(version).select("origin", "word").collect()))


def expected(texts):
    return sorted((o, w) for o, t in texts.items() for w in t.split())


EDITIONS = [{"a": "one two", "b": "three", "c": "four five", "d": "six"}, {"a": "one", "b": "three", "c": "four five seven", "e": "eight"}, {"a": "one two", "b": "three", "c": "four five", "e": "eight"}]


def merged(k):
    out = {}
    for e in EDITIONS[: k + 1]:
        out |= e
    return out


@pytest.fixture
def log():
    S.LOG.setLevel(logging.DEBUG)
    S.LOG.propagate = False
    yield S.LOG
    S.LOG.handlers.clear()
    S.LOG.setLevel(logging.NOTSET)
    S.LOG.propagate = True


@pytest.mark.parametrize("at", ["^rows of", "^done of", "^beside.*log", "^there is.*log", "^beside.*live", "^there is.*live"])
def test_a_death_at_any_write(spark, tmp_path, log, at):
    store = Store(spark, str(tmp_path / "s"), 3)
    ingest(store, docs(spark, EDITIONS[0]), words, 2)
    for k in (1, 2):
        stop = Stop(at)
        log.addHandler(stop)
        before = held(store)
        died = False
        try:
            ingest(store, docs(spark, EDITIONS[k]), words, 1)
        except KeyboardInterrupt:
            died = True
        log.removeHandler(stop)
        again = Store(spark, str(tmp_path / "s"))
        assert held(again) in ([before, expected(merged(k))] if died else [expected(merged(k))])
        assert ingest(again, docs(spark, EDITIONS[k]), words, 1)["complete"]
        assert held(again) == expected(merged(k))
        assert {tuple(r) for r in again.done().select("origin").collect()} == {(o,) for o in merged(k)}
        store = again
    store.vacuum(1)
    assert held(store) == expected(merged(2)) and len(store.versions()) == 1


def test_a_failing_step_keeps_what_was_before_and_is_published(spark, tmp_path):
    store, calls, built = Store(spark, str(tmp_path / "s"), 4), [], []
    texts = {f"o{k}": f"w{k} x" for k in range(12)}

    def flaky(part):
        calls.append(1)
        return words(part).withColumn("word", F.raise_error(F.lit("busy"))) if len(calls) == 2 else words(part)

    first = ingest(store, docs(spark, texts), flaky, 1, lambda s, v: built.append(v))
    assert not first["complete"] and first["commits"] == 1 and built == [store.live()] and 0 < len(held(store)) < 24
    last = ingest(store, docs(spark, texts), flaky, 1, lambda s, v: built.append(v))
    assert last["complete"] and held(store) == expected(texts) and built[-1] == store.live() == last["version"]
    assert ingest(store, docs(spark, texts), flaky, 1)["documents"] == 0


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), 8)
    texts = {f"o{k}": f"w{k}" for k in range(40)}
    ingest(store, docs(spark, texts), words)
    one = store.manifest()
    ingest(store, docs(spark, texts | {"o7": "changed"}), words)
    two = store.manifest()
    assert sum(one["rows"][b] != two["rows"][b] for b in one["rows"]) == 1
    assert held(store, one["version"]) == expected(texts) and held(store) == expected(texts | {"o7": "changed"})


def test_documents_without_rows_and_nulls(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), 2)
    ingest(store, docs(spark, {"a": "one", "b": "two"}), words)
    got = ingest(store, spark.createDataFrame([("a", "  ", "h1"), (None, "x", None), ("b", "two", None)], "origin string, text string, hash string"), words)
    assert got["documents"] == 3 and held(store) == [("", "x"), ("a", "one"), ("b", "two")]
    assert {tuple(r) for r in store.done().collect()} >= {("", ""), ("b", "")}
    empty = Store(spark, str(tmp_path / "e"), 2)
    assert ingest(empty, docs(spark, {"a": "x"}).limit(0), words) == {"complete": True, "error": None, "documents": 0, "commits": 0, "version": None}
    with pytest.raises(FileNotFoundError):
        empty.rows()


def test_a_second_writer_is_told(spark, tmp_path, log):
    one, two = Store(spark, str(tmp_path / "s"), 2), Store(spark, str(tmp_path / "s"), 2)
    a, b = docs(spark, {"a": "one"}), docs(spark, {"b": "two"})

    class Between(logging.Handler):
        def emit(self, record):
            if record.getMessage().startswith("done of"):
                log.removeHandler(self)
                one.upsert(a, words(a))

    log.addHandler(Between())
    with pytest.raises(Conflict):
        two.upsert(b, words(b))
    assert held(one, 1) == [("a", "one")]


def test_new_columns_are_null_in_old_rows(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), 2)
    ingest(store, docs(spark, {"a": "one"}), words)
    ingest(store, docs(spark, {"b": "two"}), lambda p: words(p).withColumn("page", F.lit(1)))
    assert {(r.origin, r.page) for r in store.rows().collect()} == {("a", None), ("b", 1)}


def test_a_batch_given_twice_counts_once(spark, tmp_path):
    store, a, b = Store(spark, str(tmp_path / "s"), 2), docs(spark, {"a": "one"}), docs(spark, {"a": "two"})
    assert store.upsert(a, words(a), ("s", 0)) == store.upsert(b, words(b), ("s", 0)) == 1
    assert held(store, 1) == [("a", "one")]


def test_a_stream_keeps_the_last_edition(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), 2)
    for k, e in enumerate(EDITIONS):
        docs(spark, e).withColumn("edition", F.lit(k)).write.mode("append").parquet(str(tmp_path / "in"))
    new = spark.readStream.schema("origin string, text string, hash string, edition int").parquet(str(tmp_path / "in"))
    streams.ingested(new, store, str(tmp_path / "ck"), words, F.col("edition")).awaitTermination()
    assert held(store, max(store.versions())) == expected(merged(2))


def test_only_changed_texts_are_shuffled(spark, tmp_path, monkeypatch):
    plans, store = {}, Store(spark, str(tmp_path / "store"), 4)
    monkeypatch.setattr(S, "settle", lambda df, name="part", by=None: (plans.setdefault(name, []).append(df._jdf.queryExecution().optimizedPlan().toString()), settle(df, name, by))[1])
    docs = lambda k: spark.createDataFrame([(f"o{i}", f"h{i}" if i % 5 else f"h{i}-{k}", "text") for i in range(20)] + [(None, None, "none")], "origin string, hash string, text string")
    rows = lambda part: part.select("origin", F.col("hash").alias("of"))
    for k in (1, 2):
        assert ingest(store, docs(k), rows)["documents"] == (21, 4)[k - 1]
    first, second = plans["todo"]
    assert "Join" not in first and "hint=(strategy=broadcast)" in second.replace(", rightHint=", ", hint=")
    assert "text" not in plans["changed"][0].split("Project")[0] and sorted(r[0] for r in store.rows().select("of").collect() if r[0].endswith("-2")) == ["h0-2", "h10-2", "h15-2", "h5-2"]


@pytest.mark.parametrize("marks", [0, 100])
def test_a_stream_settles_no_texts(spark, tmp_path, monkeypatch, marks):
    seen, store = [], Store(spark, str(tmp_path / "store"), 4)
    monkeypatch.setattr(streams, "MARKS", marks)
    monkeypatch.setattr(streams, "settle", lambda df, name="part": (seen.append(df.columns), settle(df, name))[1])
    rows = [("a", "h1", "one", 1), ("a", "h2", "two", 2), ("b", "h3", "three", 1), ("b", "h3", "three", 1), ("c", "h4", "four", None)]
    spark.createDataFrame(rows, "origin string, hash string, text string, k int").coalesce(1).write.parquet(f"{tmp_path}/in")
    new = spark.readStream.schema("origin string, hash string, text string, k int").parquet(f"{tmp_path}/in")
    streams.ingested(new, store, f"{tmp_path}/checkpoint", lambda part: part.select("origin", "text"), F.coalesce("k", F.lit(0))).awaitTermination()
    assert sorted(map(tuple, store.rows(1).select("origin", "text").collect())) == [("a", "two"), ("b", "three"), ("c", "four")]
    assert seen and not any("text" in columns for columns in seen)


@pytest.mark.parametrize("at", [2, 3, 4])
def test_no_other_failure_of_a_stream_looks_like_a_result(spark, sf, monkeypatch, at):
    calls, lines_of = [], queries_store.lines_of

    def broken(part):
        calls.append(1)
        return lines_of(part).withColumn("n", F.raise_error(F.lit("out of order")).cast("int")) if len(calls) == at else lines_of(part)

    if at == 2:  # the one that is meant to fail, but not in this way
        monkeypatch.setattr(queries_store, "failing", lambda k: broken)
    monkeypatch.setattr(queries_store, "lines_of", broken)
    with pytest.raises(StreamingQueryException, match="out of order"):
        queries_store.stream_ingest(spark, sf)
    assert len(calls) == at
