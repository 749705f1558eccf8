"""Streaming forms of the ledger's operators; each equals its batch form when the stream is replayed whole."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..session import settle
from ..sources.store import MARKS, Store


def event_stream(spark: SparkSession, folder: str, schema, watermark: str = "1 day", at: str = "occurred_at") -> DataFrame:
    """New files of an append-only folder; times are cast, as watermarks need a timestamp with zone."""
    s = spark.readStream.schema(schema).parquet(folder)
    return s.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, watermark)


def counts_by_window(events: DataFrame, window: str = "1 day", at: str = "occurred_at", key: str = "event_type") -> DataFrame:
    w = F.window(at, window)
    return events.groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def case_clocks(events: DataFrame, deadline_hours: float = 720.0, keep_hours: float = 720.0):
    """case_id, opened, disposed, breached as cases open and close. State is two times a case; once a case is disposed of and the
    watermark is ``keep_hours`` past that, its state is removed. Late or early, a disposition waits for its opening in the same state.
    """

    def update(key, frames: Iterator, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        opened, disposed = state.get if state.exists else (None, None)
        for f in frames:
            us = f["occurred_at"].astype("datetime64[us]").astype("int64")
            o, d = us[f["event_type"] == "case.created"], us[f["event_type"] == "disposition.recorded"]
            opened = min([x for x in (opened, o.min() if len(o) else None) if x is not None], default=None)
            disposed = min([x for x in (disposed, d.min() if len(d) else None) if x is not None], default=None)
        state.update((None if opened is None else int(opened), None if disposed is None else int(disposed)))
        if opened is not None and disposed is not None:
            state.setTimeoutTimestamp(int(max(state.getCurrentWatermarkMs() + 1, disposed // 1000 + keep_hours * 3.6e6)))
        if opened is not None:
            late = disposed is not None and (disposed - opened) / 3.6e9 > deadline_hours
            yield pd.DataFrame({"case_id": [key[0]], "opened": [opened], "disposed": [disposed], "breached": [late]}).astype({"opened": "Int64", "disposed": "Int64"})

    from pyspark.sql.streaming.state import GroupStateTimeout

    kind = events.schema["case_id"].dataType.simpleString()
    return events.groupBy("case_id").applyInPandasWithState(update, f"case_id {kind}, opened bigint, disposed bigint, breached boolean", "opened bigint, disposed bigint", "update", GroupStateTimeout.EventTimeTimeout)


def chain(events: DataFrame, by: str = "case_id", none: str = ""):
    """Each ledger's events chained as they come: state is the last number and hash of a ledger (``by``). Events of one batch are taken in the order of seq.

    events: FIELDS of a digest but prev_hash (strings), seq and ``by``. Gives by, seq, number, prev_hash, hash.
    """
    from ..operators.ledger import FIELDS

    def update(key, frames: Iterator, state):
        import hashlib

        import pandas as pd

        number, last = state.get if state.exists else (0, "")
        rows = []
        for _, r in pd.concat(list(frames)).sort_values("seq").iterrows():
            values = [last] + [(none if f == "supersedes" else "") if pd.isna(r[f]) else str(r[f]) for f in FIELDS[1:]]
            h = hashlib.sha256("\x1f".join(values).encode()).hexdigest()
            number += 1
            rows.append((key[0], r["seq"], number, last, h))
            last = h
        state.update((number, last))
        yield pd.DataFrame(rows, columns=[by, "seq", "number", "prev_hash", "hash"])

    from pyspark.sql.streaming.state import GroupStateTimeout

    kind = events.schema[by].dataType.simpleString()
    return events.groupBy(by).applyInPandasWithState(update, f"{by} {kind}, seq bigint, number bigint, prev_hash string, hash string", "number bigint, last string", "append", GroupStateTimeout.NoTimeout)


ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class OrderedLinks(StatefulProcessor):
    """Holds the events of some ledgers until the watermark has passed them, then links each ledger's by time and seq."""

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ledger string, us bigint, seq bigint, body string")
        self.heads = handle.getListState("heads", "ledger string, number bigint, last string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        new = [x for f in rows for x in zip(f["ledger"].tolist(), f["us"].tolist(), f["seq"].tolist(), f["body"].tolist())]
        self.waiting.appendList(new)
        self.handle.registerTimer(min(x[1] for x in new) // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import hashlib

        import pandas as pd

        passed, held = timerValues.getCurrentWatermarkInMs(), list(self.waiting.get())
        ready = sorted((x for x in held if x[1] // 1000 < passed), key=lambda x: tuple(x)[1:])
        later = [x for x in held if x[1] // 1000 >= passed]
        out = []
        if ready:
            heads = {ledger: (number, last) for ledger, number, last in self.heads.get()}
            for ledger, _, seq, body in ready:
                number, last = heads.get(ledger, (0, ""))
                h = hashlib.sha256(f"{last}\x1f{body}".encode()).hexdigest()
                out.append((ledger, seq, number + 1, last, h))
                heads[ledger] = (number + 1, h)
            self.heads.put([(ledger, *head) for ledger, head in heads.items()])
            self.waiting.put(later) if later else self.waiting.clear()
        if later:
            self.handle.registerTimer(min(x[1] for x in later) // 1000)
        if out:
            yield pd.DataFrame(out, columns=["ledger", "seq", "number", "prev_hash", "hash"])

    def close(self) -> None:
        pass


def ordered_chain(events: DataFrame, by: str = "case_id", at: str = "occurred_at", none: str = "", groups: int = 1024) -> DataFrame:
    """As chain(), but in the order of time and seq whatever batches events come in, as long as they come before the watermark.

    An event is linked once the watermark (events has one on ``at``) has passed it; until then it waits in the state, whose timers
    Spark keeps. Ledgers are dealt by hash to ``groups`` states, as each state that a batch meets costs some calls between Spark and Python; a
    worker holds what waits in one of them. The number stays as it is while a checkpoint is used. What comes behind the watermark
    is dropped by Spark and counted in the query's metrics. The state stands in RocksDB, which this sets for the session's new queries.
    """
    from ..operators.ledger import FIELDS

    events.sparkSession.conf.set(*ROCKS)
    body = F.concat_ws("\x1f", *[F.coalesce(F.col(f).cast("string"), F.lit(none if f == "supersedes" else "")) for f in FIELDS[1:]])
    ledger = F.col(by).cast("string")
    rows = events.select(F.pmod(F.xxhash64(ledger), F.lit(groups)).alias("g"), ledger.alias("ledger"), at, "seq", F.unix_micros(at).alias("us"), body.alias("body"))
    made = rows.groupBy("g").transformWithStateInPandas(OrderedLinks(), "ledger string, seq bigint, number bigint, prev_hash string, hash string", "Append", "EventTime")
    return made.select(F.col("ledger").cast(events.schema[by].dataType).alias(by), "seq", "number", "prev_hash", "hash")


def queue_changes(events: DataFrame, window: str = "1 day", at: str = "occurred_at"):
    """start, opened, disposed by window: what a running sum over windows turns into the queue's depth."""
    w = F.window(at, window)
    return events.groupBy(w.alias("w")).agg(F.count_if(F.col("event_type") == "case.created").alias("opened"), F.count_if(F.col("event_type") == "disposition.recorded").alias("disposed")).select(F.col("w.start").alias("start"), "opened", "disposed")


def replayed(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    """A stream run over all that is there, each batch's rows written whole under ``folder``; in complete mode the last batch's alone."""
    spark, schema = stream.sparkSession, stream.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out" if mode == "complete" else f"{folder}/out/batch={batch_id}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/out")


def incremental(stream: DataFrame, target: str, checkpoint: str, process):
    """Each micro-batch is processed and appended whole, so what is done stays done if a later one fails."""

    def commit(batch: DataFrame, batch_id: int) -> None:
        process(batch).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(commit).start()


def _of(batch: DataFrame, keep: DataFrame, order: Column) -> DataFrame:
    """A row of batch for each of keep (_origin, _hash, _order). Marks of keep are broadcast first, so that other rows aren't shuffled."""
    mark = lambda *c: F.xxhash64(*[F.coalesce(x.cast("string"), F.lit("")) for x in c])
    rows, own = batch.withColumn("_o", order), (F.col("origin"), F.col("hash"), F.col("_o"))
    if keep.count() <= MARKS:
        marks = keep.select(mark(F.col("_origin"), F.col("_hash"), F.col("_order")).alias("_mark")).distinct()
        rows = rows.join(F.broadcast(marks), mark(*own) == F.col("_mark"), "left_semi")
    same = F.col("origin").eqNullSafe(F.col("_origin")) & F.col("hash").eqNullSafe(F.col("_hash")) & F.col("_o").eqNullSafe(F.col("_order"))
    met = rows.join(keep, same, "left_semi")
    return met.groupBy("origin").agg(F.first(F.struct(*batch.columns)).alias("r")).select("r.*")  # a document that came twice alike


def ingested(stream: DataFrame, store: Store, checkpoint: str, process, order: Column):
    """Each micro-batch (origin, hash and others) goes into the store whole; of a document's editions in one batch only the last by ``order``.

    The store keeps the number of the last batch, so one that is given again after a failure is not added twice; documents
    whose hash the store has already are passed over.
    """

    def commit(batch: DataFrame, batch_id: int) -> None:
        slim = batch.select(F.col("origin").alias("_origin"), F.col("hash").alias("_hash"), order.alias("_order"))
        last = slim.groupBy("_origin").agg(F.max_by(F.struct("_hash", "_order"), "_order").alias("r")).select("_origin", "r.*")
        known = store.done().select(F.col("origin").alias("_origin"), F.col("hash").alias("_hash"))
        keep = settle(last.join(known, ["_origin", "_hash"], "left_anti"), "batch")
        new = batch if keep.count() == slim.count() else _of(batch, keep, order)
        store.upsert(keep.select(F.col("_origin").alias("origin"), F.col("_hash").alias("hash")), process(new), (checkpoint, batch_id))

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(commit).start()
