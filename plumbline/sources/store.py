"""A versioned store of documents' rows: a changed document replaces its old rows, and what is done survives any failure.

Rows stand in buckets by a hash of their origin. A commit writes the buckets that it touches anew, beside the others, and then one
manifest that names for each bucket the commit that wrote it last. The manifest appears under the next number
by one rename that never overwrites, so a reader sees a version whole or not at all, a writer that comes second is told, and what a failed
commit has left is in no manifest. ``live`` names the version that readers get; it moves once a run, after ``finish`` has built what
belongs to the version, as indexes.

A document's hash is kept with its rows: one that goes back to an earlier edition is changed again. Documents that
``process`` gives no rows for (no text) are not done: their old rows stay, and the next run asks for them again. A null origin is
as an empty one. Documents that share an origin are one document with the rows of all.
"""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..files import Taken, put
from ..session import settle

LOG = logging.getLogger(__name__)
DONE = "origin string, hash string"


class Conflict(Exception):
    """Another writer has committed since this one read the store."""


class Store:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        """buckets: of a new store, of some GB each at most; an old one keeps its number."""
        self.spark, self.path = spark, path.rstrip("/")
        self.fs = self._hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
        head = self.manifest()
        self.buckets = head["buckets"] if head else buckets

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _names(self, folder: str) -> list[str]:
        there = self._hadoop(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in self.fs.listStatus(there)] if self.fs.exists(there) else []

    def _read(self, path: str) -> str:
        with_file = self.fs.open(self._hadoop(path))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(with_file, "UTF-8")
        finally:
            with_file.close()

    def _put(self, text: str, path: str, overwrite: bool) -> None:
        try:
            put(self.spark, text, path, f"{self.path}/aside", overwrite, LOG.debug)
        except Taken as e:
            raise Conflict(path) from e

    # -- versions

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("log") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict | None:
        """A version's manifest, the last one's by default; None of an empty store."""
        if version is None:
            version = max(self.versions(), default=None)
        return None if version is None else json.loads(self._read(f"{self.path}/log/{version:020d}.json"))

    def live(self) -> int | None:
        """The version that readers get; None before the first run ends."""
        return int(self._read(f"{self.path}/live")) if self.fs.exists(self._hadoop(f"{self.path}/live")) else None

    def publish(self, version: int) -> None:
        self._put(str(version), f"{self.path}/live", True)

    # -- reading

    def _at(self, manifest: dict | None, kind: str, buckets: list[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(manifest["schema"])) if manifest and kind == "rows" else T._parse_datatype_string(DONE)
        there = manifest[kind] if manifest else {}
        paths = [f"{self.path}/{kind}/{commit}/bucket={b}" for b, commit in there.items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def rows(self, version: int | None = None) -> DataFrame:
        """All rows of a version; of the live one by default."""
        version = self.live() if version is None else version
        if version is None:
            raise FileNotFoundError(f"nothing is published at {self.path}")
        return self._at(self.manifest(version), "rows")

    def done(self, version: int | None = None) -> DataFrame:
        """origin, hash of what a version holds, the last one by default."""
        return self._at(self.manifest(version), "done")

    # -- writing

    def bucketed(self, df: DataFrame) -> DataFrame:
        origin = F.coalesce(F.col("origin"), F.lit(""))
        return df.withColumn("origin", origin).withColumn("bucket", F.pmod(F.xxhash64(origin), F.lit(self.buckets)).cast("int"))

    def _write(self, df: DataFrame, kind: str, commit: str) -> list[int]:
        """Writes rows by bucket, a large bucket as several files, and tells which buckets have any."""
        df.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{kind}/{commit}")
        LOG.debug("%s of %s", kind, commit)
        return sorted(int(n.removeprefix("bucket=")) for n in self._names(f"{kind}/{commit}") if n.startswith("bucket="))

    def upsert(self, documents: DataFrame, rows: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Commits documents (origin, hash) with their rows (origin and others) in place of what was there; the new version.

        batch: a stream and the number of its batch; one that is already in the store changes nothing.
        """
        base = self.manifest()
        if batch and base and base["batches"].get(batch[0], -1) >= batch[1]:
            return base["version"]
        commit = uuid.uuid4().hex
        new = settle(self.bucketed(rows), "rows")
        fresh = self.bucketed(documents).select("origin", F.coalesce("hash", F.lit("")).alias("hash"), "bucket").join(new.select("origin").distinct(), "origin", "left_semi")
        fresh = settle(fresh.select("origin", "hash", "bucket"), "fresh")
        touched = [r[0] for r in fresh.select("bucket").distinct().collect()]
        keep = lambda kind: self.bucketed(self._at(base, kind, touched).join(fresh.select("origin"), "origin", "left_anti"))
        plain = new.drop("bucket").schema
        all_rows = keep("rows").unionByName(new, allowMissingColumns=True) if base else new
        head = {"version": (base["version"] if base else 0) + 1, "buckets": self.buckets, "schema": all_rows.drop("bucket").schema.json() if base else plain.json(), "batches": dict(base["batches"]) if base else {}}
        for kind, df in (("rows", all_rows), ("done", keep("done").unionByName(fresh))):
            there = self._write(df, kind, commit) if touched else []
            head[kind] = {b: c for b, c in (base[kind] if base else {}).items() if int(b) not in touched} | {str(b): commit for b in there}
        if batch:
            head["batches"][batch[0]] = batch[1]
        self._put(json.dumps(head), f"{self.path}/log/{head['version']:020d}.json", False)
        return head["version"]

    def vacuum(self, keep: int = 2) -> int:
        """Removes what neither the last ``keep`` versions nor the live one need; how many commits went. For when no writer is at work."""
        versions = self.versions()
        kept = {*versions[-keep:], *[v for v in (self.live(),) if v is not None]}
        needed = {c for v in kept for kind in ("rows", "done") for c in self.manifest(v)[kind].values()}
        for v in set(versions) - kept:
            self.fs.delete(self._hadoop(f"{self.path}/log/{v:020d}.json"), False)
        gone = {n for kind in ("rows", "done") for n in self._names(kind)} - needed
        for n in gone:
            for kind in ("rows", "done"):
                self.fs.delete(self._hadoop(f"{self.path}/{kind}/{n}"), True)
        self.fs.delete(self._hadoop(f"{self.path}/aside"), True)
        return len(gone)


MARKS = 4_000_000  # keys that are broadcast as one number each


def chosen(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of df whose columns of keys (a settled table of rows without nulls, once each) are among keys'.

    Up to MARKS keys are broadcast as hashes first, so that only rows that may be among them are shuffled, and not the texts of all others.
    """
    mark = F.xxhash64(*keys.columns)
    if keys.count() <= MARKS:
        df = df.join(F.broadcast(keys.select(mark.alias("_mark")).distinct()), mark == F.col("_mark"), "left_semi")
    return df.join(keys, keys.columns, "left_semi")


def ingest(store: Store, docs: DataFrame, process: Callable[[DataFrame], DataFrame], per_commit: int = 100_000, finish: Callable[[Store, int], None] | None = None) -> dict:
    """Brings the store up to docs (origin, hash and others): ``process`` gives the rows (origin and others) of those that are new or changed.

    Some ``per_commit`` documents, in whole buckets, are a commit. If one fails the run stops there; what came before stays, is finished and published,
    and the next run goes on with the rest. Documents that are in the store and not in docs stay.
    """
    changed = store.bucketed(docs).withColumn("hash", F.coalesce("hash", F.lit("")))
    if store.manifest():
        changed = chosen(changed, settle(changed.select("origin", "hash").distinct().join(store.done(), ["origin", "hash"], "left_anti"), "changed"))
    todo = settle(changed, "todo")
    sizes = {r["bucket"]: r["count"] for r in todo.groupBy("bucket").count().collect()}  # a row for each bucket at most
    steps: list[list[int]] = []
    held = per_commit
    for b in sorted(sizes):
        if held + sizes[b] > per_commit:
            steps.append([])
            held = 0
        steps[-1].append(b)
        held += sizes[b]
    error = None
    for k, step in enumerate(steps):
        part = todo.where(F.col("bucket").isin(step)).drop("bucket")
        try:
            store.upsert(part.select("origin", "hash"), process(part))
        except Conflict:
            raise
        except Exception as e:  # noqa: BLE001  whatever ends it, what is done stays
            error = str(e).splitlines()[0] if str(e) else type(e).__name__
            break
    version = max(store.versions(), default=None)
    if version is not None and version != store.live():
        if finish:
            finish(store, version)
        store.publish(version)
    return {"complete": error is None, "error": error, "documents": sum(sizes.values()), "commits": len(steps) if error is None else k, "version": version}
