"""Session settings that the library is written for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}
#: Bytes of an Arrow batch between Spark and a Python worker: bounds what both hold of it, whatever the rows' lengths.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def session(name: str = "plumbline", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for k, v in (SETTINGS | settings).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Lowers the session's bound on the bytes of an Arrow batch to ``most``; a lower one stays."""
    now = spark.conf.get(BATCH_SETTING, None)
    if now is None or int(now.rstrip("bB")) > most:
        spark.conf.set(BATCH_SETTING, str(most))


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only a local session without one gets a temporary folder; on a cluster executors would not see it."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="plumbline-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """This application's folder in the shared one, removed when the application ends."""
    path = f"{shared_folder(spark)}/plumbline-{spark.sparkContext.applicationId}"
    if path not in _folders:
        _folders.add(path)
        there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)
    return path


_folders: set[str] = set()
#: The writer looks at a page's and a row group's size after a few rows, as packed rows may hold a megabyte each; else it buffers a hundred of them.
SMALL_PAGES = {"parquet.page.size.row.check.min": "2", "parquet.block.size.row.check.min": "2"}


def settle(df: DataFrame, name: str = "part", by: str | None = None) -> DataFrame:
    """df written once as a table in the shared folder and read again: its lineage ends there. by: a column with a folder for each value.

    Unlike a checkpoint this computes df once, and an executor's loss costs nothing after it.
    """
    path = f"{run_folder(df.sparkSession)}/{uuid.uuid4().hex}/{name}"
    out = df.write.options(**SMALL_PAGES)
    (out.partitionBy(by) if by else out).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df to be broadcast if it has no more than ``most`` rows; else joins shuffle it."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
