"""Small files in a store that Spark knows."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Taken(Exception):
    """There is a file of that name already."""


def put(spark: SparkSession, text: str, path: str, aside: str, overwrite: bool = False, told=lambda what: None) -> None:
    """A small file that is there whole or not at all: written in the folder ``aside``, then renamed. Without ``overwrite`` one that is there stays, and that is an error."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    Path, kind = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.hadoop.fs.Options.Rename
    new, there = Path(f"{aside}/{uuid.uuid4().hex}"), Path(path)
    fs = there.getFileSystem(conf)
    fs.mkdirs(there.getParent())
    out = fs.create(new, False)
    out.write(bytearray(text.encode()))
    out.close()
    told(f"beside {path}")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE if overwrite else kind.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(new), fs.makeQualified(there), how)
    except Py4JJavaError as e:
        fs.delete(new, False)
        if "FileAlreadyExists" in str(e.java_exception.getClass()):
            raise Taken(path) from e
        raise
    told(f"there is {path}")
