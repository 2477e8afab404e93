"""Where intermediate tables go: the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where it is unset, a local session (tests) gets a temporary folder of its
    own; a cluster must name one, since executors don't share local disks.
    """
    named = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SETTING} must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spindrift-")
        spark.conf.set(SETTING, named)
    return named.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path for one table that no other call uses."""
    return f"{folder(spark)}/spindrift/{name}-{uuid.uuid4().hex}"


def cut(frame: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: its lineage ends
    there, it is computed once, and the loss of an executor does not undo it."""
    return stored(frame, name)[0]


def stored(frame: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Like ``cut``, with the table's path, so that it can be discarded."""
    path = fresh(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of ``stored`` that nothing will read any more, wherever
    the shared folder lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
