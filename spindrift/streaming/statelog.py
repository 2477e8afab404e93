"""ST6: state of a stream as a bucketed log of deltas with compaction.

A batch of changed rows is written under its number and bucket of its keys, so
a small batch writes small files and no version of the whole state; a batch that
is run again overwrites its own files and changes nothing. Compaction folds the
deltas of the buckets they touch into a base of these buckets and leaves all
others; a manifest, written last, tells which base each bucket has, so a stop at
any moment leaves the state before or after.

    path/delta/batch=<n>/bucket=<b>    changed rows of a batch
    path/base/upto=<n>/bucket=<b>      rows of a bucket after batch n
    path/manifest/v=<n>                (bucket, upto) after the compaction at n
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructType


class StateLog:
    """Latest row of each key. Rows have the schema's columns; a row whose
    ``gone`` is true removes its key. Of rows of one key in a batch the greatest
    counts. Null keys are keys."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], buckets: int = 64) -> None:
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets
        self.stored = StructType(list(schema.fields)).add("gone", BooleanType())

    def _numbers(self, folder: str, name: str) -> list[int]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        system = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(where):
            return []
        names = [f.getPath().getName() for f in system.listStatus(where)]
        return sorted(int(n.removeprefix(f"{name}=")) for n in names if n.startswith(f"{name}=") and self._done(f"{folder}/{n}", system))

    def _done(self, folder: str, system) -> bool:
        """Whether a table was written to its end."""
        return system.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}/_SUCCESS"))

    def append(self, batch: DataFrame, number: int) -> None:
        """Write the changed rows of a batch (with or without ``gone``)."""
        if "gone" not in batch.columns:
            batch = batch.withColumn("gone", F.lit(False))
        rows = batch.select(*self.stored.names, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("bucket"))
        columns = [c for c in self.stored.names if c not in self.keys]
        rows = rows.groupBy(*self.keys, "bucket").agg(F.max(F.struct(*columns)).alias("r")).select(*self.keys, "bucket", "r.*")
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/delta/batch={number}")

    def _read(self, folders: list[str], name: str) -> DataFrame:
        schema = StructType(list(self.stored.fields)).add("bucket", IntegerType())
        out = None
        for folder in folders:
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/{folder}").withColumn(name, F.lit(int(folder.rsplit("=", 1)[1])))
            out = rows if out is None else out.unionByName(rows)
        return self.spark.createDataFrame([], schema).withColumn(name, F.lit(-1)) if out is None else out

    def _bases(self) -> tuple[int, DataFrame]:
        """The last compaction, and the base that each bucket has since."""
        done = self._numbers("manifest", "v")
        empty = self.spark.createDataFrame([], "bucket int, upto int")
        return (done[-1], self.spark.read.schema("bucket int, upto int").parquet(f"{self.path}/manifest/v={done[-1]}")) if done else (-1, empty)

    def _latest(self, upto: int | None = None, touched: list[int] | None = None) -> DataFrame:
        at, bases = self._bases()
        used = [r["upto"] for r in bases.select("upto").distinct().collect()]  # compactions since the start at most
        base = self._read([f"base/upto={n}" for n in sorted(used)], "upto").join(F.broadcast(bases), ["bucket", "upto"]).withColumnRenamed("upto", "_n")
        later = [n for n in self._numbers("delta", "batch") if n > at and (upto is None or n <= upto)]
        rows = base.unionByName(self._read([f"delta/batch={n}" for n in later], "_n"))
        if touched is not None:
            rows = rows.where(F.col("bucket").isin(touched))
        columns = [c for c in self.stored.names if c not in self.keys]
        return rows.groupBy(*self.keys, "bucket").agg(F.max_by(F.struct(*columns), "_n").alias("r")).select(*self.keys, "bucket", "r.*")

    def read(self) -> DataFrame:
        """The rows of the state."""
        return self._latest().where("not gone").select(*self.schema.names)

    def compact(self, upto: int) -> list[int]:
        """Fold the deltas up to a batch into new bases of the buckets that they
        touch, which are returned."""
        at, bases = self._bases()
        if upto <= at:
            return []
        later = [n for n in self._numbers("delta", "batch") if at < n <= upto]
        touched = sorted(r["bucket"] for r in self._read([f"delta/batch={n}" for n in later], "_n").select("bucket").distinct().collect())  # buckets at most
        rows = self._latest(upto, touched).where("not gone")
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/base/upto={upto}")
        kept = bases.where(~F.col("bucket").isin(touched)) if touched else bases
        new = self.spark.createDataFrame([(b, upto) for b in touched], "bucket int, upto int")
        kept.unionByName(new).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v={upto}")
        return touched

    def sink(self, every: int = 10) -> Callable[[DataFrame, int], None]:
        """A foreachBatch function; every so many batches the log is compacted."""

        def run(batch: DataFrame, number: int) -> None:
            self.append(batch, number)
            if number % every == every - 1:
                self.compact(number)

        return run
