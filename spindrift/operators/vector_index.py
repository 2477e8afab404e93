"""T5: an index of inverted lists over vectors, and searches that probe it.

Centres are fitted on a bounded sample; every vector is then put into the lists
of its nearest centres. The index is two tables: centres, and entries
partitioned by list, so a search reads only the lists that it probes. Lists of
any size are dealt into parts (``vectors._in_parts``), and tasks keep the best k
of each query before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.operators.storage import fresh
from spindrift.operators.vectors import _in_parts, _matrix

#: Vectors that the centres are fitted on at most, and centres at most.
SAMPLE, MOST_LISTS = 50_000, 4_096
#: Lists that a vector is put into, and rounds of fitting.
COPIES, ROUNDS = 2, 8


@dataclass(frozen=True)
class Index:
    """Where the tables of an index lie."""

    centres: str
    entries: str

    def open_centres(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.centres)

    def open_entries(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.entries)


def fit_centres(points: np.ndarray, lists: int, seed: int = 3) -> np.ndarray:
    """Unit centres by spherical k-means. Centres that lose all their points
    move to the points that are worst served."""
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), lists, replace=False)].copy()
    for _ in range(ROUNDS):
        near = points @ centres.T
        own = near.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        length = np.linalg.norm(sums, axis=1)
        lost = np.flatnonzero(length == 0)
        centres[length > 0] = sums[length > 0] / length[length > 0, None]
        centres[lost] = points[near.max(axis=1).argsort()[: len(lost)]]
    return centres


def _assigned(shared, copies: int, key: str) -> Callable:
    """Rows (key, vector) once for each of their ``copies`` nearest centres."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres: np.ndarray = shared.value
        for batch in batches:
            matrix, good = _matrix(batch.column("vector"))
            rows = np.flatnonzero(good)
            if not len(rows) or matrix.shape[1] != centres.shape[1]:
                continue
            near = matrix[rows] @ centres.T
            take = min(copies, len(centres))
            best = np.argpartition(-near, take - 1, axis=1)[:, :take]
            kept = batch.take(pa.array(np.repeat(rows, take)))
            yield pa.RecordBatch.from_arrays([kept.column(key), kept.column("vector"), pa.array(best.ravel().astype(np.int32))], names=[key, "vector", "list"])

    return run


def _dealt(rows: DataFrame, key: str, centres: np.ndarray, copies: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(centres)
    return rows.select(F.col(key).cast("long").alias(key), F.col("vector").cast("array<double>").alias("vector")).mapInArrow(_assigned(shared, copies, key), f"{key} long, vector array<double>, list int")


def build(items: DataFrame, lists: int | None = None) -> Index:
    """Index of items (item_id, vector). ``lists`` defaults to the root of their
    number, ``MOST_LISTS`` at most. Vectors that are null, zero, of another size
    than most or hold nulls are left out, as they match nothing; every other one
    is in the index. The sample for the centres is a share by a hash of the id
    that gives about ``SAMPLE`` vectors. No vectors give an empty index."""
    spark = items.sparkSession
    n = items.count()
    share = min(1.0, SAMPLE / max(n, 1))
    sample = items.where(F.pmod(F.xxhash64("item_id"), F.lit(1_000_000)) < share * 1_000_000).select("vector").limit(2 * SAMPLE).toArrow()
    matrix, good = _matrix(sample.column("vector"))
    points = matrix[good]
    lists = max(1, min(lists or int(n**0.5), MOST_LISTS, len(points)))
    centres = fit_centres(points, lists) if len(points) else np.zeros((1, max(1, matrix.shape[1])))
    index = Index(fresh(spark, "centres"), fresh(spark, "entries"))
    spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "list int, centre array<double>").write.parquet(index.centres)
    _dealt(items, "item_id", centres, COPIES).repartition("list", F.pmod(F.xxhash64("item_id"), F.lit(8))).write.partitionBy("list").parquet(index.entries)
    return index


def search(index: Index, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """The k nearest items of each query (query_id, vector) among those in its
    ``probes`` nearest lists: query_id, item_id, similarity, rank; of equal ones
    the least id. With as many probes as lists the result is exact. Queries that
    are null, zero or hold nulls find nothing."""
    spark = queries.sparkSession
    centres = np.array([r["centre"] for r in index.open_centres(spark).orderBy("list").collect()])  # MOST_LISTS at most
    asked = _dealt(queries, "query_id", centres, probes)
    entries = index.open_entries(spark) if index_has_rows(spark, index) else None
    if entries is None:
        return asked.select("query_id", F.lit(0).cast("long").alias("item_id"), F.lit(0.0).alias("similarity"), F.lit(0).alias("rank")).limit(0)
    found = _in_parts(asked, entries.select("item_id", "vector", F.col("list").cast("int").alias("list")), "list", k)
    found = found.groupBy("query_id", "item_id").agg(F.max("similarity").alias("similarity"))  # an item is in several lists
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "item_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def index_has_rows(spark: SparkSession, index: Index) -> bool:
    """Whether the entries hold a file; a partitioned table of no rows has no
    schema to read."""
    where = spark._jvm.org.apache.hadoop.fs.Path(index.entries)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    return any(f.getPath().getName().startswith("list=") for f in found)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: exact neighbours, and how many of them were found."""
    hits = exact.select("query_id", "item_id").join(found.select("query_id", "item_id", F.lit(True).alias("hit")), ["query_id", "item_id"], "left")
    return hits.agg(F.count("*").alias("n"), F.count("hit").alias("n_found"))
