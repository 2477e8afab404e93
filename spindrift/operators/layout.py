"""How rows lie over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(rows: DataFrame) -> DataFrame:
    """Deal the rows of a few unsplittable files out to all cores, before work
    that costs far more than moving them. Inputs of at least as many splits as
    cores, which is every large one, stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


#: Rows of a task of ``dealt``.
ROWS = 20_000


def tasks_for(rows: DataFrame, each: int = ROWS) -> int:
    """As many tasks as there are cores, and one for every ``each`` rows."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // each))


def dealt(rows: DataFrame, each: int = ROWS) -> DataFrame:
    """Deal out small rows that make much work, such as keys from which whole
    documents are made: as many tasks as there are cores, and a task for every
    ``each`` rows, however few files or bytes hold them. They are counted first;
    a table that has as many splits is left as it is. Spark moves filters, and
    the work they rest on, from behind a repartition back to the few tasks before
    it, but not from behind a function, so the rows pass through one."""
    tasks = tasks_for(rows, each)
    return rows.repartition(tasks).mapInArrow(lambda batches: batches, rows.schema) if rows.rdd.getNumPartitions() < tasks else rows
