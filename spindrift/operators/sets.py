"""Set operations on arrays and relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.text import let


def unique_by(items: Column, key) -> Column:
    """Items of an array whose key has not come before, in order."""

    def over(pairs: Column) -> Column:
        names = F.transform(pairs, lambda p: p["k"])
        return F.transform(F.filter(pairs, lambda p: F.array_position(names, p["k"]) == p["i"] + 1), lambda p: p["v"])

    return let(F.transform(items, lambda v, i: F.struct(v.alias("v"), key(v).alias("k"), i.alias("i"))), over)


def merge_links(primary: Column, other: Column) -> Column:
    """Links of both, those of the first before; an address counts once
    whatever its query, fragment, closing slash or case."""
    return unique_by(F.concat(primary, other), lambda u: F.lower(F.regexp_replace(F.regexp_replace(u, "[?#].*$", ""), "/+$", "")))


def unique_names(names: Column) -> Column:
    """Trimmed names, each once whatever its case."""
    return unique_by(F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: x != ""), F.lower)


def missing(rows: DataFrame, snapshot: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that a snapshot no longer has."""
    return rows.join(snapshot.select(*keys).distinct(), keys, "left_anti")


def merged_requirements(rows: DataFrame) -> DataFrame:
    """Requirements of a job and key (job_id, req_key, quote, rank, years)
    merged: the most important rank with its quote, and the most years."""
    return rows.groupBy("job_id", "req_key").agg(F.min_by("quote", F.struct("rank", "quote")).alias("quote"), F.min("rank").alias("rank"), F.max("years").alias("years"))


def concatenated(*sources: DataFrame) -> DataFrame:
    """Sources one under another by column name, with the number of each."""
    out = None
    for i, source in enumerate(sources):
        own = source.withColumn("source_no", F.lit(i))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def compared(a: Column, b: Column) -> Column:
    """U4: struct of what two arrays share, what only the first has, and whether
    it holds all of the second."""
    return F.struct(F.array_intersect(a, b).alias("both"), F.array_except(a, b).alias("only"), (F.size(F.array_except(b, a)) == 0).alias("covers"))
