"""Mutations as next states: each takes the stored rows and the new ones and
returns the whole table as it should be afterwards, to be written once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """SK1, SK2, SK15: add rows whose key is not there yet; of new rows with one
    key, the first by ``order``."""
    rest = [c for c in new.columns if c not in keys]
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(order)).alias("_r")).select(*keys, "_r.*").select(*new.columns)
    return old.unionByName(first.join(old.select(*keys), keys, "left_anti"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: dict[str, Column] | None = None) -> DataFrame:
    """SK3, SK4, SK8: new rows replace old ones of their key. ``keep`` says for a
    column when the old value wins (a condition over ``old.*``)."""
    columns = [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.struct(*columns).alias("old"))
    n = new.select(*keys, F.struct(*columns).alias("new"))
    both = o.join(n, keys, "full_outer")

    def value(c: str) -> Column:
        own = F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))
        return F.when(F.col("old").isNotNull() & F.coalesce((keep or {}).get(c, F.lit(False)), F.lit(False)), F.col(f"old.{c}")).otherwise(own).alias(c)

    return both.select(*keys, *(value(c) for c in columns)).select(*old.columns)


def update(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """SK6, SK7: columns of new rows where they are not null; no key is added."""
    columns = [c for c in new.columns if c not in keys]
    n = new.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns))
    out = old.join(n, keys, "left")
    return out.select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in old.columns))


def add_counts(old: DataFrame, new: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """SK5: counters of old and new rows added up."""
    return old.select(*keys, count).unionByName(new.select(*keys, count)).groupBy(*keys).agg(F.sum(count).alias(count))


def sync_snapshot(stored: DataFrame, snapshot: DataFrame, scope: Column, key: str, now: Column) -> DataFrame:
    """SK9, SK10, ST15: of the stored rows in scope, those missing from the
    snapshot are closed now, and those present are seen now and reopened."""
    seen = snapshot.select(key).distinct().withColumn("_seen", F.lit(True))
    out = stored.join(seen, key, "left")
    present = F.col("_seen").isNotNull()
    closed = F.when(scope & present, F.lit(None).cast("timestamp")).when(scope, F.coalesce("closed_at", now)).otherwise(F.col("closed_at"))
    return out.withColumns({"closed_at": closed, "last_seen_at": F.when(scope & present, now).otherwise(F.col("last_seen_at"))}).select(*stored.columns)


def merge_duplicate(row: dict[str, Column], other: dict[str, Column]) -> dict[str, Column]:
    """SK11, E2: the fuller description (complete before cut, then longer; of
    equals the row's own), and no embedding where the text changes."""
    better = F.when(row["truncated"] != other["truncated"], row["truncated"]).otherwise(F.length(other["description"]) > F.length(row["description"]))
    better = F.coalesce(better, row["description"].isNull() & other["description"].isNotNull())
    pick = lambda c: F.when(better, other[c]).otherwise(row[c])
    return {"description": pick("description"), "truncated": pick("truncated"), "embedding_valid": ~better}


def replace_all(old: DataFrame, new: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """SK12, SK19: the rows of the given parents replaced by new ones."""
    return old.join(parents.select(key).distinct(), key, "left_anti").unionByName(new)


def add_version(old: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """SK16: a further version per owner, which alone is active."""
    last = old.groupBy(owner).agg(F.max("version").alias("_last"))
    own = new.join(last, owner, "left").withColumn("version", F.coalesce("_last", F.lit(0)) + 1).drop("_last")
    rows = old.drop("active").unionByName(own.select(*(c for c in old.columns if c != "active")))
    return rows.withColumn("active", F.col("version") == F.max("version").over(Window.partitionBy(owner)))


def single_default(rows: DataFrame, owner: str, chosen: Column, *order: str) -> DataFrame:
    """SK17: one default for each owner, the latest chosen one."""
    rank = F.row_number().over(Window.partitionBy(owner).orderBy(F.desc(chosen), *(F.desc(c) for c in order)))
    return rows.withColumn("is_default", (rank == 1) & chosen)


def keep_listed(rows: DataFrame, listed: DataFrame, keys: list[str], guard: Column) -> DataFrame:
    """SK18: rows that are listed, or that the guard protects."""
    flag = listed.select(*keys).distinct().withColumn("_listed", F.lit(True))
    return rows.join(flag, keys, "left").where(F.col("_listed").isNotNull() | guard).drop("_listed")


def store_content(old: DataFrame, new: DataFrame, owner: str = "user_id") -> DataFrame:
    """SK20: contents stored once per owner under their SHA-256."""
    own = new.withColumn("sha", F.sha2("content", 256)).dropDuplicates([owner, "sha"])
    return old.unionByName(own.join(old.select(owner, "sha"), [owner, "sha"], "left_anti").select(*old.columns))


def set_where(rows: DataFrame, ids: DataFrame, key: str, **values: Column) -> DataFrame:
    """SK22: columns of the listed rows set."""
    flag = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    out = rows.join(flag, key, "left")
    return out.withColumns({c: F.when(F.col("_hit").isNotNull(), v).otherwise(F.col(c)) for c, v in values.items()}).select(*rows.columns)


def resolve_placeholders(rows: DataFrame, resolved: DataFrame) -> DataFrame:
    """SK23: placeholder rows (key "name:...") take the key that was found for
    their name, or go if a row with that key is there."""
    real = rows.where(~F.col("key").startswith("name:"))
    open_rows = rows.where(F.col("key").startswith("name:")).join(resolved.select(F.col("name").alias("_n"), F.col("key").alias("_k")), F.col("key") == F.concat(F.lit("name:"), F.col("_n")), "left")
    moved = open_rows.withColumn("key", F.coalesce("_k", "key")).select(*rows.columns)
    return real.unionByName(moved.join(real.select("owner", "key"), ["owner", "key"], "left_anti").dropDuplicates(["owner", "key"]).select(*rows.columns))


def changes(old: DataFrame, new: DataFrame, keys: list[str], column: str) -> DataFrame:
    """SK26: history rows for keys whose value is new or differs."""
    o = old.select(*keys, F.col(column).alias("before"))
    return new.select(*keys, F.col(column).alias("after")).join(o, keys, "left").where(~F.col("before").eqNullSafe(F.col("after")))


def as_ndjson(rows: DataFrame) -> DataFrame:
    """SK24: one JSON object a row, for a text sink."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def as_report(*parts: Column) -> Column:
    """SK25, Q17: parts of a report on lines of their own; nulls left out."""
    return F.concat_ws("\n", *parts)


def batch(rows: DataFrame, *statements: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """SK21: statements applied one after another; the result is written once,
    so either all of them hold or none."""
    for statement in statements:
        rows = statement(rows)
    return rows


def resolve_placeholders_of(rows: DataFrame, resolved: DataFrame) -> DataFrame:
    """SK23: like ``resolve_placeholders``, where each owner (resolved: owner,
    name, key) has found keys of its own."""
    real = rows.where(~F.col("key").startswith("name:"))
    found = resolved.select("owner", F.concat(F.lit("name:"), F.col("name")).alias("key"), F.col("key").alias("_k"))
    moved = rows.where(F.col("key").startswith("name:")).join(found, ["owner", "key"], "left").withColumn("key", F.coalesce("_k", "key")).select(*rows.columns)
    return real.unionByName(moved.join(real.select("owner", "key"), ["owner", "key"], "left_anti").dropDuplicates(["owner", "key"]))
