"""Order within a key: spans, gaps, latest rows, stages and numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(spans: DataFrame, key: str, start: str, stop: str) -> DataFrame:
    """Spans of a key merged where they overlap or touch (stop + 1 month):
    key, from_month, to_month. Spans that end before they start are dropped."""
    order = Window.partitionBy(key).orderBy(start, stop)
    before = F.max(stop).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.where(F.col(stop) >= F.col(start)).withColumn("_new", F.when(before.isNull() | (F.col(start) > before + 1), 1).otherwise(0))
    # by range: equal spans are of one island in whatever order they come
    numbered = marked.withColumn("_island", F.sum("_new").over(order.rangeBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "_island").agg(F.min(start).alias("from_month"), F.max(stop).alias("to_month")).drop("_island")


def total_months(merged: DataFrame, key: str) -> DataFrame:
    """Months covered by the islands of a key."""
    return merged.groupBy(key).agg(F.sum(F.col("to_month") - F.col("from_month") + 1).alias("total_months"))


def gaps(merged: DataFrame, key: str, over: int = 3) -> DataFrame:
    """Breaks of more than ``over`` months between islands."""
    last = F.lag("to_month").over(Window.partitionBy(key).orderBy("from_month"))
    found = merged.withColumn("_last", last).withColumn("months", F.col("from_month") - F.col("_last") - 1).where(F.col("months") > over)
    return found.select(key, (F.col("_last") + 1).alias("gap_from"), (F.col("from_month") - 1).alias("gap_to"), "months")


def overlaps(spans: DataFrame, key: str, number: str, start: str, stop: str) -> DataFrame:
    """Pairs of spans of a key that share months. The equality on the key
    makes it a hash join; pairs inside a key are the result itself."""
    a = spans.where(F.col(stop) >= F.col(start)).select(key, F.col(number).alias("a"), F.col(start).alias("_af"), F.col(stop).alias("_at"))
    b = a.select(key, F.col("a").alias("b"), F.col("_af").alias("_bf"), F.col("_at").alias("_bt"))
    first = (F.col("_af") < F.col("_bf")) | ((F.col("_af") == F.col("_bf")) & (F.col("a") < F.col("b")))
    pairs = a.join(b, key).where(first & (F.col("_at") >= F.col("_bf")))
    return pairs.select(key, "a", "b", (F.least("_at", "_bt") - F.col("_bf") + 1).alias("months"))


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key; map-side combined, so without a sort."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def first_of(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """W6, SK15: the first row of each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def next_after(rows: DataFrame, key: str, at: str, now: Column) -> DataFrame:
    """The first row at or after now of each key."""
    return first_of(rows.where(F.col(at) >= now), [key], at)


def running_max(rows: DataFrame, key: str, order: list[str], value: Column) -> Column:
    """The highest value up to each row."""
    return F.max(value).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def previous(key: str, order: list[str], *columns: str) -> Column:
    """W10, SK14: the state before each row, to undo it."""
    return F.lag(F.struct(*columns)).over(Window.partitionBy(key).orderBy(*order))


def numbered(rows: DataFrame, key: str, order: list, prefix: str, cap: int | None = None) -> DataFrame:
    """Labels R1, R2 ... in order within a key, up to a cap."""
    out = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    out = out.where(F.col("_n") <= cap) if cap else out
    return out.withColumn("label", F.concat(F.lit(prefix), F.col("_n").cast("string"))).drop("_n")


def top(rows: DataFrame, key: str, order: list, k: int) -> DataFrame:
    """The first k rows of each key."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def round_robin(variants: DataFrame, places: list[str], cap: int, first: int) -> DataFrame:
    """Queries of every variant (role_id, variant_no, text) at every place,
    one variant of each role after another; the same text at the same place is
    asked once for all its roles. The plan is one person's and short."""
    at = F.array(*(F.struct(F.lit(i).alias("place_no"), F.lit(p).alias("place")) for i, p in enumerate(places)))
    both = variants.withColumn("_p", F.explode(at)).select("role_id", "variant_no", "text", "_p.*")
    order = F.struct("variant_no", "place_no", "role_id")
    merged = both.groupBy(F.lower(F.trim("text")).alias("text"), "place").agg(F.min(order).alias("_at"), F.array_sort(F.collect_set("role_id")).alias("role_ids"))
    out = merged.withColumn("position", F.row_number().over(Window.orderBy("_at", "text"))).where(F.col("position") <= cap)
    return out.select("position", "text", "place", "role_ids", (F.col("position") <= first).alias("priority"))


def best_and_open(rows: DataFrame, key: str, order: list, done: Column, best: int, open_: int) -> DataFrame:
    """Of each key the first ``best`` rows, and the first ``open_`` that
    are not done: place, and open_place among those (null where done)."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    still = F.count_if(~done).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("place", place).withColumn("open_place", F.when(~done, still))
    return out.where((F.col("place") <= best) | (F.col("open_place") <= open_))
