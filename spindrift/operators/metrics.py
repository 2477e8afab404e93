"""Aggregates: shares, medians, counters and quality ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.text import round_half_up

IMPORTANCE = {"required": 3.0, "preferred": 1.5, "nice": 1.0, "other": 0.5}


def rate(hits: Column, total: Column) -> Column:
    """Share, 1 where there is nothing to find."""
    return F.when(total == 0, 1.0).otherwise(hits / total)


def midpoint(low: Column, high: Column) -> Column:
    """Middle of a range, or its one end; null unless positive."""
    middle = F.coalesce((low + high) / 2, low.cast("double"), high.cast("double"))
    return F.when(middle > 0, middle)


def pay_context(rows: DataFrame, keys: list[str], value: Column, least: int = 5) -> DataFrame:
    """Number, least, exact median and most of a value, where there are enough."""
    out = rows.withColumn("_v", value).where("_v is not null").groupBy(*keys)
    return out.agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.median("_v").alias("median"), F.max("_v").alias("high")).where(F.col("n") >= least)


def weighted_mean(value: Column, weight: Column) -> Column:
    """A11."""
    return F.sum(value * weight) / F.sum(weight)


def importance_weight(importance: Column) -> Column:
    weights = F.create_map(*(F.lit(x) for pair in IMPORTANCE.items() for x in pair))
    return F.coalesce(F.try_element_at(weights, importance), F.lit(IMPORTANCE["other"]))


def map_sums(rows: DataFrame, column: str) -> DataFrame:
    """Sum of each key over the maps of all rows."""
    return rows.select(F.explode(column).alias("key", "value")).groupBy("key").agg(F.sum("value").alias("total"))


def confidence(n: Column) -> Column:
    """How far a sample of n can be trusted."""
    return F.when(n < 5, "insufficient").when(n < 15, "low").when(n < 40, "medium").otherwise("high")


def role_market(jobs: DataFrame, roles: str, score: str, skills: str) -> DataFrame:
    """For each role: openings, rounded mean score, and the skill most
    often missing (twice at least; of equals the first by name)."""
    by_role = jobs.select(F.explode(F.array_distinct(roles)).alias("role_id"), score, skills)
    stats = by_role.groupBy("role_id").agg(F.count("*").alias("openings"), round_half_up(F.avg(score)).cast("long").alias("mean_score"))
    gaps = by_role.select("role_id", F.explode(skills).alias("skill")).groupBy("role_id", "skill").agg(F.count("*").alias("n")).where("n > 1")
    first = gaps.groupBy("role_id").agg(F.min_by("skill", F.struct(-F.col("n"), F.col("skill"))).alias("top_gap"))
    return stats.join(first, "role_id", "left")


def extraction_recall(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Per job, the share of expected requirements that were found, and of
    these the share with the right importance."""
    seen = found.select(*keys, F.col("importance").alias("_found")).dropDuplicates(keys)
    both = expected.join(seen, keys, "left")
    hit = F.col("_found").isNotNull()
    return both.groupBy(keys[0]).agg(rate(F.count_if(hit), F.count("*")).alias("recall"), rate(F.count_if(hit & (F.col("_found") == F.col("importance"))), F.count_if(hit)).alias("importance_accuracy"))


def missed_targets(scores: DataFrame, targets: DataFrame) -> DataFrame:
    """Metrics (name, value) under their target."""
    return scores.join(targets, "name").where(F.col("value") < F.col("target"))


def citation_validity(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per report, the share of cited evidence ids that exist."""
    cited = claims.select("report_id", F.explode("evidence_ids").alias("evidence_id"))
    known = evidence.select("report_id", "evidence_id", F.lit(1).alias("_known")).distinct()
    return cited.join(known, ["report_id", "evidence_id"], "left").groupBy("report_id").agg(F.count("*").alias("cited"), F.count("_known").alias("valid"))


def period_counts(events: DataFrame, at: str, *keys: str) -> DataFrame:
    """SK5, A26, ST7: events per UTC minute, day and month, in one pass."""
    periods = F.array(*(F.struct(F.lit(p).alias("period"), F.date_trunc(p, F.col(at)).alias("start")) for p in ("minute", "day", "month")))
    return events.select(*keys, F.explode(periods).alias("p")).groupBy(*keys, "p.period", "p.start").agg(F.count("*").alias("n"))


def rolling_count(key: str, at: str, seconds: int) -> Column:
    """ST13: events of a key in the seconds up to each one."""
    order = Window.partitionBy(key).orderBy(F.unix_seconds(F.col(at).cast("timestamp"))).rangeBetween(-seconds, 0)
    return F.count("*").over(order)


def wilson(hits: Column, n: Column, z: float = 1.96) -> Column:
    """Beyond the inventory: 95 % interval of a share, as struct(low, high)."""
    p, zz = hits / n, z * z
    middle, spread = (p + zz / (2 * n)) / (1 + zz / n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return F.struct(F.greatest(F.lit(0.0), middle - spread).alias("low"), F.least(F.lit(1.0), middle + spread).alias("high"))


def count_where(condition: Column) -> Column:
    """A1, A10: rows that meet a condition; unknown ones don't."""
    return F.count_if(F.coalesce(condition, F.lit(False)))
