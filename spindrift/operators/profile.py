"""Profiles, catalogues and run bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.text import skill_key
from spindrift.operators.history import islands

# Names that need a capitalised whole word, and how failures are told apart.
AMBIGUOUS = ("go", "r", "c", "express", "spring", "swift", "rust", "dart", "ember", "less", "jest", "make")


def skill_usage(spans: DataFrame, now_month: Column) -> DataFrame:
    """Of each person and skill (person_id, skill_id, role_id, from_month,
    to_month; null: still): months of use counted once, the last year of use
    and the number of roles."""
    rows = spans.withColumn("to_month", F.coalesce("to_month", now_month)).withColumn("_key", F.struct("person_id", "skill_id"))
    months = islands(rows, "_key", "from_month", "to_month").groupBy("_key").agg(F.sum(F.col("to_month") - F.col("from_month") + 1).alias("months"))
    other = rows.groupBy("_key").agg(F.floor(F.max("to_month") / 12).cast("int").alias("last_year"), F.countDistinct("role_id").alias("roles"))
    return months.join(other, "_key").select("_key.person_id", "_key.skill_id", "months", "last_year", "roles")


def mentions_named(text: Column, keys: Column, name: str) -> Column:
    """A catalogue skill occurs; short and everyday names count only as a
    capitalised whole word."""
    key = "".join(c for c in name.lower() if c.isalnum() or c in "#+")
    if key in AMBIGUOUS or len(key) <= 2:
        plain = "".join("\\" + c if c in ".*+?^${}()|[]\\" else c for c in name)
        return text.rlike(f"(^|[^A-Za-z0-9]){plain}($|[^A-Za-z0-9#+])") & F.lit(name[:1].isupper())
    return F.array_contains(keys, key) | F.array_contains(keys, key + "js")


def catalogue_faults(catalogue: DataFrame) -> DataFrame:
    """keys that several catalogue entries (skill_id, name, aliases) claim."""
    names = catalogue.select("skill_id", F.explode(F.concat(F.array("name"), "aliases")).alias("_n"))
    keyed = names.select("skill_id", skill_key(F.col("_n")).alias("key"))
    return keyed.groupBy("key").agg(F.countDistinct("skill_id").alias("owners")).where("owners > 1")


def due(now: Column) -> Column:
    """an active site whose next check is open or past."""
    return F.col("status").isin("active", "pending") & F.coalesce(F.col("next_check") <= now, F.lit(True))


def active_run(now: Column) -> Column:
    """F16: a run that is not over and started within a day."""
    return F.col("status").isin("running", "pending") & (F.col("started_at") >= now - F.expr("INTERVAL 24 HOURS"))


def top_reasons(parts: Column, k: int = 3) -> Column:
    """Keys of the known parts (key, value, points, neutral) of value 0.6
    at least, by points."""
    good = F.filter(parts, lambda p: (p["value"] >= 0.6) & ~p["neutral"])
    ordered = F.array_sort(F.transform(good, lambda p: F.struct((-p["points"]).alias("s"), p["key"].alias("key"))))
    return F.transform(F.slice(ordered, 1, k), lambda p: p["key"])


def top_gap(parts: Column) -> Column:
    """The key of the part under 0.5 that lost most points (key, value, lost)."""
    bad = F.filter(parts, lambda p: (p["value"] < 0.5) & ~p["neutral"])
    ordered = F.array_sort(F.transform(bad, lambda p: F.struct((-p["lost"]).alias("s"), p["key"].alias("key"))))
    return F.get(ordered, F.lit(0))["key"]


def failure_kind(status: Column, body: Column) -> Column:
    """What a response of a provider means."""
    return (
        F.when(status.between(200, 299), "ok").when(status.isin(401, 403), "auth").when((status == 402) | ((status == 429) & F.lower(body).rlike("quota|credit|exhausted|monthly")), "quota")
        .when(status == 429, "rate").when((status >= 500) | status.isNull(), "error").otherwise("invalid")
    )


def retry_seconds(header: Column, now: Column) -> Column:
    """A Retry-After header in seconds: a number, or a date."""
    written = F.regexp_extract(header, r"(\d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) GMT", 1)
    when = F.to_utc_timestamp(F.try_to_timestamp(written, F.lit("dd MMM yyyy HH:mm:ss")), F.current_timezone())
    return F.when(header.rlike(r"^\s*\d+\s*$"), F.trim(header).cast("long")).otherwise(F.greatest(F.lit(0), F.unix_timestamp(when) - F.unix_timestamp(now)))


def roles_for_title(matches: DataFrame, roles: DataFrame) -> DataFrame:
    """The roles a posting's title matches (job_id, user_id, role_id), else
    all roles of its user."""
    some = matches.where("role_id is not null").groupBy("job_id").agg(F.array_sort(F.collect_set("role_id")).alias("_own"))
    every = roles.groupBy("user_id").agg(F.array_sort(F.collect_set("role_id")).alias("_all"))
    return matches.select("job_id", "user_id").distinct().join(some, "job_id", "left").join(every, "user_id", "left").select("job_id", F.coalesce("_own", "_all").alias("role_ids"))


def better_pass(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Of two extraction passes (keys, value, grounded) the one with more
    grounded items; of equals the first."""
    both = first.withColumn("_p", F.lit(0)).unionByName(second.withColumn("_p", F.lit(-1)))
    return both.groupBy(*keys).agg(F.max_by(F.struct("value", "grounded"), F.struct("grounded", "_p")).alias("r")).select(*keys, "r.*")


def section_counts(draft: Column, names: list[str]) -> Column:
    """Entries in each section of a nested draft."""
    return F.struct(*(F.when(draft[n].isNull(), 0).otherwise(F.size(draft[n])).alias(n) for n in names))


def overview(sections: dict[str, DataFrame], key: str) -> DataFrame:
    """A25, SC4: entries of each owner in each section, a table a section. Each
    is counted before they meet; an owner without entries has 0."""
    counted = None
    for name, rows in sections.items():
        own = rows.groupBy(key).agg(F.count("*").alias("n")).withColumn("_s", F.lit(name))
        counted = own if counted is None else counted.unionByName(own)
    return counted.groupBy(key).agg(*(F.coalesce(F.sum(F.when(F.col("_s") == name, F.col("n"))), F.lit(0)).alias(name) for name in sections))
