"""Feed: groups, filters, counts, facets and pages of postings."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce
from operator import and_
from urllib.parse import parse_qs

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUPS = ("for_you", "saved", "not_fit", "stale", "closed", "agency", "blocked", "dismissed")
STALE_DAYS, PAGE = 30, 20


def _sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def stale(now: Column) -> Column:
    """posted, or without a date last seen, over 30 days ago."""
    return _sure(F.coalesce("posted_at", "last_seen_at") < now - F.expr(f"INTERVAL {STALE_DAYS} DAYS"))


def groups(now: Column) -> dict[str, Column]:
    """the condition of every group; hidden groups may overlap."""
    shown = F.col("feed_status") != "dismissed"
    agency, blocked = _sure(F.col("is_agency")), _sure(F.col("is_blocked"))
    misfit = F.size("not_fit") > 0
    return {
        "for_you": shown & ~misfit & ~stale(now) & F.col("closed_at").isNull() & ~agency & ~blocked, "saved": F.col("feed_status") == "saved", "not_fit": shown & misfit,
        "stale": shown & stale(now), "closed": shown & F.col("closed_at").isNotNull(), "agency": shown & agency, "blocked": shown & blocked, "dismissed": F.col("feed_status") == "dismissed",
    }


def with_company(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """A posting's company flags; null where it has no company."""
    return jobs.join(companies.select("company_id", "is_agency", "is_blocked"), "company_id", "left")


def matching(now: Column, group: str = "for_you", city: str | None = None, mode: str | None = None, days: int | None = None, provider: str | None = None, least_pay: int | None = None) -> Column:
    """F8: conjunction of a group and whichever filters are given."""
    found = [groups(now)[group]]
    if city is not None:
        found.append(F.col("city") == city)
    if mode is not None:
        found.append(F.col("work_mode") == mode)
    if days is not None:
        found.append(F.col("posted_at") >= now - F.expr(f"INTERVAL {int(days)} DAYS"))
    if provider is not None:
        found.append(F.col("provider") == provider)
    if least_pay is not None:
        found.append(F.col("salary.disclosed") & (F.col("salary.max_annual") >= least_pay))
    return reduce(and_, found)


def counts(jobs: DataFrame, now: Column, *keys: str) -> DataFrame:
    """A2: the size of every group, in one pass."""
    return jobs.groupBy(*keys).agg(*(F.count_if(c).alias(name) for name, c in groups(now).items()))


def page(jobs: DataFrame, number: int, size: int = PAGE) -> DataFrame:
    """A page by score, then date, both descending with nulls last, then id."""
    return jobs.orderBy(F.desc_nulls_last("sort_score"), F.desc_nulls_last("posted_at"), "job_id").offset((number - 1) * size).limit(size)


def page_count(total: Column, size: int = PAGE) -> Column:
    """T10."""
    return F.greatest(F.lit(1), F.ceil(total / size)).cast("long")


def facet(jobs: DataFrame, column: str) -> DataFrame:
    """A5: values of a column by descending count, then value."""
    return jobs.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def parse_query(text: str) -> dict:
    """filters of a URL query; what is invalid is dropped. Pay is given in lakhs."""
    given = {k: v[0] for k, v in parse_qs(text).items()}
    out: dict = {"group": given.get("group") if given.get("group") in GROUPS else "for_you", "page": 1}
    for name, known in (("mode", ("remote", "hybrid", "onsite")), ("provider", None), ("city", None)):
        if given.get(name) and (known is None or given[name] in known):
            out[name] = given[name]
    for name, key, scale in (("posted", "days", 1), ("salary", "least_pay", 100_000), ("page", "page", 1)):
        if given.get(name, "").isdigit() and int(given[name]) > 0:
            out[key] = int(given[name]) * scale
    return out


def any_filter(filters: dict) -> bool:
    """anything but group and page is set."""
    return bool(set(filters) - {"group", "page"})


def not_seen(now: Column, last_search: Column, days: int = 14) -> Column:
    """open, searched for since, but not seen for two weeks."""
    return F.col("closed_at").isNull() & _sure(last_search > F.col("last_seen_at")) & _sure(F.col("last_seen_at") < now - F.expr(f"INTERVAL {days} DAYS"))


def is_new(seen_at: Column, found_at: Column) -> Column:
    """found after the user last looked."""
    return _sure(found_at > seen_at)


def search_table(rows: DataFrame, text: str, columns: list[str], order: str, number: int, size: int = 50) -> DataFrame:
    """rows with a substring in any column, ordered and paged."""
    joined = F.lower(F.concat_ws(" ", *(F.col(c).cast("string") for c in columns)))
    return rows.where(F.contains(joined, F.lit(text.lower()))).orderBy(order, *columns).offset((number - 1) * size).limit(size)


def cutoff(now: datetime, days: int) -> datetime:
    return now - timedelta(days=days)


def filters_of(query: Column) -> Column:
    """filters of a URL query as a struct; what is missing or invalid
    is null, group and page have defaults, pay is given in lakhs. any_filter:
    one is set besides group and page."""
    given = F.str_to_map(query, F.lit("&"), F.lit("="))
    value = lambda name: F.nullif(F.try_element_at(given, F.lit(name)), F.lit(""))
    number = lambda name: F.when(value(name).rlike(r"^\d{1,9}$") & (value(name).try_cast("long") > 0), value(name).try_cast("long"))
    among = lambda name, known: F.when(value(name).isin(*known), value(name))
    own = {"mode": among("mode", ("remote", "hybrid", "onsite")), "city": value("city"), "provider": value("provider"), "days": number("posted"), "least_pay": number("salary") * 100_000}
    some = F.coalesce(*(v.cast("string") for v in own.values())).isNotNull()
    return F.struct(F.coalesce(among("group", GROUPS), F.lit("for_you")).alias("group"), F.coalesce(number("page"), F.lit(1)).cast("long").alias("page"), *(v.alias(k) for k, v in own.items()), some.alias("any_filter"))
