"""Queries of the feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import parse, places
from spindrift.operators import feed
from spindrift.operators.layout import dealt
from spindrift.plans.inputs import COMPANIES, NOW, POSTINGS, now, oracle, relation
from spindrift.plans.registry import query

_JOBS = oracle(postings=POSTINGS, companies=COMPANIES) + f"""
, jobs AS (
  SELECT p.*, c.is_agency, c.is_blocked, p.not_fit_text <> '' AS misfit, p.feed_status <> 'dismissed' AS shown,
    coalesce(coalesce(p.posted_at, p.last_seen_at) < TIMESTAMP '{NOW}' - INTERVAL 30 DAY, false) AS old
  FROM postings p LEFT JOIN companies c ON p.company_id = c.company_id
)"""
_FOR_YOU = "shown AND NOT misfit AND NOT old AND closed_at IS NULL AND NOT coalesce(is_agency, false) AND NOT coalesce(is_blocked, false)"


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings with company flags and their not-fit reasons as an array."""
    rows = relation(spark, sf_dir, POSTINGS).withColumn("not_fit", F.filter(F.split("not_fit_text", ";"), lambda x: x != ""))
    return feed.with_company(rows, relation(spark, sf_dir, COMPANIES))


@query(f"{_JOBS} SELECT job_id, title, sort_score, posted_at FROM jobs WHERE {_FOR_YOU} ORDER BY sort_score DESC NULLS LAST, posted_at DESC NULLS LAST, job_id LIMIT 20")
def feed_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of postings for a user."""
    return feed.page(jobs(spark, sf_dir).where(feed.matching(now())).select("job_id", "title", "sort_score", "posted_at"), 1)


@query(f"{_JOBS} SELECT job_id, provider, posted_at FROM jobs WHERE {_FOR_YOU} AND provider = 'board' AND posted_at >= TIMESTAMP '{NOW}' - INTERVAL 10 DAY")
def feed_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2, F8: a group with provider and date filters."""
    return jobs(spark, sf_dir).where(feed.matching(now(), provider="board", days=10)).select("job_id", "provider", "posted_at")


@query(
    f"""{_JOBS} SELECT user_id, count(*) FILTER ({_FOR_YOU}) AS for_you, count(*) FILTER (feed_status = 'saved') AS saved, count(*) FILTER (shown AND misfit) AS not_fit,
  count(*) FILTER (shown AND old) AS stale, count(*) FILTER (shown AND closed_at IS NOT NULL) AS closed, count(*) FILTER (shown AND coalesce(is_agency, false)) AS agency,
  count(*) FILTER (shown AND coalesce(is_blocked, false)) AS blocked, count(*) FILTER (NOT shown) AS dismissed FROM jobs GROUP BY user_id"""
)
def feed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: all group sizes of every user in one pass."""
    return feed.counts(jobs(spark, sf_dir), now(), "user_id")


@query(f"{_JOBS} SELECT provider AS value, count(*) AS n FROM jobs WHERE shown GROUP BY 1")
def feed_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: providers by number of postings."""
    return feed.facet(jobs(spark, sf_dir).where("feed_status <> 'dismissed'"), "provider")


@query(f"{_JOBS} SELECT user_id, greatest(1, CAST(ceil(count(*) / 20.0) AS BIGINT)) AS pages FROM jobs WHERE feed_status = 'saved' GROUP BY user_id")
def feed_page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of saved postings of each user."""
    return jobs(spark, sf_dir).where(feed.groups(now())["saved"]).groupBy("user_id").agg(feed.page_count(F.count("*")).alias("pages"))


@query(f"{_JOBS} SELECT user_id, count(*) FILTER (misfit) AS hidden, count(*) FILTER (NOT misfit) AS fits FROM jobs GROUP BY 1")
def not_fit_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3, F4, SC1, F1: tests on an array column, counted for each tenant; only
    the columns that are asked for are read."""
    return not_fit_flags(spark, sf_dir).groupBy("user_id").agg(F.count_if("hidden").alias("hidden"), F.count_if("fits").alias("fits"))


@query(f"{_JOBS} SELECT user_id, job_id, misfit AS hidden, NOT misfit AS fits FROM jobs")
def not_fit_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3, F4, SC1: tests on an array column, for every tenant."""
    return jobs(spark, sf_dir).select("user_id", "job_id", (F.size("not_fit") > 0).alias("hidden"), (F.size("not_fit") == 0).alias("fits"))


@query(
    f"""{_JOBS} SELECT job_id, closed_at IS NULL AND TIMESTAMP '{NOW}' > last_seen_at AND last_seen_at < TIMESTAMP '{NOW}' - INTERVAL 14 DAY AS not_seen,
  coalesce(last_seen_at > posted_at + INTERVAL 19 DAY, false) AS is_new FROM jobs"""
)
def seen_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """not seen lately, and new since the last look."""
    return jobs(spark, sf_dir).select("job_id", feed.not_seen(now(), now()).alias("not_seen"), feed.is_new(F.col("posted_at") + F.expr("INTERVAL 19 DAYS"), F.col("last_seen_at")).alias("is_new"))


@query(f"{_JOBS} SELECT job_id, title, provider FROM jobs WHERE contains(lower(title || ' ' || provider), 'data') ORDER BY job_id LIMIT 50 OFFSET 50")
def table_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """second page of the rows that hold a substring."""
    rows = jobs(spark, sf_dir).select("job_id", "title", "provider")
    return feed.search_table(rows, "Data", ["title", "provider"], "job_id", 2)


@query(f"{_JOBS} SELECT job_id, title FROM jobs WHERE job_id > 1000 AND user_id = 5 ORDER BY job_id LIMIT 200")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC2: the next 200 postings after an id."""
    return jobs(spark, sf_dir).where("job_id > 1000 AND user_id = 5").select("job_id", "title").orderBy("job_id").limit(200)


@query(f"{_JOBS} SELECT job_id, sort_score FROM jobs WHERE feed_status = 'saved' ORDER BY sort_score ASC NULLS FIRST, job_id LIMIT 25")
def oldest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: ascending with nulls first."""
    return jobs(spark, sf_dir).where("feed_status = 'saved'").select("job_id", "sort_score").orderBy(F.asc_nulls_first("sort_score"), "job_id").limit(25)


@query()
def prepared_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that is read out of a posting, in one projection."""
    from spindrift.operators.prepare import prepare

    rows = prepare(dealt(relation(spark, sf_dir, POSTINGS)))
    return rows.select("job_id", "company", "company_key", "city", "work_mode", "title_key", "description_hash", "staffing", "salary.min_annual", "salary.max_annual", "salary.currency", "salary.disclosed", "experience.min_years", "experience.max_years", "seniority", "conditions.notice_max_days", "conditions.bond", "conditions.office_days", "n_keys")


_CITY = """CASE WHEN regexp_matches(f, '^(remote|work from home|wfh|anywhere)') THEN 'Remote-India' WHEN f IN ('bengaluru', 'bangalore') THEN 'Bengaluru' WHEN f IN ('gurgaon', 'gurugram') THEN 'Gurugram'
  WHEN f IN ('navi mumbai', 'mumbai') THEN 'Mumbai' WHEN f IN ('delhi', 'delhi ncr') THEN 'Delhi' WHEN f = 'pune' THEN 'Pune' WHEN f = 'trivandrum' THEN 'Thiruvananthapuram' WHEN f = 'new york' THEN 'New York' WHEN f LIKE 'location:%' THEN 'Location: Chennai; Madras' END"""


@query(f"{_JOBS}, firsts AS (SELECT job_id, trim(lower(regexp_extract(location, '^[^,(/|]*'))) AS f FROM jobs) SELECT job_id, {_CITY} AS city FROM firsts")
def canonical_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One spelling for each city."""
    return relation(spark, sf_dir, POSTINGS).select("job_id", places.canonical_city(F.col("location")).alias("city"))


@query(
    f"""{_JOBS} SELECT job_id, CASE job_id % 14 WHEN 0 THEN 800000 WHEN 1 THEN 1000000 WHEN 2 THEN 1440000 WHEN 3 THEN 1800000 WHEN 4 THEN 90000 WHEN 6 THEN 1200000 WHEN 7 THEN 1000000 WHEN 8 THEN 93600 WHEN 9 THEN 12000000 WHEN 10 THEN 70000 WHEN 13 THEN 3000000 END::BIGINT AS min_annual,
  CASE job_id % 14 WHEN 0 THEN 1200000 WHEN 1 THEN 1600000 WHEN 2 THEN 1920000 WHEN 3 THEN 2400000 WHEN 4 THEN 90000 WHEN 6 THEN 1500000 WHEN 7 THEN 1200000 WHEN 8 THEN 124800 WHEN 9 THEN 12000000 WHEN 10 THEN 70000 WHEN 13 THEN 3000000 END::BIGINT AS max_annual,
  CASE job_id % 14 WHEN 4 THEN 'USD' WHEN 5 THEN NULL WHEN 8 THEN 'USD' WHEN 10 THEN 'EUR' WHEN 11 THEN NULL WHEN 12 THEN NULL ELSE 'INR' END AS currency, job_id % 14 NOT IN (5, 11, 12) AS disclosed FROM jobs"""
)
def salaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pay as annual amounts."""
    return dealt(relation(spark, sf_dir, POSTINGS)).select("job_id", parse.salary(F.col("salary_text")).alias("s")).select("job_id", "s.*")


@query(f"{_JOBS} SELECT job_id, CASE job_id % 7 WHEN 0 THEN 3.0 WHEN 1 THEN 4.0 WHEN 2 THEN 8.0 WHEN 3 THEN 0.0 WHEN 4 THEN 6.0 WHEN 6 THEN 2.0 END::DOUBLE AS min_years, CASE job_id % 7 WHEN 0 THEN 5.0 WHEN 3 THEN 1.0 WHEN 4 THEN 6.0 WHEN 6 THEN 4.0 END::DOUBLE AS max_years FROM jobs")
def experience_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: years of experience asked for."""
    return dealt(relation(spark, sf_dir, POSTINGS)).select("job_id", parse.experience(F.col("description")).alias("e")).select("job_id", "e.*")


@query(
    f"""{_JOBS} SELECT job_id, CASE job_id % 7 WHEN 0 THEN 30 WHEN 1 THEN 15 WHEN 6 THEN 14 END::INT AS notice_max_days, job_id % 7 = 1 AS immediate, job_id % 7 = 2 AS bond, CASE WHEN job_id % 7 = 1 THEN 'night' END AS shift,
  job_id % 7 = 3 AS contract_to_hire, CASE job_id % 7 WHEN 2 THEN 5 WHEN 3 THEN 3 END::INT AS office_days FROM jobs"""
)
def posting_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions of a posting."""
    return dealt(relation(spark, sf_dir, POSTINGS)).select("job_id", parse.conditions(F.col("description")).alias("c")).select("job_id", "c.*")
