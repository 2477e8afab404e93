"""Postings, profiles and applications made from the star-schema tables.

The statements are plain SQL that Spark and DuckDB both read, so a query and
its oracle start from the same rows. Nulls and odd spellings are put in here.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators.layout import dealt, spread

#: The time that every query takes as "now".
NOW = "2001-08-02 12:00:00"


def cases(key: str, values: list[str | None]) -> str:
    """A CASE that deals values out by a key."""
    quoted = ["NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values]
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(quoted)) + " END"


TITLES = ["Senior React.js Developer", "React Developer", "SDE II", "SDE 2 Backend", "Data Engineer", "Sr Data Engineer", "ML Engineer Intern", "Lead Platform Architect", "QA Analyst", "Junior Front-end Engineer", "Full stack developer III"]
LOCATIONS = ["Bangalore, Karnataka", "Bengaluru", "Gurgaon / Delhi", "Navi Mumbai", "Remote, India", "Pune (Hybrid)", "Delhi NCR", "New York, US", None, "Trivandrum|Kochi", "Remote - Europe", "Location: Chennai; Madras"]
PAY = ["8-12 LPA", "₹10,00,000 - ₹16,00,000 a year", "₹1,20,000 - ₹1,60,000 a month", "₹18L – ₹24L a year", "$90,000", "Not disclosed", "12-15", "10L - 12", "$45 - $60 per hour", "1.2 Cr", "€70k", None, "Competitive", "upto 30 lakhs"]
ABOUT = [
    "3-5 years of experience. Python, SQL and Apache Spark. Notice period up to 30 days.",
    "Minimum 4 years. Kafka, React.js and Node.js. Immediate joiners only; night shift.",
    "8+ years leading teams. Service bond of one year. Work from office.",
    "Fresher or 0-1 year. 3 days a week in the office. Contract to hire.",
    "Experience: 6 years in Java, Spring and PostgreSQL. Fully remote.",
    "We build tools for everyone, on-site.",
    "2 to 4 yrs with TypeScript. Notice period of 2 weeks. Hybrid.",
]
ENDINGS = [" Pvt Ltd", " Technologies Private Limited", ", Inc.", " Solutions", "", " Staffing Services LLP", " India Pvt. Ltd."]

POSTINGS = f"""
SELECT o_orderkey AS job_id, c_nationkey AS user_id, CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_custkey END AS company_id,
  replace(c_name, '#', ' ') || {cases("o_custkey", ENDINGS)} AS company_name, {cases("o_orderkey", ["board", "feed", "search", "site"])} AS provider,
  'x' || CAST(o_orderkey % 5000 AS VARCHAR(20)) AS external_id, {cases("o_orderkey", TITLES)} AS title, {cases("o_orderkey", LOCATIONS)} AS location,
  {cases("o_orderkey", PAY)} AS salary_text, {cases("o_orderkey", ABOUT)} AS description,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate END AS posted_at, o_orderdate + INTERVAL 20 DAY AS last_seen_at,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 7 = 0 THEN o_orderdate + INTERVAL 40 DAY END AS closed_at,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'saved' WHEN o_orderpriority = '5-LOW' THEN 'dismissed' ELSE 'new' END AS feed_status,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(floor(o_totalprice / 5000) AS INT) END AS sort_score,
  CASE WHEN o_orderkey % 5 = 0 THEN 'Lead-level role.;Service bond.' WHEN o_orderkey % 9 = 0 THEN 'Service bond.' ELSE '' END AS not_fit_text
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey
"""

COMPANIES = "SELECT c_custkey AS company_id, c_name AS name, c_nationkey AS user_id, c_custkey % 17 = 0 AS is_agency, c_custkey % 23 = 0 AS is_blocked FROM {customer}"

#: Moves of applications between stages, one per event.
MOVES = f"""
SELECT event_id, user_id * 7 + event_id % 7 AS application_id, ts AS occurred_at,
  CASE event_type WHEN 'signup' THEN 'APPLIED' WHEN 'view' THEN 'RECRUITER_CONTACT' WHEN 'click' THEN 'INTERVIEW' WHEN 'purchase' THEN 'OFFER' ELSE {cases("event_id", ["REJECTED", "WITHDRAWN", "GHOSTED", "ASSESSMENT"])} END AS status
FROM {{events}}
"""

#: Employment spans of a customer: each order starts one of 10 to 200 days.
SPANS = "SELECT o_custkey AS person_id, o_orderkey AS span_id, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INT) AS from_month, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 + o_orderkey % 7 AS INT) AS to_month FROM {orders}"

_NAMED = re.compile(r"\{(\w+)\}")


def relation(spark: SparkSession, sf_dir: str, statement: str) -> DataFrame:
    """Rows of a statement whose {tables} are those of a folder."""
    return spark.sql(statement, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(_NAMED.findall(statement))})


def relation_of(spark: SparkSession, sf_dir: str, statement: str, table_: str, *columns: str) -> DataFrame:
    """Rows of a statement over columns of one table, dealt out first, since its
    rows cost much more to work on than to read."""
    rows = dealt(table(spark, sf_dir, table_).select(*columns))
    return spark.sql(statement, **{table_: rows})


def oracle(**ctes: str) -> str:
    """WITH clause of named statements, for DuckDB."""
    return "WITH " + ", ".join(f"{name} AS ({_NAMED.sub(lambda m: m[1], text)})" for name, text in ctes.items())


def heavy(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows cost much to work on."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now() -> F.Column:
    return F.lit(NOW).cast("timestamp")
