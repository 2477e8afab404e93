"""Postings from provider and board responses (JSON text) as one shape.

A response table has ``source_id``, ``company`` and ``body`` (JSON). Readers
declare the schema they need, so a malformed body gives no rows, and map to:
provider, external_id, title, company, location, description, truncated,
salary_text, posted_at, apply_url, mode_hint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.parse import relative_date
from spindrift.functions.places import is_fresh, location_matches, title_matches
from spindrift.functions.text import decode_entities, html_to_text

COLUMNS = ("provider", "external_id", "title", "company", "location", "description", "truncated", "salary_text", "posted_at", "apply_url", "mode_hint")
_TEXT, _NO = "string", lambda: F.lit(None).cast("string")


def _read(responses: DataFrame, schema: str, path: str) -> DataFrame:
    rows = responses.withColumn("_b", F.from_json("body", schema, {"mode": "PERMISSIVE"}))
    return rows.select("*", F.explode(F.col(f"_b.{path}")).alias("j"))


def _shape(rows: DataFrame, provider: str, **columns: Column) -> DataFrame:
    given = {"provider": F.lit(provider), "truncated": F.lit(False), "salary_text": _NO(), "posted_at": F.lit(None).cast("timestamp"), "mode_hint": _NO(), **columns}
    return rows.select(*(given[c].alias(c) for c in COLUMNS)).where(F.col("title").isNotNull() & F.col("external_id").isNotNull())


def paged_api(responses: DataFrame) -> DataFrame:
    """SC5: an API with cut descriptions and pay as numbers."""
    schema = "results array<struct<id:string,title:string,company:struct<display_name:string>,location:struct<display_name:string>,description:string,salary_min:double,salary_max:double,created:string,redirect_url:string>>"
    j = _read(responses, f"{schema}", "results")
    pay = F.when(F.col("j.salary_min").isNotNull(), F.format_string("%d - %d a year", F.col("j.salary_min").cast("long"), F.coalesce("j.salary_max", "j.salary_min").cast("long")))
    return _shape(j, "paged", external_id=F.col("j.id"), title=html_to_text(F.col("j.title")), company=F.col("j.company.display_name"), location=F.col("j.location.display_name"), description=html_to_text(F.col("j.description")), truncated=F.lit(True), salary_text=pay, posted_at=F.try_to_timestamp("j.created"), apply_url=F.col("j.redirect_url"))


def snippet_api(responses: DataFrame) -> DataFrame:
    """SC6: an API with HTML snippets."""
    j = _read(responses, "jobs array<struct<id:string,title:string,company:string,location:string,snippet:string,salary:string,updated:string,link:string>>", "jobs")
    return _shape(j, "snippet", external_id=F.col("j.id"), title=F.col("j.title"), company=F.col("j.company"), location=F.col("j.location"), description=html_to_text(F.col("j.snippet")), truncated=F.lit(True), salary_text=F.nullif(F.col("j.salary"), F.lit("")), posted_at=F.try_to_timestamp("j.updated"), apply_url=F.col("j.link"))


def relative_api(responses: DataFrame, now: Column) -> DataFrame:
    """SC7, D10: an API that dates postings as "3 days ago"."""
    schema = "jobs_results array<struct<job_id:string,title:string,company_name:string,location:string,description:string,detected_extensions:struct<posted_at:string,salary:string,work_from_home:boolean>,apply_options:array<struct<link:string>>>>"
    j = _read(responses, schema, "jobs_results")
    return _shape(j, "relative", external_id=F.col("j.job_id"), title=F.col("j.title"), company=F.col("j.company_name"), location=F.col("j.location"), description=F.col("j.description"), salary_text=F.col("j.detected_extensions.salary"), posted_at=relative_date(F.col("j.detected_extensions.posted_at"), now), apply_url=F.get("j.apply_options", F.lit(0))["link"], mode_hint=F.when(F.col("j.detected_extensions.work_from_home"), "remote"))


def encoded_board(responses: DataFrame) -> DataFrame:
    """SC10: a board whose descriptions are HTML with its marks encoded."""
    j = _read(responses, "jobs array<struct<id:string,title:string,location:struct<name:string>,content:string,updated_at:string,absolute_url:string>>", "jobs")
    return _shape(j, "encoded", external_id=F.col("j.id"), title=F.col("j.title"), company=F.col("company"), location=F.col("j.location.name"), description=html_to_text(decode_entities(F.col("j.content"))), posted_at=F.try_to_timestamp("j.updated_at"), apply_url=F.col("j.absolute_url"))


def sectioned_board(responses: DataFrame) -> DataFrame:
    """SC11: a board (a JSON array) with its description in sections."""
    wrapped = responses.withColumn("body", F.concat(F.lit('{"jobs":'), F.col("body"), F.lit("}")))
    j = _read(wrapped, "jobs array<struct<id:string,text:string,categories:struct<location:string,commitment:string>,descriptionPlain:string,lists:array<struct<text:string,content:string>>,createdAt:long,hostedUrl:string,workplaceType:string>>", "jobs")
    lists = F.transform(F.coalesce("j.lists", F.array().cast("array<struct<text:string,content:string>>")), lambda x: F.concat(F.coalesce(x["text"], F.lit("")), F.lit("\n"), html_to_text(F.coalesce(x["content"], F.lit("")))))
    return _shape(j, "sectioned", external_id=F.col("j.id"), title=F.col("j.text"), company=F.col("company"), location=F.col("j.categories.location"), description=F.concat_ws("\n", F.col("j.descriptionPlain"), F.array_join(lists, "\n")), posted_at=F.timestamp_millis("j.createdAt"), apply_url=F.col("j.hostedUrl"), mode_hint=F.when(F.col("j.workplaceType").isin("remote", "hybrid", "onsite"), F.col("j.workplaceType")))


def listed_board(responses: DataFrame) -> DataFrame:
    """SC12: a board that marks unlisted postings; these are dropped."""
    j = _read(responses, "jobs array<struct<id:string,title:string,location:string,descriptionPlain:string,isListed:boolean,isRemote:boolean,publishedAt:string,jobUrl:string>>", "jobs").where("coalesce(j.isListed, true)")
    return _shape(j, "listed", external_id=F.col("j.id"), title=F.col("j.title"), company=F.col("company"), location=F.col("j.location"), description=F.col("j.descriptionPlain"), posted_at=F.try_to_timestamp("j.publishedAt"), apply_url=F.col("j.jobUrl"), mode_hint=F.when(F.col("j.isRemote"), "remote"))


def detailed_board(responses: DataFrame, details: DataFrame, wanted: Column) -> DataFrame:
    """SC13: a board with a list and details (external_id, description); only
    the wanted rows of the list are enriched."""
    j = _read(responses, "content array<struct<id:string,name:string,location:struct<city:string,country:string,remote:boolean>,releasedDate:string>>", "content")
    rows = _shape(j, "detailed", external_id=F.col("j.id"), title=F.col("j.name"), company=F.col("company"), location=F.concat_ws(", ", "j.location.city", "j.location.country"), description=_NO(), posted_at=F.try_to_timestamp("j.releasedDate"), apply_url=_NO(), mode_hint=F.when(F.col("j.location.remote"), "remote"))
    own = details.select("external_id", F.col("description").alias("_d"))
    return rows.where(wanted).join(own, "external_id", "left").withColumn("description", html_to_text(F.coalesce("_d", F.lit("")))).select(*COLUMNS)


def published_board(responses: DataFrame) -> DataFrame:
    """SC14: a board with states and several places."""
    j = _read(responses, "offers array<struct<id:string,title:string,status:string,description:string,requirements:string,locations:array<struct<city:string,country:string>>,published_at:string,careers_url:string,remote:boolean>>", "offers").where("j.status = 'published'")
    places = F.array_join(F.transform("j.locations", lambda x: F.concat_ws(", ", x["city"], x["country"])), " | ")
    return _shape(j, "published", external_id=F.col("j.id"), title=F.col("j.title"), company=F.col("company"), location=places, description=html_to_text(F.concat_ws("\n", "j.description", "j.requirements")), posted_at=F.try_to_timestamp("j.published_at"), apply_url=F.col("j.careers_url"), mode_hint=F.when(F.col("j.remote"), "remote"))


READERS: dict[str, Callable[[DataFrame], DataFrame]] = {"paged": paged_api, "snippet": snippet_api, "encoded": encoded_board, "sectioned": sectioned_board, "listed": listed_board, "published": published_board}


def read_all(responses: DataFrame) -> DataFrame:
    """SC15, U6: responses of every kind (column ``kind``) as one table."""
    out = None
    for kind, reader in READERS.items():
        rows = reader(responses.where(F.col("kind") == kind))
        out = rows if out is None else out.unionByName(rows)
    return out


def wanted(variants: Column, cities: Column, remote_ok: Column, now: Column) -> Column:
    """title, place and date all suit."""
    return title_matches(F.col("title"), variants) & location_matches(F.coalesce("location", F.lit("")), F.col("mode_hint"), cities, remote_ok) & is_fresh(F.col("posted_at"), now)


def synthetic(spark, n: int) -> DataFrame:
    """SC8: n deterministic postings; every sixth nearly repeats its neighbour."""
    base = spark.range(n).select((F.col("id") - F.when(F.col("id") % 6 == 5, 1).otherwise(0)).alias("k"), "id")
    titles = F.array(*(F.lit(t) for t in ("Data Engineer", "React Developer", "Platform Engineer", "QA Analyst", "ML Engineer")))
    cities = F.array(*(F.lit(c) for c in ("Bengaluru", "Pune", "Remote, India", "Hyderabad")))
    return base.select(
        F.lit("synthetic").alias("provider"), F.concat(F.lit("s"), F.col("id")).alias("external_id"), F.get(titles, (F.col("k") % 5).cast("int")).alias("title"), F.concat(F.lit("Company "), F.col("k") % 40).alias("company"),
        F.get(cities, (F.col("k") % 4).cast("int")).alias("location"), F.concat(F.lit("Posting "), F.col("k"), F.lit(": 2-4 years of SQL and Spark."), F.when(F.col("id") != F.col("k"), "  Apply!").otherwise("")).alias("description"), F.lit(False).alias("truncated"),
        F.lit("8-12 LPA").alias("salary_text"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("k") * 3600).alias("posted_at"), F.concat(F.lit("https://jobs.example/"), F.col("id")).alias("apply_url"), F.lit(None).cast("string").alias("mode_hint"),
    )


def search_synthetic(rows: DataFrame, words: str, place: str, size: int = 20) -> DataFrame:
    """SC9: postings that share a word of the title and start with the place."""
    asked = F.array(*(F.lit(w) for w in words.lower().split()))
    fits = F.arrays_overlap(F.split(F.lower("title"), " "), asked) & F.lower("location").startswith(place.lower())
    return rows.where(fits).orderBy("external_id").limit(size)
