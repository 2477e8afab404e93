"""One projection that reads everything out of a raw posting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions import parse, places
from spindrift.functions.text import skill_keys_in


def prepare(postings: DataFrame) -> DataFrame:
    """Postings (title, company_name, location, salary_text, description,
    provider, external_id, posted_at) with names, places, pay, experience,
    conditions and hashes. Pay comes from its own field, else from the first
    line of the description that names it."""
    text = F.concat_ws("\n", "title", "description")
    rows = postings.withColumn("salary", parse.salary_or_line(F.col("salary_text"), F.col("description"))).withColumn("experience", parse.experience(text))
    return rows.select(
        "job_id", "provider", "external_id", "title", "posted_at", places.display_company(F.col("company_name")).alias("company"), places.company_key(F.col("company_name")).alias("company_key"),
        places.canonical_city(F.col("location")).alias("city"), places.work_mode(F.col("location"), F.col("description"), F.lit(None).cast("string")).alias("work_mode"), places.title_key(F.col("title")).alias("title_key"),
        places.description_hash(F.col("description")).alias("description_hash"), places.is_staffing(F.col("company_name")).alias("staffing"), "salary", "experience", parse.seniority(F.col("title"), F.col("experience.min_years")).alias("seniority"),
        parse.conditions(text).alias("conditions"), F.size(skill_keys_in(text)).alias("n_keys"),
    )
