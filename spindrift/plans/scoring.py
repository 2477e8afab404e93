"""Queries of relevance and fit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators import scoring
from spindrift.plans.inputs import cases, oracle, relation
from spindrift.plans.registry import query

#: A posting beside its user's profile, with nulls put in.
PAIRS = f"""
SELECT o_orderkey AS job_id, o_custkey AS user_id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_custkey % 12 AS DOUBLE) END AS years, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey % 9 AS DOUBLE) END AS min_years,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 9 + 3 AS DOUBLE) END AS max_years, {cases("o_orderkey", ["Pune", "Delhi", None, "Remote-India", "Kochi"])} AS city, {cases("o_orderkey", ["remote", "hybrid", "onsite", None])} AS mode,
  {cases("o_custkey", ["Pune", "Delhi", ""])} AS home, {cases("o_custkey", ["remote", "hybrid", "", "onsite"])} AS wish, o_custkey % 4 = 0 AS relocates, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) END AS top,
  o_orderkey % 8 > 0 AS disclosed, {cases("o_orderkey", ["INR", "INR", "USD", None])} AS currency, CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE 200000 END AS expected, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 0.5 + (o_orderkey % 50) / 100.0 END AS cosine,
  o_custkey % 9 = 0 AS dismissed, o_orderkey % 2 = 0 AS bond, CASE WHEN o_orderkey % 3 = 1 THEN 30 END AS notice, CASE WHEN o_custkey % 6 = 0 THEN NULL ELSE CAST(o_custkey % 4 * 30 AS INT) END AS my_notice
FROM {{orders}}
"""
_A = oracle(pairs=PAIRS)
_FAR = "coalesce(mode = 'remote', false) OR coalesce(city = 'Remote-India', false)"
_PARTS = f"""
  CASE WHEN years IS NULL OR (min_years IS NULL AND max_years IS NULL) THEN 0.5 WHEN years < min_years THEN greatest(0, 1 - (min_years - years) / 3) WHEN years > max_years THEN greatest(0.3, 1 - (years - max_years) / 6) ELSE 1 END::DOUBLE AS experience,
  CASE WHEN home = '' AND wish = '' THEN 0.5 WHEN {_FAR} THEN CASE WHEN wish = 'remote' THEN 1 ELSE 0.6 END WHEN city IS NULL THEN 0.5 WHEN home = city AND (mode IS NULL OR wish = '' OR wish = mode) THEN 1 WHEN home = city THEN 0.6 WHEN relocates THEN 0.5 ELSE 0.1 END::DOUBLE AS location,
  CASE WHEN NOT disclosed OR top IS NULL OR coalesce(currency, 'INR') <> 'INR' OR expected IS NULL THEN 0.5 ELSE least(1, top / expected::DOUBLE) END::DOUBLE AS salary,
  CASE WHEN cosine IS NULL THEN NULL ELSE greatest(0, least(1, (cosine::DOUBLE - 0.55) / 0.3)) END::DOUBLE AS semantic"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = lambda c: F.filter(F.array(c), lambda x: x != "")
    return relation(spark, sf_dir, PAIRS).withColumns({"cities": some("home"), "modes": some("wish"), "cosine": F.col("cosine").cast("double")})


def _parts() -> dict[str, F.Column]:
    c = F.col
    return {
        "experience": scoring.experience_part(c("years"), c("min_years"), c("max_years")), "location": scoring.location_part(c("city"), c("mode"), c("cities"), c("modes"), c("relocates")),
        "salary": scoring.salary_part(c("top"), c("disclosed"), c("currency"), c("expected")), "semantic": scoring.semantic_part(c("cosine")),
    }


@query(f"{_A} SELECT job_id, round(experience, 6) AS experience, round(location, 6) AS location, round(salary, 6) AS salary, round(semantic, 6) AS semantic FROM (SELECT job_id, {_PARTS} FROM pairs)")
def relevance_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the quick match."""
    return pairs(spark, sf_dir).select("job_id", *(F.round(v, 6).alias(k) for k, v in _parts().items()))


_YEARS = lambda c: f"regexp_replace(printf('%.1f', {c}), '\\.0$', '')"
_LPA = lambda c: f"'₹' || regexp_replace(printf('%.1f', floor({c} / 10000 + 0.5) / 10), '\\.0$', '') || 'L'"
_WEIGH = "(CASE WHEN semantic IS NULL THEN 30 ELSE 50 END)"
_POINTS = lambda part, weight: f"floor({weight} * 100.0 / {_WEIGH} * {part} * 10 + 0.5) / 10"


@query(
    f"""{_A} SELECT job_id, key, round(points, 1) AS points, neutral, reason FROM (SELECT job_id, unnest([
  {{'key': 'experience', 'points': {_POINTS('experience', 15)}, 'neutral': years IS NULL OR (min_years IS NULL AND max_years IS NULL), 'reason': CASE WHEN min_years IS NULL AND max_years IS NULL THEN 'Experience isn''t stated.' WHEN years IS NULL THEN 'Your years of experience aren''t known yet.'
    ELSE 'Asks ' || CASE WHEN min_years IS NOT NULL AND max_years IS NOT NULL THEN {_YEARS('min_years')} || '–' || {_YEARS('max_years')} WHEN min_years IS NOT NULL THEN {_YEARS('min_years')} || '+' ELSE 'up to ' || {_YEARS('max_years')} END || ' years; you have ' || {_YEARS('years')} || '.' END}},
  {{'key': 'location', 'points': {_POINTS('location', 10)}, 'neutral': (home = '' AND wish = '') OR (NOT ({_FAR}) AND city IS NULL), 'reason': CASE WHEN home = '' AND wish = '' THEN 'No location preferences set.' WHEN ({_FAR}) AND wish = 'remote' THEN 'Remote, as you prefer.' WHEN {_FAR} THEN 'Remote role (not in your work modes).' WHEN city IS NULL THEN 'Location isn''t stated.'
    WHEN home = city AND (mode IS NULL OR wish = '' OR wish = mode) THEN 'In ' || city || ', one of your locations.' WHEN home = city THEN 'In ' || city || ', but ' || mode || ' (not one of your work modes).' WHEN relocates THEN 'In ' || city || '; you''re open to relocating.' ELSE 'In ' || city || ', outside your locations.' END}},
  {{'key': 'salary', 'points': {_POINTS('salary', 5)}, 'neutral': NOT disclosed OR top IS NULL OR coalesce(currency, 'INR') <> 'INR' OR expected IS NULL, 'reason': CASE WHEN NOT disclosed OR top IS NULL THEN 'Salary not disclosed.' WHEN coalesce(currency, 'INR') <> 'INR' THEN 'Salary in ' || currency || '.'
    WHEN expected IS NULL THEN 'Pays up to ' || {_LPA('top')} || '; set your expected salary to compare.' ELSE 'Pays up to ' || {_LPA('top')} || '; you expect ' || {_LPA('expected')} || '+.' END}},
  {{'key': 'semantic', 'points': coalesce({_POINTS('semantic', 20)}, 0), 'neutral': semantic IS NULL, 'reason': CASE WHEN semantic IS NULL THEN 'Not compared with your profile yet.' WHEN semantic >= 0.7 THEN 'Description is very close to your profile.' WHEN semantic >= 0.4 THEN 'Description is fairly close to your profile.' ELSE 'Description is not close to your profile.' END}}], recursive := true)
  FROM (SELECT *, {_PARTS} FROM pairs))"""
)
def relevance_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the quick match with points, reasons and what was unknown."""
    c = F.col
    rows = pairs(spark, sf_dir).select("*", *(v.alias(f"_{k}") for k, v in _parts().items()))
    known = {"experience": c("years").isNull() | (c("min_years").isNull() & c("max_years").isNull()), "semantic": c("_semantic").isNull(), "salary": ~(c("disclosed") & c("top").isNotNull() & (F.coalesce("currency", F.lit("INR")) == "INR") & c("expected").isNotNull())}
    known["location"] = ((F.size("cities") == 0) & (F.size("modes") == 0)) | (~scoring.remote(c("mode"), c("city")) & c("city").isNull())
    reasons = {
        "experience": scoring.experience_reason(c("years"), c("min_years"), c("max_years")), "location": scoring.location_reason(c("city"), c("mode"), c("cities"), c("modes"), c("relocates")),
        "salary": scoring.salary_reason(c("top"), c("disclosed"), c("currency"), c("expected")), "semantic": scoring.semantic_reason(c("_semantic")),
    }
    parts = scoring.explained({k: (c(f"_{k}"), known[k], reasons[k]) for k in reasons})
    return rows.select("job_id", F.inline(parts)).select("job_id", "key", F.round("points", 1).alias("points"), "neutral", "reason")


_NAMED = ["Spark", "SQL", "Python"]


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'The posting names no skills we know.' WHEN 1 THEN 'You have 1 of 3 skills it names (Spark); missing SQL, Python.' WHEN 2 THEN 'You have 3 of 3 skills it names (Spark, SQL, Python).' ELSE 'You have 0 of 3 skills it names; missing Spark, SQL, Python.' END AS skills,
CASE p_partkey % 4 WHEN 0 THEN 'No target roles selected.' WHEN 1 THEN 'Title matches “Data Engineer”.' WHEN 2 THEN 'Title is close to “Data Engineer”.' ELSE 'Title differs from your target roles.' END AS title FROM part"""
)
def skill_and_title_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons of the skills and title parts."""
    k = F.col("p_partkey") % 4
    names = F.when(k == 0, F.array().cast("array<string>")).otherwise(F.array(*(F.lit(n) for n in _NAMED)))
    levels = F.when(k == 1, F.array(F.lit(3), F.lit(0), F.lit(None).cast("int"))).when(k == 2, F.array(F.lit(1), F.lit(2), F.lit(5))).when(k == 3, F.array(F.lit(0), F.lit(0), F.lit(0))).otherwise(F.array().cast("array<int>"))
    title = scoring.title_reason(F.when(k == 1, 0.9).when(k == 2, 0.6).otherwise(0.1), F.when(k > 0, "Data Engineer"))
    return relation(spark, sf_dir, "SELECT p_partkey FROM {part}").select("p_partkey", scoring.skills_reason(names, levels).alias("skills"), title.alias("title"))


@query(
    f"""{_A} SELECT job_id, greatest(0, least(100, floor((experience * 15 + location * 10 + salary * 5 + coalesce(semantic * 20, 0)) * 100 / (CASE WHEN semantic IS NULL THEN 30 ELSE 50 END) - CASE WHEN dismissed THEN 15 ELSE 0 END + 0.5 + 1e-9)))::BIGINT AS score
FROM (SELECT job_id, dismissed, {_PARTS} FROM pairs)"""
)
def relevance_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The combined score with weights spread over known parts."""
    rows = pairs(spark, sf_dir).select("job_id", "dismissed", *(v.alias(k) for k, v in _parts().items()))
    parts = {k: F.col(k) for k in ("experience", "location", "salary", "semantic")}
    # a value just under a half by rounding of the last digit counts as the half
    nudged = {k: v + 1e-11 for k, v in parts.items()}
    return rows.select("job_id", scoring.combined(nudged, F.col("dismissed")).alias("score"))


@query(
    f"""{_A} SELECT job_id, experience, location, salary, CASE WHEN experience + location + salary >= 38 THEN 'high' ELSE 'low' END AS band FROM (SELECT job_id,
  CASE WHEN years IS NULL OR (min_years IS NULL AND max_years IS NULL) THEN 14 WHEN min_years - years > 2 THEN 0 WHEN min_years - years > 1 THEN 6 WHEN min_years - years > 0 THEN 12 WHEN years > max_years + 3 THEN 14 ELSE 20 END AS experience,
  CASE WHEN {_FAR} THEN CASE WHEN wish NOT IN ('', 'remote') THEN 0 WHEN mode IS NULL OR wish = '' OR wish = mode THEN 10 ELSE 5 END WHEN city IS NULL OR home = '' THEN 6 WHEN home = city THEN CASE WHEN mode IS NULL OR wish = '' OR wish = mode THEN 10 ELSE 5 END WHEN relocates THEN 5 ELSE 0 END AS location,
  CASE WHEN NOT disclosed OR top IS NULL OR expected IS NULL THEN 6 WHEN top >= expected THEN 10 WHEN top >= expected * 0.85 THEN 5 ELSE 0 END AS salary FROM pairs)"""
)
def fit_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4, Q6, Q7: points of the fit score."""
    c = F.col
    rows = pairs(spark, sf_dir).select(
        "job_id", scoring.experience_points(c("years"), c("min_years"), c("max_years")).alias("experience"), scoring.location_points(c("city"), c("mode"), c("cities"), c("modes"), c("relocates")).alias("location"),
        scoring.salary_points(F.lit(None).cast("long"), c("top"), c("disclosed"), c("expected")).alias("salary"),
    )
    return rows.withColumn("band", F.when(c("experience") + c("location") + c("salary") >= 38, "high").otherwise("low"))


@query(
    f"""{_A} SELECT job_id, CASE WHEN notice IS NULL THEN NULL WHEN my_notice IS NULL THEN 'warning' WHEN my_notice > notice THEN 'blocker' ELSE 'ok' END AS notice, CASE WHEN bond THEN CASE WHEN dismissed THEN 'blocker' ELSE 'warning' END END AS bond,
  (CASE WHEN notice IS NOT NULL AND my_notice > notice THEN 1 ELSE 0 END + CASE WHEN bond AND dismissed THEN 1 ELSE 0 END)::BIGINT AS blockers FROM pairs"""
)
def condition_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q8: conditions against a profile's limits."""
    c = F.struct(F.col("notice").alias("notice_max_days"), F.col("bond"), F.lit(None).cast("string").alias("shift"), F.lit(False).alias("contract_to_hire"), F.lit(None).cast("int").alias("office_days"))
    profile = {"notice_days": F.col("my_notice"), "no_bond": F.col("dismissed"), "no_night": F.lit(False), "no_to_hire": F.lit(False), "office_days": F.lit(None).cast("int")}
    rows = pairs(spark, sf_dir).withColumn("checks", scoring.condition_checks(c, profile))
    state = lambda key: F.get(F.filter("checks", lambda x: x["key"] == key), F.lit(0))["status"]
    return rows.select("job_id", state("notice").alias("notice"), state("bond").alias("bond"), F.size(F.filter("checks", lambda x: x["status"] == "blocker")).cast("long").alias("blockers"))


_REQ = "SELECT l_orderkey AS job_id, l_partkey % 40 AS skill_id, CASE l_returnflag WHEN 'R' THEN 'required' WHEN 'A' THEN 'preferred' ELSE 'nice' END AS importance, CASE WHEN l_quantity > 30 THEN 1.0 WHEN l_quantity > 15 THEN 0.5 ELSE 0.0 END AS match FROM {lineitem}"
_R = oracle(req=_REQ) + ", weighted AS (SELECT *, CASE importance WHEN 'required' THEN 3.0 WHEN 'preferred' THEN 1.5 ELSE 1.0 END::DOUBLE AS w FROM req)"


def _requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, _REQ).withColumn("match", F.col("match").cast("double"))


@query(f"{_R} SELECT job_id, round(sum(w * match) / sum(w) * 45, 6) AS points, count(*) FILTER (match = 1) AS strong, count(*) FILTER (match = 0.5) AS partial, count(*) FILTER (match = 0) AS missing, count(*) FILTER (match = 0 AND importance = 'required') AS missing_required FROM weighted GROUP BY 1")
def fit_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills of a job by importance."""
    return scoring.skills_component(_requirements(spark, sf_dir)).withColumn("points", F.round("points", 6))


@query(
    f"""{_R} SELECT * FROM (SELECT job_id, skill_id, floor(sum(w * (1 - match)) / any_value(total) * 45 + 0.5)::BIGINT AS points, min(match) AS least FROM weighted JOIN (SELECT job_id, sum(w) AS total FROM weighted GROUP BY 1) USING (job_id) GROUP BY 1, 2) t
WHERE least < 1 AND points >= 1""".replace("SELECT * FROM (SELECT job_id, skill_id", "SELECT job_id, skill_id, points FROM (SELECT job_id, skill_id")
)
def score_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q11: what learning a skill would add."""
    return scoring.gains(_requirements(spark, sf_dir))


@query(f"{_A} SELECT job_id, CASE WHEN t >= 72 AND b = 0 THEN 'APPLY' WHEN (t >= 55 AND b = 0) OR (t >= 72 AND b = 1) THEN 'CONSIDER' ELSE 'LOW_PRIORITY' END AS recommendation FROM (SELECT job_id, job_id % 101 AS t, user_id % 3 AS b FROM pairs)")
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q9: by total and blockers."""
    return pairs(spark, sf_dir).select("job_id", scoring.recommendation(F.col("job_id") % 101, F.col("user_id") % 3).alias("recommendation"))


@query("SELECT o_custkey AS user_id, CASE WHEN s >= 4 THEN 1 WHEN s >= 2 THEN 2 ELSE 4 END AS above, CASE WHEN j >= 2 THEN 3 ELSE 5 END AS below FROM (SELECT o_custkey, count(*) FILTER (o_orderpriority = '1-URGENT') AS s, count(*) FILTER (o_orderpriority = '5-LOW') AS j FROM orders GROUP BY 1)")
def learned_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margins learned from dismissals."""
    reason = "CASE o_orderpriority WHEN '1-URGENT' THEN 'too_senior' WHEN '5-LOW' THEN 'too_junior' ELSE 'other' END"
    return scoring.learned_margins(relation(spark, sf_dir, f"SELECT o_custkey AS user_id, {reason} AS reason FROM {{orders}}"))


@query(
    f"""{_A} SELECT job_id, CASE WHEN m < 0.5 AND related >= 3 THEN 0.5 ELSE m END::DOUBLE AS match FROM (SELECT job_id, related, CASE WHEN level_match > 0 AND y < asked THEN CASE WHEN level_match = 1 THEN 0.5 ELSE 0 END ELSE level_match END AS m
FROM (SELECT *, CASE WHEN level >= 3 THEN 1 WHEN level = 2 THEN 0.5 ELSE 0 END AS level_match FROM (SELECT job_id, greatest(job_id % 6, user_id % 5) AS level, CASE WHEN user_id % 5 > job_id % 6 THEN max_years ELSE years END AS y, min_years AS asked, user_id % 4 AS related FROM pairs)))"""
)
def skill_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1: match of a requirement, own, implied or related."""
    c = F.col
    return pairs(spark, sf_dir).select("job_id", scoring.skill_match(c("job_id") % 6, c("years"), c("user_id") % 5, c("max_years"), c("user_id") % 4, c("min_years")).alias("match"))


@query("SELECT p_partkey, greatest(1, least(5, CASE WHEN p_size >= 50 THEN 4 WHEN p_size >= 30 THEN 3 WHEN p_size >= 10 THEN 2 ELSE 1 END + CASE WHEN p_partkey % 5 >= 3 THEN 1 ELSE 0 END - CASE WHEN p_size > 36 THEN 1 ELSE 0 END)) AS level, CASE WHEN p_size / 50.0 >= 0.7 THEN 'core' WHEN p_size / 50.0 >= 0.4 THEN 'adjacent' ELSE 'stretch' END AS category FROM part")
def levels_and_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q13, Q14: suggested level and role category."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    size = F.col("p_size")
    return part.select("p_partkey", scoring.proficiency(size / 10, F.col("p_partkey") % 5, size).alias("level"), scoring.role_category(size / 50.0).alias("category"))
