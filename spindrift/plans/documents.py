"""Queries of sections, requirements, claims and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators import documents, history
from spindrift.plans.inputs import table
from spindrift.plans.registry import query


def _resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    body = F.concat_ws("\n", F.concat(F.lit("Name "), k), F.lit("Summary:"), F.lit("Builds data tools and"), F.lit("keeps them fast."), F.lit("WORK EXPERIENCE"), F.concat(F.lit("• Cut costs by "), k, F.lit("%")), F.lit("• Ran a team"), F.lit("Skills"), F.lit("SQL, Spark"))
    return table(spark, sf_dir, "customer").select("c_custkey", body.alias("text"))


@query("SELECT c_custkey, n AS line_no, s AS section, l AS line FROM (SELECT c_custkey, unnest([0, 2, 3, 5, 6, 8]) AS n, unnest(['header', 'summary', 'summary', 'experience', 'experience', 'skills']) AS s, unnest(['Name ' || c_custkey, 'Builds data tools and', 'keeps them fast.', '• Cut costs by ' || c_custkey || '%', '• Ran a team', 'SQL, Spark']) AS l FROM customer)")
def document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by section."""
    return documents.sections(_resumes(spark, sf_dir), "c_custkey")


@query("SELECT c_custkey, unnest(['E1', 'E2', 'E3', 'E4', 'E5']) AS evidence_id, unnest(['summary', 'summary', 'experience', 'experience', 'skills']) AS section, unnest(['Builds data tools and', 'keeps them fast.', 'Cut costs by ' || c_custkey || '%', 'Ran a team', 'SQL, Spark']) AS text FROM customer")
def evidence_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W4, SC4: numbered evidence."""
    return documents.evidence(_resumes(spark, sf_dir), "c_custkey")


@query("SELECT c_custkey, ['Builds data tools and keeps them fast.', 'Cut x (a b) now', 'https://x.y/z'] AS lines FROM customer")
def merged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrapped lines joined."""
    lines = F.array(*(F.lit(x) for x in ("Builds data tools and", "keeps them fast.", "Cut x (a", "b) now", "https://x.y/z")))
    return table(spark, sf_dir, "customer").select("c_custkey", documents.merge_wrapped(lines).alias("lines"))


@query("SELECT p_partkey AS job_id, unnest([1, 2, 3, 4])::INT AS ord, unnest(['duty', 'requirement', 'requirement', 'requirement']) AS kind, unnest(['preferred', 'required', 'nice', 'nice']) AS importance, unnest(['Build ' || p_name || '.', 'SQL and ' || p_type || '.', 'Rust is a plus.', 'Kafka']) AS quote FROM part")
def job_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duties and requirements by importance."""
    body = F.concat_ws("\n", F.lit("About us"), F.lit("Responsibilities"), F.concat(F.lit("- Build "), F.col("p_name"), F.lit(".")), F.lit("Requirements:"), F.concat(F.lit("- SQL and "), F.col("p_type"), F.lit(". Rust is a plus.")), F.lit("Nice to have"), F.lit("- Kafka"))
    return documents.requirements(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("job_id"), body.alias("text")))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN ['GitHub Actions', 'C++'] WHEN 1 THEN ['GitHub'] ELSE [] END AS skills FROM part")
def longest_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest name counts."""
    said = F.when(F.col("p_partkey") % 3 == 0, "Uses github actions, C++.").when(F.col("p_partkey") % 3 == 1, "On GitHub daily; Cobol").otherwise("Githubber")
    names = F.array(*(F.lit(x) for x in ("GitHub", "GitHub Actions", "C", "C++")))
    return table(spark, sf_dir, "part").select("p_partkey", documents.skills_in(said, names).alias("skills"))


@query("SELECT p_partkey, list_filter([CASE WHEN p_partkey % 2 = 1 THEN 'unknown id' END, CASE WHEN p_size <> 7 THEN 'unsupported number' END, CASE WHEN p_partkey % 5 = 0 THEN 'banned phrase' END], lambda x: x IS NOT NULL) AS faults FROM part")
def claim_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, numbers and phrases of claims."""
    claim = F.concat(F.lit("Cut costs by "), F.col("p_size").cast("string"), F.lit("%."), F.when(F.col("p_partkey") % 5 == 0, " A perfect match").otherwise(""))
    ids = F.when(F.col("p_partkey") % 2 == 1, F.array(F.lit("E1"), F.lit("E9"))).otherwise(F.array(F.lit("E1")))
    return table(spark, sf_dir, "part").select("p_partkey", documents.claim_faults(claim, ids, F.array(F.lit("E1"), F.lit("E2")), F.array(F.lit("saved 7% a year"))).alias("faults"))


@query("SELECT user_id, role_id, share, n_held, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY share DESC, n_held DESC, role_id)::INT AS rank FROM (SELECT u.user_id, role_id, round(count(h.skill_id) / count(*)::DOUBLE, 9) AS share, count(h.skill_id) AS n_held FROM (SELECT DISTINCT o_custkey % 50 AS user_id FROM orders) u CROSS JOIN (SELECT DISTINCT s_nationkey AS role_id, s_suppkey % 12 AS skill_id FROM supplier) t LEFT JOIN (SELECT DISTINCT o_custkey % 50 AS user_id, o_orderkey % 12 AS skill_id FROM orders WHERE o_totalprice > 440000) h ON h.user_id = u.user_id AND h.skill_id = t.skill_id GROUP BY 1, 2) WHERE n_held > 0) WHERE rank <= 6")
def suggested_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles by share of their core skills."""
    orders = table(spark, sf_dir, "orders")
    level = F.when(F.col("o_totalprice") > 440000, 3).otherwise(1)
    levels = orders.select((F.col("o_custkey") % 50).alias("user_id"), (F.col("o_orderkey") % 12).alias("skill_id"), level.alias("level"))
    targets = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("role_id"), (F.col("s_suppkey") % 12).alias("skill_id")).distinct()
    return documents.suggested_roles(documents.coverage(targets, levels).withColumn("share", F.round("share", 9)))


@query(
    """SELECT row_number() OVER (ORDER BY v, p, n)::INT AS position, text, place, role_ids, row_number() OVER (ORDER BY v, p, n) <= 5 AS priority
FROM (SELECT lower(n_name) AS text, place, list_sort(list(DISTINCT n_nationkey % 10)) AS role_ids, min(n_nationkey // 10) AS v, min(place_no) AS p, min(n_nationkey % 10) AS n FROM nation CROSS JOIN (SELECT unnest([0, 1]) AS place_no, unnest(['Pune', 'Delhi']) AS place) GROUP BY 1, 2) QUALIFY position <= 20"""
)
def search_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries round robin over variants, places and roles."""
    nation = table(spark, sf_dir, "nation")
    variants = nation.select((F.col("n_nationkey") % 10).alias("role_id"), F.floor(F.col("n_nationkey") / 10).alias("variant_no"), F.col("n_name").alias("text"))
    return history.round_robin(variants, ["Pune", "Delhi"], 20, 5)
