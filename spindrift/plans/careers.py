"""Queries of career documents: parsing, verification, reports."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import parse, places
from spindrift.operators import careers, documents, layouts, reports
from spindrift.operators.layout import dealt, tasks_for
from spindrift.plans.inputs import cases, relation, relation_of, table
from spindrift.plans.registry import query

_BODY = [
    "Asha Rao", "Senior Data Engineer", "Expected CTC: 18-22 LPA", "Notice period: 2 months", "Asha@x.example | +91 98@@", "https://github.com/u@", "Experience", "Data Engineer | Acme @\tJan 2020 - Present", "• Cut costs by 30%", "• Wrote jobs",
    "Technologies: Spark, SQL", "QA Analyst, Beta Labs\t03/2018 – 12/2019", "- Tested releases", "Projects", "Rates https://r.example/@", "• Built a site", "Tech: React", "Education", "B.Tech, Pune University, 2014 - 2018, CGPA: 8.1/10",
    "Skills", "Languages: Python, SQL, python", "Tools: Git, Docker.", "Certifications", "Spark Developer - Databricks (2021)", "Cloud Basics, Acme Academy, Mar 2020",
]
_CV = "SELECT c_custkey AS cv_id, replace(replace('" + "\n".join(_BODY) + "', '@@', lpad(CAST(c_custkey AS VARCHAR(10)), 8, '0')), '@', CAST(c_custkey AS VARCHAR(10))) AS text FROM {customer}"


def _cvs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per customer; the sign in its address is put back."""
    rows = relation_of(spark, sf_dir, _CV, "customer", "c_custkey")
    return rows.withColumn("text", F.regexp_replace("text", r"Asha(\d+)x\.example", "asha$1@x.example"))


@query("SELECT c_custkey AS cv_id, 'Asha Rao' AS name, 'Senior Data Engineer' AS headline, 'asha' || c_custkey || '@x.example' AS email, '+91 98' || lpad(c_custkey::VARCHAR, 8, '0') AS phone, ['https://github.com/u' || c_custkey, 'https://r.example/' || c_custkey] AS links FROM customer")
def cv_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who a document is of, and how to reach them."""
    return careers.headers(_cvs(spark, sf_dir), "cv_id")


_ROLES = ["Data Engineer", "QA Analyst", "Software Developer", "Programme Manager", "Platform Architect", "Associate", "Research Fellow"]
_FIRMS = [" Labs", " Technologies Pvt. Ltd.", " Bank", " Pay", " University"]
#: A job for each order: its customer's nation is the employer, its date the
#: beginning; where the customer's number is divisible by 4, jobs are rows of a
#: table, else each order's number tells the layout.
_JOBS = f"""
SELECT c_custkey AS cv_id, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate, o_orderkey) AS entry_no, o_orderkey, c_custkey % 4 = 0 AS tabled, CAST(o_orderkey % 6 AS INT) AS layout,
  {cases("o_orderkey", _ROLES)} AS title, n_name || {cases("o_custkey", _FIRMS)} AS company, o_orderdate AS started, o_orderdate + INTERVAL 400 DAY AS ended, o_orderkey % 9 = 0 AS still
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey
"""
_JOBS_DUCK = re.sub(r"\{(\w+)\}", r"\1", _JOBS)


def _job_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per customer with a job per order, in six layouts of a job and
    one of a table. Jobs go to their documents before they are written out; a task
    takes so many documents that its time does not grow with the table."""
    rows = relation(spark, sf_dir, _JOBS).repartition(tasks_for(table(spark, sf_dir, "customer")), "cv_id")
    month = lambda c: F.date_format(c, "MMM yyyy")
    dates = F.concat_ws(" – ", month("started"), F.when(F.col("still"), "Present").otherwise(month("ended")))
    line = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    t, c = F.col("title"), F.col("company")
    done = line("\n• Handled order ", F.col("o_orderkey").cast("string"), " of many and\nvarious others.\nTechnologies: Spark, SQL")
    layouts = [line(t, " | ", c, "\t", dates), line(c, "\n", t, "\n", dates), line(t, " — ", c, "\nPune · Full-time · ", dates), line(dates, "\n", t, "\n", c), line(t, " at ", c, "\n", dates, " · Remote"), line(t, "\n", c, "\nPune, India\n", dates)]
    entry = line(F.coalesce(*(F.when(F.col("layout") == i, x) for i, x in enumerate(layouts))), done)
    row = line(c, "\t", t, "\t", dates, "\tPune")
    rows = rows.select("cv_id", "tabled", F.struct("entry_no", F.when(F.col("tabled"), row).otherwise(entry).alias("text")).alias("e"))
    whole = rows.groupBy("cv_id", "tabled").agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["text"]), "\n").alias("text"))
    return whole.select("cv_id", line(F.when(F.col("tabled"), "Work Experience\nCompany\tRole\tDuration\tLocation\n").otherwise("Experience\n"), F.col("text"), "\nSkills\nSQL").alias("text"))


@query(
    f"""SELECT cv_id, entry_no, title, company, CASE WHEN tabled OR layout = 2 THEN 'Pune' WHEN layout = 5 THEN 'Pune, India' END AS location, CASE WHEN NOT tabled AND layout = 2 THEN 'full_time' END AS employment, CASE WHEN NOT tabled AND layout = 4 THEN 'remote' END AS mode,
  strftime(started, '%Y-%m') AS first, CASE WHEN NOT still THEN strftime(ended, '%Y-%m') END AS last, still, CASE WHEN tabled THEN [] ELSE ['Spark', 'SQL'] END AS technologies,
  CASE WHEN tabled THEN [] ELSE ['Handled order ' || o_orderkey || ' of many and various others.'] END AS bullets FROM ({_JOBS_DUCK})"""
)
def cv_experience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of documents in seven layouts, by the best
    labelling of their lines."""
    return layouts.experience(_job_documents(spark, sf_dir), "cv_id")


@query("SELECT c_custkey AS cv_id, 1::BIGINT AS entry_no, 'Rates' AS name, 'https://r.example/' || c_custkey AS link, ['React'] AS technologies, ['Built a site'] AS bullets FROM customer")
def cv_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects of a document."""
    return careers.projects(_cvs(spark, sf_dir), "cv_id")


_DEGREES = ["B.Tech", "M.Sc", "MBA", "Ph.D", "Diploma"]
_FIELDS = ["Computer Science", "Physics", "Marketing", "Civil Engineering"]
#: Two degrees for each supplier, the later one in another layout.
_STUDIES = f"""
SELECT s_suppkey AS cv_id, k.k AS entry_no, CAST((s_suppkey + k.k) % 5 AS INT) AS layout, {cases("(s_suppkey + k.k)", _DEGREES)} AS degree, {cases("(s_suppkey * k.k)", _FIELDS)} AS field, n_name || ' Institute of Technology' AS school,
  CAST(60 + s_suppkey % 40 AS VARCHAR(5)) || '%' AS grade, CAST(1990 + s_suppkey % 20 + 4 * k.k AS VARCHAR(5)) AS first, CAST(1993 + s_suppkey % 20 + 4 * k.k AS VARCHAR(5)) AS last
FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey, (VALUES (1), (2)) k(k)
"""
_STUDIES_DUCK = re.sub(r"\{(\w+)\}", r"\1", _STUDIES)


@query(f"SELECT cv_id, entry_no::BIGINT AS entry_no, degree, field, school, grade, CASE WHEN layout < 4 THEN first END AS first, last FROM ({_STUDIES_DUCK})")
def cv_education(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees of documents whose school stands above, below or beside."""
    rows = relation(spark, sf_dir, _STUDIES)
    line = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    d, f, s, g = F.col("degree"), F.col("field"), F.col("school"), F.col("grade")
    dates = line(F.col("first"), " – ", F.col("last"))
    forms = [line(s, "\n", d, " in ", f, "\n", dates, "\n", g), line(d, " (", f, ")\n", s, "\n", dates, " | ", g), line(d, " in ", f, " · ", s, " · ", dates, " · ", g), line(d, " (", f, "), ", s, ", ", dates, ", ", g), line(d, " in ", f, "\n", s, "\n", F.col("last"), "\n", g)]
    entry = F.struct("entry_no", F.element_at(F.array(*forms), F.col("layout") + 1).alias("text"))
    whole = rows.groupBy("cv_id").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    return layouts.education(whole.select("cv_id", line("Education\n", F.array_join(F.transform("e", lambda e: e["text"]), "\n")).alias("text")), "cv_id")


@query("SELECT c_custkey AS cv_id, 1::BIGINT AS entry_no, 'Spark Developer' AS name, 'Databricks' AS issuer, '2021' AS issued FROM customer UNION ALL SELECT c_custkey, 2, 'Cloud Basics', 'Acme Academy', '2020-03' FROM customer")
def cv_certifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Certificates of a document."""
    return careers.certifications(_cvs(spark, sf_dir), "cv_id")


@query("SELECT c_custkey AS cv_id, skill_no, label, name FROM customer, (VALUES (1, 'Languages', 'Python'), (2, 'Languages', 'SQL'), (3, 'Tools', 'Git'), (4, 'Tools', 'Docker')) t(skill_no, label, name)")
def cv_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills that a document lists, each once."""
    return careers.listed_skills(_cvs(spark, sf_dir), "cv_id")


@query("SELECT c_custkey AS cv_id, 1800000::BIGINT AS low, 2200000::BIGINT AS high, 60 AS notice_days FROM customer")
def cv_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pay and notice that a document states."""
    return careers.job_search(_cvs(spark, sf_dir), "cv_id").select("cv_id", F.col("expected.min_annual").alias("low"), F.col("expected.max_annual").alias("high"), "notice_days")


@query(
    """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN o_custkey * 100000 + 50000 WHEN 1 THEN o_custkey * 100000 WHEN 2 THEN o_custkey * 10000000 WHEN 3 THEN o_custkey * 12000 WHEN 4 THEN 100000 + o_custkey END::BIGINT AS pay,
CASE o_orderkey % 5 WHEN 0 THEN o_custkey * 7 WHEN 1 THEN (o_custkey % 9) * 30 + 15 WHEN 2 THEN 0 WHEN 3 THEN o_custkey % 90 END::INT AS notice,
  CASE WHEN o_orderkey % 3 = 0 THEN ['Gurugram', 'City ' || o_custkey] ELSE ['City ' || o_custkey] END AS locations, CASE WHEN o_orderkey % 3 = 0 THEN ['remote'] WHEN o_orderkey % 3 = 1 THEN ['remote', 'onsite'] ELSE [] END AS modes FROM orders"""
)
def search_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pay, notice and places that profiles state, as preferences."""
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    line = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    pay = F.when(k % 6 == 0, line(c, ".5 LPA")).when(k % 6 == 1, line("₹", c, " - 9999 Lakhs")).when(k % 6 == 2, line("Rs. ", c, " Crores")).when(k % 6 == 3, line(c, "k per month")).when(k % 6 == 4, line(F.format_number(F.col("o_custkey") + 100000, 0), " pa")).otherwise("negotiable")
    notice = F.when(k % 5 == 0, line(c, " weeks")).when(k % 5 == 1, line((F.col("o_custkey") % 9).cast("string"), ".5 months")).when(k % 5 == 2, "Immediate joiner").when(k % 5 == 3, (F.col("o_custkey") % 90).cast("string")).otherwise("soon")
    places_ = F.when(k % 3 == 0, F.array(F.lit("Gurugram"), F.lit("Remote"), line("City ", c), F.lit(" "))).when(k % 3 == 1, F.array(F.lit("WFH"), line(" City ", c, " "), F.lit("On-site"), F.lit("remote"))).otherwise(F.array(line("City ", c)))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", parse.ctc_annual_inr(pay).alias("pay"), parse.notice_days(notice).alias("notice"), parse.preferred_places(places_).alias("p"))
    return rows.select("o_orderkey", "pay", "notice", "p.locations", "p.modes")


_GROUNDED = (
    "SELECT c_custkey AS cv_id, path, CASE path WHEN 'name' THEN true WHEN 'company' THEN c_custkey % 3 > 0 WHEN 'near' THEN true WHEN 'far' THEN false WHEN 'skill' THEN c_custkey % 2 = 0 END AS found FROM customer, (VALUES ('name'), ('company'), ('near'), ('far'), ('skill'), ('empty')) t(path)"
)


@query(_GROUNDED)
def grounded_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which values of a parsed document its text holds to nine
    tenths, and which skills by their key."""
    return careers.grounded(_values(spark, sf_dir), _cvs(spark, sf_dir), "cv_id").select("cv_id", "path", "found")


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("cv_id")
    company = F.when(k % 3 > 0, F.concat(F.lit("ACME "), k)).otherwise("Zeta Qux Corporation")
    # "near" is one edit of 24 away, "far" two of 16 (0.875, over the 0.85 that postings are held to)
    paths = (("name", F.lit("Asha  Rao")), ("company", company), ("near", F.lit("tested releasez projects")), ("far", F.lit("Cut costz by 31%")), ("skill", F.when(k % 2 == 0, "PYTHON").otherwise("Kubernetes")), ("empty", F.lit(" ")))
    rows = [F.struct(F.lit(p).alias("path"), v.alias("value"), F.lit("skill" if p == "skill" else "text").alias("kind")) for p, v in paths]
    return _cvs(spark, sf_dir).select(k, F.inline(F.array(*rows)))


@query("SELECT c_custkey AS cv_id, 5::BIGINT AS checked, (1 + (c_custkey % 3 = 0)::INT + (c_custkey % 2 = 1)::INT)::BIGINT AS not_found FROM customer")
def grounding_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values checked and not found."""
    return careers.grounding_tallies(careers.grounded(_values(spark, sf_dir), _cvs(spark, sf_dir), "cv_id"), "cv_id")


@query(
    """SELECT c_custkey AS cv_id, 'email' AS field, 'asha' || c_custkey || '@x.example' AS value, CASE c_custkey % 3 WHEN 0 THEN 'kept' WHEN 1 THEN 'overridden' ELSE 'added_from_text' END AS issue FROM customer
UNION ALL SELECT c_custkey, 'phone', CASE WHEN c_custkey % 2 = 0 THEN '98' || lpad(c_custkey::VARCHAR, 8, '0') ELSE '+91 98' || lpad(c_custkey::VARCHAR, 8, '0') END, CASE WHEN c_custkey % 2 = 0 THEN 'kept' ELSE 'added_from_text' END FROM customer"""
)
def contact_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts of a parsed document against those that are written."""
    k = F.col("cv_id")
    email = F.when(k % 3 == 0, F.concat(F.lit("ASHA"), k, F.lit("@x.example"))).when(k % 3 == 1, "other@y.example")
    parsed = _cvs(spark, sf_dir).select(k, email.alias("email"), F.when(k % 2 == 0, F.format_string("98%08d", k)).alias("phone"))
    return careers.contact_overrides(parsed, _cvs(spark, sf_dir), "cv_id").drop("parsed")


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 1 THEN 'unread' WHEN 2 THEN 'order' ELSE 'future' END AS flag FROM orders WHERE o_orderkey % 5 IN (1, 2, 3)")
def date_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates that can't be read, are turned round or lie ahead."""
    k = F.col("o_orderkey") % 5
    start = F.when(k == 1, "sometime").when(k == 2, "Mar 2020").when(k == 3, "2030").otherwise("2018")
    finish = F.when(k == 2, "01/2019").when(k == 4, "Present").when(k == 0, "2019-05")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", start.alias("start"), finish.alias("finish"))
    return careers.date_flags(rows, ["o_orderkey"], F.lit(2025 * 12))


_ROLES = "SELECT o_custkey AS cv_id, o_orderkey AS role_no, substring(CAST(o_orderdate AS VARCHAR(30)), 1, 7) AS first, '2001-12' AS last, o_orderkey % 3 = 0 AS is_current, o_orderkey % 2 AS odd FROM {orders}"


@query(
    """SELECT o_custkey AS cv_id, o_orderkey AS role_no, CASE WHEN o_orderkey % 3 > 0 THEN '2001-12' END AS last, greatest(0, CASE WHEN o_orderkey % 3 = 0 THEN 2002 * 12 ELSE 2001 * 12 + 11 END - (year(o_orderdate) * 12 + month(o_orderdate) - 1) + 1)::INT AS months, o_orderkey % 2 = 0 AS has_metric FROM orders"""
)
def finalised_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the code owns in a draft, worked out again."""
    rows = relation(spark, sf_dir, _ROLES).withColumn("bullets", F.array(F.when(F.col("odd") == 0, " Cut costs by 30% ").otherwise(" Wrote jobs ")))
    found = careers.finalised_roles(rows, "cv_id", F.lit(2002 * 12))
    return found.select("cv_id", "role_no", "last", "months", F.col("bullets")[0]["has_metric"].alias("has_metric"))


@query(
    """WITH s AS (SELECT o_custkey AS cv_id, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS a, 2001 * 12 + 11 AS b FROM orders) SELECT cv_id, (max(b) - min(a) + 1)::BIGINT AS months FROM s WHERE b >= a GROUP BY 1"""
)
def experience_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months of work, overlaps counted once."""
    return careers.experience_totals(relation(spark, sf_dir, _ROLES), "cv_id", F.lit(2002 * 12))


#: Texts of claims with what is wrong with each where it stands, by the rule of its path.
_PATHS = ["summary", "risks.0", "strategy.questions.1", "experienceRelevance.roles.2", "requirements.3"]
_CLAIMS = [
    "Led 5 people for 3 years", "You have E1 years", 'The posting says "we love big data here"', "You are a perfect fit with 40 results", 'They wrote "cut costs by 30%" of it', "K8s and v2 of the API, not 2.8.1", "word " * 31, "word " * 41, "word " * 51, "word " * 55, "word " * 81,
]
#: Words, and issues that do not depend on the path.
_SAID = [(6, []), (4, ["written id"]), (8, ["false quotation"]), (8, ["banned phrase", "unsupported number"]), (8, []), (8, []), *((n, []) for n in (31, 41, 51, 55, 81))]


@query(
    f"""WITH c AS (SELECT o_orderkey AS report_id, {cases('o_orderkey', _PATHS)} AS path, list_extract({[n for n, _ in _SAID]}, (o_orderkey % 11 + 1)::INT) AS words, list_extract({[i for _, i in _SAID]}, (o_orderkey % 11 + 1)::INT) AS own, o_orderkey % 7 AS ids FROM orders),
r(path, most, need) AS (VALUES ('summary', 80, 'es'), ('risks.0', 50, 'r'), ('strategy.questions.1', 30, ''), ('experienceRelevance.roles.2', 50, 'e'), ('requirements.3', 40, '')),
i AS (SELECT report_id, path, unnest(list_concat(own, [CASE WHEN words > most THEN 'too long' END, CASE WHEN ids = 3 THEN 'unknown id' END,
  CASE WHEN (need = 'r' AND ids NOT IN (1, 2)) OR (need IN ('e', 'es') AND ids IN (2, 3, 6)) THEN 'uncited' END])) AS issue, ids, o.own AS o, words FROM c o JOIN r USING (path))
SELECT report_id, path, issue FROM i WHERE issue IS NOT NULL AND NOT (issue = 'written id' AND ids IN (2, 3, 6))
UNION ALL SELECT o_orderkey, {cases('o_orderkey', _PATHS)}, 'unsupported number' FROM orders WHERE o_orderkey % 11 IN (0, 5) AND o_orderkey % 7 IN (2, 3, 6)
UNION ALL SELECT o_orderkey, 'recruiterView.standsOut', 'too many items' FROM orders WHERE o_orderkey % 13 = 0"""
)
def claim_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of a report's claims by the rule of their path."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("report_id"))
    k = F.col("report_id")
    dealt = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), (k % len(values) + 1).cast("int"))
    ids = F.when(k % 7 == 1, F.array(F.lit("E1"), F.lit("R1"))).when(k % 7 == 2, F.array(F.lit("R1"))).when(k % 7 == 3, F.array(F.lit("E9"))).when(k % 7 == 6, F.array().cast("array<string>")).otherwise(F.array(F.lit("E1")))
    claims = orders.select("report_id", dealt(_PATHS).alias("path"), dealt(_CLAIMS).alias("text"), ids.alias("ids"))
    more = orders.where("report_id % 13 = 0").select("report_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i")).select("report_id", F.concat(F.lit("recruiterView.standsOut."), "i").alias("path"), F.lit("Ships weekly").alias("text"), F.array(F.lit("E1")).alias("ids"))
    cited = orders.select("report_id", F.inline(F.array(F.struct(F.lit("E1").alias("id"), F.lit("Led 5 people, cut costs by 30%, over 2.8 years").alias("text")), F.struct(F.lit("R1").alias("id"), F.lit("A posting").alias("text")))))
    return reports.claim_issues(claims.unionByName(more), cited, cited.select("report_id", "text"), reports.rule_table(spark))


@query(
    """WITH q AS (SELECT o_orderkey AS report_id, 'R1' AS req_id, o_orderkey % 3 AS given, o_orderkey % 5 AS n, o_orderkey % 4 = 0 AS semantic, o_orderkey % 2 = 0 AS held FROM orders)
SELECT report_id, req_id, 'not assessed' AS issue FROM q WHERE given = 0
UNION ALL SELECT report_id, req_id, 'uncited' FROM q WHERE given = 1 AND n = 0
UNION ALL SELECT report_id, req_id, 'another status' FROM q WHERE given = 1 AND NOT (semantic AND NOT held AND n > 0)
UNION ALL SELECT report_id, 'R9', 'unknown requirement' FROM q WHERE given = 2
UNION ALL SELECT report_id, req_id, 'assessed twice' FROM q WHERE given = 2"""
)
def assessment_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assessments of requirements against what the code found."""
    k = F.col("report_id")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("report_id"))
    wanted = orders.select("report_id", F.lit("R1").alias("req_id"), F.lit("required").alias("importance"), F.lit("skill").alias("kind"), (k % 2 == 0).alias("held"), F.lit("missing").alias("code_status"), F.lit(2).alias("n_evidence"))
    row = lambda req, status: F.struct(F.lit(req).alias("req_id"), F.lit(status).alias("status"), (k % 4 == 0).alias("semantic"), (k % 5).alias("n_evidence"))
    given = F.when(k % 3 == 1, F.array(row("R1", "partial"))).when(k % 3 == 2, F.array(row("R1", "missing"), row("R1", "missing"), row("R9", "missing")))
    return reports.assessment_issues(orders.select("report_id", F.inline(given)), wanted)


@query("SELECT o_orderkey, left(sha256(CASE WHEN o_orderkey % 2 = 0 THEN 'https://a.example/' || o_orderkey ELSE 'Engineer|Acme|' || left(sha256('build things ' || o_orderkey), 32) END), 24) AS external_id FROM orders")
def manual_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of postings added by hand."""
    k = F.col("o_orderkey")
    url = F.when(k % 2 == 0, F.concat(F.lit("https://a.example/"), k))
    text = F.concat(F.lit("Build things! "), k)
    return table(spark, sf_dir, "orders").select("o_orderkey", careers.manual_id(url, F.lit("Engineer"), F.lit("Acme"), places.description_hash(text)).alias("external_id"))


@query("SELECT c_custkey AS user_id, skill, skill_id, name, source FROM customer, (VALUES ('1', 1::BIGINT, 'React.js', 'section'), ('2', 2, 'Spark', 'inferred'), ('new:dbt', NULL, 'DBT', 'section')) t(skill, skill_id, name, source)")
def profile_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills of a profile, each once; the section's name wins over an inferred one."""
    catalogue = spark.createDataFrame([(1, "React", ["ReactJS"]), (2, "Apache Spark", ["Spark"])], "skill_id long, name string, aliases array<string>")
    said = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(s).alias("source"), F.lit(i).alias("position")) for i, (n, s) in enumerate([("react", "inferred"), ("Spark", "inferred"), ("dbt", "inferred"), ("React.js", "section"), ("DBT", "section")])))
    named = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.inline(said))
    return careers.skill_rows(named, catalogue)


@query("SELECT c_custkey AS cv_id, text, number FROM customer, (VALUES ('a', 1), ('c', 3), ('new', 4), ('other', 5)) t(text, number)")
def resynced_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8: evidence keeps its number when a document is read again; new lines get the next."""
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cv_id"))
    rows = lambda names, first, number: ids.select("cv_id", F.posexplode(F.array(*(F.lit(n) for n in names))).alias("position", "text")).withColumn(number, F.col("position") + first)
    old = rows(["a", "b", "c"], 1, "number")
    new = rows(["new", "c", "a", "other"], 0, "position")
    return documents.resynced_evidence(old, new, "cv_id").select("cv_id", "text", "number")


@query("SELECT o_custkey AS cv_id, count(*) AS n_lines, count(*) FILTER (o_orderkey % 4 > 0) AS covered FROM orders GROUP BY 1")
def bullet_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a document's lines of eight words or more its
    extracted bullets have, or are part of."""
    k = F.col("o_orderkey")
    orders = dealt(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("cv_id")))
    code = F.md5(k.cast("string"))
    long = F.concat_ws(" ", F.lit("wrote"), *(F.substring(code, i, 4) for i in range(1, 32, 4)))
    lines = orders.select("cv_id", F.explode(F.array(long, F.concat(F.lit("short line "), k))).alias("text"))
    # 3: the line and more; 2: the line with one letter other; 1: half of it; 0: only the short line
    found = F.when(k % 4 == 3, F.concat(F.lit("In short: "), long, F.lit(" and others"))).when(k % 4 == 2, F.replace(long, F.lit("wrote"), F.lit("wrota"))).when(k % 4 == 1, F.substring(long, 1, 25)).otherwise(F.concat(F.lit("short line "), k))
    return documents.bullet_coverage(lines, orders.select("cv_id", found.alias("text")), "cv_id")
