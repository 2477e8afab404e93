"""Queries of responses, files and dimensions as sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import places
from spindrift.functions.text import skill_slug
from spindrift.operators import documents, joins, profile, sets, state, vectors
from spindrift.plans.inputs import NOW, heavy, now, table
from spindrift.plans.registry import query
from spindrift.sources import pages as web
from spindrift.sources import postings, webresults
from spindrift.sources.synthetic import SyntheticPostings


def _json(**fields) -> F.Column:
    return F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))


def _said(text: str, key) -> F.Column:
    return F.concat(F.lit(text), key.cast("string"))


@query(
    f"""SELECT 0 AS source_no, 'paged' AS provider, 'p' || o_orderkey AS external_id, 'Data Engineer ' || o_orderkey AS title, 'Pune' AS location, 'Cut & short' AS description, true AS truncated, CASE WHEN o_orderkey % 2 = 0 THEN '500000 - 900000 a year' END AS salary_text, date_trunc('second', o_orderdate)::TIMESTAMP AS posted_at, NULL AS mode_hint FROM orders
UNION ALL SELECT 1, 'snippet', 'q' || o_orderkey, 'Analyst', 'Remote', 'Hi there', true, CASE WHEN o_orderkey % 2 = 0 THEN '10L' END, date_trunc('second', o_orderdate)::TIMESTAMP, NULL FROM orders
UNION ALL SELECT 2, 'relative', 'r' || o_orderkey, 'Tester', 'Delhi', 'Full text', false, '12 LPA', CASE WHEN o_orderkey % 2 = 0 THEN TIMESTAMP '{NOW}' - INTERVAL 3 DAY END, CASE WHEN o_orderkey % 3 = 0 THEN 'remote' END FROM orders"""
)
def provider_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC5, SC6, SC7, U6: answers of three job-search services, in their order."""
    k, at = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    even = k % 2 == 0
    orders = table(spark, sf_dir, "orders")

    def answers(name: str, **fields) -> DataFrame:
        return orders.select(F.to_json(F.struct(F.array(F.struct(*(v.alias(c) for c, v in fields.items()))).alias(name))).alias("body"))

    one = answers("results", id=_said("p", k), title=_said("<b>Data</b> Engineer ", k), company=F.struct(F.lit("Acme").alias("display_name")), location=F.struct(F.lit("Pune").alias("display_name")), description=F.lit("<p>Cut &amp; short</p>"), salary_min=F.when(even, 500000.0), salary_max=F.when(even, 900000.0), created=at, redirect_url=F.lit("https://a.example"))
    two = answers("jobs", id=_said("q", k), title=F.lit("Analyst"), company=F.lit("Beta"), location=F.lit("Remote"), snippet=F.lit("<div>Hi <b>there</b></div>"), salary=F.when(even, "10L").otherwise(""), updated=at, link=F.lit("https://b.example"))
    three = answers("jobs_results", job_id=_said("r", k), title=F.lit("Tester"), company_name=F.lit("Gamma"), location=F.lit("Delhi"), description=F.lit("Full text"), detected_extensions=F.struct(F.when(even, "3 days ago").otherwise("soon").alias("posted_at"), F.lit("12 LPA").alias("salary"), (k % 3 == 0).alias("work_from_home")), apply_options=F.array(F.struct(F.lit("https://c.example").alias("link"))))
    rows = sets.concatenated(postings.paged_api(one), postings.snippet_api(two), postings.relative_api(three, now()))
    return rows.select("source_no", "provider", "external_id", "title", "location", "description", "truncated", "salary_text", "posted_at", "mode_hint")


@query(
    """SELECT 'sectioned' AS provider, 's' || o_orderkey AS external_id, 'Intro' || chr(10) || 'You' || chr(10) || 'Spark' || chr(10) || 'SQL' AS description, 'Pune' AS location, date_trunc('second', o_orderdate)::TIMESTAMP AS posted_at, CASE WHEN o_orderkey % 2 = 0 THEN 'hybrid' END AS mode_hint FROM orders
UNION ALL SELECT 'published', 't' || o_orderkey, 'A' || chr(10) || 'B', 'Pune, India | Delhi, India', date_trunc('second', o_orderdate)::TIMESTAMP, CASE WHEN o_orderkey % 2 = 0 THEN 'remote' END FROM orders WHERE o_orderkey % 3 > 0"""
)
def sectioned_and_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC11, SC14, SC15: boards with sections, and with states and several places."""
    k = F.col("o_orderkey")
    lists = F.array(F.struct(F.lit("You").alias("text"), F.lit("<li>Spark</li><li>SQL</li>").alias("content")))
    one = F.to_json(F.array(F.struct(_said("s", k).alias("id"), F.lit("Engineer").alias("text"), F.struct(F.lit("Pune").alias("location")).alias("categories"), F.lit("Intro").alias("descriptionPlain"), lists.alias("lists"), (F.unix_timestamp("o_orderdate") * 1000).alias("createdAt"), F.when(k % 2 == 0, "hybrid").otherwise("unspecified").alias("workplaceType"))))
    where = F.array(*(F.struct(F.lit(c).alias("city"), F.lit("India").alias("country")) for c in ("Pune", "Delhi")))
    two = _json(offers=F.array(F.struct(_said("t", k).alias("id"), F.lit("Tester").alias("title"), F.when(k % 3 > 0, "published").otherwise("draft").alias("status"), F.lit("<p>A</p>").alias("description"), F.lit("<p>B</p>").alias("requirements"), where.alias("locations"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"), (k % 2 == 0).alias("remote"))))
    both = F.array(F.struct(F.lit("sectioned").alias("kind"), one.alias("body")), F.struct(F.lit("published").alias("kind"), two.alias("body")))
    responses = table(spark, sf_dir, "orders").select(F.lit("c").alias("company"), F.inline(both))
    return postings.read_all(responses).select("provider", "external_id", "description", "location", "posted_at", "mode_hint")


@query(
    """SELECT external_id, title, location FROM (SELECT 's' || id AS external_id, (['Data Engineer', 'React Developer', 'Platform Engineer', 'QA Analyst', 'ML Engineer'])[(k % 5 + 1)::INT] AS title, (['Bengaluru', 'Pune', 'Remote, India', 'Hyderabad'])[(k % 4 + 1)::INT] AS location
FROM (SELECT i AS id, i - CASE WHEN i % 6 = 5 THEN 1 ELSE 0 END AS k FROM range((SELECT count(*) FROM part)) t(i))) WHERE location = 'Pune' AND title LIKE '%Engineer' ORDER BY external_id LIMIT 20"""
)
def synthetic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC8, SC9, F5: made-up postings, searched by word and start of the place (a page of 20)."""
    return postings.search_synthetic(postings.synthetic(spark, table(spark, sf_dir, "part").count()), "engineer", "Pu").select("external_id", "title", "location")


@query(
    """SELECT number, 's' || number AS external_id, (['Data Engineer', 'React Developer', 'Platform Engineer', 'QA Analyst', 'ML Engineer'])[(k % 5 + 1)::INT] AS title, 'Company ' || (k % 40) AS company, (['Bengaluru', 'Pune', 'Remote, India', 'Hyderabad'])[(k % 4 + 1)::INT] AS location,
'Posting ' || k || ': 2-4 years of SQL and Spark.' || CASE WHEN k <> number THEN '  Apply!' ELSE '' END AS description, o_custkey
FROM (SELECT o_orderkey AS number, o_orderkey - CASE WHEN o_orderkey % 6 = 5 THEN 1 ELSE 0 END AS k, o_custkey FROM orders)"""
)
def synthetic_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC7, SC8: the data source of made-up postings, in partitions, joined with all orders by number."""
    spark.dataSource.register(SyntheticPostings)
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("number"), "o_custkey")
    last = orders.agg(F.max("number")).first()[0]
    rows = spark.read.format("synthetic_postings").option("rows", (last if last is not None else -1) + 1).option("parts", 16).load()
    return rows.join(orders, "number").select("number", "external_id", "title", "company", "location", "description", "o_custkey")


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' END AS kind, length(regexp_replace(left(html, (page_id % 9 * 60)::INT), '\\s', '', 'g')) >= 200 AS enough FROM pages")
def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC20, SC21: kinds of files by their first bytes, and whether a text is long enough."""
    k, html = F.col("page_id"), F.col("html")
    content = F.when(k % 3 == 0, F.concat(F.lit("%PDF-1.7\n"), html).cast("binary")).when(k % 3 == 1, F.concat(F.unhex(F.lit("504B0304")), F.lit("..word/document.xml").cast("binary"), html.cast("binary"))).otherwise(html.cast("binary"))
    return heavy(spark, sf_dir, "pages").select("page_id", web.file_kind(content).alias("kind"), web.enough_text(F.substring(html, F.lit(1), (k % 9 * 60).cast("int"))).alias("enough"))


@query("SELECT page_id, CASE WHEN page_id % 7 > 0 THEN url || chr(10) || 'Page' || chr(9) || page_id END AS text FROM pages")
def docx_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC19: texts of DOCX files; what is no such file has none."""
    rows = heavy(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.array("url", F.concat(F.lit("Page\t"), F.col("page_id").cast("string"))).alias("lines"), (F.col("page_id") % 7 == 0).alias("broken"))
    files = web.write_docx(rows).withColumn("content", F.when(F.col("broken"), F.substring("content", 1, 20)).otherwise(F.col("content")))
    return web.read_docx(files).select(F.col("path").cast("long").alias("page_id"), "text")


@query(
    """SELECT address, kind, title, snippet FROM (SELECT 'site' || o_custkey % 50 || '.example/jobs' AS address, CASE o_orderkey % 3 WHEN 0 THEN 'content' WHEN 1 THEN 'text' ELSE 'web' END AS kind, CASE WHEN o_orderkey % 4 > 0 THEN 'T' || o_orderkey ELSE '' END AS title, 'about ' || o_orderkey AS snippet,
row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1"""
)
def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC22, U2: hits of three web-search services, an address once."""
    k = F.col("o_orderkey")
    url, title, said = F.concat(F.lit("https://www.Site"), F.col("o_custkey") % 50, F.lit(".example/jobs/?ref="), k), F.when(k % 4 > 0, _said("T", k)), _said("about ", k)
    hit = lambda text: F.array(F.struct(url.alias("url"), title.alias("title"), said.alias(text)))
    body = F.when(k % 3 == 0, _json(results=hit("content"))).when(k % 3 == 1, _json(results=hit("text"))).otherwise(_json(data=F.struct(hit("description").alias("web"))))
    answers = table(spark, sf_dir, "orders").select(k.alias("query_id"), F.when(k % 3 == 0, "content").when(k % 3 == 1, "text").otherwise("web").alias("kind"), body.alias("body"))
    return webresults.distinct_hits(webresults.read_hits(answers), "query_id", "hit_no").select("address", "kind", "title", "snippet")


@query("SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'blocked' WHEN 1 THEN 'robots' WHEN 2 THEN 'redirects' WHEN 3 THEN 'failed' WHEN 4 THEN 'other' ELSE 'ok' END AS outcome, least(strlen(html), 1000)::INT AS n_bytes FROM pages")
def fetched_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC26, F18: what becomes of requests, and how much of a page is read."""
    k = F.col("page_id") % 7
    url = F.when(k == 0, "http://127.0.0.1/x").otherwise(F.col("url"))
    allowed = web.robots_allows(web.robots_rules(F.lit("User-agent: *\nDisallow: /private")), F.when(k == 1, "/private/x").otherwise("/x"))
    outcome = webresults.fetch_outcome(url, allowed, F.when(k == 2, 4).otherwise(1), F.when(k == 3, 503).otherwise(200), F.when(k == 4, "image/png").when(k == 5, "text/html; charset=utf-8"))
    return heavy(spark, sf_dir, "pages").select("page_id", outcome.alias("outcome"), F.octet_length(webresults.capped(F.col("html"), 1000)).alias("n_bytes"))


@query("SELECT regexp_replace(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+', ''), '-+$', '') || '-' || p_partkey AS slug, CASE WHEN p_size > 45 THEN 'seed' ELSE p_brand END AS category FROM part UNION ALL SELECT * FROM (VALUES ('c-sharp', 'language'), ('c-plus-plus', 'language'))")
def seeded_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC24, SC25, E8: a dimension loaded by slug from rows and inline values; the second load changes nothing."""
    stored = table(spark, sf_dir, "part").select(F.concat(skill_slug(F.col("p_name")), F.lit("-"), F.col("p_partkey")).alias("slug"), F.col("p_brand").alias("category"), "p_size")
    inline = spark.createDataFrame([("C#", "language"), ("C++", "language")], "name string, category string").select(skill_slug(F.col("name")).alias("slug"), "category")
    seed = stored.where("p_size > 45").select("slug", F.lit("seed").alias("category")).unionByName(inline)
    once = state.upsert(stored.drop("p_size"), seed, ["slug"])
    return state.upsert(once, seed, ["slug"])


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <= 4 THEN o_totalprice END AS score FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def stored_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC3, Q18, J21: analyses found by their unique key (user, job, hash of inputs); a changed input finds none."""
    key = lambda job, version: F.substring(F.sha2(F.to_json(F.struct(job.alias("job"), version.alias("version"))), 256), 1, 32)
    stored = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), key(F.col("o_orderkey"), F.lit(1)).alias("input_hash"), F.col("o_totalprice").alias("score"))
    asked = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", key(F.col("l_orderkey"), F.when(F.col("l_linenumber") <= 4, 1).otherwise(2)).alias("input_hash"))
    return asked.join(stored, ["l_orderkey", "input_hash"], "left").select("l_orderkey", "l_linenumber", "score")


@query(
    """SELECT o_custkey AS user_id, count(*) AS experience, count(DISTINCT o_orderpriority) AS skills, count(*) FILTER (o_orderstatus = 'O') AS to_confirm, coalesce(any_value(n_projects), 0) AS projects FROM orders
LEFT JOIN (SELECT o_custkey AS c, count(*) AS n_projects FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY 1) ON c = o_custkey GROUP BY 1"""
)
def profile_overviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC4, A23, A25: entries of every section of a profile, from a table each."""
    orders = table(spark, sf_dir, "orders").withColumn("user_id", F.col("o_custkey"))
    projects = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").join(orders.select("user_id", F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    sections = {"experience": orders, "projects": projects, "skills": orders.select("user_id", "o_orderpriority").distinct(), "to_confirm": orders.where("o_orderstatus = 'O'")}
    return profile.overview(sections, "user_id")


@query(
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false ELSE true END AS direct, CASE WHEN o_orderkey % 2 = 0 THEN ['https://own.example/1', 'https://seen.example/1'] ELSE ['https://seen.example/1', 'https://own.example/1'] END AS links FROM orders"""
)
def direct_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of the employer itself; its own page comes first among the links."""
    k = F.col("o_orderkey") % 4
    link = F.when(k == 0, "https://boards.greenhouse.io/acme/jobs/1").when(k == 1, "https://acme.example/careers/1").otherwise("https://www.indeed.com/x")
    via = F.when(k == 3, "Acme careers")
    own, seen = F.array(F.lit("https://own.example/1"), F.lit("https://seen.example/1?ref=x")), F.array(F.lit("https://seen.example/1"))
    first = joins.links_of(own, seen, F.col("o_orderkey") % 2 == 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", places.is_direct(F.lit("Acme Pvt Ltd"), via, F.array(link)).alias("direct"), F.transform(first, lambda u: F.regexp_replace(u, r"\?.*$", "")).alias("links"))


#: Signed hashes of the words of a text, summed in 64 slots and scaled to length 1.
_EMBEDDED = r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(substring(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 2000)), '[^a-z0-9+#.]+'), lambda x: length(x) > 1) AS words FROM documents),
h AS (SELECT doc_id, list_reduce(list_transform(string_split(word, ''), lambda c: unicode(c)::BIGINT), lambda a, b: (xor(a, b) * 16777619) & 4294967295, 2166136261::BIGINT) AS h FROM (SELECT doc_id, unnest(words) AS word FROM w)),
s AS (SELECT doc_id, h % 64 AS slot, sum(CASE WHEN h % 2 = 1 THEN 1 ELSE -1 END)::DOUBLE AS x FROM h GROUP BY ALL), n AS (SELECT doc_id, sqrt(sum(x * x)) AS n, map_from_entries(list((slot, x))) AS m FROM s GROUP BY 1)"""


@query(_EMBEDDED + " SELECT doc_id, CASE WHEN n IS NOT NULL THEN list_transform(range(64), lambda i: round(coalesce(m[i], 0) / CASE WHEN n = 0 THEN 1 ELSE n END, 6)) END AS vector, n IS NULL AS deferred FROM documents LEFT JOIN n USING (doc_id)")
def mock_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC23, V3, V4: signed hashed vectors of texts (by the rule their first
    2,000 characters); a text without words is deferred."""
    rows = heavy(spark, sf_dir, "documents").select("doc_id", "text")
    found = vectors.embed(rows, "doc_id", size=64)
    return found.select("doc_id", F.transform("vector", lambda x: F.round(x, 6) + 0.0).alias("vector"), "deferred")


@query(_EMBEDDED + " SELECT a.doc_id, round(list_sum(list_transform(range(64), lambda i: coalesce(a.m[i], 0) / a.n * coalesce(b.m[i], 0) / b.n)), 6) AS similarity FROM n a JOIN n b ON b.doc_id = a.doc_id + 1 WHERE a.n > 0 AND b.n > 0")
def mock_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1, V4: cosine of the unit vectors of each document and the next, as their dot product."""
    found = vectors.embed(heavy(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", size=64).where("vector is not null and exists(vector, x -> x <> 0)")
    later = found.select((F.col("doc_id") - 1).alias("doc_id"), F.col("vector").alias("next"))
    return found.join(later, "doc_id").select("doc_id", (F.round(vectors.dot(F.col("vector"), F.col("next")), 6) + 0.0).alias("similarity"))


@query("SELECT p_partkey, substring(trim('Engineer. Skills: ' || p_brand || ', ' || p_type || '. ' || repeat(p_name || ' ', 90)), 1, 2000) AS text FROM part")
def profile_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of a profile that is embedded, at most 2,000 characters by the rule."""
    rows = table(spark, sf_dir, "part")
    return rows.select("p_partkey", documents.profile_text(F.lit("Engineer"), F.array("p_brand", "p_type"), F.array(F.repeat(F.concat("p_name", F.lit(" ")), 90))).alias("text"))
