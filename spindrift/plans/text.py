"""Queries of text, pages, sources and entity resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import parse, places, text
from spindrift.operators import resolve
from spindrift.plans.inputs import POSTINGS, cases, heavy, now, oracle, relation, table
from spindrift.plans.registry import SQL, query
from spindrift.sources import pages as web
from spindrift.sources import postings

_P = oracle(postings=POSTINGS)
_NORMAL = "trim(regexp_replace(lower(regexp_replace(text, '[|•]', ' ', 'g')), '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, sha256({_NORMAL}) AS sha FROM documents")
def normalized_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts made equal for matching, as a hash."""
    return heavy(spark, sf_dir, "documents").select("doc_id", F.sha2(text.normalize_for_match(F.col("text")), 256).alias("sha"))


@query(f"SELECT doc_id, left(sha256(left(regexp_replace({_NORMAL}, '[^a-z0-9 ]+', '', 'g'), 3000)), 32) AS hash FROM documents")
def description_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes that ignore case, spacing and punctuation."""
    return heavy(spark, sf_dir, "documents").select("doc_id", places.description_hash(F.col("text")).alias("hash"))


@query("SELECT doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))::INT AS n_words, len(list_filter(string_split_regex(text, '\\r?\\n'), lambda l: trim(l) <> ''))::INT AS n_lines FROM documents")
def text_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and lines that are not empty."""
    return heavy(spark, sf_dir, "documents").select("doc_id", text.word_count(F.col("text")).alias("n_words"), F.size(text.split_lines(F.col("text"))).alias("n_lines"))


@query("SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}'), lambda x: lower(x))).list_sort() AS emails, len(list_distinct(list_filter(regexp_extract_all(text, '\\+?\\(?\\d[\\d\\s().-]{8,}\\d'), lambda x: length(regexp_replace(x, '\\D', '', 'g')) BETWEEN 10 AND 15)))::INT AS n_phones FROM documents")
def found_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses and numbers in texts."""
    return heavy(spark, sf_dir, "documents").select("doc_id", F.array_sort(text.emails(F.col("text"))).alias("emails"), F.size(text.phones(F.col("text"))).alias("n_phones"))


@query("SELECT page_id, list_distinct(regexp_extract_all(html, '(?i)<a\\b[^>]*?href=\"([^\"#][^\"]*)\"', 1)).list_sort() AS links FROM pages")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a page as written."""
    return heavy(spark, sf_dir, "pages").select("page_id", F.array_sort(text.links(F.col("html"))).alias("links"))


_BARE = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '(?i)<br\s*/?>|</(p|div|li|h[1-6]|tr|ul|ol|section|article)>', chr(10), 'g'), '<[^>]+>', ' ', 'g')"
_DECODED = _BARE
for _name, _value in text.ENTITIES.items():
    _DECODED = f"replace({_DECODED}, '{_name}', '{_value.replace(chr(39), chr(39) * 2)}')"


@query(rf"SELECT page_id, array_to_string(list_filter(list_transform(string_split(replace({_DECODED}, '&amp;', '&'), chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM pages")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of whole pages."""
    return heavy(spark, sf_dir, "pages").select("page_id", text.html_to_text(F.col("html")).alias("text"))


@query("SELECT page_id, regexp_replace(regexp_replace(lower(regexp_replace(url, '^https?://(www\\.)?', '')), '[?#].*$', ''), '/+$', '') AS address, regexp_extract(url, '^https?://(?:www\\.)?([^/]+)', 1) AS host FROM pages")
def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses without scheme, query and closing slash."""
    address = text.canonical_url(F.col("url"))
    return heavy(spark, sf_dir, "pages").select("page_id", address.alias("address"), F.regexp_extract(address, "^([^/]+)", 1).alias("host"))


@query("SELECT page_id, list_sort(list_distinct(list_transform(regexp_extract_all(html, '(?i)<a\\b[^>]*?href=\"([^\"#][^\"]*)\"', 1), lambda l: CASE WHEN l LIKE '/%' THEN regexp_extract(url, '^[a-zA-Z]+://[^/?#]+') || l ELSE l END))) AS links FROM pages")
def absolute_page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links made absolute, in order of their spelling. (The SQL joins the
    absolute paths that these pages hold; other forms are tested.)"""
    return heavy(spark, sf_dir, "pages").select("page_id", F.array_sort(web.absolute_links("url", "html")).alias("links"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'recruitee' ELSE 'page' END AS kind, CASE page_id % 4 WHEN 0 THEN 'acme' || page_id WHEN 1 THEN 'beta' || page_id WHEN 2 THEN 'c' || page_id ELSE 'example.com/jobs' END AS token FROM pages")
def detected_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X32, SC15: kind and token of a careers address."""
    i, k = F.col("page_id").cast("string"), F.col("page_id") % 4
    url = F.when(k == 0, F.concat(F.lit("https://boards.greenhouse.io/Acme"), i, F.lit("/jobs/1"))).when(k == 1, F.concat(F.lit("https://jobs.eu.lever.co/beta"), i)).when(k == 2, F.concat(F.lit("https://c"), i, F.lit(".recruitee.com/o/x"))).otherwise("https://www.example.com/jobs?x=1")
    return heavy(spark, sf_dir, "pages").select("page_id", web.detect_site(url).alias("s")).select("page_id", "s.kind", "s.token")


@query("SELECT page_id, n > 0 AS allowed FROM (SELECT page_id, CASE WHEN contains(url, '/fr/') THEN 0 WHEN regexp_matches(url, '/en/[0-9]*5([?/]|$)') THEN 0 ELSE 1 END AS n FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://[^/]+', ''), '#.*$', '') AS url FROM pages))")
def robots_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the longest matching rule decides."""
    rules = web.robots_rules(F.lit("User-agent: *\nDisallow: /fr/\nDisallow: /en/*5$\nDisallow: /en/*5/\nDisallow: /en/*5?\n# done\nAllow: /\n"))
    path = F.regexp_replace(F.regexp_replace("url", "^https?://[^/]+", ""), "#.*$", "")
    return heavy(spark, sf_dir, "pages").select("page_id", web.robots_allows(rules, path).alias("allowed"))


@query("SELECT page_id, NOT regexp_matches(url, '^https://') AS safe FROM pages")
def safe_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """addresses that may be fetched."""
    url = F.when(F.col("url").startswith("https://"), F.regexp_replace("url", "^https://[^/]+", "https://192.168.0.7:8080")).otherwise(F.col("url"))
    return heavy(spark, sf_dir, "pages").select("page_id", web.is_safe_url(url).alias("safe"))


def _jsonld(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a posting put into a graph of their JSON-LD."""
    posting = F.to_json(F.struct(F.lit("JobPosting").alias("@type"), F.concat(F.lit("Title "), F.col("page_id").cast("string")).alias("title"), F.struct(F.col("url").alias("name")).alias("hiringOrganization")))
    block = F.concat(F.lit('<script type="application/ld+json">{"@graph":[{"@type":"WebSite"},'), posting, F.lit("]}</script>"))
    return heavy(spark, sf_dir, "pages").select("page_id", "url", F.concat("html", block).alias("html"))


@query("SELECT page_id, 'Title ' || page_id AS title, url AS company FROM pages")
def jsonld_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC17: postings in a page's JSON-LD graph."""
    return web.read_jsonld(_jsonld(spark, sf_dir)).select("page_id", "title", "company")


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'jsonld' ELSE 'none' END AS kind FROM pages")
def careers_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC16: the first place that postings are found in."""
    with_block = _jsonld(spark, sf_dir).select("page_id", F.col("html").alias("h"))
    rows = heavy(spark, sf_dir, "pages").join(with_block, "page_id")
    plain = F.lit('<a href="/about">About</a>')
    return rows.select("page_id", web.careers_kind(F.when(F.col("page_id") % 2 == 0, F.col("h")).otherwise(plain)).alias("kind"))


@query("SELECT 'encoded' AS provider, 'j' || o_orderkey AS external_id, 'Engineer ' || o_orderkey AS title, 'Pune & ' || o_custkey AS location, 'Hello' || chr(10) || 'world' AS description FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'listed', 'j' || o_orderkey, 'Analyst', 'Remote', 'x' FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey % 3 > 0")
def board_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC10, SC12, SC15: JSON of two kinds of boards as one table."""
    k = F.col("o_orderkey")
    key = F.concat(F.lit("j"), k.cast("string"))
    one = F.struct(key.alias("id"), F.concat(F.lit("Engineer "), k.cast("string")).alias("title"), F.struct(F.concat(F.lit("Pune & "), F.col("o_custkey").cast("string")).alias("name")).alias("location"), F.lit("&lt;p&gt;Hello&lt;/p&gt; world").alias("content"))
    two = F.struct(key.alias("id"), F.lit("Analyst").alias("title"), F.lit("Remote").alias("location"), F.lit("x").alias("descriptionPlain"), (k % 3 > 0).alias("isListed"))
    body = F.when(k % 2 == 0, F.to_json(F.struct(F.array(one).alias("jobs")))).otherwise(F.to_json(F.struct(F.array(two).alias("jobs"))))
    responses = table(spark, sf_dir, "orders").select(F.when(k % 2 == 0, "encoded").otherwise("listed").alias("kind"), F.lit("c").alias("company"), body.alias("body"))
    return postings.read_all(responses).select("provider", "external_id", "title", "location", "description")


@query(
    f"""{_P} SELECT job_id FROM postings WHERE (title = 'React Developer' OR regexp_matches(title, '(?i)data')) AND location IS NOT NULL
AND (location IN ('Bangalore, Karnataka', 'Bengaluru', 'Pune (Hybrid)', 'Remote, India') OR (location LIKE 'Remote%' AND location NOT LIKE '%Europe%')) AND (posted_at IS NULL OR epoch(TIMESTAMP '2001-08-02 12:00:00') - epoch(posted_at) <= 60 * 86400)"""
)
def wanted_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F11, F12, F13, F14, SC13: title, place and date suit."""
    rows = relation(spark, sf_dir, POSTINGS).withColumn("mode_hint", F.lit(None).cast("string"))
    want = postings.wanted(F.array(F.lit("React Developer"), F.lit("Senior Data Engineer")), F.array(F.lit("Bengaluru"), F.lit("Pune")), F.lit(True), now())
    return rows.where(want).select("job_id")


@query(f"{_P} SELECT job_id, {cases('job_id', ['senior react developer', 'react developer', 'sde 2', 'sde 2 backend', 'data engineer', 'senior data engineer', 'ml engineer intern', 'lead platform architect', 'qa analyst', 'junior front end engineer', 'full stack developer 3'])} AS title_key, {cases('job_id', ['senior', None, None, None, None, 'senior', 'intern', 'lead', None, 'junior', None])} AS seniority FROM postings")
def title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles for comparison, and their level."""
    title = F.col("title")
    return relation(spark, sf_dir, POSTINGS).select("job_id", places.title_key(title).alias("title_key"), parse.seniority(title, F.lit(None).cast("double")).alias("seniority"))


@query(f"{_P} SELECT job_id, regexp_extract(company_name, '^Customer \\d+') || {cases('company_id_or_key', ['', ' Technologies', '', ' Solutions', '', ' Staffing Services', ' India'])} AS display, lower(regexp_extract(company_name, '^Customer \\d+')) || {cases('company_id_or_key', ['', '', '', '', '', ' staffing', ''])} AS key, regexp_matches(company_name, 'Staffing') AS staffing FROM (SELECT p.*, o_custkey AS company_id_or_key FROM postings p JOIN orders ON job_id = o_orderkey)")
def company_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without endings, keys, agencies."""
    name = F.col("company_name")
    return relation(spark, sf_dir, POSTINGS).select("job_id", places.display_company(name).alias("display"), places.company_key(name).alias("key"), places.is_staffing(name).alias("staffing"))


@query(f"{_P} SELECT job_id, CASE WHEN job_id % 12 = 5 OR job_id % 7 = 3 OR job_id % 7 = 6 THEN 'hybrid' WHEN job_id % 7 = 4 OR location LIKE 'Remote%' THEN 'remote' WHEN job_id % 7 IN (2, 5) THEN 'onsite' END AS mode FROM postings")
def work_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the work is done."""
    return relation(spark, sf_dir, POSTINGS).select("job_id", places.work_mode(F.col("location"), F.col("description"), F.lit(None).cast("string")).alias("mode"))


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '2023-04' WHEN 1 THEN '2021-12' WHEN 2 THEN '2019-07' WHEN 3 THEN '1997-03' WHEN 4 THEN '2018' END AS ym, CASE p_partkey % 6 WHEN 0 THEN 24279 WHEN 1 THEN 24263 WHEN 2 THEN 24234 WHEN 3 THEN 23966 WHEN 4 THEN 24221 END::INT AS month_no FROM part")
def partial_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written dates as year and month."""
    written = F.element_at(F.array(*(F.lit(x) for x in ("Apr 2023", "12/2021", "2019-07.", "14 March 1997", "2018", "sometime"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    ym = parse.year_month(written)
    return table(spark, sf_dir, "part").select("p_partkey", ym.alias("ym"), parse.month_index(ym).alias("month_no"))


@query("SELECT event_id, ts - CASE event_id % 5 WHEN 0 THEN INTERVAL 3 DAY WHEN 1 THEN INTERVAL 5 HOUR WHEN 2 THEN INTERVAL 60 DAY WHEN 3 THEN INTERVAL 1 DAY END AS at FROM (SELECT event_id, date_trunc('second', ts)::TIMESTAMP AS ts FROM events)")
def relative_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D10: "3 days ago" as a time."""
    said = F.element_at(F.array(*(F.lit(x) for x in ("3 days ago", "5 hours ago", "2 months ago", "yesterday", "soon"))), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", parse.relative_date(said, F.date_trunc("second", F.col("ts").cast("timestamp"))).alias("at"))


@query("SELECT doc_id, count(DISTINCT g) AS n_shared, count(DISTINCT item_id) AS n_items FROM (SELECT doc_id, unnest(list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] FOR i IN range(1, len(w) - 3)])) AS g FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents)) JOIN (SELECT item_id, unnest(list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] FOR i IN range(1, len(w) - 3)])) AS g FROM (SELECT item_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM benchmark)) USING (g) GROUP BY 1")
def shared_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-word runs that texts share with a list of passages."""
    grams = lambda rows, key: resolve.word_runs(rows, key, "text", 5)
    docs = grams(heavy(spark, sf_dir, "documents"), "doc_id")
    items = grams(table(spark, sf_dir, "benchmark"), "item_id")
    return docs.join(items, "run").groupBy("doc_id").agg(F.countDistinct("run").alias("n_shared"), F.countDistinct("item_id").alias("n_items"))


@query("SELECT doc_id, CASE WHEN trim(p) = '' THEN doc_id ELSE min(doc_id) OVER (PARTITION BY p) END AS canonical_id FROM (SELECT doc_id, regexp_replace(" + _NORMAL + ", '[^\\p{L}\\p{M}\\p{N} ]+', '', 'g') AS p FROM documents)")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal whole texts share the least id; texts without letters and
    digits stay alone."""
    rows = heavy(spark, sf_dir, "documents").select("doc_id", places.text_hash(F.col("text")).alias("hash"))
    return resolve.canonical_by_key(rows, "doc_id", "hash").select("doc_id", "canonical_id")


@query(
    f"""WITH RECURSIVE {_P.removeprefix('WITH ')}, rows_ AS (SELECT job_id, provider, external_id, o_custkey AS c, coalesce(location, '') AS city, title, posted_at FROM postings JOIN orders ON job_id = o_orderkey),
links AS (SELECT a.job_id AS x, b.job_id AS y FROM rows_ a JOIN rows_ b ON a.job_id <> b.job_id AND a.provider = b.provider AND a.external_id = b.external_id
  UNION SELECT a.job_id, b.job_id FROM rows_ a JOIN rows_ b ON a.job_id <> b.job_id AND a.c = b.c AND a.city = b.city AND (a.title = b.title OR 1 - levenshtein(a.title, b.title) / greatest(length(a.title), length(b.title))::DOUBLE >= 0.9) AND coalesce(abs(epoch(a.posted_at) - epoch(b.posted_at)) <= 30 * 86400, true)),
reach AS (SELECT job_id AS x, job_id AS y FROM rows_ UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x) SELECT x AS job_id, min(y) AS canonical_id FROM reach GROUP BY 1"""
)
def resolved_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same posting from several sources, as components."""
    rows = relation(spark, sf_dir, POSTINGS)
    rows = rows.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), "o_custkey"), "job_id")
    rows = rows.select("job_id", "provider", "external_id", F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("company_key"), F.col("location").alias("city"), F.col("title").alias("title_key"), F.concat(F.lit("h"), F.col("job_id").cast("string")).alias("description_hash"), "posted_at")
    return resolve.components(rows, "job_id").select("job_id", "canonical_id")


@query()
def greedy_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings merged one after another in the order of their ids,
    with links by provider id, description and close titles (order decides, so
    no SQL; tested against a loop)."""
    rows = relation(spark, sf_dir, POSTINGS).select(
        "job_id", "provider", "external_id", F.lower("company_name").alias("company_key"), F.col("location").alias("city"), F.lower("title").alias("title_key"),
        F.when(F.col("job_id") % 5 > 0, F.md5(F.concat_ws("|", "company_name", "description"))).alias("description_hash"), "posted_at", (F.col("job_id") % 3 == 0).alias("truncated"), "description",
    )
    return resolve.greedy(rows, "job_id")


#: D14 puts together what other queries read one by one, and so does its SQL.
_KEYS = "[k FOR k IN list_transform(string_split(regexp_replace(trim(regexp_replace(lower(title || chr(10) || description), '[\\s,;:()|·•/]+', ' ', 'g')), '[^a-z0-9#+ ]', '', 'g'), ' '), lambda k: k)]"
_RUNS = " || ".join(f"[array_to_string(w[i:i + {n - 1}], '') FOR i IN range(1, len(w) - {n - 2})]" for n in (1, 2, 3, 4))
SQL["prepared_postings"] = f"""SELECT job_id, display AS company, key AS company_key, city, mode AS work_mode, title_key, left(sha256(left(regexp_replace(trim(regexp_replace(lower(description), '\\s+', ' ', 'g')), '[^a-z0-9 ]+', '', 'g'), 3000)), 32) AS description_hash, staffing, min_annual, max_annual, currency, disclosed, min_years, max_years,
coalesce(seniority, CASE WHEN min_years >= 8 THEN 'lead' WHEN min_years >= 5 THEN 'senior' WHEN min_years >= 2 THEN 'mid' WHEN min_years IS NOT NULL THEN 'junior' END) AS seniority, notice_max_days, bond, office_days,
(SELECT count(DISTINCT k) FROM (SELECT unnest(r || list_transform(list_filter(r, lambda k: k LIKE '%js' AND length(k) > 3), lambda k: left(k, length(k) - 2))) AS k) WHERE k <> '')::INT AS n_keys
FROM (SELECT p.*, {_RUNS} AS r FROM (SELECT *, {_KEYS} AS w FROM ({_P} SELECT job_id, title, description FROM postings)) p)
JOIN ({SQL['company_names']}) USING (job_id) JOIN ({SQL['canonical_cities']}) USING (job_id) JOIN ({SQL['work_modes']}) USING (job_id) JOIN ({SQL['title_keys']}) USING (job_id) JOIN ({SQL['salaries']}) USING (job_id) JOIN ({SQL['experience_asked']}) USING (job_id) JOIN ({SQL['posting_conditions']}) USING (job_id)"""
