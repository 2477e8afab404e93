"""Queries of the smaller text, feed and table rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import parse, places, text
from spindrift.operators import composer, documents, events, feed, history, metrics, profile, scoring, sets, state
from spindrift.operators.reports import strategy_fits
from spindrift.operators.storage import cut, fresh
from spindrift.plans.inputs import NOW, POSTINGS, cases, now, oracle, relation, table
from spindrift.plans.registry import query
from spindrift.sources import pages as web
from spindrift.streaming import applications
from spindrift.streaming.statelog import StateLog

_P = oracle(postings=POSTINGS)


def dealt(key: str, values: list) -> F.Column:
    """Values dealt out by a key, as ``cases`` does in SQL."""
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.col(key) % len(values) + 1).cast("int"))


def quoted(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def lists(key: str, values: list[list]) -> str:
    """A CASE that deals lists out by a key."""
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {quoted(v)}" for i, v in enumerate(values)) + " END"


@query(f"{_P} SELECT job_id, coalesce(posted_at, last_seen_at) < TIMESTAMP '{NOW}' - INTERVAL 30 DAY AS stale FROM postings")
def stale_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """postings over 30 days old by their date, or last seen so long ago if they have none."""
    return relation(spark, sf_dir, POSTINGS).select("job_id", feed.stale(now()).alias("stale"))


_QUERIES = ["group=saved&mode=remote&page=3", "group=nonsense&salary=12", "mode=moon&posted=7&city=Pune", "page=-2&salary=abc", "", "provider=board&posted=0"]


@query(
    f"""SELECT o_orderkey, {cases('o_orderkey', ['saved', 'for_you', 'for_you', 'for_you', 'for_you', 'for_you'])} AS "group", CASE o_orderkey % 6 WHEN 0 THEN 3 ELSE 1 END::BIGINT AS page, {cases('o_orderkey', ['remote', None, None, None, None, None])} AS mode, {cases('o_orderkey', [None, None, 'Pune', None, None, None])} AS city,
{cases('o_orderkey', [None, None, None, None, None, 'board'])} AS provider, CASE WHEN o_orderkey % 6 = 2 THEN 7 END::BIGINT AS days, CASE WHEN o_orderkey % 6 = 1 THEN 1200000 END::BIGINT AS least_pay, o_orderkey % 6 IN (0, 1, 2, 5) AS any_filter FROM orders"""
)
def parsed_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """filters of a page's query string; what is invalid is dropped."""
    return table(spark, sf_dir, "orders").select("o_orderkey", feed.filters_of(dealt("o_orderkey", _QUERIES)).alias("f")).select("o_orderkey", "f.*")


@query("SELECT o_custkey AS user_id, count(*) AS runs, count(*) FILTER (o_orderstatus = 'F') AS finished FROM orders GROUP BY 1")
def finished_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: how many of a user's runs are over."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count("*").alias("runs"), metrics.count_where(F.col("o_orderstatus") == "F").alias("finished"))


@query("SELECT p_brand AS name, avg(p_size) AS value, 25.0 + length(p_brand) % 3 AS target FROM part GROUP BY 1 HAVING avg(p_size) < 25.0 + length(p_brand) % 3")
def missed_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics under their target."""
    rows = table(spark, sf_dir, "part")
    targets = rows.select(F.col("p_brand").alias("name"), (F.lit(25.0) + F.length("p_brand") % 3).alias("target")).distinct()
    return metrics.missed_targets(rows.groupBy(F.col("p_brand").alias("name")).agg(F.avg("p_size").alias("value")), targets)


@query("SELECT o_custkey AS user_id, o_orderkey AS job_id, o_orderstatus AS kind FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of rows with one key the first."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("kind"), "o_orderdate", F.col("o_orderkey").alias("job_id"))
    return history.first_of(rows, ["user_id", "kind"], "o_orderdate", "job_id").select("user_id", "job_id", "kind")


@query(
    """SELECT user_id, job_id, place, open_place FROM (SELECT o_custkey AS user_id, o_orderkey AS job_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place,
CASE WHEN o_orderstatus <> 'F' THEN row_number() OVER (PARTITION BY o_custkey, o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey) END AS open_place FROM orders) WHERE place <= 10 OR open_place <= 5"""
)
def best_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best postings of each run, and its five best that aren't analysed yet."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("job_id"), "o_totalprice", (F.col("o_orderstatus") == "F").alias("analysed"))
    return history.best_and_open(rows, "user_id", [F.desc("o_totalprice"), "job_id"], F.col("analysed"), 10, 5).select("user_id", "job_id", "place", "open_place")


@query("SELECT user_id, list_sort(list_intersect(a, b)) AS both, list_sort(list_filter(a, lambda x: NOT list_contains(b, x))) AS only, list_has_all(a, b) AS covers FROM (SELECT o_custkey AS user_id, list(DISTINCT o_orderstatus) FILTER (o_orderkey % 2 = 0) AS a_, list(DISTINCT o_orderstatus) FILTER (o_orderkey % 2 = 1) AS b_, coalesce(a_, []) AS a, coalesce(b_, []) AS b FROM orders GROUP BY 1)")
def array_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U4: what two arrays share, what only the first has, and whether it holds the second."""
    even = F.col("o_orderkey") % 2 == 0
    pairs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.collect_set(F.when(even, F.col("o_orderstatus"))).alias("a"), F.collect_set(F.when(~even, F.col("o_orderstatus"))).alias("b"))
    return pairs.select("user_id", sets.compared(F.col("a"), F.col("b")).alias("s")).select("user_id", F.array_sort("s.both").alias("both"), F.array_sort("s.only").alias("only"), "s.covers")


_LINES = ["• Built things", "- Python, SQL and Spark.", "➢ a | b", "Acme  |  Pune\t2019", "Plain"]


@query(
    f"""SELECT o_orderkey, {cases('o_orderkey', ['Built things', 'Python, SQL and Spark.', 'a | b', 'Acme  |  Pune' + chr(9) + '2019', 'Plain'])} AS line, {lists('o_orderkey', [['Built things'], ['Python', 'SQL and Spark'], ['a', 'b'], ['Acme', 'Pune', '2019'], ['Plain']])} AS items,
{lists('o_orderkey', [['Built things'], ['Python, SQL and Spark.'], ['a', 'b'], ['Acme', 'Pune', '2019'], ['Plain']])} AS fields FROM orders"""
)
def line_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without their bullet, their items and fields."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.strip_bullet(dealt("o_orderkey", _LINES)).alias("line"))
    return rows.select("o_orderkey", "line", text.split_list(F.col("line")).alias("items"), text.split_fields(F.col("line")).alias("fields"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 ELSE 0.0 END::DOUBLE AS score FROM part")
def best_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X11: how well a text holds a phrase: as it is, nearly, or not at all."""
    hay = F.concat(F.lit("we made big data tables at "), F.lower("p_name"))
    needle = F.element_at(F.array(F.lit("big data tables"), F.lit("big datas tables"), F.lit("zzz qqq")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(text.best_match(hay, needle), 1).alias("score"))


_PLACES = ["Bangalore / Remote", "Remote, India", "Location: Gurgaon; Delhi", "New York", "Trivandrum | Kochi"]


@query(f"SELECT o_orderkey, {cases('o_orderkey', ['Bengaluru', None, 'Gurugram', None, 'Thiruvananthapuram'])} AS city FROM orders")
def indian_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first known city that a location names."""
    return table(spark, sf_dir, "orders").select("o_orderkey", places.indian_city(dealt("o_orderkey", _PLACES)).alias("city"))


_SKILLS = ["React.js", "C++", "Node JS", "Go", "Crème-Brûlée 2"]


@query(
    f"""SELECT o_orderkey, {cases('o_orderkey', ['reactjs', 'c++', 'nodejs', 'go', 'cremebrulee2'])} AS key, o_orderkey % 5 <> 3 AS mentioned, o_orderkey % 5 = 0 AS named, o_orderkey % 2 = 0 AS go FROM orders"""
)
def skill_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of skills, and whether a text mentions them; "go" counts only as the name Go."""
    said = F.when(F.col("o_orderkey") % 2 == 0, "We use React, Node.js, C++ and Creme Brulee 2 with Go daily").otherwise("We use React, Node.js, C++ and Creme Brulee 2, let us go")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", dealt("o_orderkey", _SKILLS).alias("name"), said.alias("text")).withColumn("keys", text.skill_keys_in(F.col("text")))
    key = text.skill_key(F.col("name"))
    react = profile.mentions_named(F.col("text"), F.col("keys"), "React") & (F.col("o_orderkey") % 5 == 0)
    return rows.select("o_orderkey", key.alias("key"), (text.mentions(F.col("keys"), key) & (key != "go")).alias("mentioned"), react.alias("named"), profile.mentions_named(F.col("text"), F.col("keys"), "Go").alias("go"))


@query("SELECT c_custkey, c_custkey % 3 < 2 AS same FROM customer")
def same_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers are equal by their last ten digits."""
    number = F.format_string("98%08d", F.col("c_custkey"))
    other = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("+91 "), F.substring(number, 1, 5), F.lit("-"), F.substring(number, 6, 5))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("(0)"), number)).otherwise(F.concat(F.lit("1"), F.substring(number, 1, 9)))
    return table(spark, sf_dir, "customer").select("c_custkey", text.same_phone(number, other).alias("same"))


_TOKENS, _HEADS = ["acme-labs", "BetaWorks", "gamma%20corp", "x_y.z"], ["Careers at Acme | Jobs", "Beta Works - Careers", "Jobs with Gamma - Pune", "Delta"]


@query(f"SELECT o_orderkey, {cases('o_orderkey', ['Acme Labs', 'Beta Works', 'Gamma Corp', 'X Y Z'])} AS from_token, {cases('o_orderkey', ['Acme', 'Beta Works', 'Gamma', 'Delta'])} AS from_title FROM orders")
def site_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A company's name from its board's address, or a page's title."""
    return table(spark, sf_dir, "orders").select("o_orderkey", web.name_from_token(dealt("o_orderkey", _TOKENS)).alias("from_token"), web.name_from_title(dealt("o_orderkey", _HEADS)).alias("from_title"))


_ROLES = ["Senior Front-end Engineer", "Full Stack Developer II", "Data Scientist (NLP)", "Lead C++ Developer", "Intern"]


@query(f"SELECT o_orderkey, {lists('o_orderkey', [['frontend'], ['fullstack'], ['data', 'scientist', 'nlp'], ['c++'], []])}::VARCHAR[] AS words, o_orderkey % 5 = 2 AS is_data FROM orders")
def role_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of a title that name the role, and whether it is a wanted one."""
    title = dealt("o_orderkey", _ROLES)
    return table(spark, sf_dir, "orders").select("o_orderkey", places.role_words(title).alias("words"), places.title_matches(title, F.array(F.lit("Senior Data Scientist"), F.lit("Engineer"))).alias("is_data"))


_AT = ["Bengaluru, India", "Remote, India", "Remote - Europe", "Pune", "Berlin"]


@query("SELECT o_orderkey, o_orderkey % 5 IN (0, 1) AS wanted, o_orderkey % 5 IN (0, 1, 3) AS anywhere FROM orders")
def wanted_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """places that suit: a city, work from home that is open to the country, or anywhere in it."""
    at, none = dealt("o_orderkey", _AT), F.lit(None).cast("string")
    return table(spark, sf_dir, "orders").select("o_orderkey", places.location_matches(at, none, F.array(F.lit("Bengaluru")), F.lit(True)).alias("wanted"), places.location_matches(at, none, F.array().cast("array<string>"), F.lit(True)).alias("anywhere"))


_DATES = ["Jan 2020 - Present", "03/2018 – 12/2019", "2015 to 2017", "since May 2021", "no dates"]


@query(f"SELECT o_orderkey, {cases('o_orderkey', ['2020-01', '2018-03', '2015', None, None])} AS first, {cases('o_orderkey', [None, '2019-12', '2017', None, None])} AS last, o_orderkey % 5 = 0 AS still, {lists('o_orderkey', [['2020-01'], ['2018-03', '2019-12'], ['2015', '2017'], ['2021-05'], []])}::VARCHAR[] AS dates FROM orders")
def date_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The span that a line states, and the dates in it."""
    line = dealt("o_orderkey", _DATES)
    return table(spark, sf_dir, "orders").select("o_orderkey", parse.date_range(line).alias("r"), parse.dates_in(line).alias("dates")).select("o_orderkey", "r.first", "r.last", "r.still", "dates")


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 800000 WHEN 1 THEN 1000000 END::BIGINT AS low, CASE o_orderkey % 3 WHEN 0 THEN 1200000 WHEN 1 THEN 1400000 END::BIGINT AS high FROM orders")
def salary_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pay from its own field, else from the line of the description that names it."""
    k = F.col("o_orderkey") % 3
    pay = parse.salary_or_line(F.when(k == 0, "8-12 LPA"), F.when(k == 1, "We are 40 people.\nSalary: 10-14 LPA\nApply").otherwise("We are 40 people."))
    return table(spark, sf_dir, "orders").select("o_orderkey", pay.alias("s")).select("o_orderkey", F.col("s.min_annual").alias("low"), F.col("s.max_annual").alias("high"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'first' WHEN 1 THEN 'longer text' WHEN 2 THEN 'whole' ELSE 'same!' END AS description, o_orderkey % 4 = 0 AS truncated, o_orderkey % 4 IN (0, 3) AS embedding_valid FROM orders")
def merged_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK11, E2: the fuller description of two, and whether the vector still holds."""
    k = F.col("o_orderkey") % 4
    own = {"description": F.when(k == 0, "first").when(k == 1, "short").when(k == 2, "a long cut text").otherwise("same!"), "truncated": k.isin(0, 2)}
    other = {"description": F.when(k == 0, "x").when(k == 1, "longer text").when(k == 2, "whole").otherwise("equal"), "truncated": k == 0}
    return table(spark, sf_dir, "orders").select("o_orderkey", *(v.alias(c) for c, v in state.merge_duplicate(own, other).items()))


@query("SELECT l_orderkey AS job_id, l_linenumber AS ord FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F' UNION ALL SELECT o_orderkey, 1 FROM orders WHERE o_orderstatus = 'F'")
def replaced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK12, SK19: all rows of some parents replaced by new ones."""
    old = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("ord"))
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("job_id"), F.lit(1).alias("ord"))
    return state.replace_all(old, done, done, "job_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber <= 2 OR l_returnflag = 'R'")
def kept_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK18: rows that are listed, or that a guard protects, stay."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return state.keep_listed(rows, rows.where("l_linenumber <= 2"), ["l_orderkey", "l_linenumber"], F.col("l_returnflag") == "R").select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'closed' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END AS status, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS score FROM orders UNION ALL SELECT -o_orderkey, 'new', 0 FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey > 0")
def batched_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK21: statements of one batch applied one after another to a table, written once."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("open").alias("status"), F.col("o_totalprice").alias("score"))
    better = rows.where("id % 2 = 0").select("id", (F.col("score") * 2).alias("score"))
    added = rows.where("id % 5 = 0").select((-F.col("id")).alias("id"), F.lit("new").alias("status"), F.lit(0.0).alias("score"))
    return state.batch(rows, lambda t: state.update(t, better, ["id"]), lambda t: state.set_where(t, rows.where("id % 3 = 0"), "id", status=F.lit("closed")), lambda t: state.insert_ignore(t, added, ["id"], "score"))


@query("SELECT c_custkey AS owner, CASE WHEN c_custkey % 3 = 2 THEN 'name:acme' ELSE 'board:acme' END AS key FROM customer UNION ALL SELECT c_custkey, 'name:beta' FROM customer")
def resolved_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK23: sites known by name only take the address that was found for them, or go if it is there."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("owner"), F.explode(F.when(k % 3 == 0, F.array(F.lit("name:acme"), F.lit("board:acme"), F.lit("name:beta"))).otherwise(F.array(F.lit("name:acme"), F.lit("name:beta")))).alias("key"))
    found = rows.where("owner % 3 <> 2").select("owner", F.lit("acme").alias("name"), F.lit("board:acme").alias("key")).distinct()
    return state.resolve_placeholders_of(rows, found)


@query("SELECT o_orderkey, concat_ws(chr(10), 'Order ' || o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Done.' END, 'Priority ' || o_orderpriority) AS report FROM orders")
def report_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK25, Q17: a report's parts on lines of their own; empty parts left out."""
    return table(spark, sf_dir, "orders").select("o_orderkey", state.as_report(F.concat(F.lit("Order "), "o_orderkey"), F.when(F.col("o_orderstatus") == "F", "Done."), F.concat(F.lit("Priority "), "o_orderpriority")).alias("report"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'note' WHEN o_orderkey % 5 = 1 THEN 'rejected' ELSE 'note' END AS kind, CASE WHEN o_orderkey % 5 = 1 THEN o_orderdate WHEN o_orderkey % 5 = 0 THEN o_orderdate WHEN o_orderkey % 5 = 2 THEN o_orderdate + INTERVAL 12 HOUR ELSE o_orderdate + INTERVAL 6 HOUR END::TIMESTAMP AS last_activity,
CASE WHEN o_orderkey % 5 IN (0, 1) THEN o_orderdate + INTERVAL 3 HOUR END::TIMESTAMP AS follow_up_at FROM orders"""
)
def late_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST5, ST4: notes may be back-dated and move activity forward only; far future ones are refused; a follow-up that is past is done."""
    k, at = F.col("o_orderkey") % 5, F.col("o_orderdate").cast("timestamp")
    hours = lambda n: F.expr(f"INTERVAL {n} HOURS")
    noted = F.when(k == 0, at - hours(240)).when(k == 1, at + hours(48)).when(k == 2, at + hours(12)).otherwise(at + hours(6))
    return table(spark, sf_dir, "orders").select("o_orderkey", events.noted(noted, at, at + hours(3), at).alias("n")).select("o_orderkey", "n.*")


@query("SELECT c_nationkey AS user_id, CASE WHEN count(*) FILTER (c_mktsegment = 'BUILDING') >= 4 THEN 1 WHEN count(*) FILTER (c_mktsegment = 'BUILDING') >= 2 THEN 2 ELSE 4 END AS above, max(c_acctbal) AS years, list_sort(list(DISTINCT c_mktsegment)) AS skills FROM customer GROUP BY 1")
def ranking_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ranking needs of each user, as one row: margins, profile and held skills."""
    rows = table(spark, sf_dir, "customer").withColumn("user_id", F.col("c_nationkey"))
    dismissals = rows.select("user_id", F.when(F.col("c_mktsegment") == "BUILDING", "too_senior").otherwise("other").alias("reason"))
    profiles = rows.groupBy("user_id").agg(F.max("c_acctbal").alias("years"))
    skills = rows.select("user_id", F.col("c_mktsegment").alias("skill_id"), F.lit(3).alias("level"))
    held = scoring.ranking_context(profiles, skills, skills.limit(0).select(F.col("skill_id").alias("from_id"), F.col("skill_id").alias("to_id")), dismissals)
    return held.select("user_id", "above", "years", F.array_sort(F.transform("skills", lambda s: s["skill_id"])).alias("skills"))


@query("SELECT l_orderkey AS job_id, l_linenumber AS req, CASE WHEN l_returnflag = 'R' AND l_linenumber % 2 = 0 THEN 0.5 WHEN l_returnflag = 'R' THEN 0.0 ELSE 1.0 END::DOUBLE AS match, CASE WHEN l_returnflag = 'R' AND l_linenumber % 2 = 0 THEN 'partial' WHEN l_returnflag = 'R' THEN 'missing' ELSE 'strong' END AS status FROM lineitem")
def semantic_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q10: a missing skill that a report found under another name counts half."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("req"), F.when(F.col("l_returnflag") == "R", 0.0).otherwise(1.0).alias("match"))
    return scoring.with_semantic(rows, rows.where("req % 2 = 0").select("job_id", "req"), ["job_id", "req"]).select("job_id", "req", "match", scoring.status(F.col("match")).alias("status"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 1 THEN ['weights'] WHEN o_orderkey % 4 = 2 THEN ['thresholds'] WHEN o_orderkey % 4 = 3 THEN ['weights', 'thresholds'] ELSE [] END::VARCHAR[] AS faults, CASE o_orderkey % 4 WHEN 0 THEN 'high' WHEN 3 THEN 'low' ELSE 'medium' END AS confidence FROM orders"""
)
def config_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q12, Q15: what is wrong with weights and thresholds, and how sure a report may be."""
    k = F.col("o_orderkey") % 4
    weights = F.create_map(F.lit("skills"), F.when(k.isin(1, 3), 50).otherwise(45), F.lit("experience"), F.lit(20), F.lit("role"), F.lit(15), F.lit("location"), F.lit(10), F.lit("salary"), F.lit(10))
    faults = scoring.config_faults(weights, F.lit(72), F.when(k >= 2, 80).otherwise(55))
    return table(spark, sf_dir, "orders").select("o_orderkey", faults.alias("faults"), scoring.report_confidence(k).alias("confidence"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.6 WHEN 2 THEN 0.5 ELSE 0.1 END::DOUBLE AS location, CASE WHEN p_size % 2 = 0 THEN least(1.0, p_size / 40.0) ELSE 0.5 END::DOUBLE AS salary FROM part")
def place_and_pay_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How place and pay suit; unknown pay is neutral."""
    k, size = F.col("p_partkey") % 4, F.col("p_size")
    city = F.when(k <= 1, "Pune").when(k == 3, "Delhi")
    cities, modes = F.array(F.lit("Pune")), F.array(F.lit("hybrid"))
    where = scoring.location_part(city, F.when(k == 1, "onsite"), cities, modes, F.lit(False))
    pay = scoring.salary_part(size.cast("double"), size % 2 == 0, F.lit("INR"), F.lit(40))
    return table(spark, sf_dir, "part").select("p_partkey", where.alias("location"), pay.alias("salary"))


@query("SELECT job_id, req_key, 'R' || n AS label, quote FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY rank, quote, req_key) AS n FROM (SELECT l_orderkey AS job_id, 'k' || l_linenumber AS req_key, min(l_linenumber % 3) AS rank, 'needs k' || l_linenumber AS quote FROM lineitem WHERE l_linenumber <> 5 GROUP BY 1, l_linenumber)) WHERE n <= 40")
def final_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements that the job's text bears out, merged and numbered."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.concat(F.lit("k"), "l_linenumber").alias("req_key"), F.concat(F.lit("needs k"), "l_linenumber").alias("quote"), (F.col("l_linenumber") % 3).alias("rank"), F.lit(1).alias("years"))
    jobs = rows.select("job_id").distinct().withColumn("normal_text", F.lit("needs k1 and needs k2, needs k3, needs k4. also needs k6 or needs k7"))
    return documents.finalised(rows.where("req_key <> 'k5'").unionByName(rows.where("req_key = 'k5'").withColumn("quote", F.lit("wholly unrelated words"))), jobs).select("job_id", "req_key", "label", "quote")


@query("SELECT o_orderkey AS report_id, o_orderkey % 2 = 0 AS status, o_orderkey % 3 = 0 AS blocker, true AS mentions, o_orderkey % 5 = 0 AS cites, o_orderkey % 4 < 2 AS strategy, o_orderkey % 4 = 1 AS fits FROM orders")
def checklists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q19: whether reports hold what a checklist asks."""
    k = F.col("o_orderkey")
    reports = table(spark, sf_dir, "orders").select(k.alias("report_id"), F.create_map(F.lit("R1"), F.when(k % 2 == 0, "strong").otherwise("missing")).alias("statuses"), F.when(k % 3 == 0, F.array(F.lit("bond"))).otherwise(F.array().cast("array<string>")).alias("blockers"), F.lit("APPLY").alias("recommendation"), F.when(k % 4 == 0, "skip").when(k % 4 == 1, "apply_now").otherwise("wait").alias("action"))
    claims = reports.select("report_id", F.lit("summary").alias("section"), F.lit("Years of Spark and SQL").alias("text"), F.when(F.col("report_id") % 5 == 0, 1).otherwise(0).alias("n_cited"))
    items = [documents.check("status", requirement="R1", among=["strong", "partial"]), documents.check("blocker", blocker="bond"), documents.check("mentions", sections=["summary"], terms=[["spark", "flink"], ["sql"]]), documents.check("cites", section="summary"), documents.check("strategy", among=["skip", "apply_now"])]
    held = documents.checklist(reports, claims, dict(zip(("status", "blocker", "mentions", "cites", "strategy"), items, strict=True)))
    return held.join(reports.select("report_id", strategy_fits(F.col("action"), F.col("recommendation")).alias("fits")), "report_id")


@query("SELECT o_orderstatus AS stage, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1")
def resumed_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST6, E8: stages that each write a version of the state; one that is run again after a stop changes nothing."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("stage"), F.col("o_totalprice").alias("total"))
    path = fresh(spark, "stages")

    def add(batch: DataFrame, old: DataFrame | None) -> DataFrame:
        own = batch.groupBy("stage").agg(F.count("*").alias("n"), F.sum("total").alias("total"))
        return own if old is None else old.unionByName(own)

    step = applications.sync_sink(path, add)
    for number, stage in enumerate(("F", "O", "O", "P")):
        step(rows.where(F.col("stage") == stage), number - (number > 1))
    return spark.read.parquet(f"{path}/v=2")


#: Batches of a stream: changes of customers' rows, by the number of their orders.
_CHANGES = "SELECT o_custkey AS key, CAST(o_orderkey % 6 AS INT) AS batch, max(o_totalprice) AS price, max(o_orderkey) % 10 = 0 AS gone FROM orders GROUP BY 1, 2"


@query(f"SELECT key, price FROM (SELECT key, arg_max(struct_pack(price := price, gone := gone), batch) AS r FROM ({_CHANGES}) GROUP BY 1), LATERAL (SELECT r.price AS price, r.gone AS gone) WHERE NOT gone")
def logged_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST6, E8, SK3: state of customers in a log of deltas: six batches, one of
    them run again, compacted after the third, with removed keys."""
    orders = table(spark, sf_dir, "orders")
    changes = orders.groupBy(F.col("o_custkey").alias("key"), (F.col("o_orderkey") % 6).cast("int").alias("batch")).agg(F.max("o_totalprice").alias("price"), (F.max("o_orderkey") % 10 == 0).alias("gone"))
    changes = cut(changes, "changes")
    log = StateLog(spark, fresh(spark, "state-log"), changes.select("key", "price").schema, ["key"], 16)
    write = log.sink(every=3)
    for number in (0, 1, 1, 2, 3, 4, 3, 5):
        write(changes.where(F.col("batch") == number).select("key", "price", "gone"), number)
    return log.read()


@query(
    """WITH l AS (SELECT l_orderkey, string_agg('- R' || l_linenumber || ' supplier ' || l_suppkey || ' (required): ' || CASE WHEN l_returnflag = 'R' THEN 'missing' ELSE 'strong' END || CASE WHEN l_linestatus = 'F' THEN ' — ' || 'seen' ELSE '' END, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus) AS asked,
  string_agg('- ' || CASE WHEN l_linenumber % 2 = 1 THEN 'Skills' ELSE 'Role alignment' END || ': ' || floor(l_quantity / 2 + 0.5)::BIGINT || '/50 — part ' || l_partkey, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus) AS scored FROM lineitem GROUP BY 1)
SELECT o_orderkey, concat_ws(chr(10) || chr(10), 'Fit Report: ' || o_orderpriority || ' at Firm ' || o_custkey, 'Fit score ' || (o_orderkey % 101) || '/100 · ' || (['Apply', 'Consider', 'Low priority'])[(o_orderkey % 3 + 1)::INT],
  'Customer ' || o_custkey || CASE WHEN o_orderkey % 2 = 0 THEN ' [E1, S2]' ELSE '' END, 'ROLE' || chr(10) || 'What it is [R1]' || chr(10) || 'Senior', 'REQUIREMENTS' || chr(10) || asked,
  CASE WHEN scored IS NOT NULL OR o_orderkey % 7 = 0 THEN concat_ws(chr(10), 'SCORE', scored, CASE WHEN o_orderkey % 7 = 0 THEN '- +3 with SQL' END) END, CASE WHEN o_orderkey % 4 = 0 THEN 'CONDITIONS' || chr(10) || '- Bond' END,
  CASE WHEN o_orderkey % 5 = 0 THEN 'RECRUITER VIEW' || chr(10) || '- + Ships [E1]' || chr(10) || '- ! (high) Gap [E2]' END, CASE WHEN o_orderkey % 6 = 0 THEN 'RISKS' || chr(10) || '- Old stack [R1] → Learn it' END,
  concat_ws(chr(10), 'STRATEGY: ' || CASE WHEN o_orderkey % 2 = 0 THEN 'Apply now' ELSE 'Skip' END, 'Because [E1]', CASE WHEN o_orderkey % 8 = 0 THEN 'Lead with:' || chr(10) || '- Ships [E1]' END, CASE WHEN o_orderkey % 9 = 0 THEN 'Ask the recruiter:' || chr(10) || '- Who leads?' END)) AS report
FROM orders LEFT JOIN l ON l_orderkey = o_orderkey"""
)
def fit_report_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK25, Q17: fit reports as plain text, of orders and their lines."""
    k = F.col("o_orderkey")
    said = lambda text, *ids: F.struct(F.lit(text).alias("text"), F.array(*map(F.lit, ids)).cast("array<string>").alias("ids"))
    none = lambda kind: F.array().cast(kind)
    item = F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", F.concat(F.lit("R"), "l_linenumber").alias("req_id"), F.concat(F.lit("supplier "), "l_suppkey").alias("text"), F.lit("required").alias("importance"), F.when(F.col("l_returnflag") == "R", "missing").otherwise("strong").alias("status"),
        F.when(F.col("l_linestatus") == "F", "seen").otherwise("").alias("note"), F.when(F.col("l_linenumber") % 2 == 1, "skills").otherwise("roleAlignment").alias("key"), (F.col("l_quantity") / 2).alias("points"), F.lit(50).alias("most"), F.concat(F.lit("part "), "l_partkey").alias("reason"),
    )
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(item)).alias("requirements"))
    claim = "array<struct<text:string,ids:array<string>>>"
    rows = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left").select(
        k, F.col("o_orderpriority").alias("title"), F.concat(F.lit("Firm "), "o_custkey").alias("company"), (k % 101).alias("total"), F.element_at(F.array(*map(F.lit, ("APPLY", "CONSIDER", "LOW_PRIORITY"))), (k % 3 + 1).cast("int")).alias("recommendation"),
        F.struct(F.concat(F.lit("Customer "), "o_custkey").alias("text"), F.when(k % 2 == 0, F.array(F.lit("E1"), F.lit("S2"))).otherwise(none("array<string>")).alias("ids")).alias("summary"), F.array(said("What it is", "R1"), said("Senior")).alias("role"),
        "requirements", F.col("requirements").alias("components"), F.when(k % 7 == 0, F.array(F.struct(F.lit(3).alias("points"), F.lit("SQL").alias("skill")))).alias("gains"), F.when(k % 4 == 0, F.array(F.lit("Bond"), F.lit(""))).otherwise(none("array<string>")).alias("conditions"),
        F.when(k % 5 == 0, F.array(said("Ships", "E1"))).otherwise(none(claim)).alias("stands_out"), F.when(k % 5 == 0, F.array(F.struct(F.lit("Gap").alias("text"), F.array(F.lit("E2")).alias("ids"), F.lit("high").alias("severity")))).alias("red_flags"),
        F.when(k % 6 == 0, F.array(F.struct(F.lit("Old stack").alias("text"), F.array(F.lit("R1")).alias("ids"), F.lit("learn").alias("mitigation")))).alias("risks"), F.when(k % 2 == 0, "apply_now").otherwise("skip").alias("action"), said("Because", "E1").alias("reasoning"),
        F.when(k % 8 == 0, F.array(said("Ships", "E1"))).otherwise(none(claim)).alias("emphasise"), F.when(k % 9 == 0, F.array(F.lit("Who leads?"))).alias("questions"),
    )
    return rows.select("o_orderkey", composer.fit_report().alias("report"))
