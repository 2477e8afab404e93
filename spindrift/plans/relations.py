"""Queries of joins, sets, windows, spans and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import parse, places, text
from spindrift.operators import history, joins, matching, metrics, sets, vector_index, vectors
from spindrift.plans.inputs import COMPANIES, MOVES, NOW, POSTINGS, SPANS, now, oracle, relation, table
from spindrift.plans.registry import SQL, query

_P = oracle(postings=POSTINGS)
_PC = oracle(postings=POSTINGS, companies=COMPANIES)
_M = oracle(moves=MOVES)
_S = oracle(spans=SPANS)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose key is in a list."""
    keys = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(keys, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query(f"{_PC} SELECT c.company_id, c.name FROM companies c WHERE NOT is_agency AND NOT is_blocked AND NOT EXISTS (SELECT 1 FROM postings p WHERE p.company_id = c.company_id AND p.provider = 'site')")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean companies without a posting on a site of their own."""
    sites = relation(spark, sf_dir, POSTINGS).where("provider = 'site' AND company_id IS NOT NULL").select("company_id")
    return relation(spark, sf_dir, COMPANIES).where("NOT is_agency AND NOT is_blocked").join(sites, "company_id", "left_anti").select("company_id", "name")


@query(f"{_PC} SELECT c.company_id, count(p.job_id) AS openings FROM companies c LEFT JOIN postings p ON c.company_id = p.company_id GROUP BY 1 ORDER BY openings DESC, 1 LIMIT 30")
def by_relation_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies by their number of postings."""
    counted = relation(spark, sf_dir, POSTINGS).where("company_id IS NOT NULL").groupBy("company_id").agg(F.count("*").alias("n"))
    out = relation(spark, sf_dir, COMPANIES).join(counted, "company_id", "left").select("company_id", F.coalesce("n", F.lit(0)).cast("long").alias("openings"))
    return out.orderBy(F.desc("openings"), "company_id").limit(30)


@query("SELECT c_custkey, len(l) AS n_orders, l[1].o_orderkey AS first_order, l[len(l)].o_orderkey AS last_order FROM customer LEFT JOIN (SELECT o_custkey, list({'o_orderdate': o_orderdate, 'o_orderkey': o_orderkey} ORDER BY o_orderdate, o_orderkey) AS l FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def nested_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer with their orders as an ordered array."""
    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderkey")
    out = joins.nested(table(spark, sf_dir, "customer").select("c_custkey"), own, "c_custkey", "l", "o_orderdate", "o_orderkey")
    return out.select("c_custkey", F.when(F.col("l").isNotNull(), F.size("l")).cast("long").alias("n_orders"), F.get("l", F.lit(0))["o_orderkey"].alias("first_order"), F.try_element_at("l", F.lit(-1))["o_orderkey"].alias("last_order"))


@query(f"{_P} SELECT a.job_id AS left_id, b.job_id AS right_id FROM postings a JOIN postings b ON a.provider = b.provider AND a.external_id = b.external_id UNION SELECT a.job_id, b.job_id FROM postings a JOIN postings b ON a.company_id = b.company_id")
def any_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by either of two keys, as two equi-joins."""
    rows = relation(spark, sf_dir, POSTINGS).select("job_id", "provider", "external_id", "company_id")
    return joins.any_key(rows, rows, [["provider", "external_id"], ["company_id"]], "job_id", "job_id")


_SKILLS = "SELECT p_partkey AS skill_id, p_name AS name, 'part-' || CAST(p_partkey AS VARCHAR(20)) AS slug, lower(p_brand) AS alias FROM {part}"
_EDGES = "SELECT l_partkey AS from_id, l_suppkey AS to_id, CASE WHEN l_returnflag = 'R' THEN 'implies' ELSE 'related' END AS kind FROM {lineitem} WHERE l_quantity > 45"
_LEVELS = "SELECT DISTINCT o_custkey % 50 AS user_id, o_orderkey % 90 AS skill_id, CAST(1 + (o_custkey + o_orderkey) % 5 AS INT) AS level FROM {orders} WHERE o_totalprice > 300000"
_ONE_LEVEL = f"SELECT user_id, skill_id, max(level) AS level FROM ({_LEVELS}) AS l GROUP BY user_id, skill_id"
_E = oracle(edges=_EDGES, levels=_ONE_LEVEL)


@query(f"{_E} SELECT to_id AS skill_id, list_sort(list(DISTINCT from_id)) AS implied_by FROM edges WHERE kind = 'implies' GROUP BY 1")
def implied_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills that imply each skill."""
    edges = relation(spark, sf_dir, _EDGES)
    return joins.implied_by(edges.select(F.col("to_id").alias("skill_id")).distinct(), edges)


@query(f"{_E} SELECT from_id AS skill_id, to_id AS other_id FROM edges WHERE kind = 'related' UNION SELECT to_id, from_id FROM edges WHERE kind = 'related'")
def related_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Related skills both ways."""
    return joins.related(relation(spark, sf_dir, _EDGES))


@query(f"{_E} SELECT user_id, skill_id, max(level) AS level FROM (SELECT user_id, skill_id, level FROM levels UNION ALL SELECT user_id, to_id, level FROM levels JOIN edges ON skill_id = from_id AND kind = 'implies') GROUP BY 1, 2")
def levels_through_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best level, own or implied, one hop."""
    return joins.levels_with_implied(relation(spark, sf_dir, _ONE_LEVEL), relation(spark, sf_dir, _EDGES))


@query("SELECT regexp_replace(lower(p_name), '[^a-z0-9#+]', '', 'g') AS key, min(p_partkey) AS skill_id FROM part GROUP BY 1 UNION ALL SELECT key, min(p_partkey) FROM (SELECT unnest(['part' || p_partkey, regexp_replace(lower(p_brand), '[^a-z0-9#+]', '', 'g')]) AS key, p_partkey FROM part) GROUP BY 1")
def alias_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index of names, slugs and aliases; earlier entries win."""
    rows = relation(spark, sf_dir, _SKILLS).withColumn("aliases", F.array("alias"))
    return joins.alias_index(rows)


@query(f"{_P} SELECT job_id, min(p_partkey) AS skill_id FROM (SELECT job_id, CASE job_id % 3 WHEN 0 THEN 'smallring' WHEN 1 THEN 'brand#2js' ELSE 'nosuchskill' END AS k FROM postings) LEFT JOIN (SELECT unnest([regexp_replace(lower(p_name), '[^a-z0-9#+]', '', 'g'), regexp_replace(lower(p_brand), '[^a-z0-9#+]', '', 'g')]) AS key, p_partkey FROM part) ON key = k OR (k LIKE '%js' AND key = left(k, -2)) GROUP BY 1")
def skill_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names matched through the index, with or without js."""
    index = joins.alias_index(relation(spark, sf_dir, _SKILLS).withColumn("aliases", F.array("alias")))
    rows = relation(spark, sf_dir, POSTINGS).select("job_id", F.when(F.col("job_id") % 3 == 0, "Small Ring").when(F.col("job_id") % 3 == 1, "Brand#2.js").otherwise("no such skill").alias("name"))
    return joins.match_names(rows, "name", index).select("job_id", "skill_id")


@query("SELECT p_partkey, CASE WHEN p_size >= 40 THEN 'lead' WHEN p_size >= 25 THEN 'senior' WHEN p_size >= 10 THEN 'mid' WHEN p_size >= 2 THEN 'junior' END AS band FROM part")
def band_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-open bands."""
    return table(spark, sf_dir, "part").select("p_partkey", joins.band(F.col("p_size"), [(2, "junior"), (10, "mid"), (25, "senior"), (40, "lead")]).alias("band"))


@query("SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON regexp_replace(lower(replace(s_name, 'Supplier', '')), '[^a-z0-9]', '', 'g') = regexp_replace(lower(replace(c_name, 'Customer', '')), '[^a-z0-9]', '', 'g')")
def letters_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names equal in letters and digits."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", places.letters_key(F.regexp_replace("s_name", "Supplier", "")).alias("k"))
    return s.join(table(spark, sf_dir, "customer").select("c_custkey", places.letters_key(F.regexp_replace("c_name", "Customer", "")).alias("k")), "k").select("s_suppkey", "c_custkey")


@query("SELECT role_id, count(*) AS n FROM (SELECT o_orderkey, unnest([o_custkey % 11, o_custkey % 7]) AS role_id FROM orders) GROUP BY 1")
def containment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings whose array of roles holds a role, by explode and equality."""
    return table(spark, sf_dir, "orders").select(F.explode(F.array(F.col("o_custkey") % 11, F.col("o_custkey") % 7)).alias("role_id")).groupBy("role_id").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey AS user_id, (n_nationkey + 1) % 25 AS slug FROM nation WHERE (n_nationkey + 1) % 25 <> n_nationkey UNION SELECT n_nationkey, (n_nationkey + 2) % 25 FROM nation")
def adjacent_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families next to a user's own."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    families = nation.select(F.col("k").alias("slug"), F.array((F.col("k") + 1) % 25, (F.col("k") + 2) % 25, F.col("k")).alias("adjacent"))
    return joins.expanded(families, nation.select(F.col("k").alias("user_id"), F.col("k").alias("slug")))


@query(f"{_P} SELECT o_orderkey AS job_id, coalesce(p.title, CASE WHEN o_orderkey % 3 = 0 THEN 'frozen' END, 'Job') AS title FROM orders LEFT JOIN (SELECT * FROM postings WHERE job_id % 2 = 0) p ON o_orderkey = p.job_id")
def orphan_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live title, else the frozen one, else a default."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderkey") % 3 == 0, "frozen").alias("frozen"))
    return joins.with_fallback(rows, relation(spark, sf_dir, POSTINGS).where("job_id % 2 = 0"), "job_id", "title", "frozen", "Job").select("job_id", "title")


_ISLANDS = f"""{_S}, ordered AS (SELECT *, max(to_month) OVER (PARTITION BY person_id ORDER BY from_month, to_month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM spans),
marked AS (SELECT *, sum(CASE WHEN before IS NULL OR from_month > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY person_id ORDER BY from_month, to_month RANGE UNBOUNDED PRECEDING) AS island FROM ordered),
islands AS (SELECT person_id, min(from_month) AS from_month, max(to_month) AS to_month FROM marked GROUP BY person_id, island)"""


@query(f"{_ISLANDS} SELECT * FROM islands")
def merged_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping and touching spans merged."""
    return history.islands(relation(spark, sf_dir, SPANS), "person_id", "from_month", "to_month")


@query(f"{_ISLANDS} SELECT person_id, sum(to_month - from_month + 1)::BIGINT AS total_months FROM islands GROUP BY 1")
def months_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months with overlaps counted once."""
    return history.total_months(history.islands(relation(spark, sf_dir, SPANS), "person_id", "from_month", "to_month"), "person_id")


@query(f"{_ISLANDS} SELECT person_id, last + 1 AS gap_from, from_month - 1 AS gap_to, from_month - last - 1 AS months FROM (SELECT *, lag(to_month) OVER (PARTITION BY person_id ORDER BY from_month) AS last FROM islands) WHERE from_month - last - 1 > 3")
def span_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaks of over three months."""
    return history.gaps(history.islands(relation(spark, sf_dir, SPANS), "person_id", "from_month", "to_month"), "person_id")


@query(f"{_S} SELECT a.person_id, a.span_id AS a, b.span_id AS b, least(a.to_month, b.to_month) - b.from_month + 1 AS months FROM spans a JOIN spans b ON a.person_id = b.person_id AND (a.from_month, a.span_id) < (b.from_month, b.span_id) AND a.to_month >= b.from_month")
def span_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of spans that share months."""
    return history.overlaps(relation(spark, sf_dir, SPANS), "person_id", "span_id", "from_month", "to_month")


@query(f"{_M} SELECT application_id, arg_max(status, (occurred_at, event_id)) AS status, max(occurred_at) AS occurred_at FROM moves GROUP BY 1")
def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W7, ST4: last state and activity of each application."""
    return history.latest(relation(spark, sf_dir, MOVES), ["application_id"], "occurred_at", "event_id").select("application_id", "status", "occurred_at")


@query(f"{_M} SELECT application_id, min(occurred_at) AS occurred_at FROM moves WHERE occurred_at >= TIMESTAMP '2024-01-20' GROUP BY 1")
def next_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event at or after a time."""
    return history.next_after(relation(spark, sf_dir, MOVES), "application_id", "occurred_at", F.lit("2024-01-20").cast("timestamp")).select("application_id", "occurred_at")


@query(f"{_M} SELECT event_id, lag(status) OVER (PARTITION BY application_id ORDER BY occurred_at, event_id) AS before FROM moves")
def undo_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W10, SK14: the state that undoing an event restores."""
    rows = relation(spark, sf_dir, MOVES)
    return rows.select("event_id", history.previous("application_id", ["occurred_at", "event_id"], "status")["status"].alias("before"))


@query("SELECT l_orderkey, l_linenumber, 'R' || rn AS label FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag, l_linenumber, l_partkey, l_extendedprice) AS rn FROM lineitem) WHERE rn <= 4")
def numbered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels in order, up to a cap."""
    return history.numbered(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_returnflag", "l_linenumber", "l_partkey", "l_extendedprice"], "R", 4).select("l_orderkey", "l_linenumber", "label")


@query("SELECT o_custkey, o_orderkey, rn::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 6")
def top_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six of each key."""
    return history.top(table(spark, sf_dir, "orders"), "o_custkey", [F.desc("o_totalprice"), "o_orderkey"], 6).select("o_custkey", "o_orderkey", "rank")


@query("SELECT list_transform([o_orderkey % 3], lambda x: 'https://a.example/' || x || CASE WHEN x = 0 THEN '' ELSE '?q=1' END) || CASE WHEN o_orderkey % 3 = 0 THEN ['https://b.example/1'] ELSE [] END AS links, o_orderkey FROM orders")
def merged_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links by canonical address, the first's before."""
    k = F.col("o_orderkey") % 3
    base = F.concat(F.lit("https://a.example/"), k.cast("string"))
    first = F.array(F.when(k == 0, base).otherwise(F.concat(base, F.lit("?q=1"))))
    other = F.when(k == 0, F.array(F.upper(base), F.lit("https://b.example/1"))).otherwise(F.array(F.concat(base, F.lit("/#top"))))
    return table(spark, sf_dir, "orders").select("o_orderkey", sets.merge_links(first, other).alias("links"))


@query("SELECT p_partkey, ['A ' || p_type, p_name] AS names FROM part")
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trimmed names once each, whatever their case."""
    own = F.concat(F.lit("A "), F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", sets.unique_names(F.array(F.concat(F.lit(" "), own), F.col("p_name"), F.lower(own), F.lit("  "), F.upper("p_name"))).alias("names"))


@query(f"{_P} SELECT job_id FROM postings WHERE provider = 'site' AND job_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30)")
def missing_from_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U3, SK9: rows that a snapshot no longer has."""
    seen = table(spark, sf_dir, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("job_id"))
    return sets.missing(relation(spark, sf_dir, POSTINGS).where("provider = 'site'").select("job_id"), seen, ["job_id"])


@query("SELECT l_orderkey AS job_id, l_linenumber AS req_key, arg_min(l_returnflag, (l_linestatus, l_returnflag)) AS quote, min(l_linestatus) AS rank, max(l_quantity) AS years FROM lineitem GROUP BY 1, 2")
def merged_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates merged by importance and years."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("req_key"), F.col("l_returnflag").alias("quote"), F.col("l_linestatus").alias("rank"), F.col("l_quantity").alias("years"))
    return sets.merged_requirements(rows)


@query("SELECT o_orderpriority AS reason, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3, A4: rows by reason."""
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_orderpriority").alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT p_brand, count(*) AS n, min(m) AS low, median(m) AS median, max(m) AS high FROM (SELECT p_brand, CASE WHEN p_size % 5 = 0 THEN p_retailprice ELSE (p_retailprice + p_size) / 2 END AS m FROM part WHERE p_size % 3 > 0) WHERE m > 0 GROUP BY 1 HAVING count(*) >= 5")
def pay_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact median of the midpoints, five at least; a third of all rows
    has no pay to it, which the operator leaves out."""
    told = F.col("p_size") % 3 > 0
    low = F.when(told & (F.col("p_size") % 5 != 0), F.col("p_size"))
    return metrics.pay_context(table(spark, sf_dir, "part"), ["p_brand"], metrics.midpoint(low, F.when(told, F.col("p_retailprice"))))


@query("SELECT key, sum(value)::BIGINT AS total FROM (SELECT unnest(['k', event_type]) AS key, unnest([CAST(json_extract(props, '$.k') AS BIGINT), 1]) AS value FROM events) GROUP BY 1")
def map_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters summed by key over JSON and map columns."""
    k = F.coalesce(F.from_json("props", "k long")["k"], F.lit(0))
    rows = table(spark, sf_dir, "events").select(F.create_map(F.lit("k"), k, F.col("event_type"), F.lit(1).cast("long")).alias("m"))
    return metrics.map_sums(rows, "m")


@query("SELECT l_orderkey, round(sum(l_discount * w) / sum(w), 9) AS match FROM (SELECT *, CASE l_returnflag WHEN 'R' THEN 3.0 WHEN 'A' THEN 1.5 ELSE 0.5 END::DOUBLE AS w FROM lineitem) GROUP BY 1")
def weighted_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean by importance."""
    importance = F.when(F.col("l_returnflag") == "R", "required").when(F.col("l_returnflag") == "A", "preferred").otherwise("unknown")
    rows = table(spark, sf_dir, "lineitem").withColumn("w", metrics.importance_weight(importance))
    return rows.groupBy("l_orderkey").agg(F.round(metrics.weighted_mean(F.col("l_discount"), F.col("w")), 9).alias("match"))


@query("SELECT source, round(CASE WHEN count(quality) = 0 THEN 1 ELSE count(*) FILTER (quality = 1) / count(quality)::DOUBLE END, 6) AS good, count(quality) AS n, CASE WHEN count(quality) < 5 THEN 'insufficient' WHEN count(quality) < 15 THEN 'low' WHEN count(quality) < 40 THEN 'medium' ELSE 'high' END AS confidence FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id GROUP BY 1")
def quality_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares with a label for their sample size."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    n = F.count("quality")
    return rows.groupBy("source").agg(F.round(metrics.rate(F.count_if(F.col("quality") == 1), n), 6).alias("good"), n.alias("n"), metrics.confidence(n).alias("confidence"))


@query("SELECT e.l_orderkey, round(count(f.l_partkey) / count(*)::DOUBLE, 6) AS recall, round(CASE WHEN count(f.l_partkey) = 0 THEN 1 ELSE count(*) FILTER (f.importance = e.l_returnflag) / count(f.l_partkey)::DOUBLE END, 6) AS importance_accuracy FROM (SELECT DISTINCT l_orderkey, l_partkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2) e LEFT JOIN (SELECT l_orderkey, l_partkey, min(l_linestatus) AS importance FROM lineitem WHERE l_quantity > 10 GROUP BY 1, 2) f USING (l_orderkey, l_partkey) GROUP BY 1")
def extraction_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of expected rows and right importance among the found."""
    lines = table(spark, sf_dir, "lineitem")
    expected = lines.groupBy("l_orderkey", "l_partkey").agg(F.min("l_returnflag").alias("importance"))
    found = lines.where("l_quantity > 10").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linestatus").alias("importance"))
    out = metrics.extraction_recall(expected, found, ["l_orderkey", "l_partkey"])
    return out.select("l_orderkey", F.round("recall", 6).alias("recall"), F.round("importance_accuracy", 6).alias("importance_accuracy"))


_ROLES = "SELECT role_id, count(*) AS openings, floor(avg(score) + 0.5)::BIGINT AS mean_score FROM (SELECT unnest(list_distinct([o_custkey % 11, o_custkey % 7])) AS role_id, o_totalprice AS score FROM orders) GROUP BY 1"


@query(
    f"""SELECT m.*, top_gap FROM ({_ROLES}) m LEFT JOIN (SELECT role_id, arg_min(skill, (-n, skill)) AS top_gap FROM (SELECT role_id, skill, count(*) AS n FROM (SELECT unnest(list_distinct([o_custkey % 11, o_custkey % 7])) AS role_id, o_orderpriority AS skill FROM orders) GROUP BY 1, 2) WHERE n > 1 GROUP BY 1) g USING (role_id)"""
)
def role_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Openings, mean score and top gap of each role."""
    rows = table(spark, sf_dir, "orders").select(F.array(F.col("o_custkey") % 11, F.col("o_custkey") % 7).alias("roles"), F.col("o_totalprice").alias("score"), F.array("o_orderpriority").alias("skills"))
    return metrics.role_market(rows, "roles", "score", "skills")


@query("SELECT user_id, period, start, count(*) AS n FROM (SELECT user_id, unnest(['minute', 'day', 'month']) AS period, unnest([date_trunc('minute', ts)::TIMESTAMP, date_trunc('day', ts)::TIMESTAMP, date_trunc('month', ts)::TIMESTAMP]) AS start FROM events) GROUP BY ALL")
def period_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK5, A26, ST7: counters of three periods in one pass."""
    return metrics.period_counts(table(spark, sf_dir, "events"), "ts", "user_id")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT - CASE WHEN epoch(ts)::BIGINT > epoch(ts) THEN 1 ELSE 0 END RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS n FROM events")
def hourly_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST13: events of a user in the hour up to each."""
    return table(spark, sf_dir, "events").select("event_id", metrics.rolling_count("user_id", "ts", 3600).alias("n"))


@query("SELECT q.vec_id AS query_id, v.vec_id AS item_id, rank::INT AS rank FROM (SELECT q.vec_id AS qid, v.vec_id AS vid, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) DESC, v.vec_id) AS rank FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0) JOIN embeddings q ON q.vec_id = qid JOIN embeddings v ON v.vec_id = vid WHERE rank <= 5")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact nearest neighbours of every twentieth vector."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.lit("m").alias("model"), F.col("embedding").alias("vector"))
    return vectors.nearest(rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), rows.withColumnRenamed("vec_id", "item_id"), 5).select("query_id", "item_id", "rank")


_NEAREST = SQL["nearest_vectors"]


@query(_NEAREST)
def probed_all_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: a search of the index that probes every list finds what the exact one does."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    index = vector_index.build(rows.withColumnRenamed("vec_id", "item_id"))
    lists = index.open_centres(spark).count()
    return vector_index.search(index, rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 5, lists).select("query_id", "item_id", "rank")


@query("SELECT 5 * count(*) AS n, true AS reached FROM embeddings WHERE vec_id % 20 = 0")
def index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether probing a part of the lists finds nine tenths of the exact nearest neighbours."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.lit("m").alias("model"), F.col("embedding").alias("vector"))
    asked, items = rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), rows.withColumnRenamed("vec_id", "item_id")
    index = vector_index.build(items)
    lists = index.open_centres(spark).count()
    found = vector_index.search(index, asked, 5, max(1, lists * 2 // 5))
    return vector_index.recall(found, vectors.nearest(asked, items, 5)).select("n", (F.col("n_found") >= 0.9 * F.col("n")).alias("reached"))


@query("SELECT left_id, arg_max(right_id, (s, -right_id)) AS right_id FROM (SELECT a.vec_id AS left_id, b.vec_id AS right_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.label = (b.label + 1) % 10) WHERE s >= 0 GROUP BY 1")
def best_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar row of the group before, if similar at all."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector"))
    left = rows.select(F.col("vec_id").alias("left_id"), F.col("label").alias("group_id"), "vector")
    right = rows.select(F.col("vec_id").alias("right_id"), ((F.col("label") + 1) % 10).alias("group_id"), "vector")
    return vectors.best_over(left, right, 0.0).select("left_id", "right_id")


@query(f"SELECT o_orderkey, greatest(0, floor((epoch(TIMESTAMP '{NOW}') - epoch(o_orderdate)) / 86400))::BIGINT AS days, date_trunc('month', o_orderdate)::TIMESTAMP AS month_start, (date_trunc('month', o_orderdate) + INTERVAL 1 MONTH)::TIMESTAMP AS next_month, (date_trunc('day', o_orderdate) + INTERVAL 1 DAY)::TIMESTAMP AS next_day FROM orders")
def period_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days since, and starts and resets of periods."""
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", parse.days_between(d, now()).alias("days"), parse.period_start(d, "month").alias("month_start"), parse.next_reset(d, "month").alias("next_month"), parse.next_reset(d, "day").alias("next_day"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_name, ' ') THEN upper(substr(p_name, 1, 1)) || upper(substr(regexp_extract(p_name, '([^ ]+)$'), 1, 1)) ELSE upper(substr(p_name, 1, 1)) END AS initials, len(string_split(trim(p_name), ' ')) AS n_words, regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') AS slug FROM part")
def name_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Initials, words and slugs."""
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", text.initials(name).alias("initials"), text.word_count(name).cast("long").alias("n_words"), text.skill_slug(name).alias("slug"))


@query("SELECT a.p_partkey AS a, b.p_partkey AS b, round(1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name))::DOUBLE, 6) AS similarity FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey WHERE 1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name))::DOUBLE >= 0.5")
def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Close names among candidates of the same block."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    return matching.similar_rows(part, ["p_brand", "p_size"], "p_partkey", "p_name", 0.5).select("a", "b", F.round("similarity", 6).alias("similarity"))
