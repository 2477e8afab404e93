"""Queries of events and next states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators import events, state
from spindrift.plans.inputs import MOVES, cases, oracle, relation, table
from spindrift.plans.registry import query

_NOW = "2024-02-10 00:00:00"
_STAGE = "CASE status WHEN 'APPLIED' THEN 1 WHEN 'RECRUITER_CONTACT' THEN 2 WHEN 'ASSESSMENT' THEN 3 WHEN 'INTERVIEW' THEN 4 WHEN 'FINAL_ROUND' THEN 5 WHEN 'OFFER' THEN 6 END"
_T = oracle(moves=MOVES) + f""", lagged AS (SELECT *, lag(status) OVER (PARTITION BY application_id ORDER BY occurred_at, event_id) AS from_status FROM moves),
kept AS (SELECT * FROM lagged WHERE from_status IS NULL OR from_status <> status),
states AS (SELECT *, coalesce(max({_STAGE}) OVER w, 1) AS stage_reached, CASE WHEN status IN ('REJECTED', 'WITHDRAWN', 'GHOSTED') THEN occurred_at END AS closed_at,
  coalesce(from_status IN ('REJECTED', 'WITHDRAWN', 'GHOSTED') AND status NOT IN ('REJECTED', 'WITHDRAWN', 'GHOSTED'), false) AS reopened, max(occurred_at) OVER w AS last_activity
  FROM kept WINDOW w AS (PARTITION BY application_id ORDER BY occurred_at, event_id ROWS UNBOUNDED PRECEDING)),
now_states AS (SELECT * FROM states QUALIFY row_number() OVER (PARTITION BY application_id ORDER BY occurred_at DESC, event_id DESC) = 1)"""


def _now() -> F.Column:
    return F.lit(_NOW).cast("timestamp")


@query(f"{_T} SELECT event_id, stage_reached, closed_at, reopened, last_activity FROM states")
def state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1, ST4, W9, SK13: accepted moves with the stage reached."""
    return events.transitions(relation(spark, sf_dir, MOVES)).select("event_id", "stage_reached", "closed_at", "reopened", "last_activity")


@query(f"{_T} SELECT event_id, ['APPLIED', 'RECRUITER_CONTACT', 'ASSESSMENT', 'INTERVIEW', 'FINAL_ROUND', 'OFFER'][coalesce({_STAGE.replace('status', 'from_status')}, stage_reached)] AS rejected_at FROM states WHERE status = 'REJECTED'")
def rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1: the stage a rejection happened at."""
    return events.transitions(relation(spark, sf_dir, MOVES)).where("status = 'REJECTED'").select("event_id", "rejected_at")


_IDLE = f"greatest(0, floor((epoch(TIMESTAMP '{_NOW}') - floor(epoch(last_activity))) / 86400))::BIGINT"
_OPEN = "status NOT IN ('REJECTED', 'WITHDRAWN', 'GHOSTED')"


@query(f"{_T} SELECT application_id, CASE WHEN {_OPEN} THEN {_IDLE} END AS idle, status = 'APPLIED' AND {_IDLE} >= 30 AS ghosted FROM now_states")
def idle_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST2: days of silence."""
    rows = events.current(events.transitions(relation(spark, sf_dir, MOVES)))
    s, at = F.col("status"), F.col("last_activity")
    return rows.select("application_id", events.idle_days(s, at, _now()).alias("idle"), events.suggests_ghosted(s, at, _now()).alias("ghosted"))


@query(f"{_T} SELECT CASE WHEN {_OPEN} THEN status ELSE 'CLOSED' END AS lane, count(*) AS n FROM now_states GROUP BY 1")
def board_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applications by lane."""
    return events.board(events.current(events.transitions(relation(spark, sf_dir, MOVES))))


@query(
    f"""{_T}, rounds AS (SELECT application_id, min(occurred_at + INTERVAL 14 DAY) AS round_at FROM moves WHERE status = 'INTERVIEW' AND occurred_at + INTERVAL 14 DAY BETWEEN TIMESTAMP '{_NOW}' - INTERVAL 24 HOUR AND TIMESTAMP '{_NOW}' + INTERVAL 48 HOUR GROUP BY 1),
k AS (SELECT n.*, round_at, CASE WHEN application_id % 3 = 0 THEN last_activity + INTERVAL 12 DAY END AS follow FROM now_states n LEFT JOIN rounds USING (application_id) WHERE {_OPEN}),
a AS (SELECT *, CASE WHEN round_at IS NOT NULL THEN 'interview' WHEN follow <= TIMESTAMP '{_NOW}' + INTERVAL 12 HOUR THEN 'follow_up' WHEN status = 'OFFER' AND application_id % 2 = 0 THEN 'offer' WHEN status = 'APPLIED' AND {_IDLE} >= 30 THEN 'ghosted' WHEN {_IDLE} >= 14 THEN 'idle' END AS kind FROM k)
SELECT application_id, kind, CASE kind WHEN 'interview' THEN round_at WHEN 'follow_up' THEN follow ELSE last_activity END AS due_at, CASE kind WHEN 'interview' THEN 1 WHEN 'follow_up' THEN 2 WHEN 'offer' THEN 3 WHEN 'ghosted' THEN 4 ELSE 5 END AS urgency FROM a WHERE kind IS NOT NULL"""
)
def todays_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST3, W8, T9: the most urgent thing to do for each application."""
    moves = relation(spark, sf_dir, MOVES)
    rows = events.current(events.transitions(moves)).withColumn("follow_up_at", F.when(F.col("application_id") % 3 == 0, F.col("last_activity") + F.expr("INTERVAL 12 DAYS")))
    rows = rows.withColumn("offer_decision", F.when(F.col("application_id") % 2 == 0, F.lit(None).cast("string")).otherwise("accepted"))
    rounds = moves.where("status = 'INTERVIEW'").select("application_id", (F.col("occurred_at") + F.expr("INTERVAL 14 DAYS")).alias("scheduled_at"), F.lit("pending").alias("result"))
    return events.todays_actions(rows, rounds, F.lit(_NOW).cast("timestamp_ntz"))


_CALLS = f"SELECT event_id AS call_id, CASE user_id % 2 WHEN 0 THEN 'search' ELSE 'embed' END AS service, 'p' || CAST(user_id % 5 AS VARCHAR(5)) AS provider, ts AS at, {cases('event_id', ['ok', 'error', 'error', 'error', 'ok', 'auth', 'quota', 'error', 'error'])} AS outcome FROM {{events}}"


@query(
    oracle(calls=_CALLS)
    + """, runs AS (SELECT *, sum(CASE WHEN outcome = 'ok' THEN 1 ELSE 0 END) OVER (PARTITION BY service, provider ORDER BY \"at\", call_id ROWS UNBOUNDED PRECEDING) AS run FROM calls),
counted AS (SELECT *, sum(CASE WHEN outcome <> 'ok' THEN 1 ELSE 0 END) OVER (PARTITION BY service, provider, run ORDER BY \"at\", call_id ROWS UNBOUNDED PRECEDING)::INT AS failures FROM runs)
SELECT call_id, failures, CASE WHEN outcome = 'ok' THEN NULL WHEN outcome = 'quota' THEN date_trunc('day', \"at\") + INTERVAL 1 DAY ELSE to_timestamp(floor(epoch(\"at\")) + 60 * CASE WHEN outcome = 'auth' THEN 60 WHEN failures >= 3 THEN 10 ELSE power(2, failures - 1) END) AT TIME ZONE 'UTC' END AS rests_until FROM counted"""
)
def provider_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST8, D13: failures in a row and cooldowns."""
    return events.provider_health(relation(spark, sf_dir, _CALLS)).select("call_id", "failures", "rests_until")


@query("SELECT service, arg_min(provider, (coalesce(override, position), position, provider)) AS provider FROM (SELECT 's' || s_nationkey AS service, s_name AS provider, s_suppkey AS position, CASE WHEN s_suppkey % 7 = 0 THEN -s_suppkey END AS override, s_acctbal < 9000 * 0.9 AS usable FROM supplier) WHERE usable GROUP BY 1")
def first_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST9, ST10, ST11, A27: the provider a service would use."""
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_nationkey").cast("string")).alias("service"), F.col("s_name").alias("provider"), F.col("s_suppkey").alias("position"),
        F.when(F.col("s_suppkey") % 7 == 0, -F.col("s_suppkey")).alias("override"), events.available(F.col("s_acctbal"), F.lit(9000), F.lit(None).cast("timestamp"), _now()).alias("usable"))
    return events.first_available(rows)


@query("SELECT event_id AS request_id FROM (SELECT event_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) WHERE gap < INTERVAL 600 SECOND")
def throttle_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST12: requests that came too soon after another."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("host"), F.col("ts").alias("at"))
    return events.throttle_breaches(rows, 600).select("request_id")


_READS = f"SELECT event_id AS read_id, user_id AS site_id, ts AS at, {cases('event_id', ['ok', 'empty', 'empty', 'empty', 'failed', 'failed', 'refused'])} AS outcome FROM {{events}}"


def _streak(name: str, outcome: str) -> str:
    return f", {name}_r AS (SELECT *, sum(CASE WHEN outcome <> '{outcome}' THEN 1 ELSE 0 END) OVER (PARTITION BY site_id ORDER BY \"at\", read_id ROWS UNBOUNDED PRECEDING) AS run FROM reads), {name} AS (SELECT read_id, sum(CASE WHEN outcome = '{outcome}' THEN 1 ELSE 0 END) OVER (PARTITION BY site_id, run ORDER BY \"at\", read_id ROWS UNBOUNDED PRECEDING)::INT AS {name} FROM {name}_r)"


@query(
    oracle(reads=_READS) + _streak("empty_runs", "empty") + _streak("failures", "failed") + """ SELECT read_id, empty_runs, failures, to_timestamp(floor(epoch(\"at\")) + 86400 * CASE WHEN outcome = 'refused' THEN 30 WHEN failures > 0 THEN least(30, power(2, failures)) WHEN empty_runs >= 3 THEN 7 ELSE 1 END) AT TIME ZONE 'UTC' AS next_check
FROM reads JOIN empty_runs USING (read_id) JOIN failures USING (read_id)"""
)
def site_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST14, D13: when a site is read again."""
    return events.site_schedule(relation(spark, sf_dir, _READS)).select("read_id", "empty_runs", "failures", "next_check")


def _ranks(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").where(which)
    return rows.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"), F.col("o_orderstatus").alias("source"))


def _one(rows: DataFrame) -> DataFrame:
    return rows.groupBy("k").agg(F.min_by(F.struct("v", "source"), "v").alias("r")).select("k", "r.*")


_OLD = "(SELECT o_custkey AS k, min(o_orderkey) AS v, arg_min(o_orderstatus, o_orderkey) AS source FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)"
_NEW = "(SELECT o_custkey AS k, min(o_orderkey) AS v, arg_min(o_orderstatus, o_orderkey) AS source FROM orders WHERE o_totalprice > 350000 GROUP BY 1)"


@query(f"SELECT * FROM {_OLD} UNION ALL SELECT * FROM {_NEW} n WHERE n.k NOT IN (SELECT k FROM {_OLD})")
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK1, SK2, SK15: rows with a new key are added."""
    return state.insert_ignore(_one(_ranks(spark, sf_dir, "o_orderstatus = 'F'")), _ranks(spark, sf_dir, "o_totalprice > 350000"), ["k"], "v")


@query(f"SELECT k, coalesce(n.v, o.v) AS v, CASE WHEN o.v % 2 = 0 THEN o.source ELSE coalesce(n.source, o.source) END AS source FROM {_OLD} o FULL JOIN {_NEW} n USING (k)")
def upsert_with_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK3, SK4, SK8: new rows win but where the old value is protected."""
    return state.upsert(_one(_ranks(spark, sf_dir, "o_orderstatus = 'F'")), _one(_ranks(spark, sf_dir, "o_totalprice > 350000")), ["k"], {"source": F.col("old.v") % 2 == 0})


@query(f"SELECT k, CASE WHEN n.v % 3 = 0 OR n.v IS NULL THEN o.v ELSE n.v END AS v, o.source FROM {_OLD} o LEFT JOIN {_NEW} n USING (k)")
def update_from_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK6, SK7: values that are not null replace old ones."""
    new = _one(_ranks(spark, sf_dir, "o_totalprice > 350000")).select("k", F.when(F.col("v") % 3 != 0, F.col("v")).alias("v"))
    return state.update(_one(_ranks(spark, sf_dir, "o_orderstatus = 'F'")), new, ["k"])


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'F' THEN CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate END WHEN hit THEN NULL ELSE coalesce(CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate END, TIMESTAMP '2024-02-10') END AS closed_at, CASE WHEN o_orderstatus = 'F' AND hit THEN TIMESTAMP '2024-02-10' ELSE o_orderdate END AS last_seen_at FROM (SELECT *, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40) AS hit FROM orders)")
def snapshot_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK9, SK10, ST15: close what is missing, reopen what is present."""
    stored = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderdate")).cast("timestamp").alias("closed_at"), F.col("o_orderdate").cast("timestamp").alias("last_seen_at"), "o_orderstatus")
    snapshot = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("id"))
    return state.sync_snapshot(stored, snapshot, F.col("o_orderstatus") == "F", "id", _now()).select("id", "closed_at", "last_seen_at")


@query("SELECT c_custkey AS owner, v AS version, v = 3 AS active FROM customer, (SELECT unnest([1, 2, 3]) AS v)")
def config_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK16: a new version becomes the active one."""
    owners = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner"))
    old = owners.withColumn("version", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("active", F.col("version") == 2)
    return state.add_version(old, owners, "owner")


@query("SELECT doc_id, sha256(text) AS sha FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY source, text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def stored_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK20, X18: contents once per owner under their hash."""
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", F.sha2("text", 256).alias("sha"))
    return rows.groupBy("source", "sha").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "sha")


@query(f"SELECT n.k, o.v AS before, n.v AS after FROM {_NEW} n LEFT JOIN {_OLD} o USING (k) WHERE o.v IS DISTINCT FROM n.v")
def value_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK26: history of changed values."""
    return state.changes(_one(_ranks(spark, sf_dir, "o_orderstatus = 'F'")), _one(_ranks(spark, sf_dir, "o_totalprice > 350000")), ["k"], "v")
