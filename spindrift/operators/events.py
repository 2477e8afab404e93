"""State of applications and of providers, from their events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.parse import days_between

# Stages in order, what closes an application, and limits in days or minutes.
STAGES = ("APPLIED", "RECRUITER_CONTACT", "ASSESSMENT", "INTERVIEW", "FINAL_ROUND", "OFFER")
CLOSED = ("REJECTED", "WITHDRAWN", "GHOSTED")
ACTIONS = ("interview", "follow_up", "offer", "ghosted", "idle")
IDLE_DAYS, GHOST_DAYS = 14, 30
CIRCUIT_FAILURES, CIRCUIT_MINUTES, AUTH_MINUTES, SOFT_LIMIT = 3, 10, 60, 0.9


def stage_of(status: Column) -> Column:
    """Number of a stage; null for closed states."""
    stages = F.array(*(F.lit(s) for s in STAGES))
    return F.nullif(F.array_position(stages, status), F.lit(0)).cast("int")


def is_closed(status: Column) -> Column:
    return status.isin(*CLOSED)


def transitions(moves: DataFrame, key: str = "application_id", order: tuple[str, ...] = ("occurred_at", "event_id")) -> DataFrame:
    """ST1, W9, SK13: every accepted move (key, occurred_at, event_id, status)
    with stage_reached, which never falls, closed_at, reopened, rejected_at and
    last_activity. A move to the state that holds already is refused, and so is
    one over a day before the first. A rejection counts the stage it happened
    at as reached."""
    own = Window.partitionBy(key).orderBy(*order)
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    before = F.lag("status").over(own)
    rows = moves.withColumn("from_status", before).where(F.col("from_status").isNull() | (F.col("from_status") != F.col("status")))
    stage = stage_of(F.col("status"))
    reached = F.coalesce(F.max(stage).over(upto), F.lit(1))
    rows = rows.withColumn("stage_reached", reached)
    at = F.coalesce(stage_of(F.col("from_status")), F.col("stage_reached"))
    stages = F.array(*(F.lit(s) for s in STAGES))
    return rows.withColumns({
        "closed_at": F.when(is_closed(F.col("status")), F.col("occurred_at")), "reopened": F.coalesce(is_closed(F.col("from_status")) & ~is_closed(F.col("status")), F.lit(False)),
        "rejected_at": F.when(F.col("status") == "REJECTED", F.get(stages, at - 1)), "last_activity": F.max("occurred_at").over(upto),
    })


def current(states: DataFrame, key: str = "application_id") -> DataFrame:
    """The state each application is in now."""
    rest = [c for c in states.columns if c != key]
    return states.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("occurred_at", "event_id")).alias("s")).select(key, "s.*")


def idle_days(status: Column, last_activity: Column, now: Column) -> Column:
    """ST2: days since anything happened; null once closed."""
    return F.when(~is_closed(status), days_between(last_activity, now))


def suggests_ghosted(status: Column, last_activity: Column, now: Column) -> Column:
    """ST2: still applied after 30 days of silence."""
    return (status == "APPLIED") & (days_between(last_activity, now) >= GHOST_DAYS)


def todays_actions(applications: DataFrame, rounds: DataFrame, now: Column) -> DataFrame:
    """ST3: one action for each open application (application_id, status,
    last_activity, follow_up_at, offer_decision): a pending round (scheduled_at,
    result) from a day ago to two ahead, a follow-up due within 12 hours, an
    open offer, silence, idleness; the most urgent counts."""
    hours = lambda n: F.expr(f"INTERVAL {n} HOURS")
    soon = rounds.where((F.col("result") == "pending") & F.col("scheduled_at").between(now - hours(24), now + hours(48)))
    soon = soon.groupBy("application_id").agg(F.min("scheduled_at").alias("round_at"))
    rows = applications.where(~is_closed(F.col("status"))).join(soon, "application_id", "left")
    follow = F.col("follow_up_at") <= now + hours(12)
    offer = (F.col("status") == "OFFER") & (F.coalesce("offer_decision", F.lit("pending")) == "pending")
    silent = suggests_ghosted(F.col("status"), F.col("last_activity"), now)
    idle = days_between(F.col("last_activity"), now) >= IDLE_DAYS
    kind = F.when(F.col("round_at").isNotNull(), "interview").when(follow, "follow_up").when(offer, "offer").when(silent, "ghosted").when(idle, "idle")
    due = F.when(kind == "interview", F.col("round_at")).when(kind == "follow_up", F.col("follow_up_at")).otherwise(F.col("last_activity"))
    order = F.array_position(F.array(*(F.lit(a) for a in ACTIONS)), F.col("kind"))
    return rows.select("application_id", kind.alias("kind"), due.alias("due_at")).where("kind is not null").withColumn("urgency", order.cast("int"))


def board(applications: DataFrame) -> DataFrame:
    """Applications by column of the board; closed ones share one."""
    return applications.groupBy(F.when(is_closed(F.col("status")), "CLOSED").otherwise(F.col("status")).alias("lane")).agg(F.count("*").alias("n"))


def provider_health(calls: DataFrame) -> DataFrame:
    """ST8: after each call (service, provider, at, outcome in ok, error, auth,
    quota): failures in a row and until when it rests. A success clears all;
    auth rests an hour, quota until the next day, the third failure in a row
    opens the circuit for ten minutes, fewer rest 1, 2, 4 ... minutes."""
    own = Window.partitionBy("service", "provider").orderBy("at", "call_id")
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum(F.when(F.col("outcome") == "ok", 1).otherwise(0)).over(upto)
    rows = calls.withColumn("_run", run)
    failures = F.sum(F.when(F.col("outcome") != "ok", 1).otherwise(0)).over(Window.partitionBy("service", "provider", "_run").orderBy("at", "call_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("failures", failures.cast("int"))
    minutes = F.when(F.col("outcome") == "auth", AUTH_MINUTES).when(F.col("failures") >= CIRCUIT_FAILURES, CIRCUIT_MINUTES).otherwise(F.least(F.pow(F.lit(2.0), F.col("failures") - 1), F.lit(10.0)))
    rest = F.when(F.col("outcome") == "quota", F.date_trunc("day", F.col("at")).cast("timestamp") + F.expr("INTERVAL 1 DAY")).otherwise(F.timestamp_seconds(F.unix_timestamp("at") + minutes * 60))
    return rows.withColumn("rests_until", F.when(F.col("outcome") != "ok", rest)).drop("_run")


def available(used: Column, limit: Column, rests_until: Column, now: Column, reserve: bool = False) -> Column:
    """ST9: not resting, and under 90 % of the limit (all of it in reserve)."""
    share = 1.0 if reserve else SOFT_LIMIT
    return F.coalesce(rests_until <= now, F.lit(True)) & F.coalesce(used < limit * share, F.lit(True))


def first_available(providers: DataFrame) -> DataFrame:
    """ST10, ST11, A27: of each service the first available provider (service,
    provider, position, override, usable); an override replaces the position."""
    order = F.struct(F.coalesce("override", "position"), F.col("position"), F.col("provider"))
    return providers.where("usable").groupBy("service").agg(F.min_by("provider", order).alias("provider"))


def throttle_breaches(requests: DataFrame, seconds: float = 1.0) -> DataFrame:
    """ST12: requests that follow another to the same host too soon."""
    gap = F.unix_micros(F.col("at").cast("timestamp")) - F.lag(F.unix_micros(F.col("at").cast("timestamp"))).over(Window.partitionBy("host").orderBy("at", "request_id"))
    return requests.withColumn("gap", gap / 1e6).where(F.col("gap") < seconds)


def site_schedule(reads: DataFrame) -> DataFrame:
    """ST14: after each read of a site (site_id, at, read_id, outcome in ok,
    empty, failed, refused): empty runs and failures so far, and when it is
    due next: a day, a week after three empty reads, 2^n days after n failures
    (30 at most), 30 days after a refusal."""
    own = Window.partitionBy("site_id").orderBy("at", "read_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = reads
    for name, outcome in (("empty_runs", "empty"), ("failures", "failed")):
        broken = F.sum(F.when(F.col("outcome") != outcome, 1).otherwise(0)).over(own)
        rows = rows.withColumn("_run", broken)
        count = F.sum(F.when(F.col("outcome") == outcome, 1).otherwise(0)).over(Window.partitionBy("site_id", "_run").orderBy("at", "read_id").rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn(name, count.cast("int")).drop("_run")
    days = F.when(F.col("outcome") == "refused", 30).when(F.col("failures") > 0, F.least(F.pow(F.lit(2.0), F.col("failures")), F.lit(30.0))).when(F.col("empty_runs") >= 3, 7).otherwise(1)
    return rows.withColumn("next_check", F.timestamp_seconds(F.unix_timestamp("at") + days * 86_400))


def noted(at: Column, last_activity: Column, follow_up_at: Column, now: Column) -> Column:
    """ST5, ST4: struct of what a note makes of an application. One dated over a
    day ahead is rejected and changes nothing; any other moves last_activity
    forward only, and clears a follow-up that is due by then."""
    rejected = at > now + F.expr("INTERVAL 1 DAY")
    return F.struct(F.when(rejected, "rejected").otherwise("note").alias("kind"), F.when(rejected, last_activity).otherwise(F.greatest(last_activity, at)).alias("last_activity"), F.when(rejected | ~F.coalesce(follow_up_at <= at, F.lit(False)), follow_up_at).alias("follow_up_at"))
