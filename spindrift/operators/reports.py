"""Rules of a report as rows, joined with its claims.

A report is its claims (report_id, path, text, ids), with paths such as
``recruiterView.standsOut.2``; a rule is a row for the path without the number
at its end. So limits and needs are data, and every check is a join or a sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import text

# Per path the most words, the most items (0: no limit) and what a
# claim must cite; generic phrases; actions that suit a recommendation.
RULES = (
    ("summary", 80, 0, "evidence or stat"), ("roleDecoded.whatTheRoleIs", 50, 0, "requirement"), ("roleDecoded.seniority", 50, 0, "requirement"), ("roleDecoded.technologyDepth", 50, 10, "requirement"), ("requirements", 40, 0, ""),
    ("experienceRelevance.roles", 50, 6, "evidence"), ("experienceRelevance.domainAndScale", 50, 0, ""), ("recruiterView.standsOut", 50, 5, "evidence"), ("recruiterView.redFlags", 50, 6, "any"), ("risks", 50, 8, "requirement"),
    ("strategy.reasoning", 50, 0, ""), ("strategy.emphasise", 50, 5, "evidence"), ("strategy.questions", 30, 5, ""),
)
BANNED = (
    "improve your skills", "tailor your resume", "tailor your cv", "highlight your experience", "highlight your skills", "stand out from the crowd", "perfect fit", "great fit", "ideal candidate", "strong candidate", "passionate about",
    "team player", "think outside the box", "hit the ground running", "go-getter", "dynamic environment", "fast-paced environment", "leverage your", "upskill", "it is important to note",
)
ACTIONS = {"APPLY": ("apply_now", "tailor_first"), "CONSIDER": ("tailor_first", "seek_referral"), "LOW_PRIORITY": ("seek_referral", "skip")}
_NUMBER = r"(?<![\w.])\d[\d,]*(?:\.\d+)?(?!\w)"
_QUOTED = '["“]([^"”]{3,})["”]'
_IDS = "array<string>"


def rule_table(spark: SparkSession, rules: tuple = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "section string, most_words int, most_items int, need string")


def numbers(said: Column) -> Column:
    """Numbers of a text that stand alone: neither "K8s" nor "v2" holds one."""
    return F.transform(F.regexp_extract_all(said, F.lit(f"({_NUMBER})"), 1), lambda n: F.replace(n, F.lit(","), F.lit("")).try_cast("double"))


def section_of(path: Column) -> Column:
    return F.regexp_replace(path, r"\.\d+$", "")


def claim_issues(claims: DataFrame, cited: DataFrame, quotable: DataFrame, rules: DataFrame, banned: tuple[str, ...] = BANNED) -> DataFrame:
    """Issues of claims: report_id, path, issue (a row each).

    claims (report_id, path, text, ids; E evidence, R requirements, S stats),
    cited (report_id, id, text: what an id stands for), quotable (report_id,
    text), rules (``rule_table``). Issues: unknown id; too long; banned phrase;
    false quotation (of three words or more that no quotable text holds);
    unsupported number (backed by no cited text, whole, floored or rounded;
    numbers in true quotations and in ids need no backing); written id; uncited
    (the path's need); too many items, for the path. A null text is empty, null
    ids are none; a path without a rule has no limit and no need.
    """
    rows = claims.select("report_id", "path", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("ids", F.array().cast(_IDS)).alias("ids"), section_of(F.col("path")).alias("section")).join(F.broadcast(rules), "section", "left")
    one = rows.select("report_id", "path", F.explode("ids").alias("id")).join(cited.select("report_id", "id", F.col("text").alias("_c")), ["report_id", "id"], "left")
    known = F.col("_c").isNotNull()
    back = one.groupBy("report_id", "path").agg(
        F.flatten(F.collect_list(numbers(F.coalesce("_c", F.lit(""))))).alias("_known"), F.count_if(~known).alias("_unknown"),
        *(F.count_if(known & F.startswith("id", F.lit(kind))).alias(f"_n{kind}") for kind in "ERS"),
    )
    quotes = F.filter(F.regexp_extract_all("text", F.lit(_QUOTED), 1), lambda q: text.word_count(q) >= 3)
    said = rows.select("report_id", "path", F.explode(F.array_distinct(quotes)).alias("q")).withColumn("_q", text.normalize_for_match(F.col("q")))
    sources = quotable.select("report_id", text.normalize_for_match(F.col("text")).alias("_s"))
    real = said.join(sources, "report_id", "left").groupBy("report_id", "path", "q").agg(F.coalesce(F.bool_or(F.contains("_s", "_q")), F.lit(False)).alias("_ok"))
    real = real.groupBy("report_id", "path").agg(F.count_if(~F.col("_ok")).alias("_false"), F.collect_list(F.when(F.col("_ok"), F.col("q"))).alias("_true"))
    whole = rows.join(back, ["report_id", "path"], "left").join(real, ["report_id", "path"], "left")
    bare = F.aggregate(F.coalesce("_true", F.array().cast(_IDS)), F.col("text"), lambda t, q: F.replace(t, q, F.lit(" ")))
    whole = whole.withColumn("_loose", numbers(F.regexp_replace(bare, r"\b[ERS]\d+\b", " "))).withColumn("_known", F.coalesce("_known", F.array().cast("array<double>")))
    loose = F.filter("_loose", lambda n: ~F.exists("_known", lambda v: (n == v) | (n == F.floor(v)) | (n == F.round(v))))
    generic = F.regexp_like(F.lower("text"), F.lit("|".join(rf"\Q{b}\E" for b in banned)))
    written = F.exists("ids", lambda i: F.regexp_like("text", F.concat(F.lit(r"\b\Q"), i, F.lit(r"\E\b"))))
    has = {k: F.coalesce(F.col(f"_n{k}"), F.lit(0)) > 0 for k in "ERS"}
    cites = F.when(F.col("need") == "evidence", has["E"]).when(F.col("need") == "requirement", has["R"]).when(F.col("need") == "evidence or stat", has["E"] | has["S"]).when(F.col("need") == "any", F.size("ids") > 0).otherwise(True)
    issues = F.array_compact(F.array(
        F.when(F.col("_unknown") > 0, "unknown id"), F.when(generic, "banned phrase"), F.when(text.word_count(F.col("text")) > F.col("most_words"), "too long"), F.when(F.col("_false") > 0, "false quotation"),
        F.when(F.size(loose) > 0, "unsupported number"), F.when(written, "written id"), F.when(~cites, "uncited"),
    ))
    many = rows.groupBy("report_id", "section").agg(F.count("*").alias("_n"), F.max("most_items").alias("_most")).where("_most > 0 and _n > _most").select("report_id", F.col("section").alias("path"), F.lit("too many items").alias("issue"))
    return whole.select("report_id", "path", F.explode(issues).alias("issue")).unionByName(many)


def assessment_issues(assessed: DataFrame, requirements: DataFrame) -> DataFrame:
    """How a report's assessments (report_id, req_id, status, semantic,
    n_evidence) differ from what the code found (requirements: report_id, req_id,
    importance, kind, held, code_status, n_evidence): report_id, req_id, issue.

    unknown requirement; assessed twice; uncited (strong or partial without
    evidence, where there is some or the code scores nothing); another status
    (a missing skill that the user does not hold may become partial as a
    semantic match that cites evidence); not assessed (required ones).
    """
    mine = assessed.groupBy("report_id", "req_id").agg(F.count("*").alias("_times"), F.first(F.struct("status", "semantic", F.col("n_evidence").alias("cites"))).alias("a"))
    rows = mine.join(requirements, ["report_id", "req_id"], "full")
    there, done = F.col("code_status").isNotNull(), F.col("a").isNotNull()
    cites = F.coalesce(F.col("a.cites"), F.lit(0)) > 0
    semantic = (F.col("kind") == "skill") & ~F.col("held") & (F.col("code_status") == "missing") & (F.col("a.status") == "partial") & F.col("a.semantic") & cites
    other = there & done & (F.col("code_status") != "unscored") & (F.col("a.status") != F.col("code_status")) & ~F.coalesce(semantic, F.lit(False))
    uncited = there & done & F.col("a.status").isin("strong", "partial") & ~cites & ((F.col("n_evidence") > 0) | (F.col("code_status") == "unscored"))
    found = F.array_compact(F.array(F.when(done & ~there, "unknown requirement"), F.when(F.col("_times") > 1, "assessed twice"), F.when(uncited, "uncited"), F.when(other, "another status"), F.when(there & ~done & (F.col("importance") == "required"), "not assessed")))
    return rows.select("report_id", "req_id", F.explode(found).alias("issue"))


def strategy_fits(action: Column, recommendation: Column) -> Column:
    """Whether an action suits a recommendation; null for an unknown one."""
    out = F.lit(None).cast("boolean")
    for name, among in ACTIONS.items():
        out = F.when(recommendation == name, action.isin(*among)).otherwise(out)
    return out
