"""Profiles, job texts and reports: sections, evidence, requirements, claims."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from spindrift.functions.text import best_match, let, mentions, normalize_for_match, sentences, skill_key, skill_keys_in, split_lines, strip_bullet, word_count
from spindrift.operators.matching import containment

# How a wrapped line goes on, and what headings say.
JOINERS = r"(?i)(?:[,–—&(/:]|\s-|\b(?:and|or|of|to|in|on|with|for|the|a|an|by|from|at|as|across|into|using|via|including))$"
HEADINGS = (
    ("summary", r"^(professional |career )?(summary|profile|objective)$|^about( me)?$"), ("experience", r"^(work |professional |employment )?(experience|history)$|^employment$"), ("projects", r"^(personal |key |academic )?projects$"),
    ("education", r"^education(al background)?$|^academics?$"), ("skills", r"^(technical |key |core )?(skills|competencies)$|^tech(nical)? stack$"), ("certifications", r"^(licenses and )?certifications?$|^courses$"),
)
JOB_HEADINGS = (("duties", r"(?i)^(key )?(responsibilities|duties|what you('| wi)ll do|the role).*$"), ("required", r"(?i)^(requirements|must[- ]haves?|qualifications|what you('| wi)ll need|what we look for).*$"), ("nice", r"(?i)^(nice[- ]to[- ]haves?|preferred|bonus|good to have).*$"))
NICE = r"(?i)\b(nice to have|preferred|bonus|plus|good to have|desirable)\b"
NUMBER = r"\d+(?:[.,]\d+)*"
BANNED = r"(?i)\b(guarantee[ds]?|perfect (fit|match)|rock ?star|ninja|100% (match|fit))\b"
#: Share of a quotation that a posting must hold.
GROUNDED = 0.85


def merge_wrapped(lines: Column) -> Column:
    """Lines joined that go on from the one before: after a joining word or
    an open bracket, or when they start in lower case; a word cut by a hyphen
    is joined without a blank. Lines with tabs stand alone."""

    def step(out: Column, line: Column) -> Column:
        prev = F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit(""))
        # what a line ends in is told by its last characters, which are few to search
        tail = F.substring(prev, -24, 24)
        apart = (F.size(out) == 0) | prev.contains("\t") | line.contains("\t")
        glued = line.rlike("^[a-z0-9]") & tail.rlike("[A-Za-z0-9]-$|/$") & (tail.rlike("-$") | ~line.contains(" "))
        opened = prev.contains("(") & (F.length(F.regexp_replace(prev, "[^(]", "")) > F.length(F.regexp_replace(prev, "[^)]", "")))
        on = opened | (line.rlike("^[a-z]") & ~line.rlike(r"^(https?://|www\.)|^\S+@")) | tail.rlike(JOINERS)
        head = F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))
        return F.when(apart, F.concat(out, F.array(line))).when(glued, F.concat(head, F.array(F.concat(prev, line)))).when(on, F.concat(head, F.array(F.concat(prev, F.lit(" "), line)))).otherwise(F.concat(out, F.array(line)))

    return F.aggregate(lines, F.array().cast("array<string>"), step)


def heading_of(line: Column, headings=HEADINGS) -> Column:
    """The section a line opens, or null, by patterns that hold from the
    beginning of a line."""

    def known(name: Column) -> Column:
        out = F.lit(None).cast("string")
        for section, pattern in reversed(headings):
            out = F.when(name.rlike(pattern), section).otherwise(out)
        # most lines are no heading, so one test of them all goes first
        return F.when(name.rlike(f"^(?:{'|'.join(pattern for _, pattern in headings)})"), out)

    return F.when(F.length(line) <= 60, let(F.lower(F.trim(F.regexp_replace(line, r"[:\s]+$", ""))), known))


def stretches(items: Column, opens: Callable[[Column, Column], Column]) -> Column:
    """Items cut before each one that opens a stretch by ``opens`` (item, place
    from 0): an array of arrays; items before the first such one are left out."""

    def cut(b: Column) -> Column:
        end = lambda j: F.coalesce(F.get(b["starts"], j + 1), F.size(b["items"]))
        return F.transform(b["starts"], lambda at, j: F.slice(b["items"], at + 1, end(j) - at))

    def starts(items: Column) -> Column:
        return F.filter(F.transform(items, lambda x, i: F.when(opens(x, i), i)), lambda i: i.isNotNull())

    return let(items, lambda x: let(F.struct(x.alias("items"), starts(x).alias("starts")), cut))


def text_sections(text: Column, headings=HEADINGS) -> Column:
    """Stretches of a text's lines in order, each from its heading to the
    next: array of section, line_no (of the first line) and lines (heading left
    out); lines before the first heading are in section header. A text is cut
    where it lies, so no line is shuffled to meet its heading."""

    def cut(lines: Column) -> Column:
        marked = F.filter(F.transform(lines, lambda x, i: F.struct(heading_of(x, headings).alias("section"), i.alias("at"))), lambda m: m["section"].isNotNull())

        def of(heads: Column) -> Column:
            before = F.struct(F.lit("header").alias("section"), F.lit(0).alias("line_no"), F.slice(lines, F.lit(1), F.coalesce(F.get(heads, 0)["at"], F.size(lines))).alias("lines"))
            end = lambda j: F.coalesce(F.get(heads, j + 1)["at"], F.size(lines))
            after = F.transform(heads, lambda h, j: F.struct(h["section"].alias("section"), (h["at"] + 1).alias("line_no"), F.slice(lines, h["at"] + 2, end(j) - h["at"] - 1).alias("lines")))
            return F.concat(F.array(before), after)

        return let(marked, of)

    return let(split_lines(text), cut)


def section_lines(text: Column, section: str) -> Column:
    """Lines of a text's section in order, wherever its headings stand. The text
    is cut where a line reads like a heading, so that only the first line of a
    stretch is judged; should one be none, all lines are."""
    # every line that heading_of takes, and maybe others
    reads_like = "|".join(pattern.replace("^", "").replace("$", r"(?=[:\s]*(?:\n|$))") for _, pattern in HEADINGS)

    def lines_of(part: Column) -> Column:
        return F.array_remove(F.split(part, "\n"), "")

    def chosen(parts: Column) -> Column:
        # the first stretch goes before every heading
        heads = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.struct(heading_of(F.substring_index(p, "\n", 1)).alias("section"), p.alias("part")))

        def of(heads: Column) -> Column:
            found = F.flatten(F.transform(F.filter(heads, lambda h: h["section"] == section), lambda h: let(lines_of(h["part"]), lambda x: F.slice(x, F.lit(2), F.size(x)))))
            return F.when(F.forall(heads, lambda h: h["section"].isNotNull()), found)

        return let(heads, of)

    by_parts = let(F.split(F.concat(F.lit("\n"), F.array_join(split_lines(text), "\n")), rf"\n(?=(?iu: *(?:{reads_like})))"), chosen)
    every = F.flatten(F.transform(F.filter(text_sections(text), lambda s: s["section"] == section), lambda s: s["lines"]))
    return F.coalesce(by_parts, every)


def sections(documents: DataFrame, key: str, headings=HEADINGS) -> DataFrame:
    """Lines of texts (key, text) with their section: key, line_no,
    section, line; lines before the first heading are in section header."""
    parts = documents.select(key, F.inline(text_sections(F.col("text"), headings)).alias("section", "_from", "_lines"))
    return parts.select(key, "section", "_from", F.posexplode("_lines").alias("_i", "line")).select(key, (F.col("_from") + F.col("_i")).alias("line_no"), "section", "line")


def evidence(documents: DataFrame, key: str) -> DataFrame:
    """W4, SC4: bullets and lines of every section numbered E1, E2 ... in order."""
    rows = sections(documents, key).where("section <> 'header'")
    order = Window.partitionBy(key).orderBy("line_no")
    return rows.select(key, F.concat(F.lit("E"), F.row_number().over(order).cast("string")).alias("evidence_id"), "section", strip_bullet(F.col("line")).alias("text"))


def requirements(jobs: DataFrame) -> DataFrame:
    """Requirements and duties of job texts (job_id, text): job_id,
    ord, kind (duty, requirement), importance, quote."""
    rows = sections(jobs, "job_id", JOB_HEADINGS)
    units = rows.select("job_id", "section", "line_no", F.posexplode(sentences(strip_bullet(F.col("line")))).alias("_i", "quote"))
    kind = F.when(F.col("section") == "duties", "duty").otherwise("requirement")
    importance = F.when((F.col("section") == "nice") | F.col("quote").rlike(NICE), "nice").when(F.col("section") == "required", "required").otherwise("preferred")
    order = F.row_number().over(Window.partitionBy("job_id").orderBy("line_no", "_i"))
    return units.where("section <> 'header'").select("job_id", order.alias("ord"), kind.alias("kind"), importance.alias("importance"), "quote")


def finalised(found: DataFrame, jobs: DataFrame, cap: int = 40) -> DataFrame:
    """Q16: requirements (job_id, req_key, quote, rank, years) that the job's
    text (job_id, normal_text) bears out, merged by key, numbered R1, R2 ... by
    rank and first quote."""
    grounded = found.join(jobs, "job_id").where(best_match(F.col("normal_text"), F.lower("quote")) >= GROUNDED)
    merged = grounded.groupBy("job_id", "req_key").agg(F.min_by("quote", F.struct("rank", "quote")).alias("quote"), F.min("rank").alias("rank"), F.max("years").alias("years"))
    n = F.row_number().over(Window.partitionBy("job_id").orderBy("rank", "quote", "req_key"))
    return merged.withColumn("_n", n).where(F.col("_n") <= cap).withColumn("label", F.concat(F.lit("R"), F.col("_n").cast("string"))).drop("_n")


def keyword_check(texts: DataFrame, skills: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """For each text (key, text) and wanted skill (key, skill_id), whether
    one of its names (skills: skill_id, name) is in the text."""
    keys = texts.select(key, skill_keys_in(F.col("text")).alias("_keys"))
    names = skills.select("skill_id", skill_key(F.col("name")).alias("_k"))
    return wanted.join(names, "skill_id").join(keys, key).groupBy(key, "skill_id").agg(F.bool_or(mentions(F.col("_keys"), F.col("_k"))).alias("present"))


@F.arrow_udf(ArrayType(StringType()))
def _munched(text: pa.Array, names: pa.Array) -> pa.Array:
    out = []
    for t, ns in zip(text.to_pylist(), names.to_pylist(), strict=True):
        low, found = (t or "").lower(), []
        for name in sorted(ns or [], key=lambda n: (-len(n), n)):
            at, part = low.find(name.lower()), name.lower()
            hit = False
            while at >= 0:
                before, after = low[at - 1 : at], low[at + len(part) : at + len(part) + 1]
                if not (before.isalnum() or after.isalnum() or after in ("+", "#") and after):
                    low, hit = low[:at] + "\n" * len(part) + low[at + len(part) :], True
                at = low.find(part, at + 1)
            if hit:
                found.append(name)
        out.append(found)
    return pa.array(out, pa.list_(pa.string()))


def skills_in(text: Column, names: Column) -> Column:
    """Names that occur as whole words, longest first; a shorter one
    counts only where no longer one stands."""
    return _munched(text, names)


def claim_faults(claim: Column, ids: Column, known: Column, facts: Column) -> Column:
    """What is wrong with a claim: ids that don't exist, numbers that
    neither evidence nor facts hold, banned phrases."""
    numbers = F.transform(F.regexp_extract_all(claim, F.lit(f"({NUMBER})"), 1), lambda n: F.replace(n, F.lit(","), F.lit("")))
    ground = F.transform(F.regexp_extract_all(F.concat_ws(" ", facts), F.lit(f"({NUMBER})"), 1), lambda n: F.replace(n, F.lit(","), F.lit("")))
    return F.array_compact(F.array(F.when(F.size(F.array_except(ids, known)) > 0, "unknown id"), F.when(F.size(F.array_except(numbers, ground)) > 0, "unsupported number"), F.when(claim.rlike(BANNED), "banned phrase")))


def report_faults(claims: DataFrame, evidence_rows: DataFrame, required: DataFrame) -> DataFrame:
    """Faults of reports, a row each: of claims (report_id, claim_no,
    claim, evidence_ids), and requirements (report_id, req_id) that no claim
    covers (claims.req_id)."""
    known = evidence_rows.groupBy("report_id").agg(F.collect_set("evidence_id").alias("known"), F.collect_list("text").alias("facts"))
    rows = claims.join(known, "report_id", "left")
    empty = F.array().cast("array<string>")
    own = rows.select("report_id", "claim_no", F.explode(claim_faults(F.col("claim"), F.col("evidence_ids"), F.coalesce("known", empty), F.coalesce("facts", empty))).alias("fault"))
    missed = required.join(claims.select("report_id", "req_id"), ["report_id", "req_id"], "left_anti").select("report_id", F.lit(None).cast("int").alias("claim_no"), F.concat(F.lit("not covered: "), F.col("req_id")).alias("fault"))
    return own.unionByName(missed)


def coverage(targets: DataFrame, levels: DataFrame) -> DataFrame:
    """Share of a role's core skills (role_id, skill_id) that a user holds
    at level 3 at least; roles of which a user holds none have no row."""
    core = targets.select("role_id", "skill_id").distinct()
    total = core.groupBy("role_id").agg(F.count("*").alias("_total"))
    held = levels.where("level >= 3").select("user_id", "skill_id").distinct().join(core, "skill_id").groupBy("user_id", "role_id").agg(F.count("*").alias("n_held"))
    return held.join(total, "role_id").select("user_id", "role_id", (F.col("n_held") / F.col("_total")).alias("share"), "n_held")


def suggested_roles(shares: DataFrame, k: int = 6) -> DataFrame:
    """The first roles by share, then number of skills held."""
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("share"), F.desc("n_held"), "role_id"))
    return shares.where("n_held > 0").withColumn("rank", rank).where(F.col("rank") <= k)


def resynced_evidence(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """V8: lines keep the number they had; new ones get the next free."""
    kept = new.join(old.select(key, "text", "number").dropDuplicates([key, "text"]), [key, "text"], "left")
    last = old.groupBy(key).agg(F.max("number").alias("_last"))
    fresh = F.row_number().over(Window.partitionBy(key, F.col("number").isNull()).orderBy("position"))
    return kept.join(last, key, "left").withColumn("number", F.coalesce("number", F.coalesce("_last", F.lit(0)) + fresh)).drop("_last")


def profile_text(headline: Column, skills: Column, titles: Column, cap: int = 2000) -> Column:
    """The text of a profile that is embedded."""
    return F.substring(F.trim(F.concat_ws(". ", headline, F.concat(F.lit("Skills: "), F.array_join(skills, ", ")), F.array_join(titles, "; "))), 1, cap)


#: Words of a line that is a bullet for certain, and what of it must be found.
SUBSTANTIVE_WORDS, BULLET_GROUNDED = 8, 0.9


def bullet_coverage(lines: DataFrame, bullets: DataFrame, key: str) -> DataFrame:
    """Of a document's lines (key, text) of eight words or more how
    many some extracted bullet (key, text) has, or is part of, by equal or nearly
    equal words: key, n_lines, covered. Shorter lines don't count. A line meets
    only its own document's bullets; a text that occurs again is compared once."""
    own = lines.where(word_count(F.col("text")) >= SUBSTANTIVE_WORDS).groupBy(key, normalize_for_match(F.col("text")).alias("_t")).agg(F.count("*").alias("_n")).withColumn("_id", F.xxhash64("_t"))
    said = bullets.select(key, normalize_for_match(F.col("text")).alias("_b")).where("_b <> ''").distinct()
    # a line and a bullet meet once, and either may hold the other
    met = own.select(key, "_id", "_t").join(said.select(key, "_b").hint("merge"), key)
    hit = met.where((containment(F.col("_b"), F.col("_t")) >= BULLET_GROUNDED) | (containment(F.col("_t"), F.col("_b")) >= BULLET_GROUNDED)).select(key, "_id").distinct().withColumn("_hit", F.lit(True))
    return own.join(hit.hint("merge"), [key, "_id"], "left").groupBy(key).agg(F.sum("_n").alias("n_lines"), F.coalesce(F.sum(F.when(F.col("_hit"), F.col("_n"))), F.lit(0)).alias("covered"))


def check(kind: str, **asked) -> tuple[str, dict]:
    """An item of a checklist (Q19): status (requirement, among), blocker
    (blocker), no_blocker, recommendation (among), strategy (among: the report's
    action), mentions (sections, terms: in one claim a term of each group), cites
    (section)."""
    return kind, asked


def checklist(reports: DataFrame, claims: DataFrame, items: dict[str, tuple[str, dict]]) -> DataFrame:
    """Q19: of each report (report_id, statuses as a map, blockers,
    recommendation, action) whether it holds each item. Claims (report_id, section,
    text, n_cited) are reduced once to a flag for each item."""
    text = F.lower("text")

    def of_claim(kind: str, asked: dict) -> Column | None:
        if kind == "mentions":
            found = F.col("section").isin(*asked["sections"])
            for group in asked["terms"]:
                any_term = F.lit(False)
                for term in group:
                    any_term = any_term | F.contains(text, F.lit(term.lower()))
                found = found & any_term
            return found
        return (F.col("section") == asked["section"]) & (F.col("n_cited") > 0) if kind == "cites" else None

    def of_report(name: str, kind: str, asked: dict) -> Column:
        if kind == "status":
            return F.try_element_at("statuses", F.lit(asked["requirement"])).isin(*asked["among"])
        if kind == "blocker":
            return F.array_contains("blockers", asked["blocker"])
        if kind == "no_blocker":
            return F.size("blockers") == 0
        return F.col("recommendation" if kind == "recommendation" else "action").isin(*asked["among"]) if kind in ("recommendation", "strategy") else F.col(f"_{name}")

    flags = {name: c for name, (kind, asked) in items.items() if (c := of_claim(kind, asked)) is not None}
    rows = reports
    if flags:
        rows = rows.join(claims.groupBy("report_id").agg(*(F.bool_or(c).alias(f"_{name}") for name, c in flags.items())), "report_id", "left")
    return rows.select("report_id", *(F.coalesce(of_report(name, *item), F.lit(False)).alias(name) for name, item in items.items()))
