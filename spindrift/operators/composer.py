"""SK25, Q17: texts from templates over nested rows.

A template is a tree: ``line`` joins parts, ``each`` writes an item for each
element of an array, ``section`` puts a heading over what is not empty, ``text``
joins sections. A part that is null or empty leaves nothing behind, not even its
separator, so a report of any shape comes from one Column expression and is
written where its row lies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What codes are called in a report.
RECOMMENDATIONS = {"APPLY": "Apply", "CONSIDER": "Consider", "LOW_PRIORITY": "Low priority"}
ACTIONS = {"apply_now": "Apply now", "tailor_first": "Tailor the CV first", "seek_referral": "Seek a referral", "skip": "Skip"}
MITIGATIONS = {"surface_evidence": "Surface existing evidence", "cover_note": "Mention in a cover note", "interview_prep": "Prepare for the interview", "learn": "Learn it"}
COMPONENTS = {"skills": "Skills", "experience": "Experience", "roleAlignment": "Role alignment", "location": "Location and work mode", "salary": "Salary"}


def _part(value: Column | str) -> Column:
    return F.lit(value) if isinstance(value, str) else value.cast("string")


def _filled(parts: list[Column]) -> Column:
    return F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != ""))


def line(*parts: Column | str) -> Column:
    """Parts one after another; null if one of them is null."""
    return F.concat(*map(_part, parts))


def maybe(*parts: Column | str) -> Column:
    """Like ``line``, but empty if a part is null."""
    return F.coalesce(line(*parts), F.lit(""))


def each(items: Column, item: Callable[[Column], Column], mark: str = "- ", between: str = "\n") -> Column:
    """A marked item for each element that has a text."""
    texts = F.filter(F.transform(items, item), lambda t: t.isNotNull() & (t != ""))
    return F.coalesce(F.array_join(F.transform(texts, lambda t: F.concat(F.lit(mark), t)), between), F.lit(""))


def block(*parts: Column, between: str = "\n") -> Column:
    """Parts that are not empty, on lines of their own."""
    return F.array_join(_filled([p.cast("string") for p in parts]), between)


def section(heading: Column | str, *parts: Column) -> Column:
    """A heading over what is not empty; nothing if all is."""
    body = block(*parts)
    return F.when(body != "", F.concat(_part(heading), F.lit("\n"), body)).otherwise("")


def text(*sections: Column) -> Column:
    return block(*sections, between="\n\n")


def called(code: Column, names: dict[str, str]) -> Column:
    """What a code is called; an unknown one is shown as it is."""
    out = code
    for key, name in names.items():
        out = F.when(code == key, name).otherwise(out)
    return out


def claim(c: Column) -> Column:
    """A claim (text, ids) and what it cites."""
    return F.concat(c["text"], F.when(F.size(c["ids"]) > 0, F.concat(F.lit(" ["), F.array_join(c["ids"], ", "), F.lit("]"))).otherwise(""))


def claims(items: Column, shown: Callable[[Column], Column] = claim, mark: str = "- ") -> Column:
    return each(items, shown, mark)


def fit_report() -> Column:
    """SK25: a fit report as plain text, of columns title, company, total,
    recommendation, summary (claim), role (claims), requirements (req_id, text,
    importance, status, note), components (key, points, most, reason), gains
    (points, skill), conditions (texts), stands_out (claims), red_flags (claims
    with severity), risks (claims with mitigation), action, reasoning (claim),
    emphasise (claims), questions (texts)."""
    asked = lambda r: F.concat_ws(" — ", line(r["req_id"], " ", r["text"], " (", r["importance"], "): ", r["status"]), F.nullif(r["note"], F.lit("")))
    # halves are rounded up, as reports round points
    scored = lambda c: line(called(c["key"], COMPONENTS), ": ", F.floor(c["points"] + 0.5).cast("long"), "/", c["most"], " — ", c["reason"])
    return text(
        line("Fit Report: ", F.col("title"), " at ", F.col("company")),
        line("Fit score ", F.col("total"), "/100 · ", called(F.col("recommendation"), RECOMMENDATIONS)),
        claim(F.col("summary")),
        section("ROLE", each(F.col("role"), claim, mark="")),
        section("REQUIREMENTS", each(F.col("requirements"), asked)),
        section("SCORE", each(F.col("components"), scored), each(F.col("gains"), lambda g: line("+", g["points"], " with ", g["skill"]))),
        section("CONDITIONS", each(F.col("conditions"), lambda c: c)),
        section("RECRUITER VIEW", claims(F.col("stands_out"), mark="- + "), each(F.col("red_flags"), lambda c: line("! (", c["severity"], ") ", claim(c)))),
        section("RISKS", each(F.col("risks"), lambda r: line(claim(r), " → ", called(r["mitigation"], MITIGATIONS)))),
        section(line("STRATEGY: ", called(F.col("action"), ACTIONS)), claim(F.col("reasoning")), section("Lead with:", claims(F.col("emphasise"))), section("Ask the recruiter:", each(F.col("questions"), lambda q: q))),
    )
