"""Explainable scores: relevance of a posting and fit of a profile.

Inputs are columns of joined rows (a posting beside its one user's profile), so
every part is a Column and a whole table is scored in one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.text import lpa, round_half_up, similarity
from spindrift.operators.metrics import importance_weight

# Weights, thresholds and raw points.
WEIGHTS = {"skills": 30, "semantic": 20, "title": 20, "experience": 15, "location": 10, "salary": 5}
FIT_WEIGHTS = {"skills": 45, "experience": 20, "role": 15, "location": 10, "salary": 10}
APPLY, CONSIDER = 72, 55
DISMISSED_PENALTY = 15
NEUTRAL = 0.5


def clamp(x: Column) -> Column:
    """Into 0 to 1; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def remote(mode: Column, city: Column) -> Column:
    return F.coalesce((mode == "remote") | (city == "Remote-India"), F.coalesce(mode == "remote", F.lit(False)) | F.coalesce(city == "Remote-India", F.lit(False)))


def _has(values: Column, value: Column) -> Column:
    return F.coalesce(F.array_contains(values, value), F.lit(False))


def skills_part(levels: Column) -> Column:
    """Mean of min(1, level / 3) over the named skills' levels (array);
    neutral without any."""
    total = F.aggregate(levels, F.lit(0.0), lambda s, x: s + F.least(F.lit(1.0), F.coalesce(x, F.lit(0)) / 3))
    return F.when(F.size(levels) == 0, NEUTRAL).otherwise(total / F.size(levels))


def title_part(title_key: Column, variants: Column) -> Column:
    """R2: best of similarity and share of covered words over the variants' keys."""
    words = F.split(title_key, " ")

    def one(v: Column) -> Column:
        own = F.filter(F.split(v, " "), lambda w: w != "")
        covered = F.size(F.filter(own, lambda w: F.array_contains(words, w))) / F.greatest(F.lit(1), F.size(own))
        return F.greatest(similarity(title_key, v), covered)

    return F.when(F.size(variants) == 0, NEUTRAL).otherwise(clamp(F.array_max(F.transform(variants, one))))


def experience_part(years: Column, low: Column, high: Column) -> Column:
    """1 in range, falling over three years below and six above."""
    unknown = years.isNull() | (low.isNull() & high.isNull())
    value = F.when(years < low, 1 - (low - years) / 3).when(years > high, F.greatest(F.lit(0.3), 1 - (years - high) / 6)).otherwise(1.0)
    return F.when(unknown, NEUTRAL).otherwise(clamp(value))


def location_part(city: Column, mode: Column, cities: Column, modes: Column, relocates: Column) -> Column:
    """R4."""
    wants_remote = _has(modes, F.lit("remote")) | _has(cities, F.lit("Remote-India"))
    mode_fits = mode.isNull() | (F.size(modes) == 0) | _has(modes, mode)
    local = F.when(city.isNull(), NEUTRAL).when(_has(cities, city) & mode_fits, 1.0).when(_has(cities, city), 0.6).when(relocates, 0.5).otherwise(0.1)
    value = F.when(remote(mode, city), F.when(wants_remote, 1.0).otherwise(0.6)).otherwise(local)
    return F.when((F.size(cities) == 0) & (F.size(modes) == 0), NEUTRAL).otherwise(value)


def salary_part(top: Column, disclosed: Column, currency: Column, expected: Column) -> Column:
    """R5."""
    known = disclosed & top.isNotNull() & (F.coalesce(currency, F.lit("INR")) == "INR") & (F.coalesce(expected, F.lit(0)) > 0)
    return F.when(F.coalesce(known, F.lit(False)), clamp(top / expected)).otherwise(NEUTRAL)


def semantic_part(cosine: Column) -> Column:
    """Null while there is no vector."""
    return clamp((cosine - 0.55) / 0.3)


def combined(parts: dict[str, Column], dismissed: Column) -> Column:
    """Weighted points of the parts that are known, their weights
    stretched to 100; a dismissed company costs points; 0 to 100."""
    weight = sum((F.when(v.isNotNull(), WEIGHTS[k]).otherwise(0) for k, v in parts.items()), F.lit(0))
    points = sum((F.coalesce(v * WEIGHTS[k], F.lit(0.0)) for k, v in parts.items()), F.lit(0.0)) * 100 / weight
    return F.greatest(F.lit(0), F.least(F.lit(100), round_half_up(points - F.when(dismissed, DISMISSED_PENALTY).otherwise(0)))).cast("long")


def _said(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def skills_reason(names: Column, levels: Column) -> Column:
    """What of the named skills is held (arrays, a null or 0 level: not)."""
    both = F.arrays_zip(names.alias("n"), levels.alias("l"))
    has = lambda x: F.coalesce(x["l"], F.lit(0)) > 0
    held, missing = (F.transform(F.filter(both, f), lambda x: x["n"]) for f in (has, lambda x: ~has(x)))
    listed = F.when(F.size(held) > 0, _said(" (", F.array_join(F.slice(held, 1, 4), ", "), ")")).otherwise("")
    lacks = F.when(F.size(missing) > 0, _said("; missing ", F.array_join(F.slice(missing, 1, 3), ", "))).otherwise("")
    return F.when(F.size(names) == 0, "The posting names no skills we know.").otherwise(_said("You have ", F.size(held).cast("string"), " of ", F.size(names).cast("string"), " skills it names", listed, lacks, "."))


def title_reason(value: Column, best: Column) -> Column:
    """R2: how close the title is to the best target role (null: none is set)."""
    return F.when(best.isNull(), "No target roles selected.").when(value >= 0.8, _said("Title matches “", best, "”.")).when(value >= 0.5, _said("Title is close to “", best, "”.")).otherwise("Title differs from your target roles.")


def experience_reason(years: Column, low: Column, high: Column) -> Column:
    """R3."""
    asks = F.when(low.isNotNull() & high.isNotNull(), _said(_plain(low), "–", _plain(high))).when(low.isNotNull(), _said(_plain(low), "+")).otherwise(_said("up to ", _plain(high)))
    return F.when(low.isNull() & high.isNull(), "Experience isn't stated.").when(years.isNull(), "Your years of experience aren't known yet.").otherwise(_said("Asks ", asks, " years; you have ", _plain(years), "."))


def location_reason(city: Column, mode: Column, cities: Column, modes: Column, relocates: Column) -> Column:
    """R4."""
    wants_remote = _has(modes, F.lit("remote")) | _has(cities, F.lit("Remote-India"))
    fits = mode.isNull() | (F.size(modes) == 0) | _has(modes, mode)
    return (
        F.when((F.size(cities) == 0) & (F.size(modes) == 0), "No location preferences set.").when(remote(mode, city) & wants_remote, "Remote, as you prefer.").when(remote(mode, city), "Remote role (not in your work modes).")
        .when(city.isNull(), "Location isn't stated.").when(_has(cities, city) & fits, _said("In ", city, ", one of your locations.")).when(_has(cities, city), _said("In ", city, ", but ", mode, " (not one of your work modes)."))
        .when(relocates, _said("In ", city, "; you're open to relocating.")).otherwise(_said("In ", city, ", outside your locations."))
    )


def salary_reason(top: Column, disclosed: Column, currency: Column, expected: Column) -> Column:
    """R5."""
    pays = _said("Pays up to ", lpa(top))
    return (
        F.when(~disclosed | top.isNull(), "Salary not disclosed.").when(F.coalesce(currency, F.lit("INR")) != "INR", _said("Salary in ", currency, "."))
        .when(F.coalesce(expected, F.lit(0)) <= 0, _said(pays, "; set your expected salary to compare.")).otherwise(_said(pays, "; you expect ", lpa(expected), "+."))
    )


def semantic_reason(value: Column) -> Column:
    """By the part's value."""
    return F.when(value.isNull(), "Not compared with your profile yet.").when(value >= 0.7, "Description is very close to your profile.").when(value >= 0.4, "Description is fairly close to your profile.").otherwise("Description is not close to your profile.")


def explained(parts: dict[str, tuple[Column, Column, Column]]) -> Column:
    """Array of (key, weight, value, points, neutral, reason) of parts
    given as (value, neutral, reason): weights are stretched to 100 over the
    parts that are known; weights and points have one decimal."""
    whole = sum((F.when(v.isNotNull(), WEIGHTS[k]).otherwise(0) for k, (v, _, _) in parts.items()), F.lit(0))
    tenths = lambda x: round_half_up(x * 10) / 10

    def one(key: str, value: Column, neutral: Column, reason: Column) -> Column:
        weight = F.when(value.isNotNull(), WEIGHTS[key] * 100 / whole).otherwise(0.0)
        return F.struct(F.lit(key).alias("key"), tenths(weight).alias("weight"), value.alias("value"), tenths(weight * F.coalesce(value, F.lit(0.0))).alias("points"), neutral.alias("neutral"), reason.alias("reason"))

    return F.array(*(one(k, *p) for k, p in parts.items()))


def learned_margins(dismissals: DataFrame) -> DataFrame:
    """Per user, how far a posting's years may lie above or below, by the
    number of dismissals for that reason."""
    senior, junior = F.count_if(F.col("reason") == "too_senior"), F.count_if(F.col("reason") == "too_junior")
    return dismissals.groupBy("user_id").agg(F.when(senior >= 4, 1).when(senior >= 2, 2).otherwise(4).alias("above"), F.when(junior >= 2, 3).otherwise(5).alias("below"))


def _plain(n: Column) -> Column:
    return F.regexp_replace(F.format_string("%.1f", n), r"\.0$", "")


def not_fit_reasons(job: dict[str, Column], profile: dict[str, Column]) -> Column:
    """why a posting is hidden, as an array of sentences."""
    y, low, high, level = profile["years"], job["min_years"], job["max_years"], job["seniority"]
    too_high = F.when(low >= y + profile["above"], F.concat(F.lit("Asks "), _plain(low), F.lit("+ years; you have "), _plain(y), F.lit("."))).when((level == "lead") & (y < 5), "Lead-level role.")
    too_low = F.when(high <= y - profile["below"], F.concat(F.lit("For up to "), _plain(high), F.lit(" years of experience."))).when(((level == "intern") & (y >= 1)) | ((level == "junior") & (y >= 4)), "Junior or intern role.")
    city = job["city"]
    away = (F.size(profile["cities"]) > 0) & city.isNotNull() & ~remote(job["work_mode"], city) & ~_has(profile["cities"], city) & ~profile["relocates"]
    c = job["conditions"]
    office = (profile["office_days"].isNotNull()) & (c["office_days"] > profile["office_days"])
    late = profile["notice_days"] > c["notice_max_days"] + 15
    return F.array_compact(
        F.array(
            too_high, too_low, F.when(away, F.concat(F.lit("In "), city, F.lit(", outside your locations."))), F.when(profile["no_bond"] & c["bond"], "Service bond."),
            F.when(profile["no_night"] & (c["shift"] == "night"), "Night or rotational shifts."), F.when(profile["no_to_hire"] & c["contract_to_hire"], "Contract-to-hire."),
            F.when(office, F.concat(F.lit("Office "), c["office_days"].cast("string"), F.lit(" days a week (you accept "), profile["office_days"].cast("string"), F.lit(")."))),
            F.when(late, F.concat(F.lit("Wants joiners within "), c["notice_max_days"].cast("string"), F.lit(" days; your notice is "), profile["notice_days"].cast("string"), F.lit("."))),
        )
    )


def level_match(level: Column) -> Column:
    return F.when(level >= 3, 1.0).when(level == 2, 0.5).otherwise(0.0)


def skill_match(direct: Column, direct_years: Column, implied: Column, implied_years: Column, related: Column, asked_years: Column) -> Column:
    """Q1: match of one skill requirement: own or implied level, one step less
    for too few years; a related skill of level 3 gives half."""
    from_implied = F.coalesce(implied, F.lit(0)) > F.coalesce(direct, F.lit(0))
    level = F.greatest(F.coalesce(direct, F.lit(0)), F.coalesce(implied, F.lit(0)))
    years = F.when(from_implied, implied_years).otherwise(direct_years)
    match = level_match(level)
    short = F.coalesce((match > 0) & (years < asked_years), F.lit(False))
    match = F.when(short, F.when(match == 1, 0.5).otherwise(0.0)).otherwise(match)
    return F.when((match < 0.5) & (F.coalesce(related, F.lit(0)) >= 3), 0.5).otherwise(match)


def status(match: Column) -> Column:
    return F.when(match == 1, "strong").when(match == 0.5, "partial").otherwise("missing")


def other_status(kind: Column, asked: Column, years: Column) -> Column:
    """Q2: a requirement that is not a skill."""
    gap = asked - years
    return F.when((kind == "experience") & gap.isNotNull(), F.when(gap <= 0, "strong").when(gap <= 1, "partial").otherwise("missing")).otherwise("unscored")


def skills_component(requirements: DataFrame, most: int = FIT_WEIGHTS["skills"]) -> DataFrame:
    """Per job (job_id, match, importance of its skill
    requirements) points, counts by status, and missing required ones."""
    s, w = status(F.col("match")), importance_weight(F.col("importance"))
    return requirements.groupBy("job_id").agg(
        (F.sum(w * F.col("match")) / F.sum(w) * most).alias("points"), F.count_if(s == "strong").alias("strong"), F.count_if(s == "partial").alias("partial"), F.count_if(s == "missing").alias("missing"),
        F.count_if((s == "missing") & (F.col("importance") == "required")).alias("missing_required"),
    )


def experience_points(years: Column, low: Column, high: Column) -> Column:
    """Q4."""
    gap = low - years
    return F.when(years.isNull() | (low.isNull() & high.isNull()), 14).when(gap > 0, F.when(gap <= 1, 12).when(gap <= 2, 6).otherwise(0)).when(years > high + 3, 14).otherwise(20)


def role_points(family: Column, title: Column, targets: Column, titles: Column, adjacent: Column) -> Column:
    """Q5, J17."""
    close = F.exists(titles, lambda t: similarity(title, t) >= 0.85)
    return F.when(_has(targets, family) | close, 15).when(_has(adjacent, family) | ((F.size(targets) == 0) & (F.size(titles) == 0)), 8).otherwise(0)


def location_points(city: Column, mode: Column, cities: Column, modes: Column, relocates: Column) -> Column:
    """Q6: city and work mode together."""
    far = remote(mode, city)
    takes_remote = (F.size(modes) == 0) | _has(modes, F.lit("remote"))
    place = F.when(far, F.when(takes_remote, "match").otherwise("mismatch")).when(city.isNull() | (F.size(cities) == 0), "unknown").when(_has(cities, city), "match").when(relocates, "relocate").otherwise("mismatch")
    way = F.when(mode.isNull() | (F.size(modes) == 0), "unknown").when(_has(modes, mode), "match").otherwise("mismatch")
    return F.when(place == "mismatch", 0).when(place == "unknown", 6).when((place == "match") & (way != "mismatch"), 10).otherwise(5)


def salary_points(low: Column, high: Column, disclosed: Column, expected: Column) -> Column:
    """Q7."""
    top = F.coalesce(high, low)
    return F.when(~disclosed | top.isNull() | expected.isNull(), 6).when(top >= expected, 10).when(top >= expected * 0.85, 5).otherwise(0)


def condition_checks(c: Column, profile: dict[str, Column]) -> Column:
    """Q8: array of (key, status) for what a posting states."""
    one = lambda key, state: F.struct(F.lit(key).alias("key"), state.alias("status"))
    notice = F.when(profile["notice_days"].isNull(), "warning").when(profile["notice_days"] > c["notice_max_days"], "blocker").otherwise("ok")
    hard = lambda flag: F.when(flag, "blocker").otherwise("warning")
    return F.array_compact(
        F.array(
            F.when(c["notice_max_days"].isNotNull(), one("notice", notice)), F.when(c["bond"], one("bond", hard(profile["no_bond"]))), F.when(c["shift"] == "night", one("shift", hard(profile["no_night"]))),
            F.when(c["contract_to_hire"], one("contract", hard(profile["no_to_hire"]))), F.when(c["office_days"].isNotNull(), one("wfo", F.when(c["office_days"] > profile["office_days"], "blocker").otherwise("ok"))),
        )
    )


def recommendation(total: Column, blockers: Column) -> Column:
    """Q9: a blocker costs one level."""
    return F.when((total >= APPLY) & (blockers == 0), "APPLY").when(((total >= CONSIDER) & (blockers == 0)) | ((total >= APPLY) & (blockers == 1)), "CONSIDER").otherwise("LOW_PRIORITY")


def gains(requirements: DataFrame, most: int = FIT_WEIGHTS["skills"]) -> DataFrame:
    """Q11: points that each skill not yet strong would add at level 3, one or
    more (job_id, skill_id, match, importance). The job's sums are made once
    and each skill's own share is exchanged in them."""
    w = importance_weight(F.col("importance"))
    own = requirements.groupBy("job_id", "skill_id").agg(F.sum(w * (1 - F.col("match"))).alias("_more"), F.min("match").alias("_least"))
    whole = requirements.groupBy("job_id").agg(F.sum(w).alias("_all"))
    points = round_half_up(F.col("_more") / F.col("_all") * most).cast("long")
    return own.where("_least < 1 and skill_id is not null").join(whole, "job_id").select("job_id", "skill_id", points.alias("points")).where("points >= 1")


def check_config(weights: dict[str, int], apply: int, consider: int) -> list[str]:
    """Q12: what is wrong with weights and thresholds."""
    wrong = []
    if set(weights) != set(FIT_WEIGHTS) or any(w < 0 for w in weights.values()) or sum(weights.values()) != 100:
        wrong.append("weights must cover every part and sum to 100")
    if not 0 <= consider < apply <= 100:
        wrong.append("consider must lie under apply, both in 0 to 100")
    return wrong


def proficiency(years: Column, roles: Column, months_ago: Column) -> Column:
    """Q13: level 1 to 5 by years of use, breadth and how long ago."""
    base = F.when(years >= 5, 4).when(years >= 3, 3).when(years >= 1, 2).otherwise(1)
    return F.greatest(F.lit(1), F.least(F.lit(5), base + F.when(roles >= 3, 1).otherwise(0) - F.when(months_ago > 36, 1).otherwise(0)))


def role_category(coverage: Column) -> Column:
    """Q14."""
    return F.when(coverage >= 0.7, "core").when(coverage >= 0.4, "adjacent").otherwise("stretch")


def report_confidence(flags: Column) -> Column:
    """Q15: by the number of parts with unknown inputs."""
    return F.when(flags == 0, "high").when(flags <= 2, "medium").otherwise("low")


def cache_key(*inputs: Column) -> Column:
    """Q18: 32 hex digits of the inputs."""
    return F.substring(F.sha2(F.to_json(F.struct(*inputs)), 256), 1, 32)


def config_faults(weights: Column, apply: Column, consider: Column) -> Column:
    """Q12: names of what is wrong with weights (a map) and thresholds."""
    parts = F.array(*(F.lit(p) for p in sorted(FIT_WEIGHTS)))
    total = F.aggregate(F.map_values(weights), F.lit(0), lambda s, x: s + x)
    fine = F.array_sort(F.map_keys(weights)).eqNullSafe(parts) & (total == 100) & ~F.exists(F.map_values(weights), lambda x: x < 0)
    return F.array_compact(F.array(F.when(~F.coalesce(fine, F.lit(False)), "weights"), F.when(~F.coalesce((consider >= 0) & (consider < apply) & (apply <= 100), F.lit(False)), "thresholds")))


def with_semantic(matches: DataFrame, accepted: DataFrame, keys: list[str]) -> DataFrame:
    """Q10: matches of requirements (keys, match); a missing one that was
    accepted under another name counts half."""
    flag = accepted.select(*keys).distinct().withColumn("_accepted", F.lit(True))
    out = matches.join(flag, keys, "left")
    return out.withColumn("match", F.when((F.col("match") == 0) & F.col("_accepted").isNotNull(), 0.5).otherwise(F.col("match"))).drop("_accepted")


def ranking_context(profiles: DataFrame, skills: DataFrame, implied: DataFrame, dismissals: DataFrame) -> DataFrame:
    """A row per profile (user_id, ...) with what ranking needs besides: its
    margins (R8) and held skills, where a skill that implies another (from_id,
    to_id) gives it its level."""
    through = skills.join(implied, skills["skill_id"] == implied["from_id"]).select("user_id", F.col("to_id").alias("skill_id"), "level")
    best = skills.select("user_id", "skill_id", "level").unionByName(through).groupBy("user_id", "skill_id").agg(F.max("level").alias("level"))
    held = best.groupBy("user_id").agg(F.collect_list(F.struct("skill_id", "level")).alias("skills"))
    out = profiles.join(learned_margins(dismissals), "user_id", "left").join(held, "user_id", "left")
    none = F.array().cast(held.schema["skills"].dataType)
    return out.withColumns({"above": F.coalesce("above", F.lit(4)), "below": F.coalesce("below", F.lit(5)), "skills": F.coalesce("skills", none)})
