"""Rules of text, parsing and places on small tables of cases."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindrift.functions import parse, places, text
from spindrift.operators import feed, scoring, sets


def values(spark, cases, kind, use):
    frame = spark.createDataFrame(list(enumerate(cases)), f"i int, x {kind}")
    return [r.y for r in frame.select("i", use(F.col("x")).alias("y")).orderBy("i").collect()]


def test_salaries(spark):
    cases = {
        "8-12 LPA": (800_000, 1_200_000, "INR"), "₹10,00,000 - ₹16,00,000 a year": (1_000_000, 1_600_000, "INR"), "₹1,20,000 - ₹1,60,000 a month": (1_440_000, 1_920_000, "INR"), "₹18L – ₹24L a year": (1_800_000, 2_400_000, "INR"),
        "$90,000": (90_000, 90_000, "USD"), "12-15": (1_200_000, 1_500_000, "INR"), "€40k to €50k": (40_000, 50_000, "EUR"), "$45 per hour": (93_600, 93_600, "USD"), "1.5 Cr": (15_000_000, 15_000_000, "INR"), "Not disclosed": None, "Competitive": None, "": None, None: None, "soon": None,
    }
    got = values(spark, list(cases), "string", parse.salary)
    assert [(s.min_annual, s.max_annual, s.currency) if s.disclosed else None for s in got] == list(cases.values())


def test_experience_and_seniority(spark):
    cases = {"2-4 years": (2, 4), "3+ yrs": (3, None), "minimum 5 years": (5, None), "at least of 2 years": (2, None), "Experience: 6 years": (6, 6), "1.5 to 3 years": (1.5, 3), "none": (None, None), None: (None, None)}
    assert [tuple(e) for e in values(spark, list(cases), "string", parse.experience)] == list(cases.values())
    titles = {"Software Intern": "intern", "Principal Engineer": "lead", "Engineering Manager": "lead", "Sr. Dev": "senior", "SDE III": "senior", "SDE I": "junior", "Graduate Trainee": "intern", "Dev": "senior"}
    assert values(spark, list(titles), "string", lambda t: parse.seniority(t, F.lit(5.0))) == list(titles.values())


def test_conditions(spark):
    got = values(spark, ["Notice period max 2 months, service bond", "Immediate joiners, night shifts", "3 days a week in the office", "WFO, C2H", ""], "string", parse.conditions)
    assert [(c.notice_max_days, c.immediate, c.bond, c.shift, c.contract_to_hire, c.office_days) for c in got] == [(60, False, True, None, False, None), (15, True, False, "night", False, None), (None, False, False, None, False, 3), (None, False, False, None, True, 5), (None, False, False, None, False, None)]


def test_partial_dates(spark):
    cases = {"Apr 2023": "2023-04", "September '21": "2021-09", "04/2023": "2023-04", "2023-4": "2023-04", "14 March 1997": "1997-03", "March 14, 1997": "1997-03", "2019": "2019", "Foo 2020": None, "13/2020": None, "1890": None, None: None}
    assert values(spark, list(cases), "string", parse.year_month) == list(cases.values())
    assert values(spark, ["2021-07", "2021"], "string", parse.month_index) == [2021 * 12 + 6, 2021 * 12 + 5]
    assert values(spark, ["Present.", "till  date", "2020"], "string", parse.is_present) == [True, True, False]


def test_names_and_places(spark):
    assert values(spark, ["Kestrel Pay Pvt. Ltd.", "Quill, Inc.", "Ltd.", "A Private Limited LLP"], "string", places.display_company) == ["Kestrel Pay", "Quill", "Ltd.", "A"]
    assert values(spark, ["Banyan Analytics Technologies Pvt Ltd", "Tech", "Núm 1 Labs India"], "string", places.company_key) == ["banyan analytics", "tech", "n m 1"]
    assert values(spark, ["Bangalore, Karnataka", "Remote, India", "new delhi", "st. john-town (x)", " ", None, "Pimpri Chinchwad"], "string", places.canonical_city) == ["Bengaluru", "Remote-India", "Delhi", "St. John-Town", None, None, "Pune"]
    assert values(spark, ["Office: Gurgaon; US", "India", "Paris | Chennai"], "string", places.indian_city) == ["Gurugram", None, "Chennai"]
    titles = {"React.js Developer": "react developer", "ReactJS Developer": "react developer", "SDE II": "sde 2", "Sr. QA": "senior qa"}
    assert values(spark, list(titles), "string", places.title_key) == list(titles.values())
    fits = lambda t: places.title_matches(t, F.array(F.lit("Front end Developer"), F.lit("Senior")))
    assert values(spark, ["Frontend Engineer II", "Back-end Engineer", "Front-End / React"], "string", fits) == [True, False, True]
    there = lambda x: places.location_matches(x, F.lit(None).cast("string"), F.array(F.lit("Pune")), F.lit(True))
    assert values(spark, ["Pune, India", "Remote", "Remote - US", "Remote, APAC, US", "Delhi"], "string", there) == [True, True, False, True, False]


def test_text_rules(spark):
    assert values(spark, ["by 38%", "Used Angular 12", "Mentored 2", "in 2019", "from 3.9s to 1.6s", "plain"], "string", text.has_metric) == [True, False, True, False, True, False]
    assert values(spark, ["Reduced load", "Ran it"], "string", text.bullet_kind) == ["achievement", "responsibility"]
    assert values(spark, ["a, b; and c.", "C, C++"], "string", text.split_list) == [["a", "b", "c"], ["C", "C++"]]
    assert values(spark, ["• x", "– y", "z"], "string", text.strip_bullet) == ["x", "y", "z"]
    assert values(spark, ["ﬁne – “x”  Y", "soft­hyphen", "well-\nknown"], "string", text.normalize_for_match) == ['fine - "x" y', "softhyphen", "well-known"]
    assert values(spark, [1234567, 999, -100000, 12345], "long", text.indian_grouping) == ["12,34,567", "999", "-1,00,000", "12,345"]
    assert values(spark, ["C#", "React.js", "Node JS", "C++"], "string", text.skill_key) == ["c#", "reactjs", "nodejs", "c++"]
    keys = values(spark, ["React Testing Library, Next.js"], "string", text.skill_keys_in)[0]
    assert {"react", "reacttestinglibrary", "nextjs", "next"} <= set(keys)
    assert values(spark, ["-2.5", "2.5", "-0.4"], "string", lambda x: text.round_half_up(x.cast("double"))) == [-2, 3, 0]
    assert values(spark, ["<p>a &amp; b</p><script>x</script><li>c"], "string", text.html_to_text) == ["a & b\nc"]
    near = lambda x: text.best_match(x, F.lit("data tools for"))
    got = values(spark, ["builds data tools for us", "builds date tools for us", "nothing here"], "string", near)
    assert got[0] == 1 and 0.9 < got[1] < 1 and got[2] == 0


def test_links_merge_once(spark):
    frame = spark.createDataFrame([(["https://A.x/1?a", "https://b.x/"], ["https://a.x/1/", "https://c.x"])], "a array<string>, b array<string>")
    assert frame.select(sets.merge_links(F.col("a"), F.col("b")).alias("l")).first().l == ["https://A.x/1?a", "https://b.x/", "https://c.x"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=st.text(alphabet="abcé", max_size=8), b=st.text(alphabet="abcé", max_size=8))
def test_similarity_is_a_share(spark, a, b):
    x, y = spark.createDataFrame([(a, b)], "a string, b string").select(text.similarity(F.col("a"), F.col("b")), text.similarity(F.col("b"), F.col("a"))).first()
    assert x == y and 0 <= x <= 1 and (x == 1) == (a == b)


def test_query_strings_and_config():
    assert feed.parse_query("group=saved&mode=remote&posted=7&salary=12&page=2&city=Pune&bad=1") == {"group": "saved", "page": 2, "mode": "remote", "city": "Pune", "days": 7, "least_pay": 1_200_000}
    assert feed.parse_query("group=x&mode=y&posted=-1") == {"group": "for_you", "page": 1} and not feed.any_filter({"group": "x", "page": 1})
    assert scoring.check_config(scoring.FIT_WEIGHTS, 72, 55) == [] and len(scoring.check_config({"skills": 1}, 50, 60)) == 2


def test_not_fit_reasons(spark):
    job = {"min_years": F.lit(9.0), "max_years": F.lit(None).cast("double"), "seniority": F.lit("lead"), "city": F.lit("Pune"), "work_mode": F.lit("onsite"), "conditions": parse.conditions(F.lit("service bond, night shift, wfo, notice period 30 days"))}
    profile = {"years": F.lit(3.0), "above": F.lit(4), "below": F.lit(5), "cities": F.array(F.lit("Delhi")), "relocates": F.lit(False), "no_bond": F.lit(True), "no_night": F.lit(False), "no_to_hire": F.lit(False), "office_days": F.lit(2), "notice_days": F.lit(60)}
    got = spark.range(1).select(scoring.not_fit_reasons(job, profile).alias("r")).first().r
    assert got == ["Asks 9+ years; you have 3.", "In Pune, outside your locations.", "Service bond.", "Office 5 days a week (you accept 2).", "Wants joiners within 30 days; your notice is 60."]


@pytest.mark.parametrize("path,allowed", [("/x", True), ("/private/a", False), ("/private/open", True), ("/a.pdf", False), ("/a.pdfx", True)])
def test_robots(spark, path, allowed):
    from spindrift.sources import pages

    rules = pages.robots_rules(F.lit("User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /private\nAllow: /private/open\nDisallow: /*.pdf$\n"))
    assert spark.range(1).select(pages.robots_allows(rules, F.lit(path)).alias("a")).first().a is allowed


def test_pay_notice_and_places_of_a_profile(spark):
    pay = {"8.5 LPA": 850_000, "12 Lakhs": 1_200_000, "₹8,50,000": 850_000, "8-12 LPA": 800_000, "70k per month": 840_000, "negotiable": None, "": None, None: None, "1.2 Cr": 12_000_000}
    notice = {"60 days": 60, "2 months": 60, "Immediate joiner": 0, "soon": None, "1.5 weeks": 11, "45": 45, "nil": 0, "": None, None: None}
    got = spark.createDataFrame([(i, t) for i, t in enumerate(pay)], "i int, t string").select("i", parse.ctc_annual_inr(F.col("t")).alias("v")).orderBy("i").collect()
    assert [r.v for r in got] == list(pay.values())
    got = spark.createDataFrame([(i, t) for i, t in enumerate(notice)], "i int, t string").select("i", parse.notice_days(F.col("t")).alias("v")).orderBy("i").collect()
    assert [r.v for r in got] == list(notice.values())
    frame = spark.createDataFrame([(["Gurugram", "Noida", "Remote"],), ([" wfh ", "REMOTE", "", " "],), (None,)], "p array<string>")
    assert [r.v and (r.v.locations, r.v.modes) for r in frame.select(parse.preferred_places(F.col("p")).alias("v")).collect()] in ([(["Gurugram", "Noida"], ["remote"]), ([], ["remote"]), (None, None)], [(["Gurugram", "Noida"], ["remote"]), ([], ["remote"]), None])
