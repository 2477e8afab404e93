"""Numbers, dates and conditions read out of text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions.text import let, round_half_up

# Patterns that pay, experience and conditions are read by.
UNDISCLOSED = r"not\s+disclosed|negotiable|competitive|as\s+per\s+(company|industry)|best\s+in\s+industry"
CURRENCIES = (("USD", r"\$|usd"), ("EUR", "€|eur"), ("GBP", "£|gbp"), ("INR", r"₹|inr|rs\.?|lpa|lakh|lac|crore"))
AMOUNT = r"(\d[\d,]*(?:\.\d+)?)\s*(lpa|l|lakhs?|lacs?|cr|crores?|k)?"
RANGE = AMOUNT + r"\s*(?:-|–|—|to)\s*[₹$€£]?\s*" + AMOUNT
MONTHLY = r"(per|a|/)\s*month|monthly|p\.?m\.?\b|/mo\b"
HOURLY = r"(per|an?|/)\s*hour|hourly"
YEARS_RANGE = r"(\d{1,2}(?:\.\d)?)\s*(?:-|–|to)\s*(\d{1,2}(?:\.\d)?)\s*\+?\s*(?:years?|yrs?)"
YEARS_PLUS = r"(\d{1,2}(?:\.\d)?)\s*\+\s*(?:years?|yrs?)"
YEARS_LEAST = r"(?:minimum|min\.?|at\s+least)\s*(?:of\s*)?(\d{1,2})\s*(?:years?|yrs?)"
YEARS_EXACT = r"experience\s*[:\-]?\s*(\d{1,2})\s*(?:years?|yrs?)\b"
NOTICE = r"notice\s+period\s*(?:of\s*|up\s*to\s*|:|-|less\s+than\s*|max(?:imum)?\s*)*(\d{1,3})\s*(days?|weeks?|months?)"
OFFICE_DAYS = r"(\d)\s*days?\s*(?:a|per)?\s*(?:week\s*)?(?:work(?:ing)?\s+from|in\s+the|at\s+the|in)\s+(?:the\s+)?office"
IMMEDIATE = r"\bimmediate\s+(joiners?|joining|start)\b|\bjoin\s+immediately\b"
BOND = r"\b(service\s+)?bond\b|\bservice\s+agreement\b"
NIGHT = r"\bnight\s+shifts?\b|\brotational\s+shifts?\b|\b(us|uk)\s+shifts?\b|\bgraveyard\b"
TO_HIRE = r"\bcontract[\s-]+to[\s-]+hire\b|\bc2h\b"
FROM_OFFICE = r"\bwork\s+from\s+office\b|\bwfo\b"
SENIORITY = (
    ("intern", r"\bintern(ship)?\b|\btrainee\b"),
    ("lead", r"\b(principal|staff|head|director|vp|architect)\b"),
    ("lead", r"\b(lead|manager)\b"),
    ("senior", r"\b(senior|sr\.?)\b|\bsde\s*(3|iii)\b"),
    ("junior", r"\b(junior|jr\.?|fresher|graduate|entry)\b|\bsde\s*(1|i)\b"),
)
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
PRESENT = r"(?i)^(present|current|currently|now|till date|till now|to date|date|ongoing|today|working)$"
#: Hours and months of a year that pay is multiplied by.
HOURS, MONTHS_A_YEAR = 2080, 12


def group(text: Column, pattern: str, index: int) -> Column:
    """A group of the first match, null where nothing matches."""
    return F.nullif(F.regexp_extract(text, pattern, index), F.lit(""))


def _choose(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    out = otherwise
    for condition, value in reversed(cases):
        out = F.when(condition, value).otherwise(out)
    return out


def salary(text: Column, default_currency: str = "INR") -> Column:
    """Struct of min_annual, max_annual (long), currency, disclosed."""
    return let(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), lambda s: _salary(s, default_currency))


def _salary(s: Column, default_currency: str) -> Column:
    currency = _choose([(s.rlike(p), F.lit(c)) for c, p in CURRENCIES], F.lit(default_currency))
    period = F.when(s.rlike(MONTHLY), MONTHS_A_YEAR).when(s.rlike(HOURLY), HOURS).otherwise(1)
    # the matched text is short, so groups are read out of it and not out of all
    found = F.struct(F.nullif(F.regexp_extract(s, RANGE, 0), F.lit("")).alias("both"), F.regexp_extract(s, AMOUNT, 0).alias("one"), currency.alias("currency"), period.alias("period"), ((s != "") & ~s.rlike(UNDISCLOSED)).alias("said"))
    return let(found, lambda f: let(_amounts(f), lambda m: _annual(f, m)))


def _amounts(f: Column) -> Column:
    """The two amounts of a match before its period."""
    number = lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double")
    scale = lambda u: F.when(u.rlike("^(l|lpa|lakhs?|lacs?)$"), 100_000).when(u.rlike("^(cr|crores?)$"), 10_000_000).when(u == "k", 1_000).otherwise(1)
    low, low_unit, high, high_unit = (group(f["both"], RANGE, i) for i in (1, 2, 3, 4))
    one = number(group(f["one"], AMOUNT, 1)) * scale(group(f["one"], AMOUNT, 2))
    ranged = f["both"].isNotNull()
    return F.struct(
        F.when(ranged, number(low) * scale(F.coalesce(low_unit, high_unit))).otherwise(one).alias("a"),
        F.when(ranged, number(high) * scale(F.coalesce(high_unit, low_unit))).otherwise(one).alias("b"),
    )


def _annual(f: Column, m: Column) -> Column:
    lakhs = F.when((f["currency"] == "INR") & (m["b"] * f["period"] < 1000), 100_000).otherwise(1)
    known = F.coalesce(f["said"] & (m["b"] > 0), F.lit(False))
    value = lambda x: F.when(known, round_half_up(x * f["period"] * lakhs)).cast("long")
    return F.struct(value(F.least(m["a"], m["b"])).alias("min_annual"), value(F.greatest(m["a"], m["b"])).alias("max_annual"), F.when(known, f["currency"]).alias("currency"), known.alias("disclosed"))


def experience(text: Column) -> Column:
    """D3: struct of min_years and max_years; the first kind of phrase that occurs counts."""
    return let(F.lower(text), _experience)


def _experience(t: Column) -> Column:
    found = [group(t, p, 1).cast("double") for p in (YEARS_RANGE, YEARS_PLUS, YEARS_LEAST, YEARS_EXACT)]
    high = F.when(found[0].isNotNull(), group(t, YEARS_RANGE, 2).cast("double")).when(found[1].isNull() & found[2].isNull(), found[3])
    return F.struct(F.coalesce(*found).alias("min_years"), high.alias("max_years"))


def seniority(title: Column, min_years: Column) -> Column:
    """By title, else by the years asked for."""
    return let(F.lower(title), lambda t: _seniority(t, min_years))


def _seniority(t: Column, min_years: Column) -> Column:
    by_years = F.when(min_years >= 8, "lead").when(min_years >= 5, "senior").when(min_years >= 2, "mid").when(min_years.isNotNull(), "junior")
    return _choose([(t.rlike(p), F.lit(level)) for level, p in SENIORITY], by_years)


def conditions(text: Column) -> Column:
    """Struct of what a posting asks of its applicants."""
    return let(F.lower(text), _conditions)


def _conditions(t: Column) -> Column:
    immediate = t.rlike(IMMEDIATE)
    unit = group(t, NOTICE, 2)
    days = group(t, NOTICE, 1).cast("int") * F.when(unit.startswith("week"), 7).when(unit.startswith("month"), 30).otherwise(1)
    office = F.coalesce(group(t, OFFICE_DAYS, 1).cast("int"), F.when(t.rlike(FROM_OFFICE), 5))
    return F.struct(
        F.coalesce(days, F.when(immediate, 15)).alias("notice_max_days"), immediate.alias("immediate"), t.rlike(BOND).alias("bond"),
        F.when(t.rlike(NIGHT), "night").alias("shift"), t.rlike(TO_HIRE).alias("contract_to_hire"), office.alias("office_days"),
    )


def year_month(text: Column) -> Column:
    """D7: "Apr 2023", "04/2023", "2023-04", "14 March 1997", "2023" as
    YYYY-MM or YYYY; null for anything else."""
    return let(F.regexp_replace(F.regexp_replace(F.trim(text), "[.,;]+$", ""), r"\s+", " "), _year_month)


def _year_month(s: Column) -> Column:
    named, numeric, iso, year = r"^([A-Za-z]{3,9})\.?,?\s*'?(\d{4}|\d{2})$", r"^(\d{1,2})\s*[/.-]\s*(\d{4})$", r"^(\d{4})\s*[/.-]\s*(\d{1,2})$", r"^(\d{4})$"
    day_first, month_first = r"^\d{1,2}(?:st|nd|rd|th)?\s+([A-Za-z]{3,9}),?\s+(\d{4})$", r"^([A-Za-z]{3,9})\s+\d{1,2},?\s+(\d{4})$"
    names = F.array(*(F.lit(m) for m in MONTHS))
    full = ("january february march april may june july august september october november december sept").split()

    def month_of(name: Column) -> Column:
        known = F.lower(name).isin(*MONTHS, *full)
        return F.when(known, F.array_position(names, F.lower(F.substring(name, 1, 3))).cast("int"))

    def made(y: Column, m: Column) -> Column:
        y = F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y).cast("int")
        return F.when(y.between(1950, 2100) & m.between(1, 12), F.format_string("%04d-%02d", y, m))

    return F.coalesce(
        made(group(s, named, 2), month_of(group(s, named, 1))), made(group(s, numeric, 2), group(s, numeric, 1).cast("int")), made(group(s, iso, 1), group(s, iso, 2).cast("int")),
        made(group(s, day_first, 2), month_of(group(s, day_first, 1))), made(group(s, month_first, 2), month_of(group(s, month_first, 1))), F.when(group(s, year, 1).cast("int").between(1950, 2100), group(s, year, 1)),
    )


def is_present(text: Column) -> Column:
    """A word that means "until now"."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"[.\s]+$", ""), r"\s+", " ").rlike(PRESENT)


def month_index(value: Column) -> Column:
    """Months since year 0; a bare year counts as its June."""
    month = F.nullif(F.substring(value, 6, 2), F.lit("")).cast("int")
    return F.substring(value, 1, 4).cast("int") * 12 + F.coalesce(month, F.lit(6)) - 1


def months_between(start: Column, end: Column) -> Column:
    """Inclusive months, never negative."""
    return F.greatest(F.lit(0), month_index(end) - month_index(start) + 1)


def relative_date(text: Column, now: Column) -> Column:
    """D10: "3 days ago" as a time; a month is 30 days."""
    pattern = r"(\d+)\+?\s*(minute|hour|day|week|month)s?\s+ago"
    t = F.lower(text)
    seconds = F.create_map(*(F.lit(x) for pair in (("minute", 60), ("hour", 3600), ("day", 86_400), ("week", 604_800), ("month", 2_592_000)) for x in pair))
    amount = group(t, pattern, 1).cast("long") * F.try_element_at(seconds, group(t, pattern, 2))
    return F.when(amount.isNotNull(), F.timestamp_seconds(F.unix_timestamp(now) - amount)).when(t.rlike(r"\b(today|just\s+posted)\b"), now).when(t.rlike(r"\byesterday\b"), F.timestamp_seconds(F.unix_timestamp(now) - 86_400))


def days_between(start: Column, end: Column) -> Column:
    """Whole days, never negative."""
    return F.greatest(F.lit(0), F.floor((F.unix_timestamp(end) - F.unix_timestamp(start)) / 86_400)).cast("long")


def period_start(ts: Column, period: str) -> Column:
    """Start of the UTC minute, day or month."""
    return F.date_trunc(period, ts)


def next_reset(ts: Column, period: str) -> Column:
    """Start of the next UTC minute, day or month."""
    start = F.date_trunc(period, ts)
    return F.add_months(start, 1).cast("timestamp") if period == "month" else start + F.expr(f"INTERVAL 1 {period}")


def provider_backoff(failures: Column) -> Column:
    """Minutes of pause after so many failures in a row, 10 at most."""
    return F.least(F.pow(F.lit(2.0), failures - 1), F.lit(10.0))


def site_backoff(failures: Column) -> Column:
    """Days until a site is read again, 30 at most."""
    return F.least(F.pow(F.lit(2.0), failures - 1), F.lit(30.0))


def notice_days(text: Column) -> Column:
    """A stated notice period in days: "60 days", "1.5 months", "Immediate",
    "nil", or a bare number of days; null for anything else."""

    def days(t: Column) -> Column:
        pattern = r"(\d+(?:\.\d+)?)\s*(day|week|month)"
        n, unit = group(t, pattern, 1).cast("double"), group(t, pattern, 2)
        stated = round_half_up(n * F.when(unit == "week", 7).when(unit == "month", 30).otherwise(1)).cast("int")
        bare = F.when(t.rlike(r"^\d{1,3}$"), t.try_cast("int"))
        return F.when(t.rlike("immediate|serving.*0|none|nil"), 0).when(n.isNotNull(), stated).otherwise(bare)

    return let(F.trim(F.lower(text)), days)


def ctc_annual_inr(text: Column) -> Column:
    """Pay of a profile in rupees a year, the lower end of a range: "8.5
    LPA", "12 lakhs", "1.2 Cr", "70k per month", or a plain number of 5 to 9
    digits; null for anything else."""
    lakhs, crores = r"(\d+(?:\.\d+)?)\s*(?:-\s*\d+(?:\.\d+)?\s*)?(?:lpa|l\b|lakhs?|lacs?)", r"(\d+(?:\.\d+)?)\s*(?:cr|crores?)\b"
    monthly, plain = r"(\d+(?:\.\d+)?)\s*(k)?\s*(?:/|per)\s*(?:month|mo)\b", r"^(\d{5,9})(?:\s*(?:per annum|pa|/year|a year))?$"

    def rupees(s: Column) -> Column:
        number = lambda pattern: group(s, pattern, 1).cast("double")
        a_month = number(monthly) * F.when(group(s, monthly, 2) == "k", 12_000).otherwise(12)
        return round_half_up(F.coalesce(number(lakhs) * 100_000, number(crores) * 10_000_000, a_month, number(plain))).cast("long")

    return let(F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit(","), F.lit("")), r"₹|rs\.?|inr", "")), rupees)


# What a preferred location says of the mode of work.
MODE_WORDS = {"remote": "remote", "work from home": "remote", "wfh": "remote", "hybrid": "hybrid", "onsite": "onsite", "on-site": "onsite"}


def preferred_places(items: Column) -> Column:
    """Preferred locations as struct(locations, modes): places in order, and
    the modes of work that are named among them, each once."""
    modes = F.create_map(*(F.lit(x) for pair in MODE_WORDS.items() for x in pair))
    named = F.transform(items, lambda i: F.struct(F.trim(i).alias("place"), F.try_element_at(modes, F.lower(F.trim(i))).alias("mode")))
    return let(named, lambda n: F.struct(F.transform(F.filter(n, lambda x: x["mode"].isNull() & (x["place"] != "")), lambda x: x["place"]).alias("locations"), F.array_distinct(F.array_compact(F.transform(n, lambda x: x["mode"]))).alias("modes")))


# How dates are written in a line.
_DATE = r"(?:(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.?,?\s*'?\d{4}|\d{1,2}\s*[/.]\s*\d{4}|\d{4}\s*[/.-]\s*\d{2}(?!\d)|(?:19|20)\d{2})"
_UNTIL = r"present|current(?:ly)?|now|till date|till now|to date|ongoing|today"
DATE_RANGE = rf"(?i)({_DATE})\s*(?:-|–|—|to|until|till)\s*({_DATE}|{_UNTIL})"


#: What every date range holds somewhere, and few other lines do.
_DATED = r"(?i)\d\s*(?:-|–|—|to|until|till)"


def has_date_range(line: Column) -> Column:
    """Whether a line holds a span of dates; most are passed over by a look."""
    return line.rlike(_DATED) & line.rlike(DATE_RANGE)


def date_range(line: Column) -> Column:
    """Struct of first, last (YYYY-MM or YYYY; null while it goes on) and
    still, of the first span in a line; all null where there is none."""

    def read(s: Column) -> Column:
        return let(is_present(s["end"]), lambda still: F.struct(year_month(s["begin"]).alias("first"), F.when(~still, year_month(s["end"])).alias("last"), F.coalesce(still, F.lit(False)).alias("still")))

    return let(F.struct(group(line, DATE_RANGE, 1).alias("begin"), group(line, DATE_RANGE, 2).alias("end")), read)


def dates_in(line: Column) -> Column:
    """The dates of a line in order."""
    found = F.regexp_extract_all(line, F.lit(f"(?i)({_DATE})"), 1)
    return F.filter(F.transform(found, year_month), lambda d: d.isNotNull())


#: The first line of a text that speaks of pay.
PAY_LINE = r"(?im)^.*\b(?:salary|ctc|compensation|pay)\b.*$"


def salary_or_line(said: Column, description: Column) -> Column:
    """Pay by its own field, else by the first line of the description that
    names it."""
    return salary(F.coalesce(said, F.nullif(F.regexp_extract(description, PAY_LINE, 0), F.lit(""))))
