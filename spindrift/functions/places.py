"""Companies, places and kinds of posting, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions.text import let, normalize_for_match, similarity, squeeze, title_case

# Endings of company names, spellings of cities, words of agencies, boards and titles.
LEGAL = r"(?i)[\s,]+(?:pvt\.?\s*ltd\.?|private\s+limited|pvt\.?|limited|ltd\.?|llp|inc\.?|llc|corp\.?|corporation|gmbh|plc|co\.)$"
GENERIC = r"\s+(?:technologies|technology|tech|solutions|services|software|systems|india|labs|global)$"
CITIES = (
    ("Remote-India", "^(remote|work from home|wfh|anywhere)"), ("Bengaluru", "^(bengaluru|bangalore|bangalore urban|bengaluru urban)$"), ("Gurugram", "^(gurugram|gurgaon)$"),
    ("Mumbai", "^(mumbai|bombay|navi mumbai|thane)$"), ("Delhi", "^(new delhi|delhi|delhi ncr|ncr)$"), ("Noida", "^(noida|greater noida)$"), ("Hyderabad", "^(hyderabad|secunderabad)$"),
    ("Chennai", "^(chennai|madras)$"), ("Kolkata", "^(kolkata|calcutta)$"), ("Pune", "^(pune|pimpri chinchwad)$"), ("Kochi", "^(kochi|cochin)$"), ("Thiruvananthapuram", "^(thiruvananthapuram|trivandrum)$"), ("India", "^(india|in)$"),
)
STAFFING = r"(?i)\b(staffing|recruit\w*|placement\w*|manpower|consultan(cy|ts)|hr\s+solutions|talent\s+(acquisition|solutions|bridge)|search\s+partners|outsourcing)\b"
HYBRID = r"\bhybrid\b|\d\s*days?\s*(a|per)\s*week\s*(in|from)\s*(the\s*)?office"
REMOTE = r"\b(fully\s+remote|100%\s*remote|remote[-\s]first|work\s+from\s+home|wfh)\b|^remote"
ONSITE = r"\b(work\s+from\s+office|wfo|on[-\s]?site|in[-\s]office)\b"
BOARDS = r"(greenhouse\.io|lever\.co|ashbyhq\.com|smartrecruiters\.com|recruitee\.com|workable\.com|myworkdayjobs\.com)$"
INDIA, ANYWHERE = r"(?i)\bindia\b|\bbharat\b", r"(?i)\bremote\b|\banywhere\b|\bwork from home\b"
ELSEWHERE = r"(?i)\b(us|usa|united states|canada|uk|united kingdom|europe|eu|emea|latam|germany|australia)\b"
TITLE_NOISE = ("senior", "sr", "junior", "jr", "lead", "principal", "staff", "associate", "intern", "trainee", "developer", "engineer", "engineering", "software", "sde", "i", "ii", "iii", "1", "2", "3", "the", "and", "of", "for", "-", "&")
#: Postings with later dates than these are not taken, or not compared.
FRESH_DAYS, APART_DAYS = 60, 30


def display_company(name: Column) -> Column:
    """Up to three legal endings taken off; never empty."""
    out = F.trim(name)
    for _ in range(3):
        out = F.trim(F.regexp_replace(out, LEGAL, ""))
    return F.when(out == "", F.trim(name)).otherwise(out)


def company_key(name: Column, ascii_only: bool = False) -> Column:
    """For matching: no punctuation, up to two generic endings taken off."""
    key = squeeze(F.regexp_replace(normalize_for_match(display_company(name), ascii_only), "[^a-z0-9 ]+", " "))
    for _ in range(2):
        key = F.regexp_replace(key, GENERIC, "")
    return key


def letters_key(name: Column) -> Column:
    """Letters and digits only, for joins on names."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def canonical_city(location: Column, ascii_only: bool = False) -> Column:
    """The known spelling of the first part of a location."""

    def known(first: Column) -> Column:
        city = title_case(first)
        for name, pattern in reversed(CITIES):
            city = F.when(first.rlike(pattern), name).otherwise(city)
        return F.when(first != "", city)

    return let(normalize_for_match(F.trim(F.get(F.split(location, r"[,(/|]"), F.lit(0))), ascii_only), known)


def indian_city(location: Column, ascii_only: bool = False) -> Column:
    """The first listed city that any part of a location names."""

    def named(part: Column) -> Column:
        return let(F.trim(F.regexp_replace(normalize_for_match(part, True), r"^[a-z ]{2,20}:\s*", "")), known)

    def known(text: Column) -> Column:
        city = F.lit(None).cast("string")
        for name, pattern in reversed(CITIES):
            if name not in ("Remote-India", "India"):
                city = F.when(text.rlike(pattern), name).otherwise(city)
        return city

    return F.get(F.array_compact(F.transform(F.split(location, "[,(/|;·]"), named)), F.lit(0))


def work_mode(location: Column, description: Column, hint: Column) -> Column:
    """The hint, else what location and description say."""
    text = F.lower(F.concat(F.coalesce(location, F.lit("")), F.lit("\n"), F.coalesce(description, F.lit(""))))
    said = let(text, lambda t: F.when(t.rlike(HYBRID), "hybrid").when(t.rlike(REMOTE), "remote").when(t.rlike(ONSITE), "onsite"))
    return F.coalesce(hint, said)


def description_hash(text: Column, ascii_only: bool = False) -> Column:
    """Equal for texts that differ in case, spacing and punctuation only."""
    plain = F.regexp_replace(normalize_for_match(text, ascii_only), "[^a-z0-9 ]+", "")
    return F.substring(F.sha2(F.substring(plain, 1, 3000), 256), 1, 32)


def text_hash(text: Column) -> Column:
    """Hash of a whole text; equal for texts that differ in case, spacing
    and punctuation only. Letters, marks and digits of every script count; null
    where a text has none."""

    def digest(plain: Column) -> Column:
        return F.when(F.trim(plain) != "", F.sha2(plain, 256))

    return let(F.regexp_replace(normalize_for_match(text), r"[^\p{L}\p{M}\p{N} ]+", ""), digest)


def is_staffing(company: Column) -> Column:
    """X19."""
    return company.rlike(STAFFING)


def is_direct(company: Column, via: Column, links: Column, ascii_only: bool = False) -> Column:
    """Posted by the employer: its own site, or a board it uses."""
    via = F.lower(F.coalesce(via, F.lit("")))

    def found(x: Column) -> Column:
        # the key is worked out before, as no Python may run inside a lambda
        key, named = x["key"], F.length(x["key"]) > 2

        def direct(url: Column) -> Column:
            host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://([^/?#:]+)", 1))
            return host.rlike(BOARDS) | (named & (host != "") & F.contains(host, key) & F.lower(url).rlike("career|jobs"))

        return (named & F.contains(x["via"], key) & x["via"].rlike("career|jobs|company")) | (x["via"] == "company website") | F.exists(x["links"], direct)

    key = F.get(F.split(company_key(company, ascii_only), " "), F.lit(0))
    return let(F.struct(key.alias("key"), via.alias("via"), links.alias("links")), found)


def title_key(title: Column, ascii_only: bool = False) -> Column:
    """A title for comparison: no js endings, levels as digits."""
    key = normalize_for_match(title, ascii_only)
    for pattern, plain in ((r"\b(\w+)\.?js\b", "$1"), (r"\bjs\b", " "), (r"\biii\b", "3"), (r"\bii\b", "2"), (r"\bsr\b", "senior"), (r"\bjr\b", "junior"), ("[^a-z0-9 ]+", " ")):
        key = F.regexp_replace(key, pattern, plain)
    return squeeze(key)


def role_words(title: Column) -> Column:
    """The words of a title that say what the role is."""
    joined = title
    for pattern, plain in ((r"(?i)front[\s-]end", "frontend"), (r"(?i)full[\s-]stack", "fullstack"), (r"(?i)back[\s-]end", "backend")):
        joined = F.regexp_replace(joined, pattern, plain)
    parts = F.split(F.regexp_replace(F.lower(joined), r"[^a-z0-9+#.\s-]", " "), r"[\s/-]+")
    return F.filter(F.transform(parts, lambda w: F.regexp_replace(w, r"\.$", "")), lambda w: (F.length(w) > 1) & ~w.isin(*TITLE_NOISE))


def title_matches(title: Column, variants: Column) -> Column:
    """every role word of some variant is in the title."""
    wanted = F.filter(F.transform(variants, role_words), lambda w: F.size(w) > 0)
    return let(role_words(title), lambda own: F.exists(wanted, lambda w: F.size(F.array_except(w, own)) == 0))


def location_matches(location: Column, mode_hint: Column, cities: Column, remote_ok: Column) -> Column:
    """one of the cities, anywhere in the country without cities, or
    remote work that is open to it."""
    city = indian_city(location)
    wanted = F.coalesce(F.array_contains(cities, city), F.lit(False))
    remote = F.coalesce(mode_hint == "remote", F.lit(False)) | location.rlike(ANYWHERE)
    open_here = location.rlike(INDIA) | location.rlike(r"(?i)\b(apac|asia)\b") | ~location.rlike(ELSEWHERE)
    return wanted | F.when(remote & remote_ok, open_here).otherwise((F.size(cities) == 0) & (location.rlike(INDIA) | city.isNotNull()))


def is_fresh(posted: Column, now: Column, days: int = FRESH_DAYS) -> Column:
    """not older than so many days, or undated."""
    return posted.isNull() | (F.unix_timestamp(now) - F.unix_timestamp(posted) <= days * 86_400)


def same_posting(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """The same id at a provider, the same description, or the same company
    and city with close titles and dates."""
    ids = (a["provider"] == b["provider"]) & (a["external_id"] == b["external_id"])
    text = (a["description_hash"] != "") & (a["description_hash"] == b["description_hash"])
    place = (a["company_key"] != "") & (a["company_key"] == b["company_key"]) & (F.coalesce(a["city"], F.lit("")) == F.coalesce(b["city"], F.lit("")))
    near = F.coalesce(F.abs(F.unix_timestamp(a["posted_at"]) - F.unix_timestamp(b["posted_at"])) <= APART_DAYS * 86_400, F.lit(True))
    close = similarity(a["title_key"], b["title_key"]) >= 0.9
    return F.coalesce(ids, F.lit(False)) | F.coalesce(text, F.lit(False)) | F.coalesce(place & near & close, F.lit(False))
