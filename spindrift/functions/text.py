"""Text rules as Column expressions. A null in gives a null out unless stated."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Glyphs that count as a dash, an apostrophe, a quote or a bullet.
DASHES = "‐‑‒–—―−"
APOSTROPHES = "‘’‛′`"
QUOTES = "“”″"
BULLETS = "•●▪■◦‣∙·|\t"

# What a list is split on, and what ends a company's name.
LIST_SPLIT = r"\s*[,;|•·]\s*|\t"
FIELD_SPLIT = r"\s+[·|•]\s+|\t|\s{2,}"
BULLET_START = r"^[\s•●▪■◦‣∙*➢►▶✓✔–—-]+\s*"
OUTCOME_VERBS = "(?i)^(reduced|improved|increased|cut|raised|grew|saved|boosted|won|achieved|doubled|tripled|halved|accelerated|optimi[sz]ed|decreased|lowered|delivered|launched|shipped|scaled|generated|drove|exceeded)\\b"
NUMBER_TOKEN = r"(?i)^[(₹$€£]?\d[\d,.]*(%|x|×|k|m|s|ms|\+)?[,.;:)]?$"
INJECTION = r"(?i)ignore (all |any )?(previous|prior|above) (instructions|prompts)|disregard (the|all|any)|you are now|system prompt|act as (an?|the)|reveal (your|the) (prompt|instructions)|</?(system|assistant|user)>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it occurs."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _normal(text: pa.Array, form: str) -> pa.Array:
    """A normal form of texts; only those beyond ASCII become Python objects."""
    wide = pc.invert(pc.fill_null(pc.string_is_ascii(text), True))
    if not pc.any(wide).as_py():
        return text
    changed = [unicodedata.normalize(form, x) for x in text.filter(wide).to_pylist()]
    return pc.replace_with_mask(text, wide, pa.array(changed, text.type))


@F.arrow_udf(StringType())
def _nfkc(text: pa.Array) -> pa.Array:
    return _normal(text, "NFKC")


@F.arrow_udf(StringType())
def _nfkd(text: pa.Array) -> pa.Array:
    return _normal(text, "NFKD")


def normalize_for_match(text: Column, ascii_only: bool = False) -> Column:
    """Lower case, one kind of dash and quote, bullets as blanks, single
    blanks. ``ascii_only`` leaves compatibility forms as they are and so needs
    no Python; for ASCII texts both give the same."""
    text = text if ascii_only else _nfkc(text)
    text = F.replace(text, F.lit("­"), F.lit(""))
    text = F.lower(F.regexp_replace(text, "(?<=[A-Za-z0-9])-\n(?=[a-z0-9])", "-"))
    for glyphs, plain in ((DASHES, "-"), (APOSTROPHES, "'"), (QUOTES, '"'), (BULLETS, " ")):
        text = F.translate(text, glyphs, plain * len(glyphs))
    return squeeze(text)


def squeeze(text: Column) -> Column:
    """One blank for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def split_lines(text: Column) -> Column:
    """Lines that are not empty; blanks single, tabs kept bare. The text is
    cleaned as a whole before it is cut, by plain replacing, which gives the
    same lines."""
    text = F.replace(text, F.lit(" "), F.lit(" "))
    text = F.when(F.contains(text, F.lit("  ")), F.regexp_replace(text, "  +", " ")).otherwise(text)
    for said, kept in ((" \t", "\t"), ("\t ", "\t"), ("\r\n", "\n"), (" \n", "\n"), ("\n ", "\n")):
        text = F.replace(text, F.lit(said), F.lit(kept))
    return F.array_remove(F.split(F.trim(text), "\n"), "")


def strip_bullet(line: Column) -> Column:
    """X3."""
    return F.trim(F.regexp_replace(line, BULLET_START, ""))


def split_list(text: Column) -> Column:
    """Items of a list, without a leading "and" or a closing full stop."""
    tidy = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"(?i)^(and|&)\s+", ""), r"[.\s]+$", ""))
    return F.filter(F.transform(F.split(text, LIST_SPLIT), tidy), lambda x: x != "")


def split_fields(line: Column) -> Column:
    """Fields of a header line."""
    return F.filter(F.transform(F.split(line, FIELD_SPLIT), lambda x: F.trim(x)), lambda x: x != "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def word_count(text: Column) -> Column:
    """X8."""
    return F.size(words(text))


def has_metric(text: Column) -> Column:
    """Whether a line states a measurable result; years, and numbers that
    read as a version after a capitalised word, don't count."""

    def counts(word: Column, before: Column) -> Column:
        digits, marked = F.regexp_replace(word, r"\D", ""), word.rlike("(?i)[%+kmsx]")
        year = digits.rlike(r"^(19|20)\d{2}$") & ~marked
        version = before.rlike("^[A-Z]") & (word.contains(".") | (F.length(digits) <= 2)) & ~marked
        return word.rlike(NUMBER_TOKEN) & ~year & ~version

    def any_counts(w: Column) -> Column:
        # the word before each one; the first two have none that names a product
        before = F.slice(F.concat(F.array(F.lit(""), F.lit("")), F.slice(w, 2, F.size(w))), 1, F.size(w))
        return F.exists(F.zip_with(w, before, counts), lambda x: x)

    return text.rlike(r"[%×]|[₹$€£]\s?\d") | let(F.split(text, r"\s+"), any_counts)


def bullet_kind(text: Column) -> Column:
    """Achievement or responsibility."""
    return F.when(has_metric(text) | text.rlike(OUTCOME_VERBS), "achievement").otherwise("responsibility")


def similarity(a: Column, b: Column) -> Column:
    """One less the edit distance over the longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def best_match(haystack: Column, needle: Column) -> Column:
    """X11: 1 for a substring, else the best similarity of a run of about as
    many words that shares at least half of them (of the run, if it is shorter).
    For many values and texts ``operators.matching.best_containment`` meets only
    the runs that can match."""

    def over(both: Column) -> Column:
        hay, own = both["hay"], both["own"]
        n = F.size(own)

        def of_size(size: Column) -> Column:
            starts = F.when(F.size(hay) >= size, F.sequence(F.lit(1), F.size(hay) - size + 1)).otherwise(F.array().cast("array<int>"))
            near = F.filter(F.transform(starts, lambda i: F.slice(hay, i, size)), lambda r: 2 * F.size(F.filter(r, lambda w: F.array_contains(own, w))) >= F.least(n, size))
            return F.array_max(F.transform(near, lambda r: similarity(F.array_join(r, " "), needle)))

        return F.coalesce(F.greatest(*(of_size(F.greatest(F.lit(1), n + d)) for d in (-1, 0, 1))), F.lit(0.0))

    both = F.struct(F.split(haystack, " ").alias("hay"), F.split(needle, " ").alias("own"))
    return F.when((needle == "") | F.contains(haystack, needle), 1.0).otherwise(let(both, over))


def title_case(text: Column) -> Column:
    """The first letter of every run of word characters in upper case."""
    parts = F.regexp_extract_all(text, F.lit(r"(\w+|\W+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))), "")


def skill_names(names: Column, ascii_only: bool = False) -> Column:
    """Names in the form that keys are taken from; a text of one a line keeps its lines."""
    return F.lower(names if ascii_only else _nfkd(names))


def bare_key(name: Column) -> Column:
    """X21 of a name that ``skill_names`` gave."""
    return F.regexp_replace(name, "[^a-z0-9#+]", "")


def skill_key(name: Column, ascii_only: bool = False) -> Column:
    """Letters, digits, # and + only, lower case."""
    return bare_key(skill_names(name, ascii_only))


def skill_keys_in(text: Column, ascii_only: bool = False) -> Column:
    """The distinct keys of all runs of one to four words, and those that
    end in js also without it. The text is cleaned as a whole before it is cut
    into words, and a run's key is the shorter run's and one word's more."""

    def runs(keys: Column) -> Column:
        out, run = [keys], keys
        for size in (2, 3, 4):
            n = F.greatest(F.lit(0), F.size(keys) - (size - 1))
            run = F.zip_with(F.slice(run, F.lit(1), n), F.slice(keys, F.lit(size), n), lambda x, y: F.concat(x, y))
            out.append(run)
        return F.array_distinct(F.filter(F.concat(*out), lambda k: k != ""))

    def with_short(keys: Column) -> Column:
        some = F.filter(keys, lambda k: k.endswith("js") & (F.length(k) > 3))
        return F.array_distinct(F.concat(keys, F.transform(some, lambda k: F.substring(k, F.lit(1), F.length(k) - 2))))

    text = F.lower(text if ascii_only else _nfkd(text))
    words = F.split(F.regexp_replace(F.trim(F.regexp_replace(text, r"[\s,;:()|·•/]+", " ")), "[^a-z0-9#+ ]", ""), " ")
    return let(let(words, runs), with_short)


def mentions(keys: Column, key: Column) -> Column:
    """A key is among the keys of a text, with or without a js ending."""
    cut = F.substring(key, F.lit(1), F.length(key) - 2)
    return (key != "") & (F.array_contains(keys, key) | F.array_contains(keys, F.concat(key, F.lit("js"))) | (key.endswith("js") & F.array_contains(keys, cut)))


def skill_slug(name: Column) -> Column:
    """Lower case words joined by hyphens; # and + spelt out."""
    text = F.replace(F.replace(F.lower(name), F.lit("#"), F.lit(" sharp ")), F.lit("+"), F.lit(" plus "))
    return F.regexp_replace(F.regexp_replace(text, "[^a-z0-9]+", "-"), "^-+|-+$", "")


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
#: The same addresses, sought only where a run of their letters begins or the last one ended.
_EMAILS = rf"(?:\G|(?<![A-Za-z0-9._%+-]))({EMAIL.replace('+@', '++@')})"
PHONE = r"\+?\(?\d[\d\s().-]{8,}\d"
URL = r"https?://[^\s<>\"')]+"


def emails(text: Column) -> Column:
    """X27. An address stands in one line, so only lines with its sign are gone through."""
    lines = F.array_join(F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit("@"))), "\n")
    return F.array_distinct(F.transform(F.regexp_extract_all(lines, F.lit(_EMAILS), 1), F.lower))


def phones(text: Column) -> Column:
    """Runs that hold 10 to 15 digits."""
    found = F.regexp_extract_all(text, F.lit(f"({PHONE})"), 1)
    return F.array_distinct(F.filter(found, lambda p: F.length(F.regexp_replace(p, r"\D", "")).between(10, 15)))


def urls(text: Column) -> Column:
    """X27."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({URL})"), 1), lambda u: F.regexp_replace(u, r"[.,;:!?]+$", "")))


def same_phone(a: Column, b: Column) -> Column:
    """The same last ten digits."""
    last = lambda x: F.right(F.regexp_replace(x, r"\D", ""), F.lit(10))
    return last(a) == last(b)


def canonical_url(url: Column) -> Column:
    """Without scheme, www., query, fragment and closing slash; lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(url), r"^(?i)https?://(www\.)?", ""), r"[?#].*$", ""), "/+$", ""))


def classify_url(url: Column) -> Column:
    """The kind of site a link goes to."""
    host = F.regexp_extract(canonical_url(url), "^([^/]+)", 1)
    kind = F.lit("other")
    for part, name in reversed((("linkedin.com", "linkedin"), ("github.com", "github"), ("gitlab.com", "gitlab"), ("leetcode.com", "leetcode"), ("medium.com", "blog"))):
        kind = F.when(host.endswith(part), name).otherwise(kind)
    return kind


# Character references that pages use.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&copy;": "©", "&middot;": "·"}


def decode_entities(text: Column) -> Column:
    """The common named references; the ampersand last."""
    for name, value in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(value))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def html_to_text(html: Column) -> Column:
    """Scripts, styles and comments dropped, blocks on lines of their own."""
    text = F.regexp_replace(html, r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?i)<br\s*/?>|</(p|div|li|h[1-6]|tr|ul|ol|section|article)>", "\n")
    text = decode_entities(F.regexp_replace(text, "<[^>]+>", " "))
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), squeeze), lambda x: x != ""), "\n")


def links(html: Column) -> Column:
    """The distinct addresses that anchors point at, as written."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'(?i)<a\b[^>]*?href="([^"#][^"]*)"'), 1))


def flags_injection(text: Column) -> Column:
    """the text tries to give instructions."""
    return text.rlike(INJECTION)


def sentences(text: Column) -> Column:
    """Sentence units, split after a full stop, question or exclamation
    mark, at semicolons and at line ends."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n+|;\s*"), lambda x: F.trim(x)), lambda x: x != "")


def round_half_up(x: Column) -> Column:
    """Halves go toward positive infinity."""
    return F.floor(x + 0.5)


def initials(name: Column) -> Column:
    """First letters of the first and the last word."""
    w = words(name)
    letter = lambda x: F.upper(F.substring(x, 1, 1))
    return F.when(F.size(w) == 0, "?").when(F.size(w) == 1, letter(F.get(w, F.lit(0)))).otherwise(F.concat(letter(F.get(w, F.lit(0))), letter(F.element_at(w, -1))))


def indian_grouping(number: Column) -> Column:
    """1234567 as 12,34,567."""
    digits = F.abs(number).cast("long").cast("string")
    head = F.regexp_replace(F.substring(digits, F.lit(1), F.length(digits) - 3), r"(?<=\d)(?=(\d\d)+$)", ",")
    text = F.when(F.length(digits) <= 3, digits).otherwise(F.concat(head, F.lit(","), F.right(digits, F.lit(3))))
    return F.when(number < 0, F.concat(F.lit("-"), text)).otherwise(text)


def lpa(amount: Column) -> Column:
    """An annual amount in lakhs, one decimal at most."""
    tenths = round_half_up(amount / 10_000)
    return F.concat(F.lit("₹"), F.regexp_replace(F.format_string("%.1f", tenths / 10), r"\.0$", ""), F.lit("L"))
