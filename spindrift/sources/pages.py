"""What is read out of fetched pages and files."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from urllib.parse import urljoin
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

_BLOCK = re.compile(r"(?is)<script\b[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>")
_POSTING = "JobPosting"


def _postings(value: object) -> Iterator[dict]:
    """Postings anywhere in a JSON-LD value; lists and graphs are walked."""
    todo = [value]
    while todo:
        now = todo.pop()
        if isinstance(now, list):
            todo.extend(reversed(now))
        elif isinstance(now, dict):
            kinds = now.get("@type")
            if _POSTING in (kinds if isinstance(kinds, list) else [kinds]):
                yield now
            todo.extend(reversed([v for v in now.values() if isinstance(v, (dict, list))]))


def _text(value: object) -> str | None:
    if isinstance(value, list):
        value = value[0] if value else None
    if isinstance(value, dict):
        value = value.get("name") or value.get("value")
    return None if value is None else str(value)


@F.arrow_udf(ArrayType(StringType()))
def jsonld_postings(html: pa.Array) -> pa.Array:
    """SC17: JSON of every posting in a page's JSON-LD, at any depth; blocks
    that are no JSON are passed over."""
    out: list[list[str] | None] = []
    for page in html.to_pylist():
        found = []
        for block in _BLOCK.findall(page or ""):
            try:
                value = json.loads(block.strip())
            except ValueError:
                continue
            for p in _postings(value):
                place = p.get("jobLocation")
                place = place[0] if isinstance(place, list) and place else place
                address = place.get("address") if isinstance(place, dict) else None
                city = _text(address.get("addressLocality")) if isinstance(address, dict) else _text(place)
                found.append(json.dumps({"title": _text(p.get("title")), "company": _text(p.get("hiringOrganization")), "location": city, "description": _text(p.get("description")), "posted": _text(p.get("datePosted")), "url": _text(p.get("url"))}))
        out.append(found)
    return pa.array(out, pa.list_(pa.string()))


_FIELDS = "title string, company string, location string, description string, posted string, url string"


def read_jsonld(pages: DataFrame) -> DataFrame:
    """SC17: pages (page_id, url, html) as postings, one a row."""
    rows = pages.select("page_id", F.explode(jsonld_postings("html")).alias("j"))
    return rows.select("page_id", F.from_json("j", _FIELDS).alias("p")).select("page_id", "p.*").where("title is not null")


@F.arrow_udf(ArrayType(StringType()))
def absolute_links(base: pa.Array, html: pa.Array) -> pa.Array:
    """Links of a page made absolute, each once, in order."""
    found = re.compile(r"(?i)<a\b[^>]*?href=[\"']([^\"'#][^\"']*)[\"']")
    out = []
    for url, page in zip(base.to_pylist(), html.to_pylist(), strict=True):
        own: dict[str, None] = {}
        for link in found.findall(page or ""):
            try:
                own[urljoin(url or "", link)] = None
            except ValueError:
                continue
        out.append(list(own))
    return pa.array(out, pa.list_(pa.string()))


#: Addresses of boards by kind; the group is the board's token.
SITES = (
    ("greenhouse", r"(?:boards|job-boards)\.greenhouse\.io/([\w-]+)"), ("lever", r"jobs\.(?:eu\.)?lever\.co/([\w-]+)"), ("ashby", r"jobs\.ashbyhq\.com/([\w.%-]+)"),
    ("smartrecruiters", r"(?:careers|jobs)\.smartrecruiters\.com/([\w-]+)"), ("recruitee", r"([\w-]+)\.recruitee\.com"),
)


def detect_site(url: Column) -> Column:
    """Struct of kind, token and key of a careers address; any other page
    is kind page under its address."""
    kind, token = F.lit("page"), F.lower(F.regexp_replace(F.regexp_replace(url, r"^(?i)https?://(www\.)?", ""), r"[?#].*$|/+$", ""))
    for name, pattern in reversed(SITES):
        hit = url.rlike(pattern)
        kind, token = F.when(hit, name).otherwise(kind), F.when(hit, F.lower(F.regexp_extract(url, pattern, 1))).otherwise(token)
    return F.struct(kind.alias("kind"), token.alias("token"), F.concat(kind, F.lit(":"), token).alias("key"))


def careers_kind(html: Column) -> Column:
    """SC16: where a careers page's postings are found first: an embedded board,
    JSON-LD, or its own links."""
    board = F.lit(None).cast("string")
    for name, pattern in reversed(SITES):
        board = F.when(html.rlike(r"(?i)(src|href)=[\"'][^\"']*" + pattern), name).otherwise(board)
    return F.coalesce(board, F.when(html.contains("application/ld+json") & html.contains(_POSTING), "jsonld"), F.when(html.rlike(r"(?i)<a\b[^>]*href=[\"'][^\"']*(job|career|opening|position)"), "links"), F.lit("none"))


def name_from_token(token: Column) -> Column:
    """A company's name from its board token."""
    spaced = F.regexp_replace(F.regexp_replace(token, "%20|[-_.]+", " "), r"(?<=[a-z])(?=[A-Z])", " ")
    return F.array_join(F.transform(F.filter(F.split(spaced, " "), lambda w: w != ""), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")


def name_from_title(title: Column) -> Column:
    """A company's name from a page title such as "Careers at X"."""
    at = F.nullif(F.regexp_extract(title, r"(?i)(?:careers?|jobs?|openings?)\s+(?:at|with)\s+([^|–—:-]+)", 1), F.lit(""))
    first = F.regexp_replace(F.get(F.split(title, r"\s+[|–—:-]\s+"), F.lit(0)), r"(?i)\s*\b(careers?|jobs?|openings?)\b\s*", " ")
    return F.nullif(F.trim(F.coalesce(at, first)), F.lit(""))


def robots_rules(text: Column, agent: str = "*") -> Column:
    """rules of the groups for an agent: array of (allow, path)."""
    group = F.regexp_extract_all(text, F.lit(r"(?is)(?:^|\n)\s*user-agent:\s*" + re.escape(agent) + r"\s*\r?\n(.*?)(?=\n\s*user-agent:|\Z)"), 1)
    lines = F.filter(F.flatten(F.transform(group, lambda g: F.split(g, r"\r?\n"))), lambda x: x.rlike(r"(?i)^\s*(dis)?allow:\s*\S"))
    return F.transform(lines, lambda x: F.struct((~x.rlike(r"(?i)^\s*disallow")).alias("allow"), F.trim(F.regexp_extract(x, r":\s*([^#\s]*)", 1)).alias("path")))


def robots_allows(rules: Column, path: Column) -> Column:
    """the longest rule that matches decides, an allow among equals; no
    rule allows. ``*`` stands for anything, ``$`` for the end."""

    def matches(rule: Column) -> Column:
        plain = F.regexp_replace(rule["path"], r"([.+?^(){}\[\]|\\])", r"\\$1")
        return F.regexp_like(path, F.concat(F.lit("^"), F.regexp_replace(plain, r"\*", ".*")))

    hits = F.transform(F.filter(rules, matches), lambda r: F.struct(F.length(r["path"]).alias("n"), r["allow"].alias("allow")))
    return F.coalesce(F.array_max(hits)["allow"], F.lit(True))


@F.arrow_udf(BooleanType())
def is_public_address(address: pa.Array) -> pa.Array:
    """an IP address that is not private, local or reserved."""
    import ipaddress

    out = []
    for x in address.to_pylist():
        try:
            out.append(None if x is None else ipaddress.ip_address(x).is_global)
        except ValueError:
            out.append(False)
    return pa.array(out, pa.bool_())


def is_safe_url(url: Column) -> Column:
    """http or https, a host with a dot, no credentials, the usual ports,
    and no local name."""
    parts = r"^(https?)://(?:([^/?#@]*)@)?([^/?#:@]+)(?::(\d+))?"
    host, port = F.lower(F.regexp_extract(url, parts, 3)), F.regexp_extract(url, parts, 4)
    local = host.rlike(r"^localhost$|\.(local|internal|localhost)$|^(10|127)\.|^192\.168\.|^172\.(1[6-9]|2\d|3[01])\.|^169\.254\.|^0\.")
    return url.rlike(parts) & (F.regexp_extract(url, parts, 2) == "") & port.isin("", "80", "443") & host.contains(".") & ~local


def file_kind(content: Column) -> Column:
    """SC20: pdf, docx or null by the first bytes."""
    head = F.hex(F.substring(content, 1, 5))
    return F.when(head == "255044462D", "pdf").when(head.startswith("504B0304") & F.contains(F.hex(content), F.lit("776F72642F")), "docx")


def enough_text(text: Column, least: int = 200) -> Column:
    """SC21: at least so many characters that are not white space."""
    return F.length(F.regexp_replace(text, r"\s", "")) >= least


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> str | None:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    lines = ["".join("\t" if n.tag == _W + "tab" else n.text or "" for n in p.iter() if n.tag in (_W + "t", _W + "tab")) for p in root.iter(_W + "p")]
    return "\n".join(lines)


def docx_file(lines: list[str]) -> bytes:
    """A DOCX file with a paragraph a line."""
    body = "".join("<w:p>" + "<w:r><w:tab/></w:r>".join(f"<w:r><w:t xml:space=\"preserve\">{escape(part)}</w:t></w:r>" for part in line.split("\t")) + "</w:p>" for line in lines)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{_W[1:-1]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def write_docx(rows: DataFrame) -> DataFrame:
    """Rows (path, lines as an array, others) with a column content: a DOCX file of the lines."""

    @F.arrow_udf("binary")
    def made(lines: pa.Array) -> pa.Array:
        return pa.array([None if x is None else docx_file(x) for x in lines.to_pylist()], pa.binary())

    return rows.withColumn("content", made("lines")).drop("lines")


def read_docx(files: DataFrame) -> DataFrame:
    """SC19: text of DOCX files (path, content); null where a file is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array([docx_text(x) if x else None for x in b.column("content").to_pylist()], pa.string())], names=["path", "text"])

    return files.select("path", "content").mapInArrow(run, "path string, text string")
