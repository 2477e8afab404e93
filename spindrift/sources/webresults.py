"""Answers of web-search services and page requests, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.text import canonical_url
from spindrift.operators.history import first_of
from spindrift.sources.pages import is_safe_url

#: Redirects and bytes of a page at most.
REDIRECTS, BYTES = 3, 2 << 20
# Where a service's answer holds its hits, and what it calls their text.
SHAPES = {"content": ("results", "content"), "text": ("results", "text"), "web": ("data.web", "description")}
_SCHEMAS = {
    "content": "results array<struct<url:string,title:string,content:string>>",
    "text": "results array<struct<url:string,title:string,text:string>>",
    "web": "data struct<web:array<struct<url:string,title:string,description:string>>>",
}


def read_hits(answers: DataFrame) -> DataFrame:
    """SC22: hits of answers (query_id, kind, body as JSON) of three shapes:
    query_id, kind, hit_no, url, title, snippet; missing texts are empty. An
    answer of another shape has no hits."""
    out = None
    for kind, (path, text) in SHAPES.items():
        rows = answers.where(F.col("kind") == kind).withColumn("_b", F.from_json("body", _SCHEMAS[kind], {"mode": "PERMISSIVE"}))
        rows = rows.select("query_id", "kind", F.posexplode(F.col(f"_b.{path}")).alias("hit_no", "h")).where("h.url is not null")
        rows = rows.select("query_id", "kind", "hit_no", "h.url", F.coalesce("h.title", F.lit("")).alias("title"), F.coalesce(F.col(f"h.{text}"), F.lit("")).alias("snippet"))
        out = rows if out is None else out.unionByName(rows)
    return out


def distinct_hits(hits: DataFrame, *order: str) -> DataFrame:
    """SC22, U2: of hits of one address the first."""
    return first_of(hits.withColumn("address", canonical_url(F.col("url"))), ["address"], *order)


def fetch_outcome(url: Column, allowed: Column, redirects: Column, status: Column, content_type: Column) -> Column:
    """SC26: what becomes of a page request: blocked, robots, redirects,
    failed, other (no page) or ok."""
    kind = F.coalesce(content_type, F.lit(""))
    return (
        F.when(~is_safe_url(url), "blocked").when(~allowed, "robots").when(redirects > REDIRECTS, "redirects").when(~F.coalesce(status.between(200, 299), F.lit(False)), "failed")
        .when((kind != "") & ~kind.rlike("html|xml"), "other").otherwise("ok")
    )


def capped(html: Column, size: int = BYTES) -> Column:
    """SC26: the first bytes of a page that are read."""
    return F.substring(html.cast("binary"), 1, size)
