"""Entity resolution: blocks, links and canonical rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.places import APART_DAYS
from spindrift.functions.text import let
from spindrift.operators.matching import close_pairs
from spindrift.operators.stars import star_edges
from spindrift.operators.storage import cut

_NEVER = -(2**40)


def word_runs(rows: DataFrame, key: str, column: str, n: int) -> DataFrame:
    """The distinct runs of n words of each row: key, run."""

    def runs(w):
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " ")))

    words = F.filter(F.split(F.lower(column), "[^a-z0-9]+"), lambda w: w != "")
    return rows.select(key, F.explode(let(words, runs)).alias("run"))


def canonical_by_key(rows: DataFrame, row_id: str, key: str) -> DataFrame:
    """Rows with the least id of their key; a row without a key keeps its
    own id. The ids are summed up before the join, so a key of very many rows
    stays small on one side; the keys are written once, since they may have
    cost much to make."""
    rows = cut(rows, "keys")
    keyed = rows.dropna(subset=[key])
    least = keyed.groupBy(key, F.xxhash64(key).alias("_h")).agg(F.min(row_id).alias("canonical_id")).drop("_h")
    alone = rows.where(F.col(key).isNull()).withColumn("canonical_id", F.col(row_id))
    return keyed.join(least, key).unionByName(alone)


def close_titles(rows: DataFrame) -> DataFrame:
    """Pairs (one <= two) of distinct titles of a company and city that
    are close, each title with itself besides. Titles and not rows are compared,
    and only those that share a segment (``matching.close_pairs``)."""
    titles = rows.select("company_key", "_city", "title_key").distinct()
    itself = titles.select("company_key", "_city", F.col("title_key").alias("one"), F.col("title_key").alias("two"))
    return itself.unionByName(close_pairs(titles, ["company_key", "_city"], "title_key"))


def close_postings(rows: DataFrame, row_id: str) -> DataFrame:
    """Links (u, v) that join what is of one company and city with close
    titles and dates at most ``APART_DAYS`` apart (unknown dates suit all).

    Dates are dealt into spans of that length: rows of one span go to its least
    id, spans side by side are linked by their nearest rows, and rows without a
    date by the least of them. So the number of links grows with the rows, and
    every step is summed up before it is shuffled, however large a company is.
    """
    own = rows.where("company_key <> '' and title_key is not null").select(row_id, "company_key", F.coalesce("city", F.lit("")).alias("_city"), "title_key", F.unix_timestamp("posted_at").alias("_at"))
    pairs = close_titles(own)
    members = pairs.select("company_key", "_city", "one", "two", F.col("one").alias("title_key")).unionByName(pairs.where("one <> two").select("company_key", "_city", "one", "two", F.col("two").alias("title_key")))
    keys = ["company_key", "_city", "one", "two"]
    rows_of = own.join(members, ["company_key", "_city", "title_key"]).withColumn("_span", F.floor(F.col("_at") / (APART_DAYS * 86_400)))
    spans = rows_of.groupBy(*keys, "_span").agg(F.min(row_id).alias("v"), F.min(F.struct("_at", row_id)).alias("first"), F.max(F.struct("_at", row_id)).alias("last"))
    least = spans.select(*keys, F.coalesce("_span", F.lit(_NEVER)).alias("_s"), "v")
    to_span = rows_of.withColumn("_s", F.coalesce("_span", F.lit(_NEVER))).join(least, [*keys, "_s"]).select(F.col(row_id).alias("u"), "v")
    dated = spans.where("_span is not null")
    after = dated.select(*keys, (F.col("_span") - 1).alias("_span"), F.col("first").alias("next"))
    beside = dated.join(after, [*keys, "_span"]).where(F.col("next._at") - F.col("last._at") <= APART_DAYS * 86_400).select(F.col(f"next.{row_id}").alias("u"), F.col(f"last.{row_id}").alias("v"))
    undated = spans.where("_span is null").select(*keys, F.col("v").alias("u"))
    free = dated.join(undated, keys).select("u", "v")
    return to_span.union(beside).union(free).where("u <> v").distinct()


def links(rows: DataFrame, row_id: str) -> DataFrame:
    """Links (u, v): each row to the least of its provider id and of its
    description, and close postings of a company and city."""
    stars = None
    for keys in (["provider", "external_id"], ["description_hash"]):
        some = rows.dropna(subset=keys).where(F.col(keys[-1]) != "")
        least = some.groupBy(*keys, F.xxhash64(*keys).alias("_h")).agg(F.min(row_id).alias("v"), F.count("*").alias("n")).where("n > 1").drop("_h")
        own = some.join(least, keys).select(F.col(row_id).alias("u"), "v")
        stars = own if stars is None else stars.union(own)
    return stars.union(close_postings(rows, row_id)).where("u <> v").distinct()


def components(rows: DataFrame, row_id: str, rounds: int = 60) -> DataFrame:
    """Rows with canonical_id, the least id reachable over links, by
    large-star and small-star, whose rounds grow with the logarithm of a chain's
    length; each is written to the shared folder. Links that still change after
    ``rounds`` are an error, never a result."""
    least = star_edges(links(rows, row_id), rounds).toDF("_u", "_v")
    return rows.join(least, F.col(row_id) == F.col("_u"), "left").withColumn("canonical_id", F.coalesce("_v", row_id)).drop("_u", "_v")


def best_description(rows: DataFrame, key: str, row_id: str) -> DataFrame:
    """Of each key the complete description before a cut one, then the
    longer, then the first."""
    order = F.struct(~F.col("truncated"), F.length("description"), -F.col(row_id))
    return rows.groupBy(key).agg(F.max_by(F.struct(row_id, "description", "truncated"), order).alias("r")).select(key, "r.*")


#: Rows that a task of ``greedy`` has as Python objects at once.
_SHOWN = 4096
#: Distinct titles that are compared whatever their company; more are compared by company and city.
_TITLES = 20_000
#: Rows of a table that is broadcast; it is counted first.
_FEW = 200_000


class _Merged:
    """Records of one component so far, in the order in which they were opened,
    found by the keys that make two postings one. A row is a tuple of id, provider
    key, text key, place key, title, time, whether it is cut, and length."""

    def __init__(self) -> None:
        self.records: list[tuple] = []
        self.by_key: tuple[dict, dict, dict] = ({}, {}, {})

    @staticmethod
    def _near(a: tuple, b: tuple) -> bool:
        if a[5] is not None and b[5] is not None and abs(a[5] - b[5]) > APART_DAYS * 86_400:
            return False
        return a[4] == b[4] or _close(a[4], b[4])

    def add(self, row: tuple) -> int:
        """The record that the row joins or opens."""
        records, (by_id, by_text, by_place) = self.records, self.by_key
        at = none = len(records)
        for members in (by_id.get(row[1]), by_text.get(row[2])):
            if members:
                at = min(at, *members)
        for i in by_place.get(row[3], ()):
            if i < at and self._near(records[i], row):
                at = i
        if at == none:
            records.append(row)
        else:
            kept = records[at]
            if not (kept[6] and not row[6] or kept[6] == row[6] and row[7] > kept[7]):
                return at
            for index, key in zip(self.by_key, kept[1:4], strict=True):
                if key is not None:
                    index[key].discard(at)
            records[at] = row
        for index, key in zip(self.by_key, row[1:4], strict=True):
            if key is not None:
                index.setdefault(key, set()).add(at)
        return at


def close(a: str, b: str) -> bool:
    """Whether two titles are close: an edit distance of a tenth of the longer
    one at most. Only cells near the diagonal are worked out."""
    longest = max(len(a), len(b))
    room = longest // 10
    if a == b or not longest:
        return True
    if abs(len(a) - len(b)) > room:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        first, last = max(1, i - room), min(len(b), i + room)
        new = [longest] * (len(b) + 1)
        if first == 1:
            new[0] = i
        for j in range(first, last + 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != b[j - 1]))
        row = new
    return 1 - row[-1] / longest >= 0.9


_close = lru_cache(2**16)(close)


def _small(frame: DataFrame) -> DataFrame:
    """Marked for broadcast where it is counted to be small."""
    return F.broadcast(frame) if frame.limit(_FEW + 1).count() <= _FEW else frame.hint("merge")


def meeting(rows: DataFrame, row_id: str) -> DataFrame:
    """Rows with _component: rows that can ever meet in ``greedy`` have the same.

    Rows meet by keys: a provider id, a description, or a company, a city and a
    title that is close. Keys are hashed to 64 bits; two keys of one hash, as those
    of distant dates, put more rows together than need be, which changes no result.
    A row stands for its first key, and keys are linked where a row has two, so only
    distinct pairs of keys are shuffled, never rows. Up to ``_TITLES`` distinct
    titles are compared once for all companies and titles that are close by others
    count as one; beyond that, titles of one company and city are compared.
    """
    placed = (F.coalesce(F.col("company_key"), F.lit("")) != "") & F.col("title_key").isNotNull()
    titles = rows.where(placed).select("title_key").distinct()
    place = lambda title: F.xxhash64(F.lit(3), "company_key", F.coalesce("city", F.lit("")), title)
    code = F.xxhash64("title_key")
    apart = None
    if titles.limit(_TITLES + 1).count() <= _TITLES:
        alike = star_edges(close_pairs(titles, [], "title_key").select(F.xxhash64("one").alias("u"), F.xxhash64("two").alias("v"))).toDF("_code", "_least")
        rows = rows.withColumn("_code", code).join(F.broadcast(alike), "_code", "left").withColumn("_place", F.when(placed, place(F.coalesce("_least", "_code")))).drop("_code", "_least")
    else:
        blocks = rows.where(placed).select(F.xxhash64("company_key", F.coalesce("city", F.lit(""))).alias("_b"), "title_key").distinct()
        apart = close_pairs(blocks, ["_b"], "title_key")
        rows = rows.withColumn("_place", F.when(placed, F.xxhash64(F.lit(3), F.xxhash64("company_key", F.coalesce("city", F.lit(""))), code)))
        apart = apart.select(*(F.xxhash64(F.lit(3), "_b", F.xxhash64(c)).alias(n) for c, n in (("one", "u"), ("two", "v"))))
    by_id = F.when(F.col("provider").isNotNull() & F.col("external_id").isNotNull(), F.xxhash64(F.lit(1), "provider", "external_id"))
    by_text = F.when(F.col("description_hash") != "", F.xxhash64(F.lit(2), "description_hash"))
    rows = rows.withColumn("_first", F.coalesce(by_id, by_text, "_place"))
    others = rows.select("_first", F.explode(F.array_compact(F.array(by_text, F.col("_place")))).alias("_k"))
    if apart is not None:
        # a place stands for itself too, so that its links to others count
        others = others.unionByName(rows.where("_place is not null").select(F.col("_place").alias("_first"), F.col("_place").alias("_k")))
    before = F.lag("_first").over(Window.partitionBy("_k").orderBy("_first"))
    linked = others.distinct().select(F.col("_first").alias("u"), before.alias("v")).where("v is not null")
    least = star_edges(linked if apart is None else linked.union(apart)).toDF("_first", "_least")
    found = rows.join(_small(least), "_first", "left")
    return found.withColumn("_component", F.coalesce("_least", "_first", F.xxhash64(F.lit(4), row_id))).drop("_least", "_first", "_place")


def greedy(rows: DataFrame, row_id: str) -> DataFrame:
    """One-after-another merging of postings in the order of their
    ids: row_id, canonical_id, kept_id.

    Each row joins the first record that it equals (by provider id, description,
    or company, city, close titles and dates), or opens one; a record then is the
    row with the better description, so later rows are compared with that. Rows
    that can ever meet are in one component (``meeting``), so components are replayed,
    each as a stream in order: a task holds a component's records, not its rows.
    It says of each row which row opened its record as it passes, and what a
    record is in the end when the component does; a join brings the two together.
    canonical_id is the row that opened the record, kept_id the row that it is in
    the end. Null or empty hashes, provider ids, companies and titles equal
    nothing. Rows (row_id, provider, external_id, company_key, city, title_key,
    description_hash, posted_at, truncated, description); ids are distinct.
    """
    import pyarrow as pa

    names = ["_row", "canonical_id", "kept_id"]
    fields = ("_component", "_id", "_by_id", "_by_text", "_by_place", "title_key", "posted_at", "truncated", "length")

    def shown(*columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        component, merged, opened = None, _Merged(), []

        def ended() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(opened), _SHOWN):
                some = opened[at : at + _SHOWN]
                yield shown([None] * len(some), some, [r[0] for r in merged.records[at : at + _SHOWN]])

        for batch in batches:
            for at in range(0, batch.num_rows, _SHOWN):
                part = batch.slice(at, _SHOWN)
                ids, joined = part.column("_id").to_pylist(), []
                own = zip(*(part.column(c).to_pylist() for c in fields[1:]), strict=True)
                for at_component, row in zip(part.column("_component").to_pylist(), own, strict=True):
                    if at_component != component:
                        yield from ended()
                        component, merged, opened = at_component, _Merged(), []
                    k = merged.add(row)
                    if k == len(opened):
                        opened.append(row[0])
                    joined.append(opened[k])
                yield shown(ids, joined, [None] * len(ids))
        yield from ended()

    # keys of any length go as 16 bytes; where a length parts them, no two pairs are written alike
    pair = lambda a, b: F.concat(F.length(a).cast("string"), F.lit(":"), a, b)
    digest = lambda key: F.unhex(F.md5(key))
    company, title = F.col("company_key"), F.col("title_key")
    own = meeting(rows, row_id).select(
        "_component", F.col(row_id).cast("long").alias("_id"), pair(F.col("provider"), F.col("external_id")).alias("_by_id"), F.when(F.col("description_hash") != "", digest("description_hash")).alias("_by_text"),
        F.when((company != "") & title.isNotNull(), digest(pair(company, F.coalesce("city", F.lit(""))))).alias("_by_place"), "title_key", F.unix_timestamp("posted_at").alias("posted_at"),
        F.coalesce("truncated", F.lit(False)).alias("truncated"), F.coalesce(F.length("description"), F.lit(0)).alias("length"),
    )
    said = cut(own.repartition("_component").sortWithinPartitions("_component", "_id").mapInArrow(run, "_row long, canonical_id long, kept_id long"), "merged")
    kept = said.where("_row is null").select("canonical_id", "kept_id")
    return said.where("_row is not null").select(F.col("_row").alias(row_id), "canonical_id").join(_small(kept), "canonical_id").select(row_id, "canonical_id", "kept_id")
