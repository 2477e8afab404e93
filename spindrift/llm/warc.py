"""WARC archives and their external index.

Archives are written by Spark's own text writer (records end in CR LF CR LF),
so they may lie in any store that Spark reaches. Reading parses each file by
its Content-Length fields. The index of each file is sorted where it is read
(a run); runs are cut at sampled bounds of (URL key, timestamp, page), and a
loser tree merges the parts of all runs between two bounds, which gives
globally ordered capture histories even where one URL has most captures.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.workspace import cut, fresh

#: Payloads of fewer bytes are always stored.
LEAST_BYTES = 100
#: Records and bytes of payload in one archive file at most.
RECORDS, FILE_BYTES = 1000, 256 << 20
#: Revisits (rows of about 100 bytes) that are broadcast at most, so that pages
#: need not be shuffled; more of them are joined by shuffle.
BROADCAST_ROWS = 300_000
#: First capture's time; the capture of page n is n modulo SPAN seconds later,
#: so every date has a year of four digits and sorts as text.
EPOCH, SPAN = 1_704_067_200, 1 << 37
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_END = "\r\n"


class LoserTree:
    """Merges k sorted iterables; a replay from a leaf to the root finds the
    next least in log2(k) comparisons. Equal keys come in order of the runs."""

    def __init__(self, runs: Iterable[Iterable], key: Callable) -> None:
        self.runs, self.key = [iter(r) for r in runs], key
        self.k = len(self.runs)
        self.heads: list = [None] * self.k
        self.keys: list = [None] * self.k
        for i in range(self.k):
            self._step(i)
        self.losers = [-1] * max(1, self.k)
        for i in range(self.k):
            self._replay(i)

    def _step(self, i: int) -> None:
        self.heads[i] = next(self.runs[i], None)
        self.keys[i] = None if self.heads[i] is None else self.key(self.heads[i])

    def _before(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _replay(self, leaf: int) -> None:
        winner, at = leaf, (leaf + self.k) // 2
        while at:
            other = self.losers[at]
            if other < 0:
                self.losers[at] = winner
                return
            if self._before(other, winner):
                self.losers[at], winner = winner, other
            at //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator:
        while self.k and self.keys[best := self.losers[0]] is not None:
            head = self.heads[best]
            self._step(best)
            self._replay(best)
            yield head


def url_key(url: str | None) -> str:
    """Sort-friendly key: reversed host, then path and query; scheme, leading
    www., port and fragment dropped, lower case."""
    found = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)(?::\d+)?([^#]*)", url or "")
    host = found[1].lower().removeprefix("www.").split(".")
    return ",".join(reversed(host)) + ")" + (found[2].lower() or "/")


def records(pages: DataFrame) -> DataFrame:
    """page_id, record_type, refers_to and the record text of every page."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumn("bytes", F.octet_length("html").cast("long")).withColumn("digest", F.sha2("html", 256))
    long = pages.where(F.col("bytes") >= LEAST_BYTES).where("page_id is not null").select("page_id", "digest")
    # grouped by a second key so that the join has exchanges of its own, which adaptive execution can split
    firsts = long.groupBy("digest", F.xxhash64("digest").alias("_h")).agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n", "_h")
    again = cut(long.join(firsts, "digest").where("page_id <> refers_to").distinct(), "revisits")
    few = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    pages = pages.join(few, ["page_id", "digest"], "left")
    kind = F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")
    time = F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(SPAN))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    uri = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    block = F.when(kind == "response", F.concat(F.lit(_HTTP), "html")).otherwise(F.lit(_HTTP))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">\r\nWARC-Date: "), time,
        F.lit("\r\nWARC-Target-URI: "), uri, F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(kind == "revisit", F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">\r\nX-Payload-Length: "), F.col("bytes").cast("string"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block, F.lit("\r\n"),
    )
    return pages.select("page_id", F.col("refers_to"), kind.alias("record_type"), header.alias("record"))


def write(pages: DataFrame, path: str) -> None:
    """Write one record per row of ``pages`` (page_id, url, html) into archives
    under ``path``; a null html is an empty payload, a null url an empty URI, a
    null page_id "none". Rows that repeat a page_id share a record id unless
    their payloads differ in kind. No rows give archives without records."""
    largest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 1
    count = max(1, min(RECORDS, FILE_BYTES // largest))
    records(pages).select("record").write.option("lineSep", _END).option("maxRecordsPerFile", count).text(path)


def parse(data: memoryview) -> Iterator[tuple[dict[str, str], int, int, bytes]]:
    """(headers, offset, length, block) of the records of one archive."""
    at, whole = 0, bytes(data)
    while at < len(whole):
        stop = whole.index(b"\r\n\r\n", at)
        lines = whole[at:stop].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        begin = stop + 4
        end = begin + int(headers["Content-Length"])
        if whole[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at {at} does not end")
        yield headers, at, end + 4 - at, whole[begin:end]
        at = end + 4


def _page(value: str) -> int | None:
    number = value.removeprefix("<urn:page:").removesuffix(">")
    return None if number == "none" else int(number)


_RUN = "url_key string, captured string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, record_offset long, record_length long, run long"
_NAMES = [x.split()[0] for x in _RUN.split(", ")]
_ARROW = {"string": pa.string(), "long": pa.int64()}
_SCHEMA = pa.schema([(x.split()[0], _ARROW[x.split()[1]]) for x in _RUN.split(", ")])


def _order(row: tuple) -> tuple:
    return row[0], row[1], -1 if row[2] is None else row[2]


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted run of each archive."""
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            name = path.rsplit("/", 1)[-1]
            run = int.from_bytes(hashlib.blake2b(path.encode(), digest_size=7).digest(), "big")
            rows = []
            for headers, offset, length, block in parse(memoryview(content.as_buffer())):
                kind = headers["WARC-Type"]
                url = headers["WARC-Target-URI"]
                if kind == "response":
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    size, digest, refers = len(payload), hashlib.sha256(payload).hexdigest(), None
                    if "sha256:" + digest != headers["WARC-Payload-Digest"]:
                        raise ValueError(f"{name}: the payload at {offset} does not have its digest")
                else:
                    size, digest, refers = int(headers["X-Payload-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha256:"), _page(headers["WARC-Refers-To"])
                rows.append((url_key(url), headers["WARC-Date"], _page(headers["WARC-Record-ID"]), url, size, digest, kind, refers, name, offset, length, run))
            rows.sort(key=_order)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Loser-tree merge of what a range partition has of each run."""
    runs: dict[int, list[tuple]] = {}
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in _NAMES), strict=True):
            runs.setdefault(row[-1], []).append(row)
    part = TaskContext.get().partitionId()
    merged = iter(LoserTree([runs[r] for r in sorted(runs)], _order))
    place = 0
    while rows := list(islice(merged, 10_000)):
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SCHEMA.types, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int64()), pa.array(range(place, place + len(rows)), pa.int64()), *columns[:-1]], names=["part", "place", *_NAMES[:-1]])
        place += len(rows)


def read_index(spark: SparkSession, path: str, rows_per_part: int = 50_000) -> DataFrame:
    """Captures of the archives under ``path``, in global order of (part,
    place): url_key, captured, page_id, url, payload_bytes, payload_digest,
    record_type, refers_to, archive, record_offset, record_length. Captures of
    one key and date come by page_id, nulls first; a damaged record or payload
    raises ValueError. Archives without records give no rows."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    runs = cut(files.mapInArrow(_index, _RUN), "runs")
    parts = max(1, -(-runs.count() // rows_per_part))
    # within a partition a run's rows need not come in order after the shuffle
    ranged = runs.repartitionByRange(parts, "url_key", "captured", "page_id").sortWithinPartitions("run", "url_key", "captured", F.asc_nulls_first("page_id"))
    return ranged.mapInArrow(_merge, "part long, place long, " + _RUN.rpartition(", ")[0])


def archive_and_index(pages: DataFrame) -> DataFrame:
    """Write the archives of ``pages`` (page_id, url, html) into the shared
    folder and read them back as an index, one row per row of ``pages``.

    Of records with equal payloads of at least 100 bytes, that of the least
    page_id is a response and the others revisit it; smaller ones are all
    responses. A null html is an empty payload, a null url an empty URI. Rows
    that repeat a page_id with the same payload are of the same kind; rows
    without a page_id are responses. No rows in, no rows out; other columns
    are ignored.
    """
    spark = pages.sparkSession
    path = fresh(spark, "warc")
    write(pages, path)
    return read_index(spark, path)
