"""SC7, SC8: made-up postings as a data source of Spark, batch and stream.

    spark.dataSource.register(SyntheticPostings)
    spark.read.format("synthetic_postings").option("rows", 10**6).load()

Postings are numbered; partitions are ranges of numbers, and the cursor of a
stream is the number up to which it has read, so a restart goes on there.
With the option ``pushdown`` comparisons of ``number`` are pushed into the
ranges; the session must then have ``spark.sql.python.filterPushdown.enabled``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "number long, provider string, external_id string, title string, company string, location string, description string, posted_at timestamp"
TITLES = ["Data Engineer", "React Developer", "Platform Engineer", "QA Analyst", "ML Engineer"]
CITIES = ["Bengaluru", "Pune", "Remote, India", "Hyderabad"]
#: Postings made at a time.
_PAGE = 10_000


class Range(InputPartition):
    """Postings first <= number < last."""

    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


def ranges(first: int, last: int, parts: int) -> list[Range]:
    """A range in so many parts, none of them empty."""
    edges = np.linspace(first, max(first, last), max(1, min(parts, last - first)) + 1).astype(np.int64)
    return [Range(int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]


def made(part: Range) -> Iterator[pa.RecordBatch]:
    """Postings of a range; every sixth nearly repeats the one before it."""
    for first in range(part.first, part.last, _PAGE):
        number = np.arange(first, min(first + _PAGE, part.last))
        k = number - (number % 6 == 5)
        pick = lambda names, at: pa.array(names).take(pa.array(at))
        text = [f"Posting {a}: 2-4 years of SQL and Spark." + ("" if a == b else "  Apply!") for a, b in zip(k.tolist(), number.tolist(), strict=True)]
        columns = [
            pa.array(number), pa.array(["synthetic"] * len(number)), pa.array([f"s{i}" for i in number.tolist()]), pick(TITLES, k % 5), pa.array([f"Company {i}" for i in (k % 40).tolist()]), pick(CITIES, k % 4),
            pa.array(text), pa.array((1_700_000_000 + k * 3600) * 1_000_000, pa.timestamp("us", "UTC")),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])


class _Options:
    def __init__(self, options) -> None:
        self.rows, self.parts = int(options.get("rows", 1000)), int(options.get("parts", 8))
        if self.rows < 0 or self.parts < 1:
            raise ValueError("rows must not be negative, parts must be 1 at least")


class SyntheticReader(DataSourceReader):
    def __init__(self, options: _Options) -> None:
        self.first, self.last, self.parts = 0, options.rows, options.parts

    def partitions(self) -> list[Range]:
        return ranges(self.first, self.last, self.parts) or [Range(0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return made(partition)


class PushedReader(SyntheticReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if getattr(f, "attribute", None) != ("number",):
                yield f
            elif isinstance(f, EqualTo):
                self.first, self.last = max(self.first, f.value), min(self.last, f.value + 1)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.first = max(self.first, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                self.last = min(self.last, f.value + isinstance(f, LessThanOrEqual))
            else:
                yield f


class SyntheticStream(DataSourceStreamReader):
    def __init__(self, options: _Options) -> None:
        self.options = options

    def initialOffset(self) -> dict:  # noqa: N802
        return {"number": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"number": self.options.rows}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return ranges(start["number"], end["number"], self.options.parts)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return made(partition)


class SyntheticPostings(DataSource):
    """Options: rows (1000), parts (8), pushdown (false)."""

    @classmethod
    def name(cls) -> str:
        return "synthetic_postings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SyntheticReader:
        return (PushedReader if self.options.get("pushdown", "false").lower() == "true" else SyntheticReader)(_Options(self.options))

    def streamReader(self, schema) -> SyntheticStream:  # noqa: N802
        return SyntheticStream(_Options(self.options))
