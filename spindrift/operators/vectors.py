"""Cosine similarity: Columns for single pairs, block kernels for searches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.text import let


def dot(a: Column, b: Column) -> Column:
    """V1: cosine of unit vectors, summed in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """A vector scaled to length 1; null for a zero vector."""
    return let(norm(a), lambda n: F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)))


def cosine(a: Column, b: Column) -> Column:
    """V2."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


#: Rows of a query set that are broadcast at most, and rows of either side that
#: meet in a task when a larger one is joined in parts.
QUERIES, SIDE = 20_000, 50_000
#: Similarities that a task holds at once.
_HELD = 4_000_000
#: Similarities are compared by so many decimals, so equal vectors tie whatever
#: the order of summation.
DECIMALS = 9


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of a column of arrays, and which rows have one."""
    rows = column.to_pylist()
    size = next((len(v) for v in rows if v), 0)
    out, good = np.zeros((len(rows), size)), np.zeros(len(rows), dtype=bool)
    for i, v in enumerate(rows):
        if v is not None and len(v) == size and size and None not in v:
            out[i] = v
            good[i] = bool(np.isfinite(out[i]).all() and out[i].any())
    out[good] /= np.linalg.norm(out[good], axis=1, keepdims=True)
    return out, good


def _best(queries: np.ndarray, items: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(queries, ids, similarities) of the k best items of each query; of equal
    ones the least id."""
    step = max(1, _HELD // max(1, len(items)))
    for first in range(0, len(queries), step):
        near = np.round(queries[first : first + step] @ items.T, DECIMALS)
        if near.shape[1] > k:
            least = np.partition(near, near.shape[1] - k, axis=1)[:, -k]
            q, at = np.nonzero(near >= least[:, None])
        else:
            q, at = (x.ravel() for x in np.indices(near.shape))
        order = np.lexsort([ids[at], -near[q, at], q])
        q, at = q[order], at[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        q, at = q[place < k], at[place < k]
        yield q + first, ids[at], near[q, at]


_PAIR = "query_id long, item_id long, similarity double"


def _pairs(query_ids: np.ndarray, found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for q, ids, near in found:
        yield pa.RecordBatch.from_arrays([pa.array(query_ids[q]), pa.array(ids), pa.array(near)], names=["query_id", "item_id", "similarity"])


def _side(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    matrix, good = _matrix(table.column("vector"))
    return table.column(name).to_numpy()[good], matrix[good]


def _met(k: int) -> Callable:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        (query_ids, queries), (ids, items) = _side(left, "query_id"), _side(right, "item_id")
        schema = pa.schema([("query_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64())])
        if not len(queries) or not len(items) or queries.shape[1] != items.shape[1]:
            return schema.empty_table()
        return pa.Table.from_batches(list(_pairs(query_ids, _best(queries, items, ids, k))), schema)

    return run


def _in_parts(left: DataFrame, right: DataFrame, group: str, k: int) -> DataFrame:
    """Local best pairs of each group, whose sides are dealt into parts of about
    ``SIDE`` rows; every part of one side meets every part of the other."""

    def dealt(rows: DataFrame, other: DataFrame, key: str, own: str, far: str) -> DataFrame:
        n = rows.groupBy(group).agg(F.ceil(F.count("*") / SIDE).alias("_n"))
        m = other.groupBy(group).agg(F.ceil(F.count("*") / SIDE).alias("_m"))
        rows = rows.join(n, group).join(m, group).withColumn(own, F.pmod(F.xxhash64(key), F.col("_n")))
        rows = rows.withColumn(far, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1)))
        # both sides may come from one table; fresh columns tell them apart
        return rows.select(*(F.col(c).alias(c) for c in (group, key, "vector", own, far)))

    keys = [group, "_a", "_b"]
    a, b = dealt(left, right, "query_id", "_a", "_b"), dealt(right, left, "item_id", "_b", "_a")
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(_met(k), _PAIR)


def nearest(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """T5: exact k nearest items (item_id, model, vector) of each query
    (query_id, model, vector) of the same model: query_id, item_id, similarity,
    rank. Tasks multiply blocks and keep the best k of each query before
    anything is shuffled. Vectors that are null, zero or hold nulls match nothing."""
    queries = queries.select(F.col("query_id").cast("long").alias("query_id"), "model", "vector")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "model", "vector")
    if queries.limit(QUERIES + 1).count() <= QUERIES:
        own: dict[object, tuple[np.ndarray, np.ndarray]] = {}
        asked = queries.toArrow()
        for model in set(asked.column("model").to_pylist()) - {None}:
            own[model] = _side(asked.filter(pc.equal(asked.column("model"), model)), "query_id")
        shared = queries.sparkSession.sparkContext.broadcast(own)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                table = pa.Table.from_batches([batch])
                for model, (query_ids, asked_for) in shared.value.items():
                    ids, matrix = _side(table.filter(pc.equal(table.column("model"), model)), "item_id")
                    if len(ids) and len(query_ids) and matrix.shape[1] == asked_for.shape[1]:
                        yield from _pairs(query_ids, _best(asked_for, matrix, ids, k))

        pairs = items.mapInArrow(run, _PAIR)
    else:
        pairs = _in_parts(queries, items, "model", k)
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "item_id")))
    return ranked.where(F.col("rank") <= k)


def best_over(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """For each row (left_id, group_id, vector) the most similar of
    its group's rows (right_id, group_id, vector), if it is similar enough; of
    equal ones the least id."""
    a = left.select(F.col("left_id").cast("long").alias("query_id"), "group_id", "vector")
    b = right.select(F.col("right_id").cast("long").alias("item_id"), "group_id", "vector")
    pairs = _in_parts(a, b, "group_id", 1).where(F.col("similarity") >= least)
    return pairs.groupBy(F.col("query_id").alias("left_id")).agg(F.max_by(F.struct(F.col("item_id").alias("right_id"), "similarity"), F.struct("similarity", -F.col("item_id"))).alias("b")).select("left_id", "b.*")


def stale_embeddings(rows: DataFrame, model: str) -> DataFrame:
    """V5: rows whose vector is missing, of another model, or of another text
    (embedded_hash against text_hash)."""
    fresh = F.col("vector").isNotNull() & F.col("model").eqNullSafe(F.lit(model)) & F.col("embedded_hash").eqNullSafe(F.col("text_hash"))
    return rows.where(~fresh)


# The hash's beginning and factor.
_FNV_START, _FNV_PRIME = 2166136261, 16777619
_WORD = r"[^a-z0-9+#.]+"


def word_hashes(words: list[str]) -> np.ndarray:
    """32-bit FNV-1a hashes of words of a-z0-9+#., all at once by their places."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    h = np.full(len(words), _FNV_START, dtype=np.uint64)
    data = np.frombuffer("".join(words).encode("ascii"), dtype=np.uint8).astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    for i in range(int(sizes.max()) if len(sizes) else 0):
        live = np.flatnonzero(sizes > i)
        h[live] = ((h[live] ^ data[starts[live] + i]) * np.uint64(_FNV_PRIME)) & np.uint64(0xFFFFFFFF)
    return h


#: Texts whose words ``embed`` has as numbers at once, whatever Arrow's batches are.
_TEXTS = 512


def embed(rows: DataFrame, key: str, size: int = 384, cap: int = 2000) -> DataFrame:
    """SC23, V3, V4: signed hashed bag-of-words unit vectors of texts (key,
    text), a batch at a time: key, vector, deferred.

    Of a text with single blanks the first ``cap`` characters count; its words
    are runs of a-z0-9+#. in lower case, two characters at least. A word adds 1
    or, if its hash is even, -1 to the slot of its hash. A text that is null or
    has no words keeps a null vector and is deferred to a later run; words that
    cancel out give the zero vector."""
    words = F.split(F.lower(F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, cap)), _WORD)
    asked = rows.select(key, F.coalesce(F.filter(words, lambda w: F.length(w) > 1), F.array().cast("array<string>")).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, _TEXTS) for whole in batches for at in range(0, whole.num_rows, _TEXTS)):
            lists = batch.column("words")
            coded = lists.flatten().dictionary_encode()
            hashes = word_hashes(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.uint64)
            edges = lists.offsets.to_numpy().astype(np.int64)
            edges = edges - edges[0]
            slots, signs = (hashes % np.uint64(size)).astype(np.int64), np.where(hashes & np.uint64(1), 1.0, -1.0)
            out: list[np.ndarray | None] = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                sums = np.bincount(slots[a:b], signs[a:b], size) if b > a else None
                out.append(None if sums is None else sums / (np.linalg.norm(sums) or 1))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(out, pa.list_(pa.float64())), pa.array([v is None for v in out])], names=[key, "vector", "deferred"])

    kind = rows.schema[key].dataType.simpleString()
    return asked.mapInArrow(run, f"{key} {kind}, vector array<double>, deferred boolean")
