"""Cosine similarity join of embeddings by epsilon grid order.

Unit vectors of cosine c lie sqrt(2 - 2c) = eps apart. Vectors are projected on
leading principal directions, which never lengthens a distance, and sorted by
their grid cells of side eps there. Runs of that order are blocks of ``BLOCK``
vectors however many there are. Intervals of blocks are joined recursively as a
table: pairs of intervals whose boxes are within eps go on to their parts, down
to blocks. Near blocks meet in tasks, a few neighbouring ones on either side of
each, where intervals are halved until they are provably distant or small
enough to multiply.

Equal vectors are one class throughout; a task returns sums of links and a
spanning forest, so copies and dense groups never become lists of pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.operators.stars import send, star_edges
from spindrift.llm.workspace import cut

#: The principal directions are fitted on about so many vectors, by hash.
#: Any directions give right results; these only decide how much is skipped.
SAMPLE = 10_000
DIRECTIONS = 6
#: Vectors in a block; a task holds ``SIDE`` blocks on either side at most.
BLOCK, SIDE = 8192, 8
#: Parts of an interval in the recursion over blocks.
FAN = 16
#: (block, task) rows that may be broadcast; more are joined by shuffle.
BROADCAST_ROWS = 500_000
_LEAF = 512
_SLACK = 1e-9


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, dim (0: links with nothing), digest, raw."""
    for batch in batches:
        dims, digests, raws = [], [], []
        column = batch.column("embedding")
        values = column.values if isinstance(column, (pa.ListArray, pa.LargeListArray)) else None
        offsets = column.offsets.to_numpy()
        flat = values.to_numpy(zero_copy_only=False)
        holes = np.asarray(values.is_null().to_numpy(zero_copy_only=False), dtype=bool) if values.null_count else None
        null = column.is_null().to_pylist()
        ids = batch.column("vec_id").is_null().to_pylist()
        for i in range(batch.num_rows):
            a, b = offsets[i], offsets[i + 1]
            own = flat[a:b]
            if null[i] or ids[i] or a == b or (holes is not None and holes[a:b].any()) or not np.isfinite(own).all() or not own.any():
                dims.append(0)
                digests.append(None)
                raws.append(None)
                continue
            raw = (own.astype(np.float64) + 0.0).tobytes() if own.dtype == np.float64 else (own + np.float32(0)).tobytes()
            dims.append(b - a)
            digests.append(hashlib.blake2b(raw, digest_size=16).digest())
            raws.append(raw)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(dims, pa.int32()), pa.array(digests, pa.binary()), pa.array(raws, pa.binary())], names=["vec_id", "dim", "digest", "raw"])


def _unit(raws: list[bytes], kind: str) -> np.ndarray:
    wide = np.frombuffer(b"".join(raws), dtype=kind).reshape(len(raws), -1).astype(np.float64)
    wide = wide / np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def _project(kind: str, directions: np.ndarray, eps: float) -> Callable:
    k = directions.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at = _unit(batch.column("raw").to_pylist(), kind) @ directions
            cells = np.floor(at / eps).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.ascontiguousarray(at[:, j])) for j in range(k)), *(pa.array(np.ascontiguousarray(cells[:, j])) for j in range(k))], names=[*batch.schema.names, *(f"p{j}" for j in range(k)), *(f"g{j}" for j in range(k))])

    return run


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of the partition and of the row in it."""
    part, place = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * n, pa.int32()), pa.array(np.arange(place, place + n))], names=[*batch.schema.names, "part", "place"])
        place += n


class _Forest:
    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Link a[i] with b[i]; only pairs of different trees cost a step."""
        up = self.up
        while (up[up] != up).any():
            up[:] = up[up]
        x, y = up[a], up[b]
        some = x != y
        for p, q in np.unique(np.stack([x[some], y[some]], axis=1), axis=0).tolist():
            p, q = self.root(p), self.root(q)
            if p != q:
                up[max(p, q)] = min(p, q)


def interval_join(unit: np.ndarray, at: np.ndarray, copies: np.ndarray, one: tuple[int, int], two: tuple[int, int], cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (weighted by copies) and trees between two intervals of vectors in
    grid order; the same interval twice joins it with itself."""
    eps2 = 2 - 2 * cosine + _SLACK
    links, forest = np.zeros(len(unit), dtype=np.int64), _Forest(len(unit))
    boxes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def box(part: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        if part not in boxes:
            own = at[part[0] : part[1]]
            boxes[part] = own.min(axis=0), own.max(axis=0)
        return boxes[part]

    def halves(part: tuple[int, int]) -> list[tuple[int, int]]:
        middle = part[0] + max(_LEAF, (part[1] - part[0]) // 2 // _LEAF * _LEAF)
        return [(part[0], middle), (middle, part[1])]

    todo = [(one, two)]
    while todo:
        a, b = todo.pop()
        if a[0] >= a[1] or b[0] >= b[1]:
            continue
        if a != b:
            (low, high), (least, most) = box(a), box(b)
            gap = np.maximum(0, np.maximum(low - most, least - high))
            if gap @ gap > eps2:
                continue
        long_a, long_b = a[1] - a[0] > _LEAF, b[1] - b[0] > _LEAF
        if long_a and a == b:
            left, right = halves(a)
            todo += [(left, left), (left, right), (right, right)]
        elif long_a and (not long_b or a[1] - a[0] >= b[1] - b[0]):
            todo += [(x, b) for x in halves(a)]
        elif long_b:
            todo += [(a, x) for x in halves(b)]
        else:
            dots = unit[a[0] : a[1]] @ unit[b[0] : b[1]].T
            near = dots >= cosine
            for i, j in zip(*np.nonzero(np.abs(dots - cosine) <= _SLACK), strict=True):
                x, y = unit[a[0] + i], unit[b[0] + j]
                near[i, j] = np.dot(x, y) / np.sqrt(np.dot(x, x) * np.dot(y, y)) >= cosine
            if a == b:
                np.fill_diagonal(near, False)
            if not near.any():
                continue
            links[a[0] : a[1]] += near @ copies[b[0] : b[1]]
            if a != b:
                links[b[0] : b[1]] += copies[a[0] : a[1]] @ near
            i, j = np.nonzero(near)
            forest.join(i + a[0], j + b[0])
    while (forest.up[forest.up] != forest.up).any():
        forest.up = forest.up[forest.up]
    return links, forest.up


def _join(kind: str, directions: np.ndarray, side: int, cosine: float) -> Callable:
    def run(group: pa.Table) -> pa.Table:
        group = group.take(pa.array(np.argsort(group.column("rank").to_numpy())))
        ids, far = group.column("node").to_numpy(), group.column("block").to_numpy() // side
        unit = _unit(group.column("raw").to_pylist(), kind)
        middle, n = int(np.searchsorted(far, far[0], "right")), len(far)
        one, two = ((0, n), (0, n)) if middle == n else ((0, middle), (middle, n))
        links, up = interval_join(unit, unit @ directions, group.column("copies").to_numpy(), one, two, cosine)
        some = links > 0
        return pa.table({"node": ids[some], "links": links[some], "root": ids[up[some]]})

    return run


def near_blocks(boxes: DataFrame, blocks: int, k: int, eps: float) -> DataFrame:
    """Pairs (one <= two) of blocks whose boxes (block, a*: least, b*: most
    coordinates) are within ``eps``: intervals of blocks are joined from the
    whole sequence down, and distant ones are left out with all their parts."""
    sizes = [1]
    while sizes[-1] < blocks:
        sizes.append(sizes[-1] * FAN)
    pairs = boxes.sparkSession.createDataFrame([(0, 0)], "one long, two long")
    for above, size in zip(reversed(sizes), [*reversed(sizes[:-1])] or [1], strict=False):
        parts = boxes.groupBy(F.floor(F.col("block") / size).alias("at")).agg(*(F.min(f"a{j}").alias(f"a{j}") for j in range(k)), *(F.max(f"b{j}").alias(f"b{j}") for j in range(k)))
        parts = parts.withColumn("up", F.floor(F.col("at") / (above // size)))
        left, right = (parts.select(F.col("up").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in parts.columns if c != "up")) for name in ("one", "two"))
        gap = [F.greatest(F.lit(0.0), F.col(f"one_a{j}") - F.col(f"two_b{j}"), F.col(f"two_a{j}") - F.col(f"one_b{j}")) for j in range(k)]
        pairs = pairs.join(left, "one").join(right, "two").where("one_at <= two_at").where(sum(g * g for g in gap) <= eps * eps + _SLACK).select(F.col("one_at").alias("one"), F.col("two_at").alias("two"))
    return pairs


def _links(classes: DataFrame, dim: int, kind: str, cosine: float) -> DataFrame:
    """node, links, root of the classes of one dimension."""
    spark = classes.sparkSession
    classes = classes.where(F.col("dim") == dim).select("node", "copies", "raw")
    n = classes.count()
    eps = float(np.sqrt(2 - 2 * cosine))
    part = -(-n // SAMPLE)
    sample = _unit([bytes(r["raw"]) for r in classes.where(F.pmod(F.xxhash64("raw"), F.lit(part)) == 0).select("raw").limit(2 * SAMPLE).collect()] or [np.ones(dim, kind).tobytes()], kind)
    values, vectors = np.linalg.eigh(np.cov(sample, rowvar=False).reshape(dim, dim) if len(sample) > 1 else np.eye(dim))
    directions = np.ascontiguousarray(vectors[:, np.argsort(-values, kind="stable")[: min(DIRECTIONS, dim)]])
    k = directions.shape[1]
    cells, columns = [f"g{j}" for j in range(k)], ["node", "copies", "raw", *(f"p{j}" for j in range(k))]
    types = "node long, copies long, raw binary, " + ", ".join(f"p{j} double" for j in range(k))
    ordered = classes.mapInArrow(_project(kind, directions, max(eps, 1e-6)), types + "".join(f", {c} int" for c in cells)).repartitionByRange(-(-n // BLOCK), *cells, "node").sortWithinPartitions(*cells, "node")
    placed = cut(ordered.select(columns).mapInArrow(_placed, types + ", part int, place long"), "placed")

    # one row a partition: ranks go on from one to the next
    before, base = 0, []
    for row in placed.groupBy("part").count().orderBy("part").collect():
        base.append((row["part"], before))
        before += row["count"]
    rank = placed.join(F.broadcast(spark.createDataFrame(base, "part int, base long")), "part").withColumn("rank", F.col("base") + F.col("place")).withColumn("block", F.floor(F.col("rank") / BLOCK))
    blocks = -(-n // BLOCK)
    boxes = cut(rank.groupBy("block").agg(*(F.min(f"p{j}").alias(f"a{j}") for j in range(k)), *(F.max(f"p{j}").alias(f"b{j}") for j in range(k))), "boxes")
    side = max(1, min(SIDE, blocks // 32))
    pairs = near_blocks(boxes, blocks, k, eps).withColumn("task_one", F.floor(F.col("one") / side)).withColumn("task_two", F.floor(F.col("two") / side))
    sides = cut(pairs.select(F.explode(F.array("one", "two")).alias("block"), "task_one", "task_two").distinct(), "sides")
    few = F.broadcast(sides) if sides.count() <= BROADCAST_ROWS else sides
    meet = rank.select("node", "copies", "raw", "rank", "block").join(few, "block")
    return meet.groupBy("task_one", "task_two").applyInArrow(_join(kind, directions, side, cosine), "node long, links long, root long")


def linked_vectors(vectors: DataFrame, cosine: float = 0.9) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): vec_id, n_links
    (other vectors of cosine >= ``cosine``, in double precision), component_id
    (least vec_id reachable over links), kept.

    A vector that is null, empty, all zero, or holds a null, NaN or infinity
    links with nothing; so does one without a vec_id. Vectors of different
    length don't link. Equal vectors link; rows that repeat a vec_id are
    vectors of their own. No rows in, no rows out; other columns are ignored.
    """
    element = vectors.schema["embedding"].dataType.elementType.typeName()
    if element not in ("float", "double"):
        vectors = vectors.withColumn("embedding", F.col("embedding").cast("array<double>"))
    kind = "<f4" if element == "float" else "<f8"
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    read = cut(vectors.mapInArrow(_read, "vec_id long, dim int, digest binary, raw binary"), "vectors")
    # a class is a node of its own, whatever ids its vectors have
    classes = read.where("dim > 0").groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("dim").alias("dim"), F.first("raw").alias("raw"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    found = None
    for row in classes.select("dim").distinct().collect():
        links = _links(classes, row["dim"], kind, cosine)
        found = links if found is None else found.union(links)
    if found is None:
        return read.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = cut(found, "links")
    stars = star_edges(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked = classes.select("digest", "node", "rep", "copies").join(sums, "node", "left").join(stars.withColumnRenamed("u", "node"), "node", "left").where("copies > 1 or links > 0")
    linked = cut(linked.select("digest", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("v", "node").alias("root")), "linked")
    least = linked.groupBy("root").agg(F.min("rep").alias("c"), F.count("*").alias("classes"))
    out = send(linked, least, "root", "classes", linked.count()).select("digest", "n", "c")
    out = read.select("vec_id", "digest").join(out, "digest", "left")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
