"""Near-duplicate documents: MinHash banding, signatures, exact confirmation.

1. One pass turns each text into its set of word shingles and keeps a 128-bit
   hash of the set, band keys of ``bands * rows`` universal hash minima, and a
   short signature. Documents of equal sets form a class from here on.
2. Documents that share a band key with another are linked to the least
   document of that key, unconfirmed; large-star / small-star gives clusters.
   Two documents over the threshold share a key but with a chance under 1e-5
   at the threshold itself and far less above it.
3. Inside a cluster, signatures and then full sets confirm links. A cluster of
   more than ``chunk`` documents, or ``CHUNK_BYTES`` of sets, is dealt into
   chunks; then the documents that
   have not joined the cluster's main component meet every chunk, so no pair
   of different components is left untested and no task holds a whole group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm import textkernels as K
from spindrift.operators.stars import send, star_edges
from spindrift.llm.workspace import cut

#: Bytes of minima that a signature holds, and how many must agree at least.
#: At a similarity of 0.8 fewer agree with a chance under 1e-7.
SIGNATURE, AGREE = 64, 32
#: Up to so many rows (of about 120 bytes) a table of cluster members may be broadcast.
BROADCAST_ROWS = 200_000
#: Bytes of full sets in a chunk of a cluster, on average; a task holds two chunks.
CHUNK_BYTES = 32 << 20
_BLOCK = 512


class Sketcher:
    """Minima of ``bands * rows`` multiply-add hash functions on 64 bits."""

    def __init__(self, bands: int, rows: int, seed: int = 11) -> None:
        n = bands * rows
        if n < SIGNATURE:
            raise ValueError(f"bands * rows must be {SIGNATURE} at least")
        self.bands, self.rows = bands, rows
        self.a, self.b = (K.keyed(seed, n) | K.U64(1))[:, None], K.keyed(seed + 1, n)[:, None]
        self.weights = K.keyed(seed + 2, rows) | K.U64(1)
        self.number = K.keyed(seed + 3, bands)
        self.room = np.empty((n, _BLOCK), dtype=K.U64)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(len(self.a), 2**64 - 1, dtype=K.U64)
        for first in range(0, len(shingles), _BLOCK):
            part = shingles[first : first + _BLOCK]
            room = self.room[:, : len(part)]
            np.multiply(self.a, part, out=room)
            np.add(room, self.b, out=room)
            np.minimum(least, room.min(axis=1), out=least)
        return least

    def keys(self, minima: np.ndarray) -> np.ndarray:
        return K.fmix((minima.reshape(self.bands, self.rows) * self.weights).sum(axis=1, dtype=K.U64) ^ self.number).view(np.int64)


_SKETCH = "doc_id long, n_shingles long, c1 long, c2 long, signature binary, keys array<long>"


def _sketch(size: int, bands: int, rows: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(bands, rows)
        for batch in batches:
            n, c1, c2 = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            signatures: list[bytes | None] = [None] * batch.num_rows
            keys: list[np.ndarray | None] = [None] * batch.num_rows
            for i, _, words in K.text_words(batch.column("text"), lower=True):
                if len(words):
                    x = K.distinct(K.windows(words, size))
                    minima = sketcher.minima(x)
                    n[i] = len(x)
                    c1[i], c2[i] = (int(K.fmix(x ^ K.U64(salt)).sum(dtype=K.U64).view(np.int64)) for salt in (0x5BD1E995, 0x1B873593ABCDEF))
                    signatures[i] = (minima[:SIGNATURE] >> K.U64(32)).astype(np.uint8).tobytes()
                    keys[i] = sketcher.keys(minima)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(c1), pa.array(c2), pa.array(signatures, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "c1", "c2", "signature", "keys"])

    return run


def _sets(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: list[bytes] = [b""] * batch.num_rows
            for i, _, words in K.text_words(batch.column("text"), lower=True):
                sets[i] = K.distinct(K.windows(words, size)).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "signature", "cluster", "parts")] + [pa.array(sets, pa.binary())], names=["doc_id", "signature", "cluster", "parts", "shingles"])

    return run


def confirm(sets: list[np.ndarray], signatures: np.ndarray, label: np.ndarray, percent: int) -> np.ndarray:
    """Final labels of a group: documents of different labels are compared until
    every document outside the largest component has met all that were not yet
    in its own. Linked: 100 * intersection >= percent * union."""
    label, n = label.copy(), len(sets)
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    used = np.zeros(n, dtype=bool)
    while True:
        names, at, counts = np.unique(label, return_inverse=True, return_counts=True)
        if len(names) < 2:
            return label
        free = np.flatnonzero(~used & (at != counts.argmax()))
        if not len(free):
            return label
        pivot = free[counts[at[free]].argmin()]
        used[pivot] = True
        low, high = np.minimum(sizes, sizes[pivot]), np.maximum(sizes, sizes[pivot])
        near = np.flatnonzero((label != label[pivot]) & (100 * low >= percent * high))
        near = near[(signatures[near] == signatures[pivot]).sum(axis=1) >= AGREE]
        if not len(near):
            continue
        own = sets[pivot]
        others = np.concatenate([sets[i] for i in near])
        place = np.searchsorted(own, others)
        place[place == len(own)] = 0
        shared = np.add.reduceat((own[place] == others).astype(np.int64), np.concatenate([[0], np.cumsum(sizes[near])[:-1]]))
        linked = near[100 * shared >= percent * (sizes[near] + sizes[pivot] - shared)]
        if len(linked):
            joined = np.unique(np.append(label[linked], label[pivot]))
            label[np.isin(label, joined)] = joined[0]


def _links(percent: int) -> Callable:
    def run(group: pa.Table) -> pa.Table:
        ids = group.column("doc_id").to_numpy()
        sets = [np.frombuffer(x, dtype=K.U64) for x in group.column("shingles").to_pylist()]
        signatures = np.frombuffer(b"".join(group.column("signature").to_pylist()), dtype=np.uint8).reshape(len(ids), SIGNATURE)
        label = group.column("label").to_numpy()
        final = confirm(sets, signatures, label, percent)
        changed = (final != label) | (ids != label)
        return pa.table({"u": np.concatenate([ids[changed], label[changed]]), "v": np.concatenate([label[changed], final[changed]])})

    return run


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, bands: int = 40, rows: int = 6, chunk: int = 1024) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles,
    component_id (the least doc_id reachable over links), kept.

    Two documents are linked if the Jaccard similarity of their sets of
    ``shingle_words`` word shingles is at least ``percent`` / 100. A shorter
    text has its whole word sequence as its one shingle. A text that is null or
    has no words has an empty set and no links. A null doc_id has no links and
    a null component. Rows that repeat a doc_id each get a row. No rows in, no
    rows out; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = cut(docs.mapInArrow(_sketch(shingle_words, bands, rows), _SKETCH), "sketch")
    some = sketch.where("n_shingles > 0 and doc_id is not null")
    classes = some.groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "n_shingles", "signature", "keys")).alias("r"), F.count("*").alias("copies"))
    classes = cut(classes.select("c1", "c2", "copies", "r.*"), "classes")

    banded = classes.select(F.col("doc_id").alias("u"), F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.min("u").alias("v"), F.count("*").alias("n")).where("n > 1")
    clusters = star_edges(send(banded, shared, "key", "n", bands * classes.count()).where("u <> v").select("u", "v"))

    found = _confirmed(docs, classes, clusters, shingle_words, percent, chunk)
    changed = classes.join(found.withColumnRenamed("u", "doc_id"), "doc_id", "left").where("copies > 1 or v is not null").select("c1", "c2", F.coalesce("v", "doc_id").alias("found"))
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("found"))
    return sketch.drop("signature", "keys").join(changed, ["c1", "c2"], "left").select("doc_id", "n_shingles", F.coalesce(component, "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _confirmed(docs: DataFrame, classes: DataFrame, clusters: DataFrame, size: int, percent: int, chunk: int) -> DataFrame:
    """Stars (u, v) over confirmed links between the classes of each cluster."""
    members = clusters.unionByName(clusters.select(F.col("v").alias("u"), "v").distinct()).select(F.col("u").alias("doc_id"), F.col("v").alias("cluster"))
    members = cut(members.join(classes.select("doc_id", "n_shingles", "signature"), "doc_id"), "members")
    counts = members.groupBy("cluster").agg(F.count("*").alias("n"), F.ceil(F.greatest(F.count("*") / chunk, F.sum("n_shingles") * 8 / CHUNK_BYTES)).alias("parts"))
    n = members.count()
    if not n:
        return clusters
    members = send(members.drop("n_shingles"), counts, "cluster", "n", n).drop("n")
    few = F.broadcast(members) if n <= BROADCAST_ROWS else members
    sets = cut(docs.join(few, "doc_id").mapInArrow(_sets(size), "doc_id long, signature binary, cluster long, parts long, shingles binary"), "sets")
    parts = F.col("parts")
    sets = sets.withColumn("part", F.when(parts > 1, F.pmod(F.xxhash64("doc_id"), parts)).otherwise(0))
    links = _links(percent)
    first = star_edges(sets.withColumn("label", F.col("doc_id")).groupBy("cluster", "part").applyInArrow(links, "u long, v long"))
    large = sets.where(parts > 1)
    if large.isEmpty():
        return first

    large = large.join(first.withColumnRenamed("u", "doc_id"), "doc_id", "left").select(*large.columns, F.coalesce("v", "doc_id").alias("label"))
    large = cut(large, "large")
    sizes = large.groupBy("cluster", "label").agg(F.count("*").alias("count"), F.sum(F.octet_length("shingles")).alias("bytes"))
    largest = F.struct("count", "label")
    apart = F.greatest((F.sum("count") - F.max("count")) / chunk, (F.sum("bytes") - F.max_by("bytes", largest)) / CHUNK_BYTES)
    main = sizes.groupBy("cluster").agg(F.max_by("label", largest).alias("main"), F.ceil(apart).alias("lots"), F.sum("count").alias("n"))
    large = send(large, main, "cluster", "n", large.count()).drop("n").where("lots > 0")
    apart = large.where("label <> main")
    lots = F.col("lots")
    every = large.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), lots - 1))).withColumn("far", F.lit(0))
    again = apart.withColumn("lot", F.pmod(F.xxhash64("doc_id", F.lit(1)), lots)).withColumn("own", F.col("part")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).where("part <> own").drop("own").withColumn("far", F.lit(1))
    second = every.unionByName(again).groupBy("cluster", "part", "lot").applyInArrow(links, "u long, v long")
    return star_edges(first.union(second))


def keep_one(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose document is the least of its component, with
    all their columns. Of rows that repeat a doc_id, all stay or all go; rows
    without a doc_id stay."""
    found = near_duplicates(docs, shingle_words, percent)
    gone = found.where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
