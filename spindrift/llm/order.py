"""Training-order materialisation: a keyed permutation and fixed-stride shards.

Packed windows are written once as a table, so their numbers can't change
after they are counted. A window's number goes on from split to split without
gaps (prefix sums of the splits' counts); a keyed Feistel permutation of [0, n)
with cycle-walking turns it into its slot in the training order. Ranges of
``per_shard`` slots are the shards, and a manifest beside them tells where a
slot lies.

A shard is one file of records of the same length, in order of slots, so a
reader goes on from any slot by its number. Records are written by Spark's text
writer.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import packing
from spindrift.llm import textkernels as K
from spindrift.llm.tokens import default_vocabulary
from spindrift.llm.workspace import cut, fresh

#: Record: sequence_id, doc_id of its first piece (-1: none), tokens, pieces,
#: CRC-32 of the ids, zero; then the padded ids and a line feed.
HEADER = "<qqIIII"
_HEAD = struct.calcsize(HEADER)
ROUNDS = 6


def stride(size: int, width: int) -> int:
    return _HEAD + size * width + 1


def feistel(values: np.ndarray, domain: int, seed: int) -> np.ndarray:
    """Keyed permutation of [0, domain): a balanced Feistel network on the next
    even number of bits, walked until every value is inside."""
    half = max(1, (max(1, domain - 1).bit_length() + 1) // 2)
    mask, bits = K.U64((1 << half) - 1), K.U64(half)
    keys = K.keyed(seed, ROUNDS)
    out = values.astype(K.U64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> bits, out[todo] & mask
        for key in keys:
            left, right = right, left ^ (K.fmix(right ^ key) & mask)
        out[todo] = (left << bits) | right
        todo = todo[out[todo] >= K.U64(domain)]
    return out


#: Records of a shard at most: some 8 MB of 2048 ids of two bytes, since readers
#: take whole files into memory. Large clusters give ``per_shard`` more.
MOST = 1 << 11
#: Windows that are staged as one row, so that they are compressed together.
_RUN = 64
_STAGED = "split int, place long, first_doc array<long>, n_tokens array<long>, n_pieces array<long>, packed binary"
#: Windows that a task turns into rows at once.
_ROWS = 512
_KINDS = {2: np.dtype("<u2"), 4: np.dtype("<u4")}


def _stage(vocabulary: str, size: int, width: int) -> Callable:
    kind = _KINDS[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple] = []
        squeeze = zstandard.ZstdCompressor(level=3)

        def taken(most: int) -> Iterator[pa.RecordBatch]:
            while ready and len(ready) >= most:
                part = ready[:_RUN]
                del ready[:_RUN]
                numbers, docs, tokens, pieces, ids = zip(*part, strict=True)
                longs = pa.list_(pa.int64())
                columns = [pa.array([numbers[0] // packing.SPLIT], pa.int32()), pa.array([numbers[0] % packing.SPLIT], pa.int64()), *(pa.array([list(x)], longs) for x in (docs, tokens, pieces)), pa.array([squeeze.compress(b"".join(ids))], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["split", "place", "first_doc", "n_tokens", "n_pieces", "packed"])

        def emit(pieces: list[packing.Piece], number: int) -> None:
            ids = np.concatenate([p[3] for p in pieces])
            if width == 2 and ids.max() > 65535:
                raise ValueError("ids do not fit 16 bits")
            ready.append((number, pieces[0][0], len(ids), len(pieces), ids.astype(kind).tobytes()))

        for _ in packing.packed(batches, vocabulary, emit, size):
            yield from taken(_RUN)
        yield from taken(1)

    return run


_PLACED = "sequence_id long, slot long, first_doc long, n_tokens long, n_pieces long, packed binary"


def _slots(windows: int, seed: int, size: int, width: int) -> Callable:
    """Windows of staged rows, each with its number and slot."""
    names = [x.split()[0] for x in _PLACED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, loosen = zstandard.ZstdCompressor(level=6), zstandard.ZstdDecompressor()
        for batch in batches:
            for first, docs, tokens, pieces, packed in zip(*(batch.column(c).to_pylist() for c in ("first", "first_doc", "n_tokens", "n_pieces", "packed")), strict=True):
                ids = memoryview(loosen.decompress(packed, max_output_size=_RUN * size * width))
                ends = np.cumsum(tokens) * width
                own = [squeeze.compress(ids[b - n * width : b]) for n, b in zip(tokens, ends.tolist(), strict=True)]
                numbers = np.arange(first, first + len(tokens))
                yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(feistel(numbers, windows, seed).astype(np.int64)), *(pa.array(x, pa.int64()) for x in (docs, tokens, pieces)), pa.array(own, pa.binary())], names=names)

    return run


def _write(size: int, width: int, pad_id: int) -> Callable:
    kind = _KINDS[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loosen = zstandard.ZstdDecompressor()
        for batch in batches:
            for first in range(0, batch.num_rows, _ROWS):
                part = batch.slice(first, _ROWS)
                records = []
                for number, doc, n, pieces, packed in zip(*(part.column(c).to_pylist() for c in ("sequence_id", "first_doc", "n_tokens", "n_pieces", "packed")), strict=True):
                    ids = np.frombuffer(loosen.decompress(packed, max_output_size=size * width), dtype=kind)
                    padded = np.full(size, pad_id, dtype=kind)
                    padded[:n] = ids
                    head = struct.pack(HEADER, number, -1 if doc is None else doc, n, pieces, zlib.crc32(ids.astype("<u4").tobytes()), 0)
                    records.append(head + padded.tobytes())
                yield pa.RecordBatch.from_arrays([part.column("shard"), pa.array(records, pa.binary())], names=["shard", "record"])

    return run


_MANIFEST = "windows long, per_shard long, shards long, stride long, size int, width int, seed long"


def write_shards(docs: DataFrame, path: str, seed: int = 1, size: int = 2048, width: int = 2, pad_id: int = 0, vocabulary: str | None = None, per_shard: int | None = None) -> dict:
    """Pack ``docs`` (doc_id, text) and write their windows in training order
    under ``path``: ``shards``, one file of ``per_shard`` records each but for
    the last, and ``manifest``, which is returned.

    A null or empty text is its end id alone; a null doc_id is -1 in a record.
    Rows that repeat a doc_id are documents of their own. No rows give no
    shards and a manifest of 0 windows; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    staged = cut(docs.mapInArrow(_stage(vocabulary or default_vocabulary(), size, width), _STAGED), "windows")
    # one row a split: numbers go on from one split to the next
    windows, base = 0, []
    for row in staged.groupBy("split").agg(F.sum(F.size("n_tokens")).alias("n")).orderBy("split").collect():
        base.append((row["split"], windows))
        windows += row["n"]
    per_shard = per_shard or max(1, min(MOST, -(-windows // (2 * spark.sparkContext.defaultParallelism))))
    manifest = {"windows": windows, "per_shard": per_shard, "shards": -(-windows // per_shard), "stride": stride(size, width), "size": size, "width": width, "seed": seed}
    spark.createDataFrame([tuple(manifest.values())], _MANIFEST).coalesce(1).write.json(f"{path}/manifest")
    if windows:
        numbered = staged.join(F.broadcast(spark.createDataFrame(base, "split int, base long")), "split").withColumn("first", F.col("base") + F.col("place"))
        placed = numbered.select("first", "first_doc", "n_tokens", "n_pieces", "packed").mapInArrow(_slots(windows, seed, size, width), _PLACED)
        placed = placed.withColumn("shard", F.floor(F.col("slot") / per_shard).cast("int"))
        ranged = placed.repartitionById(manifest["shards"], F.col("shard")).sortWithinPartitions("shard", "slot")
        records = ranged.mapInArrow(_write(size, width, pad_id), "shard int, record binary")
        records.select(F.col("record").cast("string").alias("value"), "shard").write.partitionBy("shard").option("lineSep", "\n").text(f"{path}/shards")
    return manifest


def read_manifest(spark: SparkSession, path: str) -> dict:
    """The manifest of the shards under ``path``."""
    return spark.read.schema(_MANIFEST).json(f"{path}/manifest").first().asDict()


_READ = "slot long, shard int, byte_offset long, sequence_id long, first_doc long, n_tokens long, n_pieces long, ids_crc32 long, ids binary"


def _records(size: int, width: int, per_shard: int, start: int, stop: int) -> Callable:
    step = stride(size, width)
    kind = _KINDS[width]
    names, types = zip(*(x.split() for x in _READ.split(", ")), strict=True)
    arrow = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[t] for t in types]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content"), strict=True):
                data = memoryview(content.as_buffer())
                if len(data) % step:
                    raise ValueError(f"shard {shard} is not a whole number of records")
                base = shard * per_shard
                last = min(len(data) // step, stop - base)
                for first in range(max(0, start - base), last, _ROWS):
                    rows = []
                    for number in range(first, min(last, first + _ROWS)):
                        at = number * step
                        sequence, doc, n, pieces, crc, _ = struct.unpack_from(HEADER, data, at)
                        ids = np.frombuffer(data, dtype=kind, count=n, offset=at + _HEAD).astype("<u4").tobytes()
                        if zlib.crc32(ids) != crc:
                            raise ValueError(f"record {number} of shard {shard} is damaged")
                        rows.append((base + number, shard, at, sequence, None if doc < 0 else doc, n, pieces, crc, ids))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow, strict=True)], names=list(names))

    return run


def read_shards(spark: SparkSession, path: str, start: int = 0, stop: int | None = None) -> DataFrame:
    """Records of the slots from ``start`` to before ``stop``: slot, shard,
    byte_offset (in the shard), sequence_id, first_doc, n_tokens, n_pieces,
    ids_crc32, ids. Only the shards that hold such slots are opened. No
    windows, or a range without slots, give no rows."""
    told = read_manifest(spark, path)
    stop = told["windows"] if stop is None else min(stop, told["windows"])
    start = max(0, start)
    if start >= stop:
        return spark.createDataFrame([], _READ)
    per_shard = told["per_shard"]
    files = spark.read.format("binaryFile").load(f"{path}/shards").where(F.col("shard").between(start // per_shard, (stop - 1) // per_shard))
    return files.select(F.col("shard").cast("int").alias("shard"), "content").mapInArrow(_records(told["size"], told["width"], per_shard, start, stop), _READ)


def materialise(docs: DataFrame, seed: int = 1, size: int = 2048, width: int = 2, vocabulary: str | None = None) -> DataFrame:
    """Write ``docs`` (doc_id, text) as shards into the shared folder and read
    them back: slot (gapless from 0, in training order), shard, byte_offset,
    sequence_id (gapless from 0; its Feistel image is the slot), first_doc,
    n_tokens, n_pieces, ids_crc32.

    A null or empty text is its end id alone. Rows that repeat a doc_id, or
    have none, are documents of their own. The same rows in the same splits
    give the same order for a seed; other splits pack other windows. No rows
    in, no rows out; other columns are ignored.
    """
    spark = docs.sparkSession
    path = fresh(spark, "shards")
    write_shards(docs.select("doc_id", "text"), path, seed, size, width, vocabulary=vocabulary)
    return read_shards(spark, path).drop("ids")
