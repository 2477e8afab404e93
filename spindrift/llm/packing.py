"""Sum-of-squares online packing of documents into training windows.

Each task packs the documents of its own input split as they come, so nothing
is shuffled. A level array counts the open windows at every fill level; a
document goes to the level that leaves the least sum of squared counts. Whole
windows of a document longer than a window are cut off first, its rest is
placed. When a split ends, or ``max_open`` windows are open, the pieces of the
emptiest open windows are poured, cut where need be, into the gaps of the
fullest, which leaves one window at most that isn't full.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.tokens import default_vocabulary, encode

Piece = tuple[object, int, int, np.ndarray]
#: Windows that one split may number.
SPLIT = 1 << 40
_TYPES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class Packer:
    """Packs pieces (doc_id, doc_tokens, start, ids) into windows of ``size``;
    ``emit`` gets (pieces, window number) for each window that is closed."""

    def __init__(self, size: int, max_open: int, emit: Callable[[list[Piece], int], None], first: int = 0) -> None:
        self.size, self.max_open, self.emit, self.number = size, max_open, emit, first
        self.levels = np.zeros(size + 1, dtype=np.int64)
        self.windows: list[list[list[Piece]]] = [[] for _ in range(size + 1)]
        self.open = 0

    def close(self, pieces: list[Piece]) -> None:
        self.emit(pieces, self.number)
        self.number += 1

    def level_for(self, n: int) -> int:
        """The level whose use leaves the least sum of squares; 0 opens a window.
        Of equals, the fullest."""
        top = self.size - n
        here, there = self.levels[: top + 1], self.levels[n : self.size + 1]
        change = 2 * (there - here) + 2
        change[0] = 2 * there[0] + 1
        change[top] = 1 - 2 * here[top] if top else 0
        change[1:][here[1:] == 0] = np.iinfo(np.int64).max
        return top - int(change[::-1].argmin())

    def add(self, doc_id: object, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        while total - at >= self.size:
            self.close([(doc_id, total, at, ids[at : at + self.size])])
            at += self.size
        n = total - at
        if not n:
            return
        level = self.level_for(n)
        if level:
            window = self.windows[level].pop()
            self.levels[level] -= 1
            self.open -= 1
        else:
            window = []
        # a copy, so that a rest doesn't hold its whole document in memory
        window.append((doc_id, total, at, ids[at:].copy() if at else ids))
        if level + n == self.size:
            self.close(window)
            return
        self.windows[level + n].append(window)
        self.levels[level + n] += 1
        self.open += 1
        if self.open > self.max_open:
            self.pour()

    def pour(self) -> None:
        """Close every open window; one at most is not full."""
        fullest = [w for level in reversed(self.windows) for w in level]
        first, last = 0, len(fullest) - 1
        while first <= last:
            window = fullest[first]
            gap = self.size - sum(len(p[3]) for p in window)
            while gap and first < last:
                doc_id, total, start, ids = fullest[last].pop()
                window.append((doc_id, total, start, ids[:gap]))
                if len(ids) > gap:
                    fullest[last].append((doc_id, total, start + gap, ids[gap:]))
                gap -= min(gap, len(ids))
                if not fullest[last]:
                    last -= 1
            self.close(window)
            first += 1
        self.levels[:] = 0
        self.windows = [[] for _ in range(self.size + 1)]
        self.open = 0


_WINDOW = "sequence_id long, first_doc long, n_pieces long, n_tokens long, ids binary"


def _pieces(pieces: list[Piece], number: int) -> list[tuple]:
    out, offset = [], 0
    for doc_id, total, start, ids in pieces:
        out.append((doc_id, start, len(ids), total, number, offset, ids.tobytes()))
        offset += len(ids)
    return out


def _window(pieces: list[Piece], number: int) -> list[tuple]:
    ids = b"".join(p[3].tobytes() for p in pieces)
    return [(number, pieces[0][0], len(pieces), len(ids) // 4, ids)]


def packed(batches: Iterator[pa.RecordBatch], vocabulary: str, emit: Callable[[list[Piece], int], None], size: int, end_id: int = 1, max_open: int = 4096) -> Iterator[None]:
    """Pack the documents of a split; ``emit`` gets every window that closes.
    Yields after each document and at the end."""
    packer = Packer(size, max_open, emit, TaskContext.get().partitionId() * SPLIT)
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for doc_id, text in zip(batch.column("doc_id"), texts, strict=True):
            packer.add(doc_id.as_py(), np.append(encode(text.as_py() or b"", vocabulary), np.uint32(end_id)))
            yield
    packer.pour()
    yield


def _run(vocabulary: str, end_id: int, size: int, max_open: int, rows_of: Callable, types: str, rows: int = 4096) -> Callable:
    fields = [(x.split()[0], pa.binary() if x.endswith("binary") else pa.int64()) for x in types.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def taken() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), fields, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=[name for name, _ in fields])

        for _ in packed(batches, vocabulary, lambda pieces, number: out.extend(rows_of(pieces, number)), size, end_id, max_open):
            if len(out) >= rows:
                yield taken()
        if out:
            yield taken()

    return run


def pack(docs: DataFrame, vocabulary: str | None = None, end_id: int = 1, size: int = 2048, max_open: int = 4096) -> DataFrame:
    """Pieces of all documents (doc_id, text), packed into windows of ``size``.

    Per piece: doc_id, start (ids of its document before it), length,
    doc_tokens (with ``end_id``), sequence_id (unique, not gapless), offset in
    the sequence (gapless from 0), ids (unsigned little-endian 32-bit).

    A null or empty text is ``end_id`` alone. Rows that repeat a doc_id, or
    have none, are documents of their own. No rows in, no rows out; other
    columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_run(vocabulary or default_vocabulary(), end_id, size, max_open, _pieces, _TYPES), _TYPES)


def pack_windows(docs: DataFrame, vocabulary: str | None = None, end_id: int = 1, size: int = 2048, max_open: int = 4096) -> DataFrame:
    """The same windows as ``pack``, a row each: sequence_id, first_doc (doc_id
    of the first piece, null where it has none), n_pieces, n_tokens, ids
    (unpadded). Odd rows count as in ``pack``; no rows in, no rows out."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_run(vocabulary or default_vocabulary(), end_id, size, max_open, _window, _WINDOW), _WINDOW)


def padded(windows: DataFrame, pad_id: int = 0, size: int = 2048) -> DataFrame:
    """Windows of ``pack_windows`` with ids padded to ``size``, or left as they
    are where their number is a power of two."""
    full = F.when(F.expr("n_tokens & (n_tokens - 1)") == 0, F.col("n_tokens")).otherwise(F.lit(size))
    fill = F.unhex(F.repeat(F.lit(int(pad_id).to_bytes(4, "little").hex()), (full - F.col("n_tokens")).cast("int")))
    return windows.withColumn("ids", F.concat("ids", fill))
