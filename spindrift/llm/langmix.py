"""Language identification as multilingual mixture inference.

Byte trigrams of letters are counted per language over every training row.
For each document, expectation-maximisation estimates the proportions of the
languages from its trigram likelihoods; among the sets of its most probable
languages the one of best penalised likelihood stays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm import textkernels as K

#: Trigrams are hashed into so many (2 ** BITS) counters a language.
BITS = 14
#: The model that each task gets holds 2 ** BITS numbers a language. Labels of
#: more languages than this are an error, never a silent choice among them.
LANGUAGES = 512
UNKNOWN = "und"
_FOLD = np.full(256, 0x20, dtype=np.uint32)
_FOLD[65:91] = _FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def trigrams(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counter of each trigram of bytes and whether it has a letter."""
    folded = _FOLD[part]
    triple = (folded[:-2] << np.uint32(16)) | (folded[1:-1] << np.uint32(8)) | folded[2:]
    return (triple * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS), triple != np.uint32(0x202020)


def counters(column: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, np.ndarray | None, bytes]]:
    """Per text: row, its counters (None for a null) and bytes."""
    data, offsets, null = K.texts_of(column)
    for first, last in K.chunks(offsets, size):
        part = data[offsets[first] : offsets[last]]
        at = offsets[first : last + 1] - offsets[first]
        slots, lettered = trigrams(part) if len(part) > 2 else (np.zeros(0, np.uint32), np.zeros(0, bool))
        for i in range(last - first):
            a, b = at[i], max(at[i], at[i + 1] - 2)
            yield first + i, None if null[first + i] else slots[a:b][lettered[a:b]], part[at[i] : at[i + 1]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for i, slots, _ in counters(batch.column("text")):
            own = sums.setdefault(langs[i], np.zeros(1 << BITS, dtype=np.int64))
            own += np.bincount(slots, minlength=1 << BITS)
    for lang, own in sums.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(own[at])], names=["lang", "slot", "n"])


def _remainder() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3


def learn(docs: DataFrame, alpha: float = 0.5, languages: int = LANGUAGES) -> tuple[list[str], np.ndarray]:
    """(languages in order, their trigram probabilities) from the rows whose
    crc32(doc_id) mod 3 is not 1, with text and lang. More labels than
    ``languages`` raise ValueError."""
    rows = docs.where(_remainder() != 1).where("text is not null and lang is not null")
    names = sorted(r["lang"] for r in rows.select("lang").distinct().limit(languages + 1).collect())
    if len(names) > languages:
        raise ValueError(f"more than {languages} languages in the labels; raise languages or merge labels")
    counts = np.full((len(names), 1 << BITS), alpha)
    if names:
        # sums of at most languages * 2 ** BITS counters come back
        found = rows.select("lang", "text").mapInArrow(_count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
        at = found["lang"].map({x: i for i, x in enumerate(names)}).to_numpy(dtype=np.int64)
        counts[at, found["slot"].to_numpy(dtype=np.int64)] += found["n"].to_numpy(dtype=np.float64)
    return names, counts / counts.sum(axis=1, keepdims=True) if names else counts


def _maximise(p: np.ndarray, n: np.ndarray, share: np.ndarray, rounds: int) -> np.ndarray:
    total = n.sum()
    for _ in range(rounds):
        new = share * (p @ (n / (share @ p))) / total
        if np.abs(new - share).max() < 1e-4:
            return new
        share = new
    return share


def mixture(p: np.ndarray, n: np.ndarray, rounds: int = 20, penalty: float = 3.0) -> np.ndarray:
    """Proportion of each language in a text of trigram counts ``n``, whose
    probabilities by language are ``p``; 0 for the languages not selected.
    A language is worth ``penalty`` * log(n) of log-likelihood, which counts
    a third because every letter is in three trigrams."""
    share = _maximise(p, n, np.full(len(p), 1 / len(p)), rounds)
    order = np.argsort(-share, kind="stable")
    price = penalty * np.log(n.sum() + 1)
    best, chosen = -np.inf, None
    for k in range(1, len(p) + 1):
        some = order[:k]
        part = _maximise(p[some], n, share[some] / share[some].sum(), 5) if k > 1 else np.ones(1)
        value = float(n @ np.log(part @ p[some])) / 3 - price * k
        if value <= best:
            break
        best, chosen = value, (some, part)
    out = np.zeros(len(p))
    out[chosen[0]] = chosen[1] / chosen[1].sum()
    return out


_TYPES = "doc_id long, lang_pred string, score double, languages array<string>, shares array<double>"


def has_letter(part: np.ndarray) -> bool:
    """Whether a text has a character of Unicode's category L; numbers such as
    superscripts, fractions or circled ones are none."""
    return bool(_ASCII_LETTER[part].any()) or any(map(str.isalpha, part.tobytes().decode("utf-8", "replace")))


def predict(column: pa.Array, names: list[str], p: np.ndarray) -> Iterator[tuple[int, np.ndarray | None]]:
    """Per text: row and proportions, None where it is null or has no letter."""
    wide = np.ascontiguousarray(p.T)
    for i, slots, part in counters(column):
        if slots is None or not names or not has_letter(part):
            yield i, None
        elif not len(slots):
            yield i, np.full(len(names), 1 / len(names))
        else:
            n = np.bincount(slots, minlength=1 << BITS)
            at = np.flatnonzero(n)
            yield i, mixture(np.ascontiguousarray(wide[at].T), n[at].astype(np.float64))


def _predict(names: list[str], p: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(UNKNOWN, 0.0, [], [])] * batch.num_rows
            for i, share in predict(batch.column("text"), names, p):
                if share is not None:
                    order = [k for k in np.argsort(-share, kind="stable") if share[k] > 0]
                    out[i] = names[order[0]], min(1.0, float(share[order[0]])), [names[k] for k in order], [float(share[k]) for k in order]
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64())), strict=True)] if out else [pa.array([], t) for t in (pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=[x.split()[0] for x in _TYPES.split(", ")])

    return run


def identify(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): doc_id, held_out,
    lang_pred, score (share of lang_pred), languages and shares (most first).

    A text that is null or has no letter is ``und`` with score 0, and so is
    every text when nothing can be learned. A text of one or two bytes takes
    the first language. Equal shares go to the first language by name. A null
    doc_id is not learned from and not held out. No rows in, no rows out;
    other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = docs.sparkSession.sparkContext.broadcast(learn(docs))
    found = docs.select("doc_id", "text").mapInArrow(lambda batches: _predict(*model.value)(batches), _TYPES)
    return found.select("doc_id", F.coalesce(_remainder() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "languages", "shares")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a language that holds at least ``least`` of
    the text, with all their columns; no shuffle. Rows whose text is null or has
    no letter go, and all rows when nothing can be learned. Rows that repeat a
    doc_id are judged each by its text; no rows in, no rows out."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")))

    @F.arrow_udf("boolean")
    def stays(text: pa.Array) -> pa.Array:
        kept = np.zeros(len(text), dtype=bool)
        for i, share in predict(text, *model.value):
            kept[i] = share is not None and share.max() >= least
        return pa.array(kept)

    return docs.where(stays("text"))
