"""Phrase collocations by suffix counting (Suffix-sigma).

1. Words are counted by language. Those with more than 1 / ``HOT`` of all words
   are hot; there are fewer than ``HOT`` of them.
2. Each word of a text starts a suffix of its piece, truncated to ``max_n``
   words. Tasks count equal suffixes of a stretch of text and deal them out by
   language and first word; those of a hot first word are dealt out besides by
   their other words. Each part is sorted in reverse lexicographic order, and
   one stack counts the prefixes of all its suffixes, which are all phrases.
   Counts of a hot word's shorter phrases are summed afterwards.
3. Phrases over the least count are joined with the counts of their parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm import textkernels as K
from spindrift.operators.stars import HOT
from spindrift.llm.workspace import cut

#: Bytes of text whose suffixes are counted together before the shuffle.
STRETCH = 4 << 20
#: Parts of a language that are ranked on their own before they meet.
RANKED_PARTS = 512

_BREAKS, _BLANKS = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_BREAKS[[*b".,;:!?\n\x0b\x0c\r"]] = True
_BLANKS[[*b" \t"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Parts the language and the words of a suffix. It sorts before all else, so the
#: two lowest characters are escaped inside words; a suffix has max_n parts after
#: the language, of which those it lacks are empty.
SEPARATOR = "\0"


def _escaped(words: pa.Array) -> pa.Array:
    return pc.replace_substring(pc.replace_substring(words, "\1", "\1\2"), "\0", "\1\1")


def _plain(words: pa.Array) -> pa.Array:
    return pc.replace_substring(pc.replace_substring(words, "\1\1", "\0"), "\1\2", "\1")


def chained_words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Lower-cased words of texts, the text of each, and whether the next word
    is in the same piece of the same text."""
    data = _LOWER[data]
    solid = ~(_BREAKS | _BLANKS)[data]
    fresh = np.zeros(len(data) + 1, dtype=bool)
    fresh[offsets] = True
    starts = np.flatnonzero(solid & np.concatenate([[True], ~solid[:-1] | fresh[1:-1]])[: len(data)])
    ends = np.flatnonzero(solid & np.concatenate([~solid[1:] | fresh[1:-1], [True]])[: len(data)]) + 1
    text = np.searchsorted(offsets, starts, "right") - 1
    breaks = np.cumsum(_BREAKS[data])
    piece = breaks[starts]
    chained = np.zeros(len(starts), dtype=bool)
    chained[:-1] = (piece[1:] == piece[:-1]) & (text[1:] == text[:-1])
    places = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(data[solid].tobytes()))
    return words, text, chained


def _grouped(columns: list[np.ndarray], sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of small numbers: a place of each, and how often it is."""
    key, room = columns[0].astype(np.int64), sizes[0]
    for column, size in zip(columns[1:], sizes[1:], strict=True):
        if room * size >= 2**62:
            key = np.unique(key, return_inverse=True)[1]
            room = len(key) + 1
        key, room = key * size + column, room * size
    _, at, counts = np.unique(key, return_index=True, return_counts=True)
    return at, counts


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
    """Of each stretch of a batch: distinct languages, the language of each word
    by number, distinct words, each word by number, and ``chained``."""
    data, offsets, _ = K.texts_of(batch.column("text"))
    langs = batch.column("lang").fill_null("und").dictionary_encode()
    lang_of = langs.indices.to_numpy(zero_copy_only=False)
    for first, last in K.chunks(offsets, STRETCH):
        words, text, chained = chained_words(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        if len(words):
            coded = words.dictionary_encode()
            yield langs.dictionary, lang_of[first + text], coded.dictionary, coded.indices.to_numpy(), chained


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for langs, lang, words, code, _ in _stretches(batch):
            at, counts = _grouped([lang, code], [len(langs) + 1, len(words) + 1])
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(lang[at])), words.take(pa.array(code[at])), pa.array(counts.astype(np.int64))], names=["lang", "word", "n"])


def _hashes(words: pa.Array) -> np.ndarray:
    data, offsets, _ = K.texts_of(words)
    return K.word_hashes(data, offsets[:-1], offsets[1:], lower=False)


def _suffixes(max_n: int, hot: dict[str, dict[str, int]]) -> Callable:
    """Rows (bucket, suffix, n): a bucket is a hash of language and first word;
    below zero it is one of the parts of a hot first word."""
    odd = K.keyed(31, max_n) | K.U64(1)

    def parts_of(langs: pa.Array, words: pa.Array) -> np.ndarray:
        out = np.ones((len(langs), len(words)), dtype=np.int32)
        for i, name in enumerate(langs.to_pylist()):
            if name in hot:
                at = pc.index_in(pa.array(list(hot[name]), pa.string()), words)
                for place, parts in zip(at.to_pylist(), hot[name].values(), strict=True):
                    if place is not None:
                        out[i, place] = parts
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for langs, lang, words, code, chained in _stretches(batch):
                size = len(words) + 1
                code = code.astype(np.int64) + 1  # 0: no word
                columns, on = [code], chained
                for i in range(1, max_n):
                    later = np.zeros(len(code), np.int64)
                    later[:-i] = np.where(on[: len(code) - i], code[i:], 0)
                    columns.append(later)
                    on = on & np.concatenate([chained[i:], np.zeros(min(i, len(code)), dtype=bool)])[: len(code)]
                at, counts = _grouped([lang, *columns], [len(langs) + 1, *[size] * max_n])
                columns, lang = [c[at] for c in columns], lang[at]
                hashes = np.concatenate([np.zeros(1, K.U64), _hashes(words)])
                bucket = K.fmix(hashes[columns[0]] * odd[0] + _hashes(langs)[lang])
                parts = parts_of(langs, words)[lang, columns[0] - 1]
                other = np.zeros(len(at), K.U64)
                for c, weight in zip(columns[1:], odd[1:], strict=True):
                    other += hashes[c] * weight
                part = K.fmix(other) % parts.astype(K.U64)
                bucket = (np.where(parts > 1, K.fmix(bucket + part), bucket) >> K.U64(1)).astype(np.int64)
                shown = pa.concat_arrays([pa.array([""]), _escaped(words)])
                names = [_escaped(langs).take(pa.array(lang)), *(shown.take(pa.array(c)) for c in columns)]
                suffixes = pc.binary_join_element_wise(*names, SEPARATOR)
                yield pa.RecordBatch.from_arrays([pa.array(np.where(parts > 1, ~bucket, bucket)), suffixes, pa.array(counts.astype(np.int64))], names=["bucket", "suffix", "n"])

    return run


class PrefixStack:
    """Counts of all prefixes of suffixes that come in (reverse) lexicographic
    order. For each length it holds the open prefix and its count so far; a
    prefix that ends is popped into the results. Rows are taken in batches."""

    def __init__(self, max_n: int, least: int) -> None:
        self.max_n, self.least = max_n, least
        self.open: dict[int, tuple[tuple, int, bool]] = {}

    def take(self, batch: pa.RecordBatch) -> Iterator[tuple[list[pa.Array], np.ndarray]]:
        """Popped prefixes: their language and words, and their counts."""
        rows, width = batch.num_rows, self.max_n + 1
        if not rows:
            return
        n, shared = batch.column("n").to_numpy(), batch.column("bucket").to_numpy() < 0
        parts = pc.split_pattern(batch.column("suffix"), SEPARATOR).flatten()
        columns = [parts.take(pa.array(np.arange(i, rows * width, width))) for i in range(width)]
        differs = np.zeros(rows, dtype=bool)
        differs[0] = True
        for length, column in enumerate(columns):
            differs[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            if not length:
                continue
            present = pc.not_equal(column, "").to_numpy(zero_copy_only=False)
            begins = np.flatnonzero(differs & present)
            if not len(begins):
                yield from self._close(length)
                continue
            # a run ends where the next one begins, or where a shorter suffix stands
            sums = np.concatenate([[0], np.cumsum(np.where(present, n, 0))])
            counts = sums[np.append(begins[1:], rows)] - sums[begins]
            partial = shared[begins] & (length < self.max_n)
            head, tail = (tuple(c[int(i)].as_py() for c in columns[: length + 1]) for i in (begins[0], begins[-1]))
            if length in self.open and self.open[length][0] == head:
                counts[0] += self.open.pop(length)[1]
            else:
                yield from self._close(length)
            self.open[length] = (tail, int(counts[-1]), bool(partial[-1]))
            good = np.flatnonzero((counts[:-1] >= self.least) | partial[:-1])
            if len(good):
                yield [c.take(pa.array(begins[good])) for c in columns[: length + 1]], counts[good]

    def _close(self, length: int) -> Iterator[tuple[list[pa.Array], np.ndarray]]:
        if length in self.open:
            words, count, partial = self.open.pop(length)
            if count >= self.least or partial:
                yield [pa.array([w], pa.string()) for w in words], np.array([count])

    def close(self) -> Iterator[tuple[list[pa.Array], np.ndarray]]:
        for length in range(1, self.max_n + 1):
            yield from self._close(length)


def _stacked(max_n: int, least: int) -> Callable:
    def shown(popped: tuple[list[pa.Array], np.ndarray]) -> pa.RecordBatch:
        (lang, *words), counts = popped
        phrase = pc.binary_join_element_wise(*map(_plain, words), " ")
        return pa.RecordBatch.from_arrays([_plain(lang), phrase, pa.array(np.full(len(counts), len(words), np.int32)), pa.array(counts.astype(np.int64))], names=["lang", "phrase", "length", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = PrefixStack(max_n, least)
        for batch in batches:
            yield from map(shown, stack.take(batch))
        yield from map(shown, stack.close())

    return run


def phrase_counts(docs: DataFrame, words: DataFrame, max_n: int, least: int) -> DataFrame:
    """Phrases of 1 to ``max_n`` words of ``docs`` (lang, text; ``words`` has
    their lang, word, n) with at least ``least`` occurrences: lang, phrase
    (joined by spaces), length, f."""
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot: dict[str, dict[str, int]] = {}
    for r in words.where(F.col("n") > total / HOT).collect():  # fewer than HOT
        hot.setdefault(r["lang"], {})[r["word"]] = -(-r["n"] * HOT // total)
    suffixes = docs.mapInArrow(_suffixes(max_n, hot), "bucket long, suffix string, n long")
    dealt = suffixes.repartition("bucket").sortWithinPartitions("bucket", F.col("suffix").desc())
    counts = dealt.mapInArrow(_stacked(max_n, least), "lang string, phrase string, length int, f long")
    return counts.groupBy("lang", "phrase", "length").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def _part(words: Column, first: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice(words, first, size), " ")


def collocations(docs: DataFrame, max_n: int = 3, least: int = 10, covered: int = 50, top: int = 2000) -> DataFrame:
    """The first ``top`` phrases of each language of ``docs`` (lang, text):
    lang, rank, phrase, a, l, r, n, score.

    A piece ends at ``[.,;:!?\\x0A-\\x0D]``; words are runs of neither space nor
    tab, with A-Z lower-cased. A phrase of 2 to ``max_n`` words that occurs
    ``least`` times is scored by its worst cut, floor(1000000 * a * a / (l * r))
    in exact decimals, and left out if a longer phrase around it has ``covered``
    percent of its occurrences. Null languages are ``und``; null and empty texts
    have no words; repeated rows count again; ties go by a and the phrase's
    bytes. No rows in, no rows out; other columns are ignored.
    """
    docs = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    single = cut(docs.mapInArrow(_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    grams = cut(phrase_counts(docs, single, max_n, least), "grams")
    words = F.split("phrase", " ", -1)
    candidates = grams.where("length > 1").withColumnRenamed("f", "a")

    parts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("length") - 1)))
    parts = parts.select("*", _part(words, 1, F.col("k")).alias("head"), _part(words, F.col("k") + 1, F.col("length")).alias("rest"))
    parts = parts.join(grams.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(grams.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    a, l, r = (F.col(c).cast("decimal(19,0)") for c in "alr")
    score = F.call_function("div", F.lit(1000000).cast("decimal(7,0)") * a * a, (l * r).cast("decimal(38,0)"))
    scored = parts.withColumn("score", score.cast("long")).groupBy("lang", "phrase", "length", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("worst"))

    spot = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("length") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("length") - size + 1), lambda i: _part(words, i, size)))))
    around = candidates.where("length > 2").select("lang", "a", spot.alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = scored.join(around, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < covered * F.col("a"), F.lit(True)))

    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    left = left.select("lang", "phrase", "a", "worst.l", "worst.r", "worst.score").withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANKED_PARTS)))
    leading = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= top)
    ranked = leading.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    totals = single.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
