"""Byte-level BPE: ranked merges folded over distinct words by Spark's
higher-order functions, and ids decoded by joining the bytes of their pieces.

A text is cut into words by the vocabulary's pattern. A word is an array of
bytes, each a character below U+0100 (ISO-8859-1), so that parts concatenate as
strings and are looked up as such. A fold merges, step by step, the leftmost
adjacent pair of the least rank, looked up in a literal map of ranks; the
literal is an array of small maps by checksum, since Spark scans a map.

Words that occur twice or more are folded once for the whole table and
broadcast, the most frequent first, up to ``DICTIONARY_BYTES``, which is
measured before anything is collected. All other words are folded once for each
document that has them. Texts are not shuffled, only counts of words.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm import textkernels as K
from spindrift.llm.workspace import cut

#: Bytes of the broadcast dictionary: of each word its UTF-8 bytes and WORD_BYTES
#: for hash, offsets and ids. Longer words than LONGEST are left out of it.
DICTIONARY_BYTES, WORD_BYTES, LONGEST = 64 << 20, 32, 64
#: Counts below this are levels of their own, larger ones by powers of two.
_FINE = 16
#: Words that a task looks up at a time.
AT_A_TIME = 1 << 18
_BYTES = "ISO-8859-1"
_BUCKETS = 1 << 16

# Letters and numbers of Unicode 14 to 16, which the pattern's own
# library knows and the classes of an older Java do not. None is below U+0870.
LETTERS = (
    "0870-0887 0889-088E 08B5 08C8-08C9 0C5D 0CDD 170D 171F 1B4C 1C89-1C8A 2C2F 2C5F 9FFD-9FFF A7C0-A7C1 A7CB-A7CD A7D0-A7D1 A7D3 A7D5-A7DC A7F2-A7F4 "
    "10570-1057A 1057C-1058A 1058C-10592 10594-10595 10597-105A1 105A3-105B1 105B3-105B9 105BB-105BC 105C0-105F3 10780-10785 10787-107B0 107B2-107BA "
    "10D4A-10D65 10D6F-10D85 10EC2-10EC4 10F70-10F81 11071-11072 11075 1123F-11240 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 11740-11746 "
    "11AB0-11ABF 11BC0-11BE0 11F02 11F04-11F10 11F12-11F33 12F90-12FF0 1342F 13441-13446 13460-143FA 16100-1611D 16A70-16ABE 16D40-16D6C 18CFF 1AFF0-1AFF3 "
    "1AFF5-1AFFB 1AFFD-1AFFE 1B11F-1B122 1B132 1B155 1DF00-1DF1E 1DF25-1DF2A 1E030-1E06D 1E290-1E2AD 1E4D0-1E4EB 1E5D0-1E5ED 1E5F0 1E7E0-1E7E6 1E7E8-1E7EB "
    "1E7ED-1E7EE 1E7F0-1E7FE 2A6DE-2A6DF 2B735-2B739 2EBF0-2EE5D 31350-323AF"
)
NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 11F50-11F59 16130-16139 16AC0-16AC9 16D70-16D79 1CCF0-1CCF9 1D2C0-1D2D3 1E4F0-1E4F9 1E5F1-1E5FA"


#: White space below U+0870, and all of it.
_NARROW_SPACE, _WIDE_SPACE = r"\s\x{85}\x{A0}", r"\p{IsWhite_Space}"


def _ranges(listed: str) -> str:
    return "".join("-".join(f"\\x{{{x}}}" for x in part.split("-")) for part in listed.split())


def java_pattern(pattern: str, wide: bool) -> str:
    """The tokenizers' pattern for Java. ``wide`` knows all letters, numbers and
    white space, but takes seven times as long as the one for texts that stay
    below U+0870. Repeats are possessive where nothing follows them, and words
    of letters or numbers are tried before contractions, which begin with an
    apostrophe: neither changes a match."""
    classes = {r"\s": _WIDE_SPACE if wide else _NARROW_SPACE}
    classes |= {rf"\p{{{name}}}": rf"\p{{{name}}}" + (_ranges(listed) if wide else "") for name, listed in (("L", LETTERS), ("N", NUMBERS))}
    out, inside, i = [], False, 0
    while i < len(pattern):
        if pattern.startswith(r"\S", i):
            out.append(f"[^{classes[chr(92) + 's']}]")
            i += 2
            continue
        name = next((c for c in classes if pattern.startswith(c, i)), None)
        if name:
            out.append(classes[name] if inside else f"[{classes[name]}]")
        else:
            inside = pattern[i] == "[" or inside and pattern[i] != "]"
            out.append(pattern[i])
        i += len(name) if name else 1
    ways = "".join(out).split("|")
    contractions = [w for w in ways if w.startswith("'")]
    first = [w for w in ways if w.startswith(" ?[") and not w.startswith(" ?[^")]
    rest = [w for w in ways if w not in contractions and w not in first]
    return "|".join([*(_possessive(w) for w in first), *contractions, *map(_possessive, rest)])


def _possessive(way: str) -> str:
    return way.replace(" ?", " ?+", 1) + "+" if way.endswith("+") else way


class Vocabulary:
    """Pieces by rank, and the literals that expressions use."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}
        self.narrow, self.wide = (java_pattern(pattern, wide) for wide in (False, True))
        buckets: list[dict[str, int]] = [{} for _ in range(_BUCKETS)]
        for piece, rank in self.ranks.items():
            shown = piece.decode("latin-1")
            buckets[zlib.crc32(shown.encode()) % _BUCKETS][shown] = rank
        self._maps = json.dumps(buckets)
        of = {rank: piece.decode("latin-1") for piece, rank in self.ranks.items()}
        self._pieces = json.dumps([of.get(i, "") for i in range(max(of) + 1)])

    def maps(self) -> Column:
        """Literal: ranks by piece, in buckets by checksum."""
        return F.from_json(F.lit(self._maps), "array<map<string,int>>")

    def words(self, text: Column) -> Column:
        """A text's words in order; of a null text, none."""
        cuts = [F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in (self.wide, self.narrow)]
        far = (F.octet_length(text) > F.length(text)) & text.rlike(r"[\x{870}-\x{10FFFF}]")
        return F.coalesce(F.when(far, cuts[0]).otherwise(cuts[1]), F.array().cast("array<string>"))

    def pieces(self) -> Column:
        """Literal: the bytes of each id, as characters; none of an id left out."""
        return F.from_json(F.lit(self._pieces), "array<string>")


@lru_cache(maxsize=2)
def vocabulary(path: str | None = None) -> Vocabulary:
    import public_tokenizers

    return Vocabulary(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, inside a fold's step."""
    return F.element_at(F.transform(F.array(value), body), 1)


def byte_array(word: Column) -> Column:
    """A word's UTF-8 bytes, each as the character of its number."""
    return F.split(F.decode(F.encode(word, "UTF-8"), _BYTES), "")


def fold(word: Column, maps: Column) -> Column:
    """Ids of one word: each step merges the leftmost pair of the least rank.
    ``maps`` is ``Vocabulary.maps`` or a variable bound to it."""

    def rank(piece: Column) -> Column:
        return F.try_element_at(F.get(maps, F.pmod(F.crc32(piece), F.lit(_BUCKETS)).cast("int")), piece)

    def pair(part: Column, after: Column) -> Column:
        return F.struct(part.alias("part"), rank(F.concat(part, after)).alias("rank"))

    def merged(state: Column, i: Column) -> Column:
        def put(whole: Column) -> Column:
            before = F.when(i > 1, F.concat(F.slice(state, 1, i - 2), F.array(pair(F.get(state, i - 2)["part"], whole)))).otherwise(F.slice(state, 1, 0))
            return F.concat(before, F.array(pair(whole, F.get(state, i + 1)["part"])), F.slice(state, i + 2, F.size(state)))

        return _let(F.concat(F.get(state, i - 1)["part"], F.get(state, i)["part"]), put)

    def step(state: Column, _: Column) -> Column:
        first = F.array_position(state["rank"], F.array_min(state["rank"])).cast("int")  # null where no pair has a rank
        return _let(first, lambda i: F.when(i.isNull(), state).otherwise(merged(state, i)))

    def run(parts: Column) -> Column:
        # each part with the rank of it and the next one; null where they are no piece
        start = F.zip_with(parts, F.slice(parts, 2, F.size(parts)), pair)
        steps = F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)))
        return F.aggregate(steps, start, step, lambda end: F.transform(end["part"], rank))

    return _let(byte_array(word), run)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = pc.value_counts(batch.column("words").flatten())
        yield pa.RecordBatch.from_arrays([counts.field(0), counts.field(1).cast(pa.int64())], names=["word", "n"])


def frequent_words(words: DataFrame) -> DataFrame:
    """Words of rows of ``words`` that the dictionary takes: those that occur
    twice or more, the most frequent levels of counts as far as its bytes go."""
    counts = words.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = cut(counts.where((F.col("n") > 1) & (F.octet_length("word") <= LONGEST)).select("word", F.when(F.col("n") < _FINE, F.col("n")).otherwise(_FINE + F.floor(F.log2("n"))).alias("level")), "word-counts")
    sizes = sorted(counts.groupBy("level").agg(F.sum(F.octet_length("word") + WORD_BYTES).alias("bytes")).collect(), reverse=True)  # 80 levels at most
    total = np.cumsum([r["bytes"] for r in sizes]) if sizes else np.zeros(0)
    fits = int((total <= DICTIONARY_BYTES).sum())
    return counts.where(F.col("level") >= (sizes[fits - 1]["level"] if fits else 99)).select("word")


def folded(words: DataFrame, vocab: Vocabulary) -> DataFrame:
    """``words`` (word) with their ids, each folded once."""
    return words.select("word", _let(vocab.maps(), lambda maps: fold(F.col("word"), maps)).alias("ids"))


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks else pa.array([], column.type)


class Dictionary:
    """Words and their ids in arrays sorted by hash; of words that share a hash
    it keeps one, and what it lacks is folded in its document."""

    def __init__(self, table: pa.Table) -> None:
        hashes = np.concatenate([np.zeros(0, K.U64), *(self.hashes(x) for x in table.column("word").chunks)])
        order = np.argsort(hashes, kind="stable")
        order = order[np.concatenate([[True], np.diff(hashes[order]) != 0])[: len(order)]]
        self.keys, table = hashes[order], table.take(pa.array(order)).combine_chunks()
        self.words, ids = (_whole(table.column(c)) for c in ("word", "ids"))
        self.starts = ids.offsets.to_numpy().astype(np.int64)
        self.ids = ids.values.to_numpy(zero_copy_only=False).astype(np.int32)

    @staticmethod
    def hashes(words: pa.Array) -> np.ndarray:
        data, offsets, _ = K.texts_of(words)
        return K.word_hashes(data, offsets[:-1], offsets[1:], lower=False)

    def find(self, words: pa.Array) -> np.ndarray:
        """Place of each word, or -1."""
        if not len(self.keys):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.keys, self.hashes(words)), len(self.keys) - 1)
        same = pc.equal(self.words.take(pa.array(at)), words.cast(self.words.type)).to_numpy(zero_copy_only=False)
        return np.where(same, at, -1)


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of runs that begin at ``starts``, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


_SOUGHT = "runs array<array<int>>, slots array<int>, others array<string>"


def _looked_up(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Dictionary = shared.value
        for batch in batches:
            for first, last in K.chunks(batch.column("words").offsets.to_numpy().astype(np.int64), AT_A_TIME):
                yield _sought(batch.slice(first, last - first), known)

    return run


def _sought(batch: pa.RecordBatch, known: Dictionary) -> pa.RecordBatch:
    """Ids of the words of each document in runs; after each run but the last
    stands a word that the dictionary lacks, in ``slots`` by its place (from 0)
    among the document's ``others``."""
    lists = batch.column("words")
    edges = lists.offsets.to_numpy().astype(np.int64)
    edges = edges - edges[0]
    coded = lists.flatten().dictionary_encode()
    code, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    place = known.find(distinct)
    lacking = place < 0
    if len(known.keys):
        first = np.where(lacking, 0, known.starts[place])
        length = np.where(lacking, 0, known.starts[place + 1] - first)
        ids = known.ids[spans(first[code], length[code])]
    else:
        length, ids = np.zeros(len(place), np.int64), np.zeros(0, np.int32)
    ends = np.concatenate([[0], np.cumsum(length[code])])
    odd = np.flatnonzero(lacking[code])
    row = np.searchsorted(edges, odd, "right") - 1
    pairs, at = np.unique(row * np.int64(len(distinct) + 1) + code[odd], return_inverse=True)
    begins = np.searchsorted(pairs, np.arange(batch.num_rows + 1) * np.int64(len(distinct) + 1))
    others = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), distinct.take(pa.array(pairs % (len(distinct) + 1))))
    # a run ends at each such word and at the end of its document
    stops = np.concatenate([odd, edges[1:] - 0.5])
    order = np.argsort(stops, kind="stable")
    slots = np.concatenate([at - begins[row], np.full(batch.num_rows, -1)])[order]
    ends = np.concatenate([[0], ends[np.concatenate([odd, edges[1:]])[order]]])
    counts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows) + 1)]).astype(np.int32)
    inner = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
    runs = pa.ListArray.from_arrays(pa.array(counts), inner)
    slots = pa.ListArray.from_arrays(pa.array(counts), pa.array(slots, pa.int32(), mask=slots < 0))
    rest = [(n, batch.column(n)) for n in batch.schema.names if n != "words"]
    return pa.RecordBatch.from_arrays([*(c for _, c in rest), runs, slots, others], names=[*(n for n, _ in rest), "runs", "slots", "others"])


def encode(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: its ``key`` and ids array<int>, as the
    tiktoken library gives them for this vocabulary without special tokens.

    A null or empty text has no ids. Rows that repeat a key, or have none, each
    get a row; no rows in, no rows out; other columns are ignored. The fold of a
    word takes a step for each of its bytes and each step time in proportion to
    the bytes, so a word of n bytes takes n * n.
    """
    vocab = vocabulary(path)
    words = docs.select(key, vocab.words(F.col(text)).alias("words"))
    context = docs.sparkSession.sparkContext
    known = folded(frequent_words(words.select("words")).repartition(context.defaultParallelism * 4), vocab)
    shared = context.broadcast(Dictionary(known.toArrow()))
    kind = dict(docs.dtypes)[key]
    found = words.mapInArrow(_looked_up(shared), f"`{key}` {kind}, {_SOUGHT}")

    none = F.array().cast("array<int>")

    def whole(maps: Column) -> Column:
        own = F.transform("others", lambda w: fold(w, maps))
        return _let(own, lambda own: F.flatten(F.zip_with("runs", "slots", lambda run, slot: F.concat(run, F.coalesce(F.get(own, slot), none)))))

    return found.select(key, F.when(F.size("others") == 0, F.get("runs", 0)).otherwise(_let(vocab.maps(), whole)).alias("ids"))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` (ids array<int>) with a column decoded binary: the bytes of
    the pieces of its ids, joined as characters below U+0100 and turned into
    binary at once, so the time is linear. No ids give no bytes; null ids too."""
    joined = _let(vocabulary(path).pieces(), lambda pieces: F.array_join(F.transform("ids", lambda i: F.get(pieces, i)), ""))
    return encoded.withColumn("decoded", F.encode(F.coalesce(joined, F.lit("")), _BYTES))
