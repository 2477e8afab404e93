"""Spelling variants: a vocabulary joined with itself on tries.

Two words at distance one share all before the edit and all after it. Of two
words whose shorter has m characters, one half is therefore the same: their
first m / 2 characters, or their last. Words go to a partition by either
half (of m = their length, and of one less), so the sub-trie of a partition
holds the open part of its words behind a common prefix (and before a common
suffix), and no pair meets in two partitions: it belongs to the prefix side if
its common prefix reaches that far. A partition of more than ``most`` words is
halved again in the same way, until one character is open, so no prefix is hot.

Inside a partition, active-node sets go down the trie: each node has the nodes
within distance one of it, computed from its parent's; terminal nodes at a
distance of exactly one are links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.workspace import cut

_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEYS = ["m", "lo", "hi", "below", "prefix", "suffix"]
_NO_LIMIT = 1 << 30


def vocabulary(docs: DataFrame, least_chars: int = 6, least: int = 5, typo: int = 199) -> DataFrame:
    """Words of ``docs`` (doc_id, text) of at least ``least_chars`` characters
    that occur ``least`` times: word, n. Of a run whose checksum with its
    document's id is divisible by ``typo``, one character is left out. A null
    doc_id is the empty string; a null text has no words."""
    shortest = max(least_chars, 1)
    run = F.explode(F.regexp_extract_all("text", F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{shortest},}}"), F.lit(0)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run.alias("run")).select("id", F.translate("run", _UPPER, _SMALL).alias("run"))
    h = F.crc32(F.concat_ws(":", "id", "run"))
    at = F.pmod(h, F.length("run")).cast("int")
    word = F.when(h % typo == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _halved(parts: DataFrame) -> DataFrame:
    """Rows (word, n, m, lo, hi, below) by either half of what is open: the
    prefix side, and the suffix side for pairs that differ before it."""
    half = F.floor((F.col("m") - F.col("lo") - F.col("hi")) / 2).cast("int")
    ahead = F.struct((F.col("lo") + half).alias("lo"), F.col("hi").alias("hi"), F.col("below").alias("below"))
    behind = F.struct(F.col("lo").alias("lo"), (F.col("m") - F.col("lo") - half).alias("hi"), F.least("below", F.col("lo") + half).alias("below"))
    sides = parts.select("word", "n", "m", F.explode(F.array(ahead, behind)).alias("side")).select("word", "n", "m", "side.*")
    return sides.select("*", F.substring("word", F.lit(1), F.col("lo")).alias("prefix"), F.when(F.col("hi") > 0, F.substring("word", F.length("word") - F.col("hi") + 1, F.col("hi"))).otherwise("").alias("suffix"))


def partitions(words: DataFrame, most: int) -> DataFrame:
    """Rows (word, n) of ``words`` in partitions of at most ``most`` words, or
    of one open character: word, n and the partition's keys."""
    lengths = F.array(F.length("word"), F.length("word") - 1)
    parts = _halved(words.select("word", "n", F.explode(lengths).alias("m"), F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(_NO_LIMIT).alias("below")).where("m > 1"))
    found: DataFrame | None = None
    while True:
        # grouped by a hash besides, so that the join has an exchange on either side
        counts = parts.groupBy(*_KEYS, F.xxhash64(*_KEYS).alias("h")).agg(F.count("*").alias("size"), F.max(F.col("m") == F.length("word")).alias("has_shorter")).where("size > 1 and has_shorter").drop("h", "has_shorter")
        sized = cut(parts.join(counts, _KEYS), "trie-parts")
        large = (F.col("size") > most) & (F.col("m") - F.col("lo") - F.col("hi") > 1)
        small = sized.where(~large).drop("size")
        found = small if found is None else found.unionByName(small)
        hot = sized.where(large)
        if hot.isEmpty():
            return found
        parts = _halved(hot.select("word", "n", "m", "lo", "hi", "below"))


class Trie:
    """Words by characters; ``ends`` has the number of the word that ends at a
    node, or -1."""

    def __init__(self, words: list[str]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.ends = [-1]
        for number, word in enumerate(words):
            node = 0
            for c in word:
                below = self.children[node]
                node = below.get(c, -1)
                if node < 0:
                    node = below[c] = len(self.ends)
                    self.children.append({})
                    self.ends.append(-1)
            self.ends[node] = number

    def links(self) -> Iterator[tuple[int, int]]:
        """Pairs of words at distance one, each once. An active set maps the
        nodes within distance one of a node to that distance."""
        children, ends = self.children, self.ends
        open_nodes = [(0, {0: 0} | dict.fromkeys(children[0].values(), 1))]
        while open_nodes:
            node, active = open_nodes.pop()
            for c, child in children[node].items():
                near: dict[int, int] = {}
                for other, distance in active.items():
                    if distance:
                        match = children[other].get(c)
                        if match is not None:
                            near.setdefault(match, 1)
                    else:
                        near.setdefault(other, 1)
                        for letter, step in children[other].items():
                            if letter == c:
                                near[step] = 0
                            else:
                                near.setdefault(step, 1)
                for step in children[child].values():
                    near.setdefault(step, 1)
                own = ends[child]
                if own >= 0:
                    for other, distance in near.items():
                        if distance and ends[other] > own:
                            yield own, ends[other]
                open_nodes.append((child, near))


def _common(a: str, b: str) -> int:
    return sum(1 for _ in takewhile(lambda x: x[0] == x[1], zip(a, b, strict=False)))


def _pairs(rows: list[tuple], m: int, lo: int, hi: int, below: int) -> Iterator[tuple]:
    words = [r[0] for r in rows]
    for i, j in Trie([w[lo : len(w) - hi] for w in words]).links():
        a, b = words[i], words[j]
        if min(len(a), len(b)) == m and (below == _NO_LIMIT or _common(a, b) < below):
            yield a, b, rows[j][1]
            yield b, a, rows[i][1]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of partitions that come one after another."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in (*_KEYS, "word", "n")), strict=True)

    def shown(links: list[tuple]) -> pa.RecordBatch:
        words, others, n = zip(*links, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(others, pa.string()), pa.array(n, pa.int64())], names=["word", "near", "near_n"])

    def parts() -> Iterator[tuple[tuple, list[tuple]]]:
        key, members = None, []
        for row in rows():
            if row[:6] != key:
                if len(members) > 1:
                    yield key, members
                key, members = row[:6], []
            members.append(row[6:])
        if len(members) > 1:
            yield key, members

    links: list[tuple] = []
    for (m, lo, hi, below, _, _), members in parts():
        links.extend(_pairs(members, m, lo, hi, below))
        if len(links) > 20_000:
            yield shown(links)
            links = []
    if links:
        yield shown(links)


def near_words(words: DataFrame, most: int = 4096) -> DataFrame:
    """Links between words of ``words`` (word, n, distinct) that differ by one
    inserted, deleted or replaced character: word, near, near_n, both ways."""
    parts = partitions(words, most).repartition(*_KEYS).sortWithinPartitions(*_KEYS, "word")
    return parts.mapInArrow(_joined, "word string, near string, near_n long")


def _last(forms: DataFrame) -> DataFrame:
    """Rows (word, root) of rows (word, form): the end of each chain of forms.
    A form occurs more often than its word, so chains end; their length is
    bounded by the logarithm of the counts, and rounds by that of their length."""
    roots = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if roots.join(onward, "root", "left_semi").isEmpty():
            return roots
        roots = cut(roots.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")


def group_variants(docs: DataFrame, least_chars: int = 6, least: int = 5, typo: int = 199, times: int = 5, most: int = 4096) -> DataFrame:
    """One row per word of ``docs`` (doc_id, text): word, n, n_near, form,
    form_n, root.

    The form of a word is its near word of the largest count (ties: the least in
    code-point order) if that count is ``times`` its own at least, else null;
    the root follows forms to the last. A word without near words has n_near 0
    and is its own root. Null and empty texts have no words; repeated rows count
    again; a null doc_id is the empty string. No words, no rows; other columns
    are ignored.
    """
    words = cut(vocabulary(docs, least_chars, least, typo), "vocabulary")
    links = near_words(words, most)
    best = links.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("first"))
    form: Column = F.when(-F.col("first.less") >= times * F.col("n"), F.col("first.near"))
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form"), F.when(form.isNotNull(), -F.col("first.less")).alias("form_n"))
    found = cut(found, "forms")
    return found.join(_last(found.where("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))
