"""Quality rules: a linear-chain conditional random field over a text's lines.

Every line with a word is content or boilerplate. Its binary features feed a
two-state chain whose weights are fitted here on a bounded sample of labelled
documents (``SAMPLE`` documents of at most ``SAMPLE_LINES`` lines); Viterbi
decoding labels the lines of every document, and the share of words in content
lines decides whether it stays. Plain counts come from the same pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm import textkernels as K

#: The fit sees at most so many labelled documents, least hash first, and of
#: those the ones of at most so many lines.
SAMPLE, SAMPLE_LINES = 1500, 40
FEATURES = ("any", "some symbols", "many symbols", "shouting", "exclaiming", "digits", "repeated line", "short", "ends a sentence", "bars", "long words", "stuttering")


def _class(characters: str) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(characters.encode())] = True
    return table


_SYMBOL, _BAR, _LOUD, _DIGIT = _class("#*$%&|<>"), _class("|"), _class("!"), _class("0123456789")
_UPPER, _LOWER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("abcdefghijklmnopqrstuvwxyz")
_LETTER_START = np.ones(256, dtype=bool)
_LETTER_START[0x80:0xC0] = False
_LETTER_START[K.WHITE] = False
_ENDS = frozenset(b".!?:;\"'")


def _sums(mask: np.ndarray) -> np.ndarray:
    """Running sums of a mask, from 0; a chunk of texts has under 2**31 bytes."""
    out = np.zeros(len(mask) + 1, dtype=np.int32)
    np.cumsum(mask, out=out[1:])
    return out


def _repeat_words(hashes: np.ndarray, width: int = 8) -> int:
    """Words in windows of ``width`` words that occur twice or more."""
    n = len(hashes)
    if n <= width:
        return 0
    grams = K.windows(hashes, width)
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(n - width + 1, dtype=bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    cover = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(again)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width, -1)
    return int((np.cumsum(cover) > 0).sum())


def analyse(column: pa.Array, size: int = 1 << 19) -> Iterator[tuple[int, tuple[int, int, int, int, int], np.ndarray, np.ndarray]]:
    """Per text: row, (n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words), feature bits and words of its lines with a word."""
    data, offsets, _ = K.texts_of(column)
    for first, last in K.chunks(offsets, size):
        part = data[offsets[first] : offsets[last]]
        at = offsets[first : last + 1] - offsets[first]
        starts, ends = K.word_bounds(part, at)
        hashes = K.word_hashes(part, starts, ends, lower=False)
        chars, symbols = _sums(_LETTER_START[part]), _sums(_SYMBOL[part])
        bars, loud, digits, upper, low = (_sums(x[part]) for x in (_BAR, _LOUD, _DIGIT, _UPPER, _LOWER))
        stutter = _sums(np.concatenate([[False], hashes[1:] == hashes[:-1]])) if len(hashes) else np.zeros(1, np.int64)
        breaks = np.flatnonzero(part == 10)
        edge, cut = np.searchsorted(starts, at), np.searchsorted(breaks, at)
        for i in range(last - first):
            a, b = at[i], at[i + 1]
            own = hashes[edge[i] : edge[i + 1]]
            begin = np.concatenate([[a], breaks[cut[i] : cut[i + 1]] + 1])
            stop = np.concatenate([breaks[cut[i] : cut[i + 1]], [b]])
            w0, w1 = np.searchsorted(starts, begin), np.searchsorted(starts, stop)
            some = w1 > w0
            begin, stop, w0, w1 = begin[some], stop[some], w0[some], w1[some]
            seen: set[bytes] = set()
            again = np.zeros(len(begin), dtype=bool)
            text = part[a:b].tobytes()
            for k, (x, y) in enumerate(zip((begin - a).tolist(), (stop - a).tolist(), strict=True)):
                line = text[x:y]
                again[k] = line in seen
                seen.add(line)
            n_words, wide = w1 - w0, np.maximum(1, chars[stop] - chars[begin])
            ratio = lambda s, b=begin, e=stop, n=wide: (s[e] - s[b]) / n
            cased = np.maximum(1, upper[stop] - upper[begin] + low[stop] - low[begin])
            terminal = np.fromiter((x in _ENDS for x in part[ends[w1 - 1] - 1].tolist()), dtype=bool, count=len(w1))
            flags = (
                np.ones(len(begin), dtype=bool), ratio(symbols) > 0.01, ratio(symbols) > 0.1, (upper[stop] - upper[begin]) / cased > 0.5,
                ratio(loud) > 0.05, ratio(digits) > 0.2, again, n_words < 4, terminal, bars[stop] - bars[begin] > 1, wide / n_words > 12,
                (stutter[w1] - stutter[np.minimum(w0 + 1, w1)]) / n_words > 0.3,
            )
            bits = sum(flag.astype(np.int64) << k for k, flag in enumerate(flags))
            counts = (len(own), int(chars[b] - chars[a]), int(symbols[b] - symbols[a]), int(again.sum()), _repeat_words(own))
            yield first + i, counts, bits, n_words


def _unpacked(bits: np.ndarray) -> np.ndarray:
    return ((bits[..., None] >> np.arange(len(FEATURES))) & 1).astype(np.float64)


def fit(documents: list[tuple[list[int], int]]) -> tuple[np.ndarray, np.ndarray]:
    """Weights (states x features, states x states) that maximise the
    conditional likelihood of the sample; state 1 is content. First every line
    takes its document's label; then the lines of bad documents that by their
    own features are content become so, and the chain is fitted to that."""
    documents = [x for x in documents if x[0]]
    if len({label for _, label in documents}) < 2:
        emit = np.zeros((2, len(FEATURES)))
        emit[1, 0] = 1.0
        return emit, np.zeros((2, 2))
    longest = max(len(x) for x, _ in documents)
    bits = np.zeros((len(documents), longest), dtype=np.int64)
    live = np.zeros(bits.shape, dtype=bool)
    for i, (line, _) in enumerate(documents):
        bits[i, : len(line)], live[i, : len(line)] = line, True
    x, good = _unpacked(bits), np.array([label for _, label in documents], dtype=bool)[:, None] & live
    emit, move = _climb(x, live, good.astype(np.int64), np.zeros((2, len(FEATURES))), np.zeros((2, 2)))
    own = x @ (emit[1] - emit[0]) > 0
    own &= ~(own & live).all(axis=1, where=live)[:, None]
    return _climb(x, live, (good | (own & live)).astype(np.int64), emit, np.zeros((2, 2)))


def _add(a: np.ndarray) -> np.ndarray:
    """log of the sum of exponentials over the last axis, of two entries."""
    return np.logaddexp(a[..., 0], a[..., 1])


def marginals(x: np.ndarray, live: np.ndarray, emit: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each state of each line, and of each pair of states of
    neighbouring lines, by forward-backward over all documents at once."""
    longest, both = live.shape[1], live[:, 1:] & live[:, :-1]
    score = x @ emit.T
    forward, backward = score.copy(), np.zeros_like(score)
    for t in range(1, longest):
        forward[:, t] = np.where(live[:, t, None], score[:, t] + _add(forward[:, t - 1, None, :] + move.T), forward[:, t - 1])
    for t in range(longest - 2, -1, -1):
        backward[:, t] = np.where(both[:, t, None], _add((score[:, t + 1] + backward[:, t + 1])[:, None, :] + move), 0)
    norm = _add(forward[:, -1])
    p = np.exp(forward + backward - norm[:, None, None]) * live[..., None]
    return p, np.exp(forward[:, :-1, :, None] + move + (score + backward)[:, 1:, None, :] - norm[:, None, None, None]) * both[..., None, None]


def _climb(x: np.ndarray, live: np.ndarray, y: np.ndarray, emit: np.ndarray, move: np.ndarray, steps: int = 80, penalty: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Gradient ascent with adaptive steps."""
    total = live.sum()
    both = live[:, 1:] & live[:, :-1]
    gold = np.stack([live & (y == 0), live & (y == 1)], axis=-1).astype(np.float64)
    gold_move = np.zeros((2, 2))
    np.add.at(gold_move, (y[:, :-1][both], y[:, 1:][both]), 1)
    weights = [emit.copy(), move.copy()]
    kept = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    for step in range(1, steps + 1):
        emit, move = weights
        p, pairs = marginals(x, live, emit, move)
        slopes = (np.tensordot(gold - p, x, axes=((0, 1), (0, 1))) / total - penalty * emit, (gold_move - pairs.sum(axis=(0, 1))) / total - penalty * move)
        for (mean, square), w, slope in zip(kept, weights, slopes, strict=True):
            mean += 0.1 * (slope - mean)
            square += 0.01 * (slope**2 - square)
            w += 0.15 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return weights[0], weights[1]


def viterbi(scores: np.ndarray, move: np.ndarray) -> list[int]:
    """Best states of one document; of equal paths, the one with content."""
    if not len(scores):
        return []
    (m00, m01), (m10, m11) = move.tolist()
    rows = scores.tolist()
    s0, s1 = rows[0]
    back = []
    for e0, e1 in rows[1:]:
        a0, b0, a1, b1 = s0 + m00, s1 + m10, s0 + m01, s1 + m11
        back.append((int(b0 >= a0), int(b1 >= a1)))
        s0, s1 = max(a0, b0) + e0, max(a1, b1) + e1
    state = int(s1 >= s0)
    path = [state]
    for step in reversed(back):
        state = step[state]
        path.append(state)
    return path[::-1]


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines: list[list[int] | None] = [None] * batch.num_rows
        for i, _, bits, _ in analyse(batch.column("text")):
            if len(bits) <= SAMPLE_LINES:
                lines[i] = bits.tolist()
        yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(lines, pa.list_(pa.int64()))], names=["quality", "bits"])


def learn(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Fit on the ``SAMPLE`` labelled documents of least hash; a label is 0 or
    1, others are ignored. Without both labels every line counts as content."""
    chosen = labels.where("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(SAMPLE)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    rows = texts.join(F.broadcast(chosen), "doc_id").select("quality", "text").mapInArrow(_bits, "quality int, bits array<long>").where("size(bits) > 0")
    found = rows.orderBy(F.xxhash64("bits"), "quality").limit(SAMPLE).collect()
    return fit([(list(r["bits"]), r["quality"]) for r in found])


_TYPES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_words long, labels string"


def _label(emit: np.ndarray, move: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.zeros((batch.num_rows, 6), dtype=np.int64)
            names = [""] * batch.num_rows
            for i, five, bits, words in analyse(batch.column("text")):
                path = viterbi(_unpacked(bits) @ emit.T, move)
                counts[i] = *five, int(words[np.array(path, dtype=bool)].sum()) if len(path) else 0
                names[i] = "".join("bc"[s] for s in path)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(counts[:, k]) for k in range(6)), pa.array(names)], names=[x.split()[0] for x in _TYPES.split(", ")])

    return run


def judge(docs: DataFrame, labels: DataFrame, share: float = 0.5) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts, line labels (c or b
    for each line with a word), content_share, base_failed, kept.

    ``base_failed``: fewer than 20 words, or more than 30 % of them in 8-word
    windows that occur twice. ``kept``: not so, and at least ``share`` of the
    words are in content lines. A null or empty text has no words and fails.
    Rows that repeat a doc_id or have none get a row each; no rows in, no rows
    out; other columns are ignored.
    """
    emit, move = learn(docs, labels)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_label(emit, move), _TYPES)
    return _verdict(found, share)


def _verdict(found: DataFrame, share: float) -> DataFrame:
    found = found.withColumn("content_share", F.when(F.col("n_words") > 0, F.col("content_words") / F.col("n_words")).otherwise(0.0))
    found = found.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    return found.withColumn("kept", ~F.col("base_failed") & (F.col("content_share") >= share))


def keep_content(docs: DataFrame, labels: DataFrame, share: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns, in
    one pass and without a shuffle: the verdict is taken on the text itself. A
    null, empty or blank text goes; rows that repeat a doc_id or have none are
    judged each by its text; no rows in, no rows out."""
    emit, move = learn(docs, labels)

    @F.arrow_udf("boolean")
    def stays(text: pa.Array) -> pa.Array:
        kept = np.zeros(len(text), dtype=bool)
        for i, (n_words, _, _, _, repeated), bits, words in analyse(text):
            path = np.array(viterbi(_unpacked(bits) @ emit.T, move), dtype=bool)
            kept[i] = n_words >= 20 and 100 * repeated <= 30 * n_words and words[path].sum() / n_words >= share
        return pa.array(kept)

    return docs.where(stays("text"))
