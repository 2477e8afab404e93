"""SentencePiece encoding with seeded merge-dropout, and decoding.

Words are segmented by merging the best-scored neighbouring pair again and
again. Each candidate (two neighbours, by their places in the word) that comes
up in this agenda is skipped for good if a hash of it, keyed by seed, document,
place of the word and word, falls under the dropout rate, so every occurrence
of a word has draws of its own.

Only a skipped merge that would have been made changes an agenda. The model's
own segmentation tells the merges that an agenda without skips makes (those
inside its pieces); an occurrence that skips none of them keeps it. The others
go, with the merges that they skip left out, to agendas that are worked off
thousands at a time, equal (word, merges left out) once, until no merge made is
skipped.

Blanks start words and no piece reaches over one, so words are independent.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm import textkernels as K

BLANK = "▁"
#: Words of more code points are segmented one by one.
WIDE = 32
#: Bytes of text that are worked off at once; a longer text is cut before words.
_STRETCH = 1 << 20
_NONE = np.int32(1 << 30)
_START = np.ones(256, dtype=bool)
_START[0x80:0xC0] = False


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Model:
    """Merges of a SentencePiece BPE vocabulary with byte fallback."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.spm = spm = sentencepiece.SentencePieceProcessor(model_file=path)
        n = spm.vocab_size()
        names = [spm.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (spm.is_byte(i) or spm.is_control(i) or spm.is_unknown(i) or spm.is_unused(i))]
        self.byte = np.zeros(256, dtype=np.int32)
        for i in range(n):
            if spm.is_byte(i):
                self.byte[int(names[i][1:-1], 16)] = i
        self.id = {names[i]: i for i in plain}
        scores = sorted({spm.get_score(i) for i in plain}, reverse=True)
        order = {s: r for r, s in enumerate(scores)}
        self.rank = {i: order[spm.get_score(i)] for i in plain}
        # symbols: piece ids; a character that is no piece gets n + code point
        self.vocabulary, self.names, self.plain = n, names, plain
        decoded = [bytes([int(names[i][1:-1], 16)]) if spm.is_byte(i) else b"" if spm.is_control(i) or spm.is_unknown(i) else names[i].replace(BLANK, " ").encode() for i in range(n)]
        self.piece_bytes = np.frombuffer(b"".join(decoded), dtype=np.uint8)
        self.piece_length = np.array([len(x) for x in decoded], dtype=np.int64)
        self.piece_start = np.concatenate([[0], np.cumsum(self.piece_length)[:-1]])
        # code points that start in a piece
        self.piece_chars = np.array([sum(b & 0xC0 != 0x80 for b in x) for x in decoded], dtype=np.int64)
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        # merges inside each piece, as codes relative to its start: number (-1: not known yet), place in codes
        self.inner_count, self.inner_start = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64)
        self.codes = np.zeros(0, dtype=np.int32)

    def learn_inner(self, ids: np.ndarray) -> None:
        """Know the merges inside the pieces ``ids``."""
        found, base = [], len(self.codes)
        for i in np.unique(ids[self.inner_count[ids] < 0]).tolist():
            codes: list[int] = []
            if self.piece_length[i] > 0 and i in self.rank and len(self.names[i]) > 1:
                if segment_one(self, self.names[i].replace(BLANK, " "), 0, 0, codes) != [i]:
                    raise ValueError(f"piece {i} is not what its own merges give")
            self.inner_count[i], self.inner_start[i] = len(codes), base
            base += len(codes)
            found += codes
        if found:
            self.codes = np.append(self.codes, np.array(found, dtype=np.int32))

    def with_merges(self) -> Model:
        """Build what encoding needs besides; decoding does without."""
        if self.pairs:
            return self
        n, names, plain = self.vocabulary, self.names, self.plain
        pairs = []
        for i in plain:
            for cut in range(1, len(names[i])):
                a, b = (self.symbol(x) for x in (names[i][:cut], names[i][cut:]))
                if a is not None and b is not None:
                    pairs.append((a, b, i, self.rank[i]))
        left, right, self.merged, self.ranks = (np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True))
        self.pairs = {(a, b): (r, i) for a, b, i, r in pairs}
        size = 1 << 20
        self.slots = np.full(size, -1, dtype=np.int32)
        self.keys = (left << 32) | right
        place = (K.fmix(self.keys.view(K.U64)) & K.U64(size - 1)).astype(np.int64)
        self.reach = 1
        for at, start in enumerate(place.tolist()):
            step = 0
            while self.slots[(start + step) & (size - 1)] >= 0:
                step += 1
            self.slots[(start + step) & (size - 1)] = at
            self.reach = max(self.reach, step + 1)
        # symbol of each character of a text: a space is the blank, and a
        # blank sign that a text itself holds goes by its bytes
        self.characters = np.arange(0x110000, dtype=np.int32) + n
        for name, i in self.id.items():
            if len(name) == 1:
                self.characters[ord(name)] = i
        self.characters[0x20], self.characters[ord(BLANK)] = self.characters[ord(BLANK)], n + ord(BLANK)
        return self

    def symbol(self, text: str) -> int | None:
        found = self.id.get(text)
        return found if found is not None else self.vocabulary + ord(text) if len(text) == 1 else None

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged piece) of pairs; rank _NONE where there is no piece."""
        keys = (left.astype(np.int64) << 32) | right
        size = len(self.slots)
        place = (K.fmix(keys.view(K.U64)) & K.U64(size - 1)).astype(np.int64)
        rank = np.full(keys.shape, _NONE, dtype=np.int32)
        merged = np.zeros(keys.shape, dtype=np.int32)
        todo = np.arange(keys.size)
        for step in range(self.reach):
            at = self.slots[(place[todo] + step) & (size - 1)]
            some = at >= 0
            todo, at = todo[some], at[some]
            hit = self.keys[at] == keys[todo]
            rank[todo[hit]], merged[todo[hit]] = self.ranks[at[hit]], self.merged[at[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
        return rank, merged

    def pieces(self, symbols: list[int]) -> list[int]:
        """Ids of final symbols; other characters by their bytes."""
        out: list[int] = []
        for s in symbols:
            if s < self.vocabulary:
                out.append(s)
            else:
                out += self.byte[list(chr(s - self.vocabulary).encode())].tolist()
        return out


@lru_cache(maxsize=2)
def model_of(path: str) -> Model:
    return Model(path)


def _skip(key: np.ndarray, begin: np.ndarray, middle: np.ndarray, end: np.ndarray, limit: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        spot = (begin.astype(K.U64) * K.U64(0x9E3779B97F4A7C15)) ^ (middle.astype(K.U64) * K.U64(0xC2B2AE3D27D4EB4F)) ^ (end.astype(K.U64) * K.U64(0x165667B19E3779F9))
        return (K.fmix(key ^ spot) >> K.U64(32)) < K.U64(limit)


def segment_one(model: Model, word: str, key: int, limit: int, made: list[int] | None = None) -> list[int]:
    """Agenda of one word, best score first, then leftmost; ``made`` gets the
    codes of the merges made, for words of at most 63 code points."""
    symbols = [int(model.characters[ord(c)]) for c in word]
    n = len(symbols)
    ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
    agenda: list[tuple[int, int, int, int, int]] = []

    def offer(a: int) -> None:
        b = ends[a]
        if a >= 0 and b < n and (found := model.pairs.get((symbols[a], symbols[b]))):
            heapq.heappush(agenda, (found[0], a, b, ends[b], found[1]))

    live = [True] * n
    for a in range(n - 1):
        offer(a)
    while agenda:
        _, a, b, c, merged = heapq.heappop(agenda)
        if not live[a] or b >= n or not live[b] or ends[a] != b or ends[b] != c:
            continue
        if limit and bool(_skip(np.array([key], dtype=K.U64), np.array([a]), np.array([b]), np.array([c]), limit)[0]):
            continue
        symbols[a], ends[a], live[b] = merged, c, False
        if made is not None:
            made.append((a << 6 | b) << 6 | c)
        if c < n:
            before[c] = a
            offer(a)
        if before[a] >= 0:
            offer(before[a])
    return model.pieces([symbols[i] for i in range(n) if live[i]])


def _agendas(model: Model, symbols: np.ndarray, lengths: np.ndarray, barred: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Agendas of many words at once (rows of symbols, padded) without the
    merges in ``barred`` (codes, padded by -1): final symbols, their number and
    the codes of the merges made, in order. Each round pops every word's best
    candidate."""
    rows, width = symbols.shape
    s, n = symbols.astype(np.int32), lengths.copy()
    places = np.arange(width)
    begin = np.broadcast_to(places, (rows, width)).astype(np.int32).copy()
    rank = np.full((rows, width), _NONE, dtype=np.int32)
    merged = np.zeros((rows, width), dtype=np.int32)
    made = np.full((rows, max(width - 1, 1)), -1, dtype=np.int32)

    def code(r: np.ndarray, at: np.ndarray) -> np.ndarray:
        after = np.where(at + 2 < n[r], begin[r, np.minimum(at + 2, width - 1)], lengths[r])
        return ((begin[r, at] << 6 | begin[r, at + 1]) << 6 | after).astype(np.int32)

    def offer(r: np.ndarray, at: np.ndarray) -> None:
        """Candidates of the pairs that start at symbol ``at`` of rows ``r``."""
        ok = (at >= 0) & (at + 1 < n[r])
        rank[r[~ok & (at >= 0)], at[~ok & (at >= 0)]] = _NONE
        r, at = r[ok], at[ok]
        found, piece = model.look(s[r, at], s[r, at + 1])
        if barred.shape[1]:
            found[(barred[r] == code(r, at)[:, None]).any(axis=1)] = _NONE
        rank[r, at], merged[r, at] = found, piece

    r, at = np.nonzero(places[None, :] + 1 < lengths[:, None])
    offer(r, at)
    live = np.arange(rows)
    step = 0
    while len(live):
        best = rank[live].argmin(axis=1)
        some = rank[live, best] < _NONE
        live, best = live[some], best[some]
        if not len(live):
            break
        made[live, step] = code(live, best)
        step += 1
        s[live, best] = merged[live, best]
        take = np.minimum(places[None, :] + (places[None, :] > best[:, None]), width - 1)
        for table in (s, begin, rank, merged):
            table[live] = np.take_along_axis(table[live], take, axis=1)
        n[live] -= 1
        rank[live, np.minimum(n[live], width - 1)] = np.where(n[live] < width, _NONE, rank[live, width - 1])
        offer(np.concatenate([live, live]), np.concatenate([best, best - 1]))
    return s, n, made[:, :step]


def ways(model: Model, symbols: np.ndarray, lengths: np.ndarray, word: np.ndarray, keys: np.ndarray, limit: int, bars: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segmentations of occurrences (``word``: their row of ``symbols``, of at
    most WIDE columns; ``keys``: their own; ``bars``: occurrences and codes of
    merges known to be skipped): final symbols and number of each distinct
    segmentation, and which of them each occurrence has."""
    finals, counts, chosen = [], [], np.zeros(len(word), dtype=np.int64)
    todo, base = np.arange(len(word)), 0
    who, code = bars  # positions in todo, and codes
    while len(todo):
        # a node is a word and the merges left out
        with np.errstate(over="ignore"):
            mark = K.fmix(word[todo].astype(K.U64) + K.U64(11))
            np.add.at(mark, who, K.fmix(code.astype(K.U64) + K.U64(1 << 40)))
        _, first, node = np.unique(mark, return_index=True, return_inverse=True)
        order = np.argsort(who, kind="stable")
        number = np.bincount(who, minlength=len(todo))
        start = np.cumsum(number) - number
        some, width = number[first], int(number[first].max(initial=0))
        barred = np.full((len(first), width), -1, dtype=np.int32)
        inside = np.arange(width)[None, :] < some[:, None]
        barred[inside] = code[order[(start[first][:, None] + np.arange(width)[None, :])[inside]]]
        own = word[todo[first]]
        parts = [_agendas(model, symbols[own[i : i + 8192]], lengths[own[i : i + 8192]], barred[i : i + 8192]) for i in range(0, len(own), 8192)]
        finals += [p[0] for p in parts]
        counts += [p[1] for p in parts]
        chosen[todo] = base + node
        base += len(own)
        if not limit:
            break
        made = np.full((len(own), max(p[2].shape[1] for p in parts)), -1, dtype=np.int32)
        for i, p in enumerate(parts):
            made[i * 8192 : i * 8192 + len(p[2]), : p[2].shape[1]] = p[2]
        at, step = np.nonzero(made[node] >= 0)
        spot = made[node[at], step]
        skip = _skip(keys[todo[at]], spot >> 12, spot >> 6 & 63, spot & 63, limit)
        again = np.zeros(len(todo), dtype=bool)
        again[at[skip]] = True
        place = np.cumsum(again) - 1
        kept = again[who]
        who, code = np.append(place[who[kept]], place[at[skip]]), np.append(code[kept], spot[skip])
        todo = todo[again]
    return np.concatenate([*finals, np.zeros((0, symbols.shape[1]), np.int32)]), np.concatenate([*counts, np.zeros(0, np.int64)]), chosen


def segment_many(model: Model, symbols: np.ndarray, lengths: np.ndarray, keys: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Final symbols and their number of many words, each with its own key."""
    none = np.zeros(0, dtype=np.int64)
    final, n, chosen = ways(model, symbols, lengths, np.arange(len(symbols)), keys, limit, (none, none.astype(np.int32)))
    return final[chosen], n[chosen]


class Encoder:
    """Encodes texts of a batch. Words that skip no merge are the model's own;
    of the others, equal ones that skip the same merges are segmented once."""

    def __init__(self, model: Model, seed: int, dropout: float) -> None:
        self.model, self.seed = model.with_merges(), seed
        self.limit = min(int(dropout * (1 << 32)), (1 << 32) - 1) if dropout > 0 else 0
        self.hash = K.keyed(77, 256) | K.U64(1)

    def texts(self, data: np.ndarray, offsets: np.ndarray, doc_keys: np.ndarray) -> Iterator[list[np.ndarray]]:
        """Ids of the texts between ``offsets``, in lists of some texts."""
        for a, b in K.chunks(offsets, _STRETCH):
            if b - a > 1 or offsets[b] - offsets[a] <= 2 * _STRETCH:
                yield self.stretch(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], doc_keys[a:b])
            else:
                yield [self._long(data[offsets[a] : offsets[b]], doc_keys[a:b])]

    def _long(self, text: np.ndarray, key: np.ndarray) -> np.ndarray:
        """A long text in parts: the blank that starts a word stands for the
        one that is put before a text."""
        blank = text == 0x20
        starts = np.flatnonzero(blank[1:-1] & ~blank[:-2] & ~blank[2:] & (text[2:] != 0x0A)) + 1
        ids, at, place = [], 0, 0
        while at < len(text):
            later = np.searchsorted(starts, at + _STRETCH)
            stop = int(starts[later]) if later < len(starts) else len(text)
            part = text[at + (at > 0) : stop]
            (own,), n = self._words(part, np.array([0, len(part)]), key, place)
            ids.append(own)
            at, place = stop, place + n
        return np.concatenate(ids)

    def stretch(self, part: np.ndarray, at: np.ndarray, doc_keys: np.ndarray) -> list[np.ndarray]:
        """Ids of each text; ``at`` are the texts' bounds in ``part``."""
        return self._words(part, at, doc_keys, 0)[0]

    def _words(self, part: np.ndarray, at: np.ndarray, doc_keys: np.ndarray, first_place: int) -> tuple[list[np.ndarray], int]:
        """Ids of each text, and the number of words."""
        model, all_texts = self.model, len(at) - 1
        full = np.flatnonzero(at[1:] > at[:-1])
        out = [np.zeros(0, np.int32)] * all_texts
        if not len(full):
            return out, 0
        # a blank before every text that is not empty
        n, low, size = len(full), at[:-1][full], (at[1:] - at[:-1])[full]
        edge = np.concatenate([[0], np.cumsum(size + 1)])
        padded = np.empty(edge[-1], dtype=np.uint8)
        heads = np.zeros(len(padded), dtype=bool)
        heads[edge[:-1]] = True
        padded[heads], padded[~heads] = 0x20, part[low[0] : low[-1] + size[-1]]

        blank, line = padded == 0x20, padded == 0x0A
        start = np.zeros(len(padded), dtype=bool)
        start[1:] = (blank[1:] & ~blank[:-1]) | line[1:] | line[:-1]
        start[edge[:-1] + 1] = False
        start[heads] = True
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], len(padded))
        text = np.searchsorted(edge, begin, "right") - 1
        first_word = np.searchsorted(begin, edge)
        place = np.arange(len(begin)) - first_word[text] + first_place
        words = K.hash_runs(padded, begin, end, self.hash)
        keys = K.fmix(words ^ K.fmix(doc_keys[full][text] ^ K.fmix(place.astype(K.U64) + K.U64(self.seed * 1000003 + 17))))

        _, where, word = np.unique(words, return_index=True, return_inverse=True)
        data = padded.tobytes()
        said = [data[a:b].decode() for a, b in zip(begin[where].tolist(), end[where].tolist(), strict=True)]
        lengths = np.fromiter(map(len, said), dtype=np.int64, count=len(said))
        # the model puts a blank before what it is given; a word that has not just
        # one, or holds the blank sign itself, is not the model's to segment
        plain = np.fromiter((w[0] == " " and w[1:2] not in ("", " ", "\n") and BLANK not in w for w in said), dtype=bool, count=len(said))
        which = np.flatnonzero(plain)
        own = model.spm.encode([said[i][1:] for i in which.tolist()], num_threads=1)
        count = np.zeros(len(said), dtype=np.int64)
        count[which] = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
        ids = np.fromiter(chain.from_iterable(own), dtype=np.int32, count=int(count.sum()))
        at_piece = np.cumsum(count) - count

        who, code = np.zeros(0, np.int64), np.zeros(0, np.int32)
        changed = ~plain[word]
        if self.limit:
            # a word too long for codes has an agenda of its own
            changed |= lengths[word] > WIDE
            model.learn_inner(ids)
            characters = np.cumsum(model.piece_chars[ids]) - model.piece_chars[ids]
            of_piece = np.repeat(np.arange(len(said)), count)
            short = lengths[of_piece] <= WIDE
            shift = (characters - np.append(characters, 0)[at_piece[of_piece]])[short]
            inner = model.inner_count[ids[short]]
            take = np.repeat(model.inner_start[ids[short]] - np.cumsum(inner) + inner, inner) + np.arange(int(inner.sum()))
            far = np.repeat(shift, inner)
            codes = (model.codes[take] + (far << 12 | far << 6 | far)).astype(np.int32)
            number = np.bincount(np.repeat(of_piece[short], inner), minlength=len(said))
            first = np.cumsum(number) - number
            # every occurrence against the merges of its word
            each = number[word]
            by = np.repeat(np.arange(len(word)), each)
            spot = codes[np.repeat(first[word] - np.cumsum(each) + each, each) + np.arange(len(by))]
            skip = _skip(keys[by], spot >> 12, spot >> 6 & 63, spot & 63, self.limit)
            who, code = by[skip], spot[skip]
            changed[who] = True
        some = np.flatnonzero(changed)
        final = self._segment(said, lengths, word, keys, some, who, code)
        # ids of the texts from kept pieces and from those of changed words
        total = count[word]
        total[some] = final[0]
        ends = np.cumsum(total)
        result = np.empty(int(ends[-1]), dtype=np.int32)
        of_changed = np.repeat(changed, total)
        keep = np.flatnonzero(~changed)
        mine = count[word[keep]]
        result[~of_changed] = ids[np.repeat(at_piece[word[keep]] - np.cumsum(mine) + mine, mine) + np.arange(int(mine.sum()))]
        result[of_changed] = final[1]
        bounds = np.append(ends - total, ends[-1])[first_word]
        for i, k in enumerate(full.tolist()):
            out[k] = result[bounds[i] : bounds[i + 1]]
        return out, len(begin)

    def _segment(self, said: list[str], lengths: np.ndarray, word: np.ndarray, keys: np.ndarray, changed: np.ndarray, who: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of the occurrences ``changed``, and these ids in order;
        ``who`` and ``code`` are the merges known to be skipped, by occurrence."""
        slot = np.full(len(word), -1, dtype=np.int64)
        slot[changed] = np.arange(len(changed))
        who, word = slot[who], word[changed]
        back = np.zeros(len(changed), dtype=np.int64)
        counts: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        base = low = 0
        for width in (4, 6, 8, 10, 12, 16, 24, WIDE):
            rows = np.unique(word[(lengths[word] > low) & (lengths[word] <= width)])
            low = width
            if not len(rows):
                continue
            letters = np.frombuffer("".join(said[r] for r in rows.tolist()).encode("utf-32-le"), dtype=np.uint32)
            own = np.arange(width)[None, :] < lengths[rows][:, None]
            symbols = np.zeros((len(rows), width), dtype=np.int32)
            symbols[own] = self.model.characters[letters]
            row_of = np.full(len(said), -1, dtype=np.int64)
            row_of[rows] = np.arange(len(rows))
            mine = row_of[word] >= 0
            some, position = np.flatnonzero(mine), np.cumsum(mine) - 1
            barred = mine[who]
            final, n, chosen = ways(self.model, symbols, lengths[rows], row_of[word[some]], keys[changed[some]], self.limit, (position[who[barred]], code[barred]))
            back[some] = base + chosen
            base += len(n)
            own = np.arange(width)[None, :] < n[:, None]
            odd = np.flatnonzero((own & (final >= self.model.vocabulary)).any(axis=1))
            at, flat = np.cumsum(n) - n, final[own]
            pieces, n, last = [], n.copy(), 0
            for k in odd.tolist():
                part_ids = self.model.pieces(final[k, : n[k]].tolist())
                pieces += [flat[last : at[k]], np.array(part_ids, dtype=np.int32)]
                last, n[k] = at[k] + n[k], len(part_ids)
            counts.append(n)
            ids += [*pieces, flat[last:]]
        # long words: each occurrence by itself, without dropout each word once
        some = np.flatnonzero(lengths[word] > WIDE)
        _, which, same = np.unique(keys[changed[some]] if self.limit else word[some], return_index=True, return_inverse=True)
        long = [np.array(segment_one(self.model, said[word[o]], int(keys[changed[o]]), self.limit), dtype=np.int32) for o in some[which].tolist()]
        back[some] = base + same
        counts.append(np.fromiter(map(len, long), dtype=np.int64, count=len(long)))
        each, flat = np.concatenate(counts), np.concatenate([*ids, *long]) if ids or long else np.zeros(0, np.int32)
        number = each[back]
        total = np.cumsum(number)
        offsets = np.cumsum(each) - each
        take = np.repeat(offsets[back] - total + number, number) + np.arange(total[-1] if len(total) else 0)
        return number, flat[take].astype(np.int32)


_TYPES = "doc_id long, n_ids long, ids binary"


def _encode(path: str, seed: int, dropout: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model_of(path), seed, dropout)
        for batch in batches:
            data, offsets, null = K.texts_of(batch.column("text"))
            raw = batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False)
            doc_keys = K.fmix(raw.astype(np.int64).view(K.U64) ^ K.U64(seed * 7919 + 5))
            a = 0
            for ids in encoder.texts(data, offsets, doc_keys):
                own = [None if null[a + i] else x.astype("<u4").tobytes() for i, x in enumerate(ids)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, len(ids)), pa.array([len(x) for x in ids], pa.int64()), pa.array(own, pa.binary())], names=["doc_id", "n_ids", "ids"])
                a += len(ids)

    return run


def encode(docs: DataFrame, model: str | None = None, seed: int = 1, dropout: float = 0.1) -> DataFrame:
    """doc_id, n_ids, ids (unsigned little-endian 32-bit) of every row of
    ``docs`` (doc_id, text). Without dropout these are the model's own ids.

    A null text has null ids, an empty one none. Rows that repeat a doc_id get
    a row each, with equal ids for equal texts; no rows in, no rows out; other
    columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_encode(model or default_model(), seed, dropout), _TYPES)


def decode_ids(model: Model, ids: np.ndarray) -> bytes:
    lengths = model.piece_length[ids]
    total = np.concatenate([[0], np.cumsum(lengths)])
    return model.piece_bytes[np.repeat(model.piece_start[ids] - total[:-1], lengths) + np.arange(total[-1])].tobytes()[1:]


def _decode(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        for batch in batches:
            out = [None if x is None else decode_ids(model, np.frombuffer(x, dtype="<u4").astype(np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_ids"), batch.column("ids"), pa.array(out, pa.binary()).cast(pa.string())], names=["doc_id", "n_ids", "ids", "text"])

    return run


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """Texts of rows of ``encode``: doc_id, n_ids, ids, text. Null ids give a
    null text; the blank that encoding puts before a text is taken away."""
    return encoded.select("doc_id", "n_ids", "ids").mapInArrow(_decode(model or default_model()), _TYPES + ", text string")
