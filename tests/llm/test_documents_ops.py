"""Operators on documents: odd rows, brute force, round trips, accuracy."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from spindrift.llm import components, langmix, lines, mergedrop, minhash, order, packing
from spindrift.llm import textkernels as K
from spindrift.llm.tokens import default_vocabulary, encode

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, v long, ids string, key string"


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def odd_rows():
    long = "word " * 30_000 + "end"
    extra = ("src", 1, "clash", 7, "x", "k")
    rows = [(1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, "one", "fr"), (5, long, "en"), (6, long, "en"), (7, "Ünï cödé 漢字 😀 <|endoftext|> ▁ x", None), (8, "a b c d", "en"), (8, "a b c d", "en"), (None, "a b c d", "de"), (9, "123 456 %%%", "en"), (10, "A B C D", "xx")]
    return [(i, t, g, *extra) for i, t, g in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def near_rows(seed=3):
    rng = random.Random(seed)
    rows, i = [], 0
    for _ in range(12):
        base = words(rng, rng.randrange(20, 60))
        for _ in range(rng.randrange(1, 14)):
            w = list(base)
            for _ in range(rng.randrange(0, 6)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
            rows.append((i, " ".join(w)))
            i += 1
    return rows


def brute_components(rows, size, percent=80):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("size,chunk", [(2, 1024), (5, 1024), (2, 6)])
def test_near_duplicates_match_brute_force(spark, monkeypatch, size, chunk):
    if chunk == 6:
        monkeypatch.setattr(minhash, "BROADCAST_ROWS", 0)
    rows = near_rows()
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size, chunk=chunk).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(rows, size)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_duplicates_of_long_sets_in_chunks_of_bytes(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK_BYTES", 2000)
    rows = near_rows(9)
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(rows, 2)


def test_near_duplicates_odd_rows(odd, empty):
    found = minhash.near_duplicates(odd, 2).collect()
    assert len(found) == 12 and minhash.near_duplicates(empty).count() == 0
    by = {r.doc_id: r for r in found}
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[1].kept and by[2].component_id == 2
    assert by[6].component_id == 5 and not by[6].kept and by[10].component_id == 8
    assert by[None].component_id is None and by[None].kept
    kept = minhash.keep_one(odd, 2)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 5, 7, 8, None, 9}


@pytest.mark.parametrize("hot", [1, 8, 2000])
def test_stars_match_reachability(spark, monkeypatch, hot):
    """All keys by shuffle, some of them by broadcast, nearly all by broadcast."""
    monkeypatch.setattr(components, "HOT", hot)
    rng = random.Random(hot)
    edges = [(7, n) for n in range(100, 400)] + [(n, n + 1) for n in range(500, 540)] + [(rng.randrange(600, 900), rng.randrange(600, 900)) for _ in range(120)] + [(3, 3), (100, 7), (None, 5)]
    least = {n: n for e in edges if None not in e for n in e}
    for _ in least:
        before = dict(least)
        for u, v in edges:
            if u is not None:
                least[u] = least[v] = min(least[u], least[v])
        if before == least:
            break
    found = components.star_edges(spark.createDataFrame(edges, "u long, v long")).collect()
    assert sorted((r.u, r.v) for r in found) == sorted((n, m) for n, m in least.items() if n != m)
    assert components.star_edges(spark.createDataFrame([], "u long, v long")).count() == 0


def test_confirm_compares_every_pair_of_components():
    rng = random.Random(5)
    sets = [np.unique(np.array([rng.randrange(60) for _ in range(40)], dtype=np.uint64)) for _ in range(40)]
    signatures = np.zeros((40, minhash.SIGNATURE), dtype=np.uint8)  # all agree: only sets decide
    label = minhash.confirm(sets, signatures, np.arange(40), 50)
    expected = list(range(40))
    changed = True
    while changed:
        changed = False
        for a in range(40):
            for b in range(40):
                inter = len(np.intersect1d(sets[a], sets[b]))
                if 100 * inter >= 50 * (len(sets[a]) + len(sets[b]) - inter) and expected[a] != expected[b]:
                    expected[a] = expected[b] = min(expected[a], expected[b])
                    changed = True
    assert [expected.index(e) for e in expected] == [label.tolist().index(x) for x in label.tolist()]


def test_word_kernels_match_regular_expressions():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abAB é漢\n\t  \x0b\r%") for _ in range(rng.randrange(80))) for _ in range(200)] + [None, "", "x" * 5000]
    seen: dict[str, int] = {}
    for i, null, hashes in K.text_words(pa.array(texts, pa.string()), lower=False, size=300):
        found = re.findall(r"[^\x20\x09-\x0D]+", texts[i] or "")
        assert null == (texts[i] is None) and len(found) == len(hashes)
        for w, h in zip(found, hashes.tolist()):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_packing_tiles_documents(spark, odd, empty):
    rng = random.Random(2)
    rows = [(i, " ".join(words(rng, rng.choice([0, 3, 50, 400, 3000])))) for i in range(120)] + [(900, None), (901, "")]
    size = 256
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), size=size).toPandas()
    from tokenizers import Tokenizer

    hf = Tokenizer.from_file(default_vocabulary())
    for i, text in rows:
        own = pieces[pieces.doc_id == i].sort_values("start")
        ids = hf.encode(text or "", add_special_tokens=False).ids + [1]
        assert np.frombuffer(b"".join(own.ids), dtype="<u4").tolist() == ids and set(own.doc_tokens) == {len(ids)}
        assert own.start.tolist() == np.cumsum([0, *own.length])[:-1].tolist()
    for _, s in pieces.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == np.cumsum([0, *s.length])[:-1].tolist() and s.length.sum() <= size
    full = pieces.groupby("sequence_id").length.sum()
    assert (full < size).sum() <= 4  # one a split
    assert packing.pack(empty).count() == 0 and packing.pack(odd).select("doc_id").distinct().count() == 11
    padded = packing.padded(packing.pack_windows(spark.createDataFrame(rows, "doc_id long, text string"), size=size), size=size).toPandas()
    assert all(len(r.ids) == 4 * (r.n_tokens if r.n_tokens & (r.n_tokens - 1) == 0 else size) for r in padded.itertuples())


def test_sum_of_squares_takes_the_best_level():
    rng = random.Random(4)
    packer = packing.Packer(16, 1000, lambda *_: None)
    for _ in range(300):
        n = rng.randrange(1, 16)
        before = packer.levels.copy()
        level = packer.level_for(n)

        def cost(h, n=n, before=before):
            after = before.copy()
            after[h] -= h > 0
            if h + n < 16:
                after[h + n] += 1
            return int((after[1:16] ** 2).sum())

        allowed = [0] + [h for h in range(1, 16 - n + 1) if before[h]]
        assert level in allowed and cost(level) == min(map(cost, allowed))
        packer.add(0, np.zeros(n, dtype=np.uint32))


def test_encode_equals_the_tokenizers_library():
    from tokenizers import Tokenizer

    hf = Tokenizer.from_file(default_vocabulary())
    rng = random.Random(9)
    alphabet = "aZ é ß ñ 0 9 \n\t  ' . , % ! \xa0   漢 😀 \x1c ́ ǅ <|endoftext|>".split(" ") + [" ", "\n", "  "]
    for _ in range(300):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
        assert encode(text.encode(), default_vocabulary()).tolist() == hf.encode(text, add_special_tokens=False).ids
    assert 50256 in encode(b"hello <|endoftext|> world", default_vocabulary()).tolist()
    # every code point that goes by ranks, alone and between letters, digits, blanks and the one before
    for c in map(chr, range(0x240)):
        text = "".join(f"{a}{c}{b}" for a in ("a", "1", " ", "\n", "'", chr(max(0, ord(c) - 1))) for b in ("b", "2", "  ", "s", c))
        assert encode(text.encode(), default_vocabulary()).tolist() == hf.encode(text, add_special_tokens=False).ids, ord(c)


def test_merge_dropout(spark, odd, empty):
    import sentencepiece

    path = mergedrop.default_model()
    spm = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [r[1] for r in odd_rows()]
    plain = mergedrop.encode(odd, dropout=0.0).toPandas()
    by = dict(zip(zip(plain.doc_id.fillna(-1), range(len(plain))), plain.ids))
    for (_, i), ids in by.items():
        if texts[i] is None:
            assert ids is None
        elif mergedrop.BLANK not in texts[i]:
            assert np.frombuffer(ids, dtype="<u4").tolist() == spm.encode(texts[i])
    one, two, other = (mergedrop.encode(odd, dropout=0.2, seed=s) for s in (1, 1, 2))
    assert [r.ids for r in one.collect()] == [r.ids for r in two.collect()] != [r.ids for r in other.collect()]
    assert [r.text for r in mergedrop.decode(one).collect()] == texts
    assert mergedrop.encode(empty).count() == 0 and mergedrop.decode(mergedrop.encode(empty)).count() == 0


def test_every_occurrence_of_a_word_has_its_own_dropout():
    model = mergedrop.model_of(mergedrop.default_model()).with_merges()
    encoder = mergedrop.Encoder(model, 1, 0.1)
    texts = [b"the of " * 500 + b"transformations " * 1000 for _ in range(4)] + ["漢字 école ".encode() * 50 + b"x" * 60]
    part, at = np.frombuffer(b"".join(texts), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    keys = K.keyed(5, len(texts))
    got = encoder.stretch(part, at, keys)
    # ids of each occurrence by an agenda of its own
    seen = {}
    for t, k, ids in zip(texts, keys, got, strict=True):
        want = []
        for place, w in enumerate(re.findall(r" *[^ ]+| +$", t.decode())):
            w = " " * (place == 0) + w
            raw = np.frombuffer(w.encode(), dtype=np.uint8)
            word = K.hash_runs(raw, np.array([0]), np.array([len(raw)]), encoder.hash)
            own = K.fmix(keys[:0].dtype.type(k) ^ K.fmix(np.array([place], dtype=K.U64) + K.U64(1000003 + 17)))
            one = mergedrop.segment_one(model, w, int(K.fmix(word ^ own)[0]), encoder.limit)
            seen.setdefault(w, []).append(tuple(one))
            want += one
        assert ids.tolist() == want
    assert len(set(seen[" transformations"])) > 10
    # "at" at the start of a line has one candidate, skipped in a tenth of all cases
    line = np.frombuffer(b"at\n" * 4000, dtype=np.uint8)
    (ids,), (plain,) = (mergedrop.Encoder(model, 1, d).stretch(line, np.array([0, len(line)]), keys[:1]) for d in (0.1, 0.0))
    assert 0.08 < (len(ids) - len(plain)) / 4000 < 0.12


def test_a_long_text_is_encoded_as_its_parts_would_be(monkeypatch):
    model = mergedrop.model_of(mergedrop.default_model())
    rng = random.Random(4)
    text = "".join(rng.choice(["the ", "transformations ", "école  ", "\n", " ▁", "漢字 ", "x" * 70]) for _ in range(3000)).encode()
    data, bounds, key = np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]), K.keyed(5, 1)
    for dropout in (0.0, 0.3):
        encoder = mergedrop.Encoder(model, 1, dropout)
        (whole,) = encoder.stretch(data, bounds, key)
        monkeypatch.setattr(mergedrop, "_STRETCH", 500)
        ((parts,),) = encoder.texts(data, bounds, key)
        monkeypatch.undo()
        assert whole.tolist() == parts.tolist() and mergedrop.decode_ids(model, whole) == text


def test_agenda_of_many_words_is_the_agenda_of_one():
    model = mergedrop.model_of(mergedrop.default_model()).with_merges()
    rng = random.Random(7)
    some = [" " + "".join(rng.choice("thenrsaoié漢") for _ in range(rng.randrange(1, 20))) for _ in range(500)]
    lengths, keys = np.array([len(w) for w in some]), K.keyed(3, 500)
    symbols = np.zeros((500, 24), dtype=np.int32)
    for i, w in enumerate(some):
        symbols[i, : len(w)] = model.characters[[ord(c) for c in w]]
    limit = 1 << 30
    final, n = mergedrop.segment_many(model, symbols, lengths, keys, limit)
    for i, w in enumerate(some):
        assert model.pieces(final[i, : n[i]].tolist()) == mergedrop.segment_one(model, w, int(keys[i]), limit)


def brute_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines_ = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    counts = {g: grams.count(g) for g in set(grams)} if len(grams) < 500 else None
    if counts is None:
        from collections import Counter

        counts = Counter(grams)
    cover = set()
    for i, g in enumerate(grams):
        if counts[g] > 1:
            cover |= set(range(i, i + 8))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines_) - len(set(lines_)), len(cover)


def test_line_counts_match_brute_force(spark, odd, empty):
    rng = random.Random(8)
    texts = ["\n".join(" ".join(rng.choice("ab cd# é%e".split()) for _ in range(rng.randrange(6))) for _ in range(rng.randrange(12))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)]
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(50)], "doc_id long, quality int, text string")
    found = lines.judge(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
    for r in found:
        want = brute_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r.base_failed and r.kept)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert lines.judge(empty, none).count() == 0 and lines.judge(odd, labels).count() == 12
    for r in lines.judge(odd, none).collect():
        assert (r.n_words, r.n_repeat_words) == (brute_counts(dict((x[0], x[1]) for x in odd_rows())[r.doc_id])[0], brute_counts(dict((x[0], x[1]) for x in odd_rows())[r.doc_id])[4])
    kept = lines.keep_content(odd, none)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in lines.judge(odd, none).where("kept").collect())


def test_line_labelling_separates_junk(spark):
    rng = random.Random(6)
    good = ["\n".join("The " + " ".join(f"word{rng.randrange(500)}" for _ in range(12)) + "." for _ in range(5)) for _ in range(60)]
    bad = ["\n".join(" ".join(f"WORD{rng.randrange(500)}!!" for _ in range(12)) for _ in range(5)) for _ in range(30)]
    rows = list(enumerate(good + bad))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(0, 90, 2)], "doc_id long, quality int")
    kept = {r.doc_id for r in lines.judge(docs, labels).where("kept").collect()}
    assert kept == set(range(60))


def brute_viterbi(scores, move):
    import itertools

    best = None
    for path in itertools.product((0, 1), repeat=len(scores)):
        value = sum(scores[i][s] for i, s in enumerate(path)) + sum(move[a][b] for a, b in zip(path, path[1:]))
        best = value if best is None else max(best, value)
    return best


def test_marginals_match_brute_force():
    import itertools

    rng = np.random.default_rng(7)
    lengths, k = [1, 2, 4, 5], len(lines.FEATURES)
    x, live = rng.integers(0, 2, size=(4, 5, k)).astype(float), np.arange(5)[None, :] < np.array(lengths)[:, None]
    emit, move = rng.normal(size=(2, k)), rng.normal(size=(2, 2))
    p, pairs = lines.marginals(x, live, emit, move)
    for d, n in enumerate(lengths):
        score = x[d, :n] @ emit.T
        one, two, total = np.zeros((5, 2)), np.zeros((4, 2, 2)), 0.0
        for path in itertools.product((0, 1), repeat=n):
            weight = np.exp(sum(score[t][s] for t, s in enumerate(path)) + sum(move[a][b] for a, b in zip(path, path[1:])))
            total += weight
            for t, s in enumerate(path):
                one[t, s] += weight
            for t, (a, b) in enumerate(zip(path, path[1:])):
                two[t, a, b] += weight
        assert np.allclose(p[d], one / total) and np.allclose(pairs[d], two / total)


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(2)
    for n in range(1, 9):
        scores, move = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))
        path = lines.viterbi(scores, move)
        value = sum(scores[i][s] for i, s in enumerate(path)) + sum(move[a][b] for a, b in zip(path, path[1:]))
        assert value == pytest.approx(brute_viterbi(scores, move))


def test_languages_are_told_apart(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r.doc_id: r for r in langmix.identify(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(found[i].held_out == (i in set(held)) for i in truth)
    assert sum(found[i].lang_pred == truth[i] for i in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in found.values())
    assert langmix.identify(empty).count() == 0
    by = {r.doc_id: r for r in langmix.identify(odd).collect()}
    assert by[1].lang_pred == by[2].lang_pred == by[3].lang_pred == by[9].lang_pred == "und" and by[7].lang_pred != "und"
    with pytest.raises(ValueError, match="more than 3 languages"):
        langmix.learn(docs, languages=3)
    kept = langmix.keep_identified(odd)
    assert kept.columns == odd.columns and {1, 2, 3, 9}.isdisjoint({r.doc_id for r in kept.collect()})


def test_mixture_finds_two_languages():
    rng = np.random.default_rng(1)
    p = rng.dirichlet(np.full(300, 0.2), size=4) + 1e-6
    p /= p.sum(axis=1, keepdims=True)
    n = rng.multinomial(2000, 0.6 * p[1] + 0.4 * p[3]).astype(float)
    share = langmix.mixture(p, n)
    assert (share > 0).tolist() == [False, True, False, True] and abs(share[1] - 0.6) < 0.08
    assert (langmix.mixture(p, rng.multinomial(2000, p[2]).astype(float)) > 0).tolist() == [False, False, True, False]


def test_feistel_is_a_permutation():
    for domain in (1, 2, 3, 100, 1000, 4097):
        found = order.feistel(np.arange(domain), domain, 5)
        assert sorted(found.tolist()) == list(range(domain))
    assert order.feistel(np.arange(1000), 1000, 5).tolist() != order.feistel(np.arange(1000), 1000, 6).tolist()


def test_shards_hold_the_permuted_windows(spark, odd, empty):
    """Against brute force: slots, whole texts, and reading on from any slot, for several splits of the same rows."""
    rng = random.Random(3)
    rows = [(i, " ".join(words(rng, 300))) for i in range(60)]
    for splits, per_shard in ((1, None), (3, 7), (5, 1)):
        docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, splits), "doc_id long, text string")
        path = order.fresh(spark, "test")
        told = order.write_shards(docs, path, size=128, per_shard=per_shard)
        windows = packing.pack_windows(docs, size=128).orderBy("sequence_id").collect()
        n = len(windows)
        assert told == order.read_manifest(spark, path) and told["windows"] == n and told["shards"] == -(-n // told["per_shard"])
        found = order.read_shards(spark, path).orderBy("slot").collect()
        slots = order.feistel(np.arange(n), n, 1).tolist()
        assert [r.slot for r in found] == list(range(n)) and sorted(slots) == list(range(n)) != slots
        by = {r.slot: r for r in found}
        for number, w in enumerate(windows):
            r = by[slots[number]]
            assert (r.sequence_id, r.ids, r.first_doc, r.n_pieces) == (number, w.ids, w.first_doc, w.n_pieces)
            assert (r.shard, r.byte_offset) == divmod(r.slot, told["per_shard"])[:1] + (r.slot % told["per_shard"] * told["stride"],)
        part = order.read_shards(spark, path, start=n // 3, stop=n // 3 + 5)
        assert [r.ids for r in part.orderBy("slot").collect()] == [r.ids for r in found[n // 3 : n // 3 + 5]]
        assert order.read_shards(spark, path, start=n).count() == 0 and order.read_shards(spark, path, start=n - 1).count() == 1
    assert order.materialise(empty).count() == 0
    assert {r.first_doc for r in order.materialise(odd).collect()} <= {r[0] for r in odd_rows()}
