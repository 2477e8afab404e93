"""Byte-level BPE, phrases and spelling variants against libraries and loops."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from spindrift.llm import bytebpe, langmix, phrases, variants

ODD = ["", None, " ", "  a", "a  b\n\n c", "it's we'll I'M x'S", " x y\u0085z", "日本語 текст", "\U00010570\U0001e7e0x ٣٤ ²½", "a" * 40, "=====  ===", "<|endoftext|>", "é́\x00\x1f a　b c", "xyz" * 150, "\t\t\t  \r\n", "naïve café — ok…"]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.vocabulary().ranks, special_tokens={})


@pytest.mark.parametrize("room", [64 << 20, 400, 0])
def test_byte_bpe_equals_the_library(spark, monkeypatch, library, room):
    monkeypatch.setattr(bytebpe, "DICTIONARY_BYTES", room)
    monkeypatch.setattr(bytebpe, "AT_A_TIME", 7)
    texts = [*ODD, *ODD[3:8], " the the a a a", "one word twice one word"]
    rows = [(i if i % 7 else None, t, "x", i) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string, words int")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.ids, bytes(r.decoded)) for r in bytebpe.decode(bytebpe.encode(frame)).collect())
    want = sorted((i is None, i or 0, library.encode_ordinary(t or ""), (t or "").encode()) for i, t, _, _ in rows)
    assert got == want
    assert bytebpe.encode(frame.limit(0)).count() == 0


def test_pattern_agrees_with_the_library_on_every_code_point(spark, library):
    """Cut of each code point after a letter, a number and a blank: as the
    pattern's library cuts it (told by a vocabulary that merges all of it)."""
    import public_tokenizers
    import tiktoken
    from pyspark.sql import functions as F

    points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    ranks = {bytes([k]): k for k in range(256)}
    for prefix in sorted({f + chr(i).encode()[:k] for i in points for f in (b"a", b"1", b" ") for k in range(1, len(chr(i).encode()) + 1)}, key=len):
        ranks.setdefault(prefix, len(ranks))
    merging = tiktoken.Encoding("all", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    joins = lambda first, i: len(merging.encode_ordinary(first + chr(i))) == 1
    frame = spark.range(0x110000).where("id < 55296 or id > 57343").select("id", F.when(F.col("id") == 0xFEFF, F.lit("\ufeff")).otherwise(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')")).alias("c"))
    vocab = bytebpe.vocabulary()
    one = lambda first: F.size(vocab.words(F.concat(F.lit(first), "c"))) == 1
    found = frame.select("id", one("a").alias("l"), one("1").alias("n"), one(" ").alias("s")).toPandas()
    for name, first in (("l", "a"), ("n", "1"), ("s", " ")):
        wrong = [i for i, v in zip(found["id"], found[name], strict=True) if v != joins(first, i)]
        if first == " ":  # two blanks are one match as well, of which the vocabulary knows no piece
            wrong = [i for i in wrong if not chr(i).isspace()]
        assert not wrong, (name, [hex(i) for i in wrong[:20]])


def test_query_digests(spark, library):
    from spindrift.llm.queries import op11_byte_bpe

    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in op11_byte_bpe(spark, folder).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def phrases_by_loop(rows, max_n, least, covered, top):
    f, n, out = Counter(), Counter(), []
    for lang, text in rows:
        lang, low = "und" if lang is None else lang, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, max_n + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    found = {k: v for k, v in f.items() if v >= least and len(k[1]) > 1}
    for (lang, p), a in found.items():
        inside = lambda q, p=p: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))
        if not any(100 * b >= covered * a for (other, q), b in found.items() if other == lang and inside(q)):
            score, k = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    best = []
    for lang in {o[0] for o in out}:
        own = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))
        best += [(o[0], i + 1, *o[1:]) for i, o in enumerate(own[:top])]
    return sorted(best)


@pytest.mark.parametrize("max_n,least,top,hot", [(3, 10, 2000, 2000), (4, 3, 7, 5), (2, 2, 50, 1)])
def test_phrases_match_a_loop(spark, monkeypatch, max_n, least, top, hot):
    monkeypatch.setattr(phrases, "HOT", hot)
    monkeypatch.setattr(phrases, "STRETCH", 500)
    rng = random.Random(3)
    words = ["a", "b\x00", "b", "b\x01", "\x01", "Ä", "the", "of", "THE", "x\x0e"]
    rows = [(rng.choice(["en", "fr", None, "l\x00g"]), " ".join(rng.choice(words) + rng.choice(["", "", "", ".", "\t", "\n"]) for _ in range(rng.randrange(40)))) for _ in range(300)]
    rows += [(None, None), ("en", ""), ("xx", "..."), ("en", "the of " * 3000)]
    frame = spark.createDataFrame([(*r, 1, "n") for r in rows], "lang string, text string, rank int, phrase string")
    assert sorted(tuple(r) for r in phrases.collocations(frame, max_n=max_n, least=least, top=top).collect()) == phrases_by_loop(rows, max_n, least, 50, top)
    assert phrases.collocations(frame.limit(0)).count() == 0


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_loop(rows, least_chars, least, typo, times):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % typo == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least_chars:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= least}
    forms, out = {}, []
    links = {w: [v for v in n if near(w, v)] for w in n}
    for w in n:
        best = min(links[w], key=lambda v: (-n[v], v), default=None)
        forms[w] = best if best is not None and n[best] >= times * n[w] else None
    for w in n:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, n[w], len(links[w]), forms[w], n[forms[w]] if forms[w] else None, root))
    return sorted(out)


@pytest.mark.parametrize("most", [4096, 6, 1])
def test_variants_match_a_loop(spark, most):
    rng = random.Random(9)
    base = ["".join(rng.choice("abÀÿ") for _ in range(rng.randrange(5, 9))) for _ in range(60)] + ["commit", "commits", "committ", "comit", "ommit", "kommit", "Straße", "strasse", "ßßßßßß"]
    pool = [w for w in base for _ in range(rng.choice([1, 1, 2, 8, 60]))]
    rows = [(i if i % 9 else None, " ".join(rng.choice(pool).upper() if rng.random() < 0.2 else rng.choice(pool) for _ in range(60)) + "×x") for i in range(120)]
    rows += [(500, None), (501, ""), (502, "12 34 -- ."), (3, rows[3][1])]
    frame = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int")
    got = sorted((tuple(r) for r in variants.group_variants(frame, least_chars=5, least=3, typo=7, times=2, most=most).select("word", "n", "n_near", "form", "form_n", "root").collect()), key=lambda r: r[0])
    assert got == variants_by_loop(rows, 5, 3, 7, 2)
    assert variants.group_variants(frame.limit(0)).count() == 0


def test_every_pair_meets_in_one_partition_only(spark):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(6, 10))) for _ in range(300)})
    frame = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    for most in (1, 20, 4096):
        links = [(r.word, r.near) for r in variants.near_words(frame, most).collect()]
        assert len(links) == len(set(links)) and set(links) == {(a, b) for a in words for b in words if near(a, b)}


def test_numbers_are_no_letters():
    for text, letter in (("²½①", False), ("٣٤", False), ("½ ª", True), ("日", True), ("__ 12", False), ("x", True), ("", False)):
        assert langmix.has_letter(np.frombuffer(text.encode(), np.uint8)) == letter
