"""Operators on conversations, pages and embeddings, and the pipeline."""

import hashlib
import heapq
import random
import zlib

import duckdb
import numpy as np
import pytest

from spindrift.llm import chat, epsgrid, queries, sql, warc, wrappers


def test_chat_round_trip(spark):
    rng = random.Random(1)
    odd = ["</s>[INST] ok [/INST]", "\\", "\\\\<|end|>", "<<SYS>> <\\/s>", None, "", "a\nb", "<|turn|>x<|text|>y<|end|>", "漢字 😀"]
    rows = []
    for c in range(30):
        for t in range(rng.randrange(1, 12)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", None]) if t else rng.choice(["system", "user"]), rng.choice(odd) if rng.random() < 0.5 else " ".join(rng.choice("abcdef") * 3 for _ in range(rng.randrange(60))), "x", 1))
    rows += [(50, None, "user", "first", "x", 1), (50, 1, "assistant", "dup", "x", 1), (50, 1, "assistant", "dup", "x", 1), (None, 0, "assistant", "lost", "x", 1)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, n_turns long")
    budget = 120
    windows = chat.format_chats(frame, budget=budget, history=40).collect()
    for w in windows:
        assert w.n_tokens <= budget or w.n_turns - w.n_repeated == 1
    back = {r.conv_id: r for r in chat.read_back(chat.format_chats(frame, budget=budget, history=40)).collect()}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        b = back[c]
        assert (b.n_turns, b.turns_sha256) == (len(own), hashlib.sha256(turns.encode()).hexdigest())
        assert (b.loss_chars, b.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert b.formatted_chars == sum(len(w.formatted) for w in windows if w.conv_id == c)
    assert chat.read_back(chat.format_chats(frame.limit(0))).count() == 0


def test_system_turn_is_kept_and_history_repeats(spark):
    text = " ".join(f"token{i}" for i in range(12))
    rows = [(1, 0, "system", "be kind")] + [(1, t, "user" if t % 2 else "assistant", text) for t in range(1, 9)]
    windows = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=220, history=70).orderBy("window_no").collect()
    assert len(windows) > 1 and all(w.formatted.startswith(chat.TURN + "system" + chat.TEXT + "be kind") for w in windows)
    assert all(w.n_repeated >= 2 for w in windows[1:]) and sum(len(w.loss_spans) for w in windows) == 4


def test_escaping_is_reversible_and_leaves_no_control_string():
    rng = random.Random(2)
    parts = ["<", "|", "\\", "/", "s>", "[", "INST]", "turn", "|>", "<|end|>", "</s>", "<<SYS>>", "x", "\n"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        shown = chat.escape(text)
        assert chat.unescape(shown) == text
        assert not any(c in shown for c in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


PAGE = """<!DOCTYPE html><html><head><title>T{n}</title><style>p{{x}}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav><div class="cookie-notice"><p>We use cookies</p></div>
<div class="ad">Buy {n}</div><{main}><h1>Head {n} &amp; tail</h1><p>First  <b>bold</b>&nbsp;text {n}.</p><p>Second<br>line &lt;ok&gt; {n}</p><ul><li>One {n}</li><li>Two</li></ul><aside>side</aside>
<form><p>mail?</p><input></form></{main}><section id="comments"><p>Nice post {n}</p></section><div class="sidebar">Links</div><footer>&copy; us</footer></body></html>"""
TEXT = "Head {n} & tail\nFirst bold text {n}.\nSecond line <ok> {n}\nOne {n}\nTwo"


def test_main_text_of_articles(spark, monkeypatch):
    rows = [(i, f"https://www.h{i % 3}.example/p/{i}", PAGE.format(n=i, main="article"), "x") for i in range(12)]
    rows += [(100, None, None, "x"), (101, "nonsense", "", "x"), (102, "http://h1.example/", "<p>Lone <i>para</i>", "x"), (102, "http://h1.example/", "<p>Lone <i>para</i>", "x"), (None, "http://q.example/", "<article>Bare</article><!-- x", "x"), (103, "http://q.example", "<article><p>" + "long " * 50_000 + "</article>", "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = {r.page_id: r for r in wrappers.main_text(frame).collect()}
    for i in range(12):
        assert found[i].text == TEXT.format(n=i) and found[i].n_chars == len(found[i].text)
    assert found[100].text == found[101].text == "" and found[102].text == "Lone para" and found[None].text == "Bare" and found[103].n_chars == 249_999
    assert wrappers.main_text(frame.limit(0)).count() == 0
    monkeypatch.setattr(wrappers, "BROADCAST_CHARS", 0)
    assert {r.page_id: r.text for r in wrappers.main_text(frame).collect()} == {k: r.text for k, r in found.items()}


def test_wrapper_removes_what_repeats_on_pages_without_article(spark):
    page = "<body><div>Welcome to our site</div><div><p>Story number {n}</p><p>More of {n}</p></div><div>All rights reserved</div></body>"
    frame = spark.createDataFrame([(i, f"http://one.example/{i}", page.format(n=i)) for i in range(6)], "page_id long, url string, html string")
    assert {r.text for r in wrappers.main_text(frame).collect()} == {f"Story number {i}\nMore of {i}" for i in range(6)}
    shown = wrappers.expression(wrappers.infer(frame).first().wrapper)
    assert "+" in shown and shown.startswith("<body>")


def test_copies_of_a_page_without_article_keep_their_texts(spark):
    page = "<body><nav>Menu {m}</nav><div>Welcome</div><h1>Head {n}</h1><div><p>Story {n}</p><p>More {n}</p></div></body>"
    other = "<body><h2>Only {n}</h2></body>"
    rows = [("copies", 0, i) for i in range(40)] + [("two", i % 2, 0) for i in range(40)] + [("many", i % 4, 0) for i in range(40)]
    pages = [(i, f"http://{h}.example/{i}", page.format(n=n, m=m)) for i, (h, n, m) in enumerate(rows)] + [(1000 + i, f"http://copies.example/o{i}", other.format(n=i)) for i in range(5)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(7)
    found = {r.page_id: r.text for r in wrappers.main_text(frame).collect()}
    for i, (h, n, _) in enumerate(rows):
        assert found[i] == ("" if h == "many" else "Welcome\n") + f"Head {n}\nStory {n}\nMore {n}"
    assert [found[1000 + i] for i in range(5)] == [f"Only {i}" for i in range(5)]


def test_class_words_and_open_heads_do_not_hide_the_article():
    article = "<article><h1>Head</h1><p>Text</p></article>"
    whole = ['<html class="no-sidebar"><body class="with-sidebar menu">{}</body></html>', '<body id="header">{}</body>', '<main class="with-sidebar">{}</main>', '<div id="page-header-fixed">{}</div>', '<div class="has-widget sidebarOpen">{}</div>', '<div id="header">{}</div>', "<form>{}</form>", "<html><head><meta charset=x><title>T</title><body>{}</body></html>", "<head><link rel=x>{}", '<div class="banner"><div role="main">{}</div></div>']
    for page in whole:
        assert wrappers.extract(page.format(article), None, {}) == "Head\nText", page
    for state in ("post comments-open", "comments-open has-related", "sidebar", "hentry comment"):
        assert wrappers.extract(f'<body><article class="{state}"><p>Text</p></article></body>', None, {}) == "Text"
    assert wrappers.extract("<head><title>T</title><p>Bare</p>", None, {}) == wrappers.extract("<head><meta x>Bare", None, {}) == wrappers.extract("<head><meta x><b>Bare</b>", None, {}) == "Bare"
    for mark in ("<nav>{}</nav>", "<aside>{}</aside>", "<footer>{}</footer>", '<section id="comments">{}</section>', '<ol class="post-comments">{}</ol>', '<div role="complementary">{}</div>', '<div class="Sidebar sidebar-2">{}</div>'):
        assert wrappers.extract(f"<body>{article}{mark.format('<article>Other</article><p>more</p>')}</body>", None, {}) == "Head\nText", mark
    for mark in ("site-footer", "sidebar-1", "siteHeader", "cookie_notice", "menu--open", "ad"):
        assert wrappers.extract(f'<body><div class="{mark}">Other</div><p>Text</p></body>', None, {}) == "Text", mark


def parts_of(page):
    part = wrappers.page_parts(wrappers.parse(page))
    for slot, own in zip(part.slots(), wrappers._page_stats(part.slots()), strict=True):
        slot.stats, slot.blocks = own, None
    return part


def test_alignment_makes_optional_and_repeated_parts():
    def told(*pages):
        return wrappers.expression(wrappers.to_json(wrappers.merged([parts_of(p) for p in pages])))

    assert told("<nav>a</nav><p>b", "<p>c") == "(<nav> #text </nav>)? <p> #text </p>"
    assert told("<p>a<p>b<p>c", "<p>c") == "(<p> #text </p>)+"
    assert told("<dl><dt>a<dd>b<dt>c<dd>d</dl>") == "<dl> (<dt> #text </dt> <dd> #text </dd>)+ </dl>"
    assert told("<div><h2>a</h2><p>b</div>", "<div><h2>a</h2><ul><li>x<li>y</ul><p>b</div>") == "<div> <h2> #text </h2> (<ul> (<li> #text </li>)+ </ul>)? <p> #text </p> </div>"
    # kinds that come in any order become a repeated group of optional parts
    assert told("<h2>a</h2><p>b<hr><h2>c</h2><h3>x</h3><p>d<h2>e</h2><p>f<h3>g</h3><h2>h</h2><p>i") == "((<h2> #text </h2>)+? (<p> #text </p>)+? (<h3> #text </h3>)+?)+"
    deep = "<div>" * 3000 + "text"
    assert told(deep, deep + "<p>more").count("<div>") == wrappers.DEPTH and wrappers.extract(deep, None, {}) == "text"


def test_wrappers_lose_nothing():
    """Random trees: a wrapper knows every slot of the pages that it was made from."""
    rng = random.Random(8)

    def tree(depth):
        name = rng.choice(["div", "p", "ul", "h2", "section", 'div class="x"'])
        inside = "".join(tree(depth - 1) if depth and rng.random() < 0.7 else f"t{rng.randrange(99)} " for _ in range(rng.randrange(1, 6)))
        return f"<{name}>{inside}</{name.split()[0]}>"

    pages = [f"<body>{tree(3)}{tree(2)}{tree(3)}</body>" for _ in range(200)]
    half, wrapper = (wrappers.merged([parts_of(p) for p in pages[:n]]) for n in (100, 200))
    whole = sum(len(parts_of(p).slots()) for p in pages)
    assert len(wrapper.slots()) < 2 * len(half.slots()) < whole
    assert sum(s.stats[0] for s in wrapper.slots()) <= whole  # pages of a slot; what one page has twice counts once
    again = wrappers.from_json(wrappers.to_json(wrapper))
    assert wrappers.to_json(again) == wrappers.to_json(wrapper)
    for page in pages:
        for role, slot in zip(wrappers.roles(wrappers.assign(again, len(pages)), wrappers.page_parts(wrappers.parse(page))), parts_of(page).slots(), strict=True):
            assert role in ("maybe", "none") and slot.label[:2] == "#o"


def plain_page(rng, host, n):
    """A page without article, main or class words, and its article's text."""
    words = [f"w{rng.randrange(5000)}" for _ in range(4000)]
    take = iter(words)

    def said(k):
        return " ".join(next(take) for _ in range(k))

    blocks = [("h1", f"Head {n} {said(4)}")]
    for _ in range(rng.randrange(3, 9)):
        kind = rng.choice(["p", "p", "p", "h2", "ul"])
        blocks += [("li", said(6)) for _ in range(rng.randrange(1, 4))] if kind == "ul" else [(kind, said(rng.randrange(20, 60)) + "." if kind == "p" else said(3))]
    shown, inside = "", False
    for kind, text in blocks:
        shown += "<ul>" * (kind == "li" and not inside) + "</ul>" * (kind != "li" and inside)
        inside = kind == "li"
        shown += f"<{kind}>{text}</{kind}>"
    shown += "</ul>" * inside
    menu = "".join(f'<li><a href="/{host}/{i}">Menu {i}</a></li>' for i in range(rng.randrange(4, 7)))
    notice = "<div><p>We use cookies on this site.</p></div>" if rng.random() < 0.5 else ""
    share = "<div><b>Share this page</b></div>"
    views = f"<div><span>Views: {rng.randrange(10**6)}</span></div>"
    related = "<div><ul>" + "".join(f'<li><a href="/r{i}">{said(3)}</a></li>' for i in range(3)) + "</ul></div>"
    footer = f"<div>Copyright of {host}. All rights reserved.</div>"
    return f"<html><body><div><a href='/'>{host}</a></div><div><ul>{menu}</ul></div>{notice}<div>{shown}{share}</div>{views}{related}{footer}</body></html>", "\n".join(t for _, t in blocks)


def test_articles_of_plain_pages_come_from_the_wrapper(spark):
    """100 pages of five hosts whose only clue is what the host's pages have in common."""
    rng = random.Random(5)
    made = [(i, f"http://h{i % 5}.example/{i}", *plain_page(rng, f"h{i % 5}", i)) for i in range(100)]
    frame = spark.createDataFrame([m[:3] for m in made], "page_id long, url string, html string").repartition(6)
    found = {r.page_id: r.text for r in wrappers.main_text(frame).collect()}
    assert [i for i, _, _, text in made if found[i] != text] == []
    # without wrappers the menus' neighbours, notices and footers stay
    assert all(wrappers.extract(page, None, {}) != text for _, _, page, text in made)


def test_template_inside_articles_is_left_out_by_the_wrapper(spark):
    page = "<body><article><h1>Head {n}</h1><p>Story {n}</p><div>Subscribe to our letter</div><h2>Notes</h2><p>More {n}</p></article></body>"
    frame = spark.createDataFrame([(i, f"http://one.example/{i}", page.format(n=i)) for i in range(6)], "page_id long, url string, html string")
    assert {r.text for r in wrappers.main_text(frame).collect()} == {f"Head {i}\nStory {i}\nNotes\nMore {i}" for i in range(6)}
    assert wrappers.extract(page.format(n=1), None, {}) == "Head 1\nStory 1\nSubscribe to our letter\nNotes\nMore 1"


def brute_links(vectors, cosine=0.9):
    unit = {i: np.array(v, dtype=float) / np.linalg.norm(np.array(v, dtype=float)) for i, v in vectors.items()}
    up = {i: i for i in vectors}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    n = dict.fromkeys(vectors, 0)
    ids = sorted(vectors)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine:
                n[a] += 1
                n[b] += 1
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (n[i], root(i)) for i in ids}


@pytest.mark.parametrize("block,leaf,few", [(8192, 512, 9999), (40, 8, 9999), (3, 2, 0)])
def test_linked_vectors_match_brute_force(spark, monkeypatch, block, leaf, few):
    monkeypatch.setattr(epsgrid, "BLOCK", block)
    monkeypatch.setattr(epsgrid, "BROADCAST_ROWS", few)
    monkeypatch.setattr(epsgrid, "_LEAF", leaf)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(15, 12))
    good = {i: (centres[i % 15] + rng.normal(size=12) * 0.22).astype(np.float32).tolist() for i in range(200)}
    good |= {300 + i: good[0] for i in range(5)} | {400: [1.0, 2.0], 401: [2.0, 4.0], 402: [-1.0, 0.5]}
    rows = [(i, v, 1, 7) for i, v in good.items()] + [(500, None, 1, 7), (501, [], 1, 7), (502, [0.0] * 12, 1, 7), (503, [float("nan")] * 12, 1, 7), (504, [1.0, None] * 6, 1, 7), (505, [float("inf")] * 12, 1, 7), (None, good[0], 1, 7)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, kept int")
    found = {r.vec_id: r for r in epsgrid.linked_vectors(frame).collect()}
    assert len(found) == len(rows)
    assert {i: (found[i].n_links, found[i].component_id) for i in good} == brute_links(good)
    for i in (500, 501, 502, 503, 504, 505):
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (0, i, True)
    assert found[None].n_links == 0 and found[None].component_id is None
    assert epsgrid.linked_vectors(frame.limit(0)).count() == 0


def test_vectors_that_share_an_id_are_vectors_of_their_own(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (2, [-1.0, -1.0]), (3, [-1.0, -1.01]), (7, [0.01, 1.0]), (6, [0.01, 1.0])]
    found = epsgrid.linked_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (2, 1, 2), (3, 1, 2), (6, 2, 1), (7, 2, 1)]


@pytest.mark.parametrize("blocks", [1, 2, 16, 17, 300])
def test_near_blocks_match_all_pairs(spark, blocks):
    rng = np.random.default_rng(blocks)
    low = np.sort(rng.normal(size=(blocks, 2)) * 3, axis=0)
    high = low + rng.random((blocks, 2)) * 0.2
    frame = spark.createDataFrame([(i, *map(float, low[i]), *map(float, high[i])) for i in range(blocks)], "block long, a0 double, a1 double, b0 double, b1 double")
    found = {(r.one, r.two) for r in epsgrid.near_blocks(frame, blocks, 2, 0.4).collect()}
    gap = np.maximum(0, np.maximum(low[:, None] - high[None], low[None] - high[:, None]))
    near = (gap**2).sum(axis=2) <= 0.16 + 1e-9
    assert found == {(i, j) for i in range(blocks) for j in range(i, blocks) if near[i, j]}


def test_loser_tree_merges():
    rng = random.Random(3)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(20))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == list(heapq.merge(*runs))


@pytest.mark.parametrize("few", [300_000, 0])
def test_archives_read_back(spark, monkeypatch, few):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", few)
    monkeypatch.setattr(warc, "RECORDS", 3)
    same, short = "<p>" + "x" * 200 + "é</p>\r\n\r\nWARC/1.1\r\n", "tiny"
    rows = [(i, f"http://www.b{i % 4}.example/{i % 5}?q=Ü", same if i % 3 == 0 else short if i % 3 == 1 else f"{i}" * 100, "x") for i in range(30)]
    rows += [(100, None, None, "x"), (101, "http://x.example/\r\nEvil: 1", "", "x"), (0, rows[0][1], same, "x"), (None, "u", same, "x"), (102, "http://a.example", "long " * 100_000, "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")
    index = warc.archive_and_index(frame).orderBy("part", "place").collect()
    assert len(index) == len(rows)
    want = sorted((r[0] if r[0] is not None else -1, hashlib.sha256((r[2] or "").encode()).hexdigest(), len((r[2] or "").encode())) for r in rows)
    assert sorted((r.page_id if r.page_id is not None else -1, r.payload_digest, r.payload_bytes) for r in index) == want
    for r in index:
        again = r.page_id is not None and r.page_id > 0 and r.page_id < 30 and r.page_id % 3 == 0
        assert (r.record_type, r.refers_to) == (("revisit", 0) if again else ("response", None))
    keys = [(r.url_key, r.captured, r.page_id if r.page_id is not None else -1) for r in index]
    assert keys == sorted(keys)
    assert warc.archive_and_index(frame.limit(0)).count() == 0


def test_captures_of_any_page_id_come_in_order(spark):
    ids = [8 * 10**18, -(2**63), 3 * 10**11, 2**37, 5, -1, 0]
    frame = spark.createDataFrame([(i, "http://h.example/x", f"page {i}") for i in ids], "page_id long, url string, html string")
    index = warc.archive_and_index(frame).orderBy("part", "place").collect()
    assert {r.page_id for r in index} == set(ids) and all(len(r.captured) == 20 for r in index)
    assert [r.page_id for r in index] == sorted(ids, key=lambda i: (i % warc.SPAN, i))


def test_index_is_ordered_over_several_parts(spark):
    frame = spark.createDataFrame([(i, f"http://h.example/{i % 2}", f"page {i}") for i in range(200)], "page_id long, url string, html string")
    path = warc.fresh(spark, "parts")
    warc.write(frame, path)
    index = warc.read_index(spark, path, rows_per_part=20).orderBy("part", "place").collect()
    keys = [(r.url_key, r.captured, r.page_id) for r in index]
    assert len(keys) == 200 and keys == sorted(keys) and len({r.part for r in index}) > 5


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, "/root/testdata/sf0.001")
        assert after.columns == columns, name
        left = {r.doc_id for r in after.collect()}
        assert left <= ids and len(left) > 0.5 * len(ids)
        docs, ids = after, left
    pieces = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == ids


def test_pipeline_stages_take_odd_rows_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, label string, cluster long, ids string"
    extra = ("s", 1, "clash", "x", 7, "y")
    good = "\n".join("The " + " ".join(f"thing{i}{chr(97 + j)}" for j in range(11)) + "." for i in range(8))
    rows = [(1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, good, "en"), (5, good, "en"), (5, good, "en"), (None, good, "en"), (6, good + " Ünï 漢字 😀 <|endoftext|> ▁", None), (7, "word " * 40_000, "en"), (8, "123 456 %%%", "xx"), (14, good.replace("thing", "chose"), "en")]
    assert zlib.crc32(b"14") % 3 != 1  # a row to learn from
    docs = spark.createDataFrame([(i, t, g, *extra) for i, t, g in rows], schema)
    spark.createDataFrame([(4, 1, 0), (7, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    want = {"quality": {4, 5, 6, 14, None}, "language": {4, 5, 6, 14, None}, "near_dedup": {4, 14, None}}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in schema.split(", ")], name
        # document 6 differs from 4 by its last words only
        assert {r.doc_id for r in docs.collect()} == want[name], name
    pack = corpus_pipeline.STAGES[-1][1]
    assert pack(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert {r.doc_id for r in pack(spark, docs, str(tmp_path)).collect()} == {4, 14, None}


@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_queries_equal_their_statements(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    want = con.sql(sql.SQL[name])
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001").select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, name):
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
