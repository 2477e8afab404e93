"""Sources, entity resolution, next states and streams."""

import io
import json
import random
import zipfile
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.functions import text
from spindrift.operators import documents, events, history, metrics, resolve, state, vectors
from spindrift.sources import pages, postings
from spindrift.streaming import applications


def test_board_readers(spark):
    bodies = [
        ("paged", {"results": [{"id": "1", "title": "A <b>b</b>", "company": {"display_name": "C"}, "location": {"display_name": "Pune"}, "description": "x", "salary_min": 1e6, "created": "2024-01-02T03:04:05Z"}]}),
        ("snippet", {"jobs": [{"id": "2", "title": "T", "company": "C", "location": "L", "snippet": "<p>s &amp; t</p>", "salary": ""}]}),
        ("encoded", {"jobs": [{"id": "3", "title": "T", "location": {"name": "L"}, "content": "&lt;p&gt;hi&lt;/p&gt;"}]}),
        ("sectioned", [{"id": "4", "text": "T", "categories": {"location": "L"}, "descriptionPlain": "d", "lists": [{"text": "h", "content": "<li>i</li>"}], "createdAt": 1700000000000, "workplaceType": "remote"}]),
        ("listed", {"jobs": [{"id": "5", "title": "T", "isListed": False}, {"id": "6", "title": "T", "location": "L", "isRemote": True}]}),
        ("published", {"offers": [{"id": "7", "title": "T", "status": "draft"}, {"id": "8", "title": "T", "status": "published", "description": "<p>d</p>", "locations": [{"city": "Pune", "country": "IN"}]}]}),
    ]
    rows = [(k, "co", json.dumps(b)) for k, b in bodies] + [("encoded", "co", "not json"), ("listed", "co", None)]
    got = {r.external_id: r for r in postings.read_all(spark.createDataFrame(rows, "kind string, company string, body string")).collect()}
    assert set(got) == {"1", "2", "3", "4", "6", "8"}
    assert got["1"].title == "A b" and got["1"].truncated and got["1"].salary_text == "1000000 - 1000000 a year" and got["1"].posted_at == datetime(2024, 1, 2, 3, 4, 5)
    assert got["3"].description == "hi" and got["4"].description == "d\nh\ni" and got["6"].mode_hint == "remote" and got["8"].location == "Pune, IN"


def test_details_are_joined_for_wanted_rows_only(spark):
    body = json.dumps({"content": [{"id": "a", "name": "Data Engineer", "location": {"city": "Pune"}}, {"id": "b", "name": "Chef", "location": {"city": "Pune"}}]})
    out = postings.detailed_board(spark.createDataFrame([("c", body)], "company string, body string"), spark.createDataFrame([("a", "<p>x</p>"), ("b", "y")], "external_id string, description string"), F.col("title").contains("Data")).collect()
    assert [(r.external_id, r.description) for r in out] == [("a", "x")]


def test_jsonld_at_any_depth(spark):
    block = {"@graph": [{"@type": "Thing"}, {"x": [{"@type": ["JobPosting"], "title": "Deep", "hiringOrganization": {"name": "Org"}, "jobLocation": [{"address": {"addressLocality": "Pune"}}]}]}]}
    html = f'<script type="application/ld+json">{json.dumps(block)}</script><script type="application/ld+json">{{broken</script>'
    got = pages.read_jsonld(spark.createDataFrame([(1, "u", html), (2, "u", None)], "page_id long, url string, html string")).collect()
    assert [(r.page_id, r.title, r.company, r.location) for r in got] == [(1, "Deep", "Org", "Pune")]


def test_files(spark):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Hello</w:t><w:tab/><w:t>x</w:t></w:r></w:p><w:p/></w:body></w:document>')
    frame = spark.createDataFrame([("a", bytearray(buffer.getvalue())), ("b", bytearray(b"%PDF-1.7")), ("c", None)], "path string, content binary")
    assert {r.path: r.text for r in pages.read_docx(frame).collect()} == {"a": "Hello\tx\n", "b": None, "c": None}
    assert [r.k for r in frame.select("path", pages.file_kind(F.col("content")).alias("k")).orderBy("path").collect()] == ["docx", "pdf", None]


def test_urls_and_addresses(spark):
    rows = ["https://a.example/x", "ftp://a.example", "http://localhost/", "http://u:p@a.example", "https://a.example:8443/", "http://10.0.0.1/", "http://nodot/"]
    got = spark.createDataFrame(list(enumerate(rows)), "i int, u string").select("i", pages.is_safe_url(F.col("u")).alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == [True] + [False] * 6
    ips = spark.createDataFrame([("8.8.8.8",), ("10.1.1.1",), ("::1",), ("x",)], "a string").select(pages.is_public_address("a").alias("p")).collect()
    assert [r.p for r in ips] == [True, False, False, False]


def test_resolution_is_transitive(spark):
    base = ("p", "c", "Pune", "data engineer", datetime(2024, 1, 1))
    rows = [(1, "p", "1", "c", "Pune", "data engineer", "h1", base[4]), (2, "p", "2", "c", "Pune", "data engineerx", "h2", base[4]), (3, "q", "2", "d", None, "other", "h2", None), (4, "q", "9", "c", "Pune", "data engineer", "h4", datetime(2024, 6, 1)), (5, "q", "9", "z", None, "t", "", None), (6, "q", None, "", None, "t", "", None)]
    frame = spark.createDataFrame(rows, "id long, provider string, external_id string, company_key string, city string, title_key string, description_hash string, posted_at timestamp")
    got = {r.id: r.canonical_id for r in resolve.components(frame, "id").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}


def test_flags_and_pay_are_of_whole_tables(spark, monkeypatch):
    from spindrift.plans import QUERIES, relations

    folder = "/root/testdata/sf0.001"
    flags = QUERIES["not_fit_flags"](spark, folder)
    assert flags.count() == spark.read.parquet(f"{folder}/orders.parquet").count() and flags.select("user_id").distinct().count() > 20
    given = []
    monkeypatch.setattr(relations.metrics, "pay_context", lambda rows, keys, value: given.append(rows.select(value.alias("v"))) or rows)
    QUERIES["pay_context"](spark, folder)
    part = spark.read.parquet(f"{folder}/part.parquet")
    assert given[0].count() == part.count() and given[0].where("v is null").count() == part.where("p_size % 3 = 0").count()


def test_components_settle_or_fail(spark):
    # a chain 0 ~ 1 ~ 2 ... by turns of provider id and description
    rows = [(i, "p", str(i // 2), "", None, "t", f"h{(i + 1) // 2}", None) for i in range(40)]
    frame = spark.createDataFrame(rows, "id long, provider string, external_id string, company_key string, city string, title_key string, description_hash string, posted_at timestamp")
    with pytest.raises(RuntimeError, match="2 rounds"):
        resolve.components(frame, "id", rounds=2)
    assert {r.canonical_id for r in resolve.components(frame, "id").collect()} == {0}


def test_components_of_a_long_chain_of_shuffled_ids(spark):
    # labels that fall along links take as many rounds as such a chain's stretches
    ids = random.Random(3).sample(range(10_000), 600)
    rows = [(n, "p", str(i // 2), "", None, "t", f"h{(i + 1) // 2}", None) for i, n in enumerate(ids)] + [(20_000, None, None, "", None, "t", None, None)]
    frame = spark.createDataFrame(rows, "id long, provider string, external_id string, company_key string, city string, title_key string, description_hash string, posted_at timestamp")
    assert {(r.id, r.canonical_id) for r in resolve.components(frame, "id").collect()} == {*((n, min(ids)) for n in ids), (20_000, 20_000)}


def test_exact_duplicates_compare_whole_texts_of_any_script(spark, tmp_path):
    from spindrift.plans import QUERIES

    top = "Licence and more. " * 300
    texts = [top + "one", top + "two", top.upper() + "ONE!", "Привет, мир", "привет мир", "другое", "漢字", "漢語", "++ --", "!!", None, "", "Café", "Cafe\u0301", "Cafe"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.canonical_id for r in QUERIES["exact_duplicates"](spark, str(tmp_path)).collect()}
    assert got == {i: i for i in range(len(texts))} | {2: 0, 4: 3, 13: 12}


def test_best_description(spark):
    frame = spark.createDataFrame([(1, 1, "long but cut text", True), (1, 2, "short", False), (1, 3, "equal", False), (2, 4, "a", True)], "k int, id long, description string, truncated boolean")
    assert {r.k: r.id for r in resolve.best_description(frame, "k", "id").collect()} == {1: 2, 2: 4}


def test_running_twice_inserts_nothing(spark):
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "b"), (2, "d"), (2, "c")], "k int, v string")
    once = state.insert_ignore(old, new, ["k"], "v")
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "c")] == sorted(map(tuple, state.insert_ignore(once, new, ["k"], "v").collect()))


def test_other_states(spark):
    rows = spark.createDataFrame([("o", "name:Acme", 1), ("o", "board:b", 2), ("o", "name:B", 3)], "owner string, key string, n int")
    got = state.resolve_placeholders(rows, spark.createDataFrame([("Acme", "board:acme"), ("B", "board:b")], "name string, key string"))
    assert sorted(map(tuple, got.collect())) == [("o", "board:acme", 1), ("o", "board:b", 2)]
    merged = state.merge_duplicate({"description": F.lit("cut"), "truncated": F.lit(True)}, {"description": F.lit("a"), "truncated": F.lit(False)})
    assert spark.range(1).select(*(v.alias(k) for k, v in merged.items())).first().asDict() == {"description": "a", "truncated": False, "embedding_valid": False}
    kept = state.keep_listed(spark.createDataFrame([(1, "cv"), (2, "cv"), (3, "self")], "id int, source string"), spark.createDataFrame([(1,)], "id int"), ["id"], F.col("source") == "self")
    assert sorted(r.id for r in kept.collect()) == [1, 3]


def test_nearest_without_broadcast(spark, monkeypatch):
    items = spark.createDataFrame([(i, "m", [float(i % 7), 1.0, float(i % 3)]) for i in range(60)], "item_id long, model string, vector array<double>")
    queries = items.where("item_id < 9").withColumnRenamed("item_id", "query_id")
    want = sorted(map(tuple, vectors.nearest(queries, items, 4).select("query_id", "item_id", "rank").collect()))
    monkeypatch.setattr(vectors, "QUERIES", 0)
    assert sorted(map(tuple, vectors.nearest(queries, items, 4).select("query_id", "item_id", "rank").collect())) == want


def test_hashed_vectors(spark):
    frame = spark.createDataFrame([(1, "m", "aa bb"), (2, "m", "aa bb cc"), (3, "n", "aa bb")], "item_id long, model string, text string")
    items = frame.select("item_id", "model").join(vectors.embed(frame, "item_id", 64), "item_id").drop("deferred")
    got = vectors.nearest(items.where("item_id = 1").withColumnRenamed("item_id", "query_id"), items, 5).collect()
    assert [(r.item_id, round(r.similarity, 3)) for r in sorted(got, key=lambda r: r.rank)] == [(1, 1.0), (2, round((2 / 3) ** 0.5, 3))]


def test_reports(spark):
    claims = spark.createDataFrame([("r", 1, "R1", "Cut 40%", ["E1"]), ("r", 2, "R2", "Fine", ["E7"])], "report_id string, claim_no int, req_id string, claim string, evidence_ids array<string>")
    known = spark.createDataFrame([("r", "E1", "cut costs 40%")], "report_id string, evidence_id string, text string")
    required = spark.createDataFrame([("r", "R1"), ("r", "R3")], "report_id string, req_id string")
    assert sorted((r.claim_no or 0, r.fault) for r in documents.report_faults(claims, known, required).collect()) == [(0, "not covered: R3"), (2, "unknown id")]
    assert metrics.citation_validity(claims, known).first().asDict() == {"report_id": "r", "cited": 2, "valid": 1}


def _stream(spark, tmp_path, frame, schema):
    source = str(tmp_path / "in")
    frame.coalesce(1).write.parquet(source)
    return spark.readStream.schema(schema).parquet(source)


def test_stage_stream_equals_batch(spark, tmp_path):
    moves = spark.createDataFrame([(1, 1, datetime(2024, 1, 1), "APPLIED"), (1, 2, datetime(2024, 1, 2), "INTERVIEW"), (1, 3, datetime(2024, 1, 3), "INTERVIEW"), (1, 4, datetime(2024, 1, 4), "REJECTED"), (1, 5, datetime(2024, 1, 5), "APPLIED"), (2, 6, datetime(2024, 1, 1), "OFFER")], "application_id long, event_id long, occurred_at timestamp, status string")
    query = applications.stage_stream(_stream(spark, tmp_path, moves, moves.schema)).writeStream.format("memory").queryName("stages").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    got = {r.event_id: (r.stage_reached, r.reopened) for r in spark.table("stages").collect()}
    assert got == {r.event_id: (r.stage_reached, r.reopened) for r in events.transitions(moves).collect()} and got[5] == (4, True) and 3 not in got


def test_counters_and_versions(spark, tmp_path):
    rows = spark.createDataFrame([("a", datetime(2024, 1, 1, 0, 0, s)) for s in (1, 30, 59)] + [("a", datetime(2024, 1, 1, 2))], "p string, at timestamp")
    stream = _stream(spark, tmp_path, rows, rows.schema)
    query = applications.counter_stream(stream, "at", "p").writeStream.format("memory").queryName("counts").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.n for r in spark.table("counts").collect()) == [1, 3]
    path = str(tmp_path / "out")
    sink = applications.sync_sink(path, lambda new, old: new.groupBy("p").count().toDF("p", "n") if old is None else state.add_counts(old, new.groupBy("p").count().toDF("p", "n"), ["p"]))
    sink(rows, 0)
    sink(rows, 1)
    sink(rows, 1)
    assert spark.read.parquet(f"{path}/v=1").first().n == 8


def test_resynced_evidence_keeps_numbers(spark):
    old = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "k int, text string, number int")
    new = spark.createDataFrame([(1, "new", 0), (1, "y", 1), (1, "newer", 2)], "k int, text string, position int")
    assert {r.text: r.number for r in documents.resynced_evidence(old, new, "k").collect()} == {"y": 2, "new": 3, "newer": 4}


def test_equal_spans_are_of_one_island(spark):
    spans = spark.createDataFrame([(1, 10, 15), (1, 30, 35), (1, 30, 35), (1, 30, 33), (2, 5, 4)], "id long, f int, t int")
    found = history.islands(spans, "id", "f", "t").collect()
    assert sorted((r.id, r.from_month, r.to_month) for r in found) == [(1, 10, 15), (1, 30, 35)]


@pytest.mark.parametrize("queries,side", [(20_000, 50_000), (0, 7)])
def test_nearest_and_best_match_brute_force(spark, monkeypatch, queries, side):
    """By broadcast blocks, and in parts where the query set is large."""
    monkeypatch.setattr(vectors, "QUERIES", queries)
    monkeypatch.setattr(vectors, "SIDE", side)
    rng = np.random.default_rng(1)
    made = {i: rng.integers(-3, 4, size=5).astype(float).tolist() for i in range(60)}
    made |= {100: None, 101: [0.0] * 5, 102: [1.0, None, 0.0, 0.0, 0.0], 103: made[3], 104: made[3]}
    good = {i: np.array(v) / np.linalg.norm(v) for i, v in made.items() if v and None not in v and any(v)}
    model = {i: "m" if i % 3 else "n" for i in made}
    rows = spark.createDataFrame([(i, model[i], v) for i, v in made.items()], "item_id long, model string, vector array<double>")
    asked = rows.where("item_id % 4 = 0 or item_id > 99").withColumnRenamed("item_id", "query_id")
    found = {(r.query_id, r["rank"]): r.item_id for r in vectors.nearest(asked, rows, 3).collect()}
    want = {}
    for q in (i for i in good if i % 4 == 0 or i > 99):
        near = sorted((-round(float(good[q] @ good[i]), 9), i) for i in good if model[i] == model[q])
        want |= {(q, n + 1): i for n, (_, i) in enumerate(near[:3])}
    assert found == want
    left, right = rows.select(F.col("item_id").alias("left_id"), F.col("model").alias("group_id"), "vector"), rows.select(F.col("item_id").alias("right_id"), F.col("model").alias("group_id"), "vector")
    best = {r.left_id: r.right_id for r in vectors.best_over(left, right, 0.99).collect()}
    assert best == {q: min((-round(float(good[q] @ good[i]), 9), i) for i in good if model[i] == model[q])[1] for q in good}
    assert vectors.nearest(asked.limit(0), rows, 3).count() == vectors.nearest(asked, rows.limit(0), 3).count() == 0


def test_hashed_embeddings_by_published_hashes(spark):
    # values of 32-bit FNV-1a that are published with the function
    assert vectors.word_hashes(["foobar", "a", "b", "foob"]).tolist() == [0xBF9CF968, 0xE40C292C, 0xE70C2DE5, 0x3F5076EF]
    assert vectors.word_hashes([]).tolist() == []
    rows = [(1, "foobar foobar  c++ x"), (2, None), (3, "  "), (4, "Foobar\tx"), (5, "x " * 1000 + "foobar")]
    found = {r.doc_id: r for r in vectors.embed(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id").collect()}
    assert [found[i].deferred for i in (1, 2, 3, 4, 5)] == [False, True, True, False, True]  # single letters are no words, nor what lies beyond 2,000 characters
    slot, sign = 0xBF9CF968 % 384, -1.0
    assert found[4].vector[slot] == sign and sum(map(abs, found[4].vector)) == 1
    other = int(vectors.word_hashes(["c++"])[0])
    want = np.zeros(384)
    want[slot] += 2 * sign
    want[other % 384] += 1 if other & 1 else -1
    assert np.allclose(found[1].vector, want / np.linalg.norm(want)) and found[2].vector is None


def test_normal_forms_of_any_script(spark):
    rows = [(1, "ﬁne ½ Ｆull"), (2, "plain"), (3, None), (4, "É é"), (5, "A–B “q” ’s")]
    found = {r.i: (r.n, r.k) for r in spark.createDataFrame(rows, "i int, t string").select("i", text.normalize_for_match(F.col("t")).alias("n"), text.skill_key(F.col("t")).alias("k")).collect()}
    assert found == {1: ("fine 1⁄2 full", "fine12full"), 2: ("plain", "plain"), 3: (None, None), 4: ("é é", "ee"), 5: ("a-b \"q\" 's", "abqs")}
