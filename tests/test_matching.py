"""Close strings, containment, merging, layouts, report rules, the vector index
and the state log, against loops and values from outside."""

import itertools
import random
import re
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.functions import text
from spindrift.operators import careers, documents, joins, labelling, layout, layouts, matching, reports, resolve, vector_index, vectors
from spindrift.streaming.statelog import StateLog


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def likeness(a, b):
    return 1 - distance(a, b) / max(len(a), len(b), 1)


def edited(rng, text, letters="abc "):
    out = list(text)
    for _ in range(rng.randrange(1, 6)):
        i = rng.randrange(len(out) + 1)
        kind = rng.random()
        if kind < 0.33:
            out.insert(i, rng.choice(letters))
        elif out and kind < 0.66:
            out[min(i, len(out) - 1)] = rng.choice(letters)
        elif out:
            del out[min(i, len(out) - 1)]
    return "".join(out)


@pytest.mark.parametrize("tenths", [1, 2, 3])
def test_close_pairs_match_all_pairs(spark, tenths):
    rng = random.Random(5)
    base = ["".join(rng.choice("abc ") for _ in range(rng.randrange(1, 45))) for _ in range(40)]
    words = sorted({*base, *(edited(rng, s) for s in base for _ in range(4))} - {""})
    frame = spark.createDataFrame([("x", s) for s in words] + [("y", s) for s in words[::3]] + [("y", None), ("x", words[0])], "block string, s string")
    got = {(r.block, r.one, r.two) for r in matching.close_pairs(frame, ["block"], "s", tenths).collect()}
    want = {(b, *sorted(p)) for b, own in (("x", words), ("y", words[::3])) for p in itertools.combinations(own, 2) if likeness(*p) >= 1 - tenths / 10}
    assert got == want and matching.close_pairs(frame.limit(0), ["block"], "s").count() == 0


def test_candidates_of_a_hot_block_grow_with_its_titles(spark):
    """20,000 titles of one company and no city: the join meets few pairs."""
    rng = random.Random(1)
    titles = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(30)) for _ in range(20_000)]
    frame = spark.createDataFrame([("c", t) for t in titles], "company_key string, s string")
    plan = matching.close_pairs(frame, ["company_key"], "s")
    assert plan.count() == 0  # all pairs would be 2 * 10^8 edit distances


def best_by_loop(text, value):
    if not value or value in text:
        return 1.0
    words, own, best = text.split(" "), value.split(" "), 0.0
    for size in range(max(1, len(own) - 1), len(own) + 2):
        for i in range(len(words) - size + 1):
            window = words[i : i + size]
            if 2 * sum(w in own for w in window) >= min(len(own), size):
                best = max(best, likeness(" ".join(window), value))
    return best


def test_containment_matches_every_window(spark):
    rng = random.Random(7)
    texts = [(k, " ".join(rng.choice(["red", "blue", "green", "a", "the", "of", "spark"]) for _ in range(rng.randrange(1, 40)))) for k in range(12) for _ in range(2)] + [(99, None)]
    values = []
    for i in range(120):
        k = rng.randrange(13)
        words = rng.choice([t for n, t in texts if n == k] or [""]).split(" ")
        first = rng.randrange(len(words))
        words = words[first : first + rng.randrange(1, 8)]
        if rng.random() < 0.8:
            j = rng.randrange(len(words))
            words[j] = rng.choice([words[j] + "x", "zzz", words[j][1:], "spork"])
        values.append((k, i, " ".join(words)))
    values += [(0, 900, None), (0, 901, "")]
    got = {r.i: r.score for r in matching.best_containment(spark.createDataFrame(values, "k int, i int, value string"), spark.createDataFrame(texts, "k int, text string"), ["k"], "i").collect()}
    want = {i: max(best_by_loop(t, v) for n, t in texts if n == k) for k, i, v in values if v is not None and any(n == k for n, _ in texts)}
    assert got == pytest.approx(want)


def merged_by_loop(rows):
    """(id, opener, kept) of rows (id, provider, external, company, city, title, hash, at, truncated, description)."""
    records, out = [], []

    def same(a, b):
        if a[1] is not None and a[2] is not None and a[1:3] == b[1:3] or a[6] and a[6] == b[6]:
            return True
        if not a[3] or a[3] != b[3] or (a[4] or "") != (b[4] or "") or a[5] is None or b[5] is None:
            return False
        return not (a[7] and b[7] and abs(a[7] - b[7]) > timedelta(days=30)) and likeness(a[5], b[5]) >= 0.9

    for row in sorted(rows):
        at = next((i for i, (_, kept) in enumerate(records) if same(kept, row)), None)
        if at is None:
            records.append([row[0], row])
            at = len(records) - 1
        else:
            kept = records[at][1]
            if kept[8] and not row[8] or kept[8] == row[8] and len(row[9] or "") > len(kept[9] or ""):
                records[at][1] = row
        out.append((row[0], at))
    return sorted((i, records[k][0], records[k][1][0]) for i, k in out)


def test_merging_is_that_of_a_loop(spark):
    rng = random.Random(2)
    titles = ["data engineer platform", "data engineer platforms", "data engineer platformsx", "qa analyst", "qa", ""]
    rows = []
    for i in range(400):
        at = rng.choice([None, datetime(2024, 1, 1) + timedelta(days=rng.randrange(150))])
        rows.append((i, rng.choice(["p", "q", None]), rng.choice([None, str(rng.randrange(150))]), rng.choice(["c", "d", "", None]), rng.choice(["Pune", "", None]), rng.choice([*titles, None]), rng.choice([None, "", f"h{rng.randrange(200)}"]), at, rng.random() < 0.5, rng.choice([None, "", "x" * rng.randrange(9)])))
    frame = spark.createDataFrame(rows, "id long, provider string, external_id string, company_key string, city string, title_key string, description_hash string, posted_at timestamp, truncated boolean, description string")
    assert sorted(tuple(r) for r in resolve.greedy(frame, "id").collect()) == merged_by_loop(rows)
    assert resolve.greedy(frame.limit(0), "id").count() == 0
    # two null hashes, and postings half a year apart, are not one
    two = [(1, "p", "1", "c", "Pune", "data engineer", None, datetime(2024, 1, 1), False, "a"), (2, "q", "2", "c", "Pune", "data engineer", None, datetime(2024, 7, 1), False, "b")]
    assert [r.canonical_id for r in resolve.greedy(spark.createDataFrame(two, frame.schema), "id").orderBy("id").collect()] == [1, 2]


def test_near_diagonal_distance():
    rng = random.Random(8)
    for _ in range(3000):
        a = "".join(rng.choice("ab ") for _ in range(rng.randrange(0, 34)))
        b = edited(rng, a, "ab ")
        assert resolve.close(a, b) == (likeness(a, b) >= 0.9 if a or b else True)


def test_best_path_is_the_best_of_all_paths():
    rng = np.random.default_rng(3)
    grammar = labelling.Grammar({"a": {"": 0.5, "b": 0}, "b": {"": 0, "a": 0.2, "b": -1}, "c": {"a": 1, "c": 0}}, frozenset({"b", "c"}))
    scores = [rng.normal(size=(n, 3)) for n in (0, 1, 2, 3, 5, 6, 3)]

    def value(path, own):
        total, before = 0.0, ""
        for at, k in enumerate(path):
            kind = grammar.kinds[k]
            total += grammar.follows[kind].get(before, labelling.NEVER) + own[at][k]
            before = kind
        return total + (0 if before in grammar.last or not before else labelling.NEVER)

    for own, path in zip(scores, labelling.best_paths(scores, grammar), strict=True):
        every = itertools.product(range(3), repeat=len(own))
        assert value(path, own) == pytest.approx(max(value(p, own) for p in every))


LAYOUTS = {
    "lines": ("Experience\nTCS\nSoftware Engineer\nJan 2020 - Present\n• Built things\nInfosys Limited\nTrainee\nPune, India\nMar 2018 – Dec 2019\n• Learned a lot from 2018 to 2019", [("Software Engineer", "TCS", None, "2020-01", None), ("Trainee", "Infosys Limited", "Pune, India", "2018-03", "2019-12")]),
    "meta": ("Work Experience\nFrontend Developer — Kestrel Pay\nBengaluru · Full-time · Apr 2023 – Present\n• Led the migration from 2019 to 2021\nJunior Developer at Lantern Labs\nRemote · Jul 2021 – Mar 2023\n• Wrote unit tests with Jasmine and\nKarma for 15 components.", [("Frontend Developer", "Kestrel Pay", "Bengaluru", "2023-04", None), ("Junior Developer", "Lantern Labs", None, "2021-07", "2023-03")]),
    "table": ("Experience\nCompany\tRole\tDuration\tLocation\nHelio Retail\tDeveloper\tApr 2023 – Present\tPune\nNimbus\tIntern\tJan 2022 – Mar 2023\tDelhi\nHelio Retail — Key Contributions\n• Built the cart\n• Reduced errors by 3%", [("Developer", "Helio Retail", "Pune", "2023-04", None), ("Intern", "Nimbus", "Delhi", "2022-01", "2023-03")]),
    "dates first": ("Experience\nApr 2023 – Present\nData Scientist\nOrbit Learning Pvt. Ltd.\n• Developed models\nJan 2021 - Mar 2023\nAnalyst\nZeta Bank\n• Reported", [("Data Scientist", "Orbit Learning Pvt. Ltd.", None, "2023-04", None), ("Analyst", "Zeta Bank", None, "2021-01", "2023-03")]),
    "one line": ("Experience\nData Engineer | Acme\tJan 2020 - Present\n• Cut costs by 30%\nTechnologies: Spark, SQL\nQA Analyst, Beta Labs\t03/2018 – 12/2019\n- Tested releases", [("Data Engineer", "Acme", None, "2020-01", None), ("QA Analyst", "Beta Labs", None, "2018-03", "2019-12")]),
    "none": ("Skills\nSQL", []), "empty": ("", []), "null": (None, []), "bare": ("Experience\n• Did things\n• And more", []),
}


def test_jobs_of_every_layout(spark):
    names = list(LAYOUTS)
    frame = spark.createDataFrame([(i, LAYOUTS[n][0], "x") for i, n in enumerate(names)], "id long, text string, title string")
    found = layouts.experience(frame, "id").orderBy("id", "entry_no").collect()
    for i, name in enumerate(names):
        assert [(r.title, r.company, r.location, r.first, r.last) for r in found if r.id == i] == LAYOUTS[name][1], name
    bullets = {(r.id, r.entry_no): r.bullets for r in found}
    assert bullets[0, 2] == ["Learned a lot from 2018 to 2019"] and bullets[1, 2] == ["Wrote unit tests with Jasmine and Karma for 15 components."]
    assert bullets[2, 1] == ["Built the cart", "Reduced errors by 3%"] and found[2].employment == "full_time" and found[3].mode == "remote"


def test_degrees_of_every_layout(spark):
    texts = [
        "Education\nPune University\nB.Tech in Computer Science\n2014 - 2018\nCGPA: 8.1/10\nDelhi Public School\nClass XII\n2013",
        "Education\nB.Tech (Computer Science)\nPune Institute of Technology\n2014 – 2018 | 72%",
        "Education\nDegree\tInstitution\tYear\tScore\nB.Sc Physics\tPune University\t2014 – 2017\t8.2 CGPA",
        "Education\nB.Tech, Pune University, 2014 - 2018, CGPA: 8.1/10", None,
    ]
    got = [tuple(r)[2:] for r in layouts.education(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id").orderBy("id", "entry_no").collect()]
    assert got == [
        ("B.Tech", "Computer Science", "Pune University", "CGPA: 8.1/10", "2014", "2018"), ("Class XII", None, "Delhi Public School", None, None, "2013"), ("B.Tech", "Computer Science", "Pune Institute of Technology", "72%", "2014", "2018"),
        ("B.Sc", "Physics", "Pune University", "8.2 CGPA", "2014", "2017"), ("B.Tech", None, "Pune University", "CGPA: 8.1/10", "2014", "2018"),
    ]


def test_values_are_grounded_to_nine_tenths(spark):
    texts = spark.createDataFrame([(1, "Cut costs by 30% with NodeJS"), (2, None)], "id int, text string")
    values = [(1, "a", "cut costz by 31%", "text"), (1, "b", "cut costs by 31%", "text"), (1, "c", "Node.js", "skill"), (1, "d", "Kubernetes", "skill"), (1, "e", " ", "text"), (2, "a", "x", "text"), (1, "f", None, "text"), (3, "a", "x", "skill")]
    got = {(r.id, r.path): r.found for r in careers.grounded(spark.createDataFrame(values, "id int, path string, value string, kind string"), texts, "id").collect()}
    assert got == {(1, "a"): False, (1, "b"): True, (1, "c"): True, (1, "d"): False, (1, "e"): None, (2, "a"): False, (1, "f"): None, (3, "a"): False}


def test_report_rules(spark):
    long = "word " * 55
    claims = [(1, "risks.0", long, ["R1"]), (1, "summary", long, ["E1"]), (1, "risks.1", "Uses K8s and v2 with 5 people", ["E1"]), (1, "strategy.questions.0", "E1 says more", ["E1"]), (1, "elsewhere", "A perfect fit", None), (1, "experienceRelevance.roles.0", None, [])]
    claims += [(2, f"recruiterView.standsOut.{i}", "Ships", ["E1"]) for i in range(6)]
    frame = spark.createDataFrame(claims, "report_id int, path string, text string, ids array<string>")
    cited = spark.createDataFrame([(1, "E1", "Led 5 people"), (1, "R1", "x"), (2, "E1", "y")], "report_id int, id string, text string")
    got = {(r.report_id, r.path, r.issue) for r in reports.claim_issues(frame, cited, cited.select("report_id", "text"), reports.rule_table(spark)).collect()}
    assert got == {(1, "risks.0", "too long"), (1, "risks.1", "uncited"), (1, "strategy.questions.0", "written id"), (1, "elsewhere", "banned phrase"), (1, "experienceRelevance.roles.0", "uncited"), (2, "recruiterView.standsOut", "too many items")}


def test_index_finds_what_the_exact_search_does(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    points = centres[rng.integers(0, 12, 600)] + 0.3 * rng.normal(size=(600, 16))
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)] + [(700, None), (701, [0.0] * 16), (702, [1.0]), (703, [None] * 16)]
    items = spark.createDataFrame(rows, "item_id long, vector array<double>")
    index = vector_index.build(items, lists=20)
    asked = items.where("item_id % 5 = 0 or item_id >= 700").withColumnRenamed("item_id", "query_id")
    from pyspark.sql import functions as F

    model = lambda d: d.withColumn("model", F.lit("m"))
    exact = vectors.nearest(model(asked.where("query_id < 700")), model(items.where("item_id < 700")), 4)
    key = lambda d: {(r.query_id, r["rank"]): r.item_id for r in d.collect()}
    assert key(vector_index.search(index, asked, 4, 20)) == key(exact)
    r = vector_index.recall(vector_index.search(index, asked, 4, 4), exact).first()
    assert r.n == 480 and r.n_found >= 0.9 * r.n
    empty = vector_index.build(items.limit(0))
    assert vector_index.search(empty, asked, 4, 3).count() == 0


def test_state_log_replays_and_compacts_touched_buckets_only(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    frame = lambda rows: spark.createDataFrame(rows, "k long, v string, gone boolean")
    log = StateLog(spark, path, spark.createDataFrame([], "k long, v string").schema, ["k"], buckets=8)
    assert log.read().count() == 0
    log.append(frame([(i, "a", False) for i in range(50)]), 0)
    log.append(frame([(3, "b", False), (4, None, True), (None, "n", False)]), 1)
    want = {i: "a" for i in range(50) if i not in (3, 4)} | {3: "b", None: "n"}
    state = lambda: {r.k: r.v for r in log.read().collect()}
    assert state() == want
    log.append(frame([(3, "b", False), (4, None, True), (None, "n", False)]), 1)  # run again
    assert state() == want
    assert len(log.compact(1)) == 8 and state() == want and log.compact(1) == []
    log.append(frame([(7, "c", False)]), 2)
    assert len([p for p in (tmp_path / "log/delta/batch=2").iterdir() if p.name.startswith("bucket=")]) == 1
    touched = log.compact(2)
    assert len(touched) == 1 and state() == want | {7: "c"}
    assert [p.name for p in (tmp_path / "log/base/upto=2").iterdir() if p.name.startswith("bucket=")] == [f"bucket={touched[0]}"]
    log.append(frame([(7, None, True)]), 3)
    assert log.compact(3) == touched and state() == {k: v for k, v in want.items() if k != 7}
    log.append(frame([(7, "again", False)]), 4)
    assert state()[7] == "again"


def test_data_source_reads_in_parts_and_goes_on_at_its_cursor(spark, tmp_path):
    from spindrift.sources import postings
    from spindrift.sources.synthetic import Range, SyntheticPostings, ranges

    spark.dataSource.register(SyntheticPostings)
    load = lambda **o: spark.read.format("synthetic_postings").options(**o).load()
    shown = ["external_id", "title", "company", "location", "description", "posted_at"]
    want = sorted(map(tuple, postings.synthetic(spark, 50).select(*shown).collect()))
    for parts in (1, 7, 80):
        rows = load(rows=50, parts=parts)
        assert sorted(map(tuple, rows.select(*shown).collect())) == want
    assert load(rows=0).count() == 0 and load(rows=50).where("number >= 10 and number < 13 and title is not null").count() == 3
    assert [(r.first, r.last) for r in ranges(0, 10, 3)] == [(0, 3), (3, 6), (6, 10)] and ranges(5, 5, 3) == [] and isinstance(ranges(0, 1, 9)[0], Range)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = load(rows=50, pushdown=True).where("number >= 10 and number < 13 and title <> 'x'")
        assert pushed.rdd.getNumPartitions() == 3 and pushed.count() == 3
        assert load(rows=50, pushdown=True).where("number = 49").count() == 1 and load(rows=50, pushdown=True).where("number > 60").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")

    def run(rows):
        stream = spark.readStream.format("synthetic_postings").option("rows", rows).option("parts", 3).load()
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination(120)
        return sorted(r.number for r in spark.read.parquet(f"{tmp_path}/out").select("number").collect())

    assert run(30) == list(range(30)) and run(30) == list(range(30)) and run(50) == list(range(50))


def test_merging_says_rows_as_they_pass(spark, monkeypatch):
    """One component of several records, said in parts of seven rows."""
    monkeypatch.setattr(resolve, "_SHOWN", 7)
    rows = [(i, "p", str(i % 3), "c", "Pune", ["qa", "data engineer", "architect"][i % 3], f"h{i}" if i % 30 else "h", None, i < 50, "x" * i) for i in range(100)]
    frame = spark.createDataFrame(rows, "id long, provider string, external_id string, company_key string, city string, title_key string, description_hash string, posted_at timestamp, truncated boolean, description string")
    assert sorted(tuple(r) for r in resolve.greedy(frame, "id").collect()) == merged_by_loop(rows)


def test_values_and_texts_are_never_broadcast(spark):
    """Texts made from keys look small to Spark; their joins merge all the same."""
    texts = spark.range(50).selectExpr("id", "concat('cut costs by 30% with NodeJS ', id) AS text")
    values = spark.range(50).selectExpr("id", "inline(array(struct('a' AS path, 'cut costz by 30%' AS value, 'text' AS kind), struct('b' AS path, 'Node.js' AS value, 'skill' AS kind)))")
    lines = spark.range(50).selectExpr("id", "concat('one two three four five six seven ', id) AS text")
    for frame, n in ((careers.grounded(values, texts, "id"), 100), (documents.bullet_coverage(lines, lines, "id"), 50)):
        assert "BroadcastHashJoin" not in frame._jdf.queryExecution().executedPlan().toString()
        assert frame.count() == n
    assert documents.bullet_coverage(lines, lines, "id").where("covered = 1 and n_lines = 1").count() == 50


def test_filters_stay_behind_dealt_rows(spark):
    """Work goes to a task for every few rows of one split, and stays there."""
    rows = spark.range(0, 1000, 1, 1)
    plan = layout.dealt(rows, 100).where("id % 7 = 0")
    assert plan.rdd.getNumPartitions() == 10 and plan.count() == 143
    tree = plan._jdf.queryExecution().optimizedPlan().toString()
    assert tree.index("Filter") < tree.index("Repartition")


def test_similar_rows_compare_each_string_once(spark):
    names = ["red apple", "red apples", "blue", "azure sky", None]
    rows = [(i, "xy"[i % 2], names[i * 7 % 5]) for i in range(60)]
    got = {(r.a, r.b): r.similarity for r in matching.similar_rows(spark.createDataFrame(rows, "i int, k string, s string"), ["k"], "i", "s", 0.5).collect()}
    want = {(a[0], b[0]): likeness(a[2], b[2]) for a, b in itertools.combinations(rows, 2) if a[1] == b[1] and a[2] and b[2] and likeness(a[2], b[2]) >= 0.5}
    assert got == pytest.approx(want)
    plan = matching.similar_rows(spark.createDataFrame(rows, "i int, k string, s string"), ["k"], "i", "s", 0.5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("levenshtein") > plan.index("Join")


def test_pairs_by_any_key_need_no_distinct(spark):
    rows = spark.createDataFrame([(1, "p", "a", 7), (2, "p", "a", 7), (3, "p", None, 7), (4, None, None, None)], "id int, k string, e string, c int")
    found = joins.any_key(rows, rows, [["k", "e"], ["c"]], "id", "id")
    assert sorted(map(tuple, found.collect())) == [(a, b) for a in (1, 2, 3) for b in (1, 2, 3)]
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
    # an id that occurs again agrees by another row
    twice = rows.union(spark.createDataFrame([(3, "p", "a", None)], rows.schema))
    assert sorted(map(tuple, joins.any_key(twice, twice, [["k", "e"], ["c"]], "id", "id").collect())) == [(a, b) for a in (1, 2, 3) for b in (1, 2, 3)]


def test_texts_are_embedded_in_parts(spark, monkeypatch):
    monkeypatch.setattr(vectors, "_TEXTS", 3)
    texts = spark.createDataFrame([(i, None if i % 5 == 0 else f"spark {i} words {i * i}") for i in range(20)], "id long, text string")
    got = {r.id: r.vector for r in vectors.embed(texts.coalesce(1), "id", 16).collect()}
    for i in (0, 4, 7, 19):
        assert got[i] == vectors.embed(texts.where(f"id = {i}"), "id", 16).first().vector


def test_jobs_are_worked_out_once(spark):
    texts = spark.createDataFrame([(1, "Experience\nEngineer | Acme\tJan 2020 - Present\n- Built it")], "id long, text string")
    assert layouts.experience(texts, "id")._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_lines_and_addresses_are_those_of_loops(spark):
    rng = random.Random(3)
    bits = ["a", "b ", "\t", "\xa0", "  ", "\n", "\r\n", "\r", " \n ", "x@y.co", "@", ".", "a.b+c@d-e.co.in", "q@z.cc@w.dd", "@x.comz", "1@2.3"]
    texts = [None, "", "\n", *("".join(rng.choice(bits) for _ in range(rng.randrange(1, 30))) for _ in range(800))]
    tidy = lambda x: re.sub(" ?\t ?", "\t", re.sub("[ \xa0]+", " ", x)).strip(" ")
    lines = [None if t is None else [y for y in map(tidy, re.split("\r?\n", t)) if y] for t in texts]
    found = [None if t is None else list(dict.fromkeys(x.lower() for x in re.findall(text.EMAIL, t))) for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", text.split_lines(F.col("t")), text.emails(F.col("t"))).collect()
    assert [tuple(r)[1:] for r in sorted(rows)] == list(zip(lines, found, strict=True))
    # a run of letters is gone through once and not from each of its letters
    long = spark.createDataFrame([(0, "a" * 150_000 + " x@y.co")], "i int, t string")
    began = time.monotonic()
    assert long.select(text.emails(F.col("t"))).first()[0] == ["x@y.co"] and time.monotonic() - began < 10


def test_headers_read_their_lines_once(spark):
    texts = spark.createDataFrame([(1, "CV 2020\nAsha Rao\nPune\nData Engineer\nasha@x.example"), (2, ""), (3, None)], "id int, text string")
    found = careers.headers(texts, "id")
    assert found._jdf.queryExecution().optimizedPlan().toString().count(", 1, 12)") == 1
    assert sorted(tuple(r)[:4] for r in found.collect()) == [(1, "Asha Rao", "Data Engineer", "asha@x.example"), (2, None, None, None), (3, None, None, None)]


#: Sections that occur twice, bullets, a list that goes on, and names of one key.
_ODD_CV = "Asha\nSkills\nLanguages: Python, SQL, python\nProjects:\nRates http://r.example/1\n• Built it\nTech: React\n- Ran it\nCOURSES\nBasics, Acme, Mar 2020\n• Expert - Beta (2021)\nSkills\nＰｙｔｈｏｎ, Git., ;\nProjects\n• Second\nThird"


def _shuffled(frame):
    return "Exchange" in frame._jdf.queryExecution().executedPlan().toString()


def test_sections_and_skills_are_read_in_the_row(spark):
    texts = spark.createDataFrame([(1, _ODD_CV), (2, ""), (3, None), (4, "Skills"), (5, "a\n\nb")], "id int, text string")
    lines = documents.sections(texts, "id")
    assert not _shuffled(lines)
    want = [(1, 0, "header", "Asha"), (1, 2, "skills", "Languages: Python, SQL, python"), (1, 12, "skills", "Ｐｙｔｈｏｎ, Git., ;"), (5, 0, "header", "a"), (5, 1, "header", "b")]
    assert sorted(tuple(r) for r in lines.where("section in ('header', 'skills')").collect()) == want
    skills = careers.listed_skills(texts, "id")
    assert not _shuffled(skills)
    assert sorted(tuple(r) for r in skills.collect()) == [(1, 1, "Languages", "Python"), (1, 2, "Languages", "SQL"), (1, 3, None, "Git")]


def test_certificates_are_read_in_the_row(spark):
    found = careers.certifications(spark.createDataFrame([(1, _ODD_CV), (2, None)], "id int, text string"), "id")
    assert not _shuffled(found)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1, "Basics", "Acme", "2020-03")]
    lines = spark.createDataFrame([(1, "Courses\n• One\n• Two 2020\nThree\n• Four")], "id int, text string")
    assert sorted(tuple(r)[1:] for r in careers.entries(lines, "id", "certifications").collect()) == [(1, "• One", ["• Two 2020"]), (2, "Three", ["• Four"])]


def test_projects_are_read_in_the_row(spark):
    found = careers.projects(spark.createDataFrame([(1, _ODD_CV), (2, None)], "id int, text string"), "id")
    assert not _shuffled(found)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1, "Rates", "http://r.example/1", ["React"], ["Built it", "Ran it", "Second"]), (1, 2, "Third", None, [], [])]


def test_contacts_of_texts_are_not_broadcast(spark):
    texts = spark.range(40).selectExpr("id", "concat('a', id, '@x.example 98765 43210') AS text").where("id % 4 > 0")
    parsed = spark.range(40).selectExpr("id", "CASE WHEN id % 3 = 0 THEN concat('A', id, '@x.example') END AS email", "'+91 9876543210' AS phone")
    found = careers.contact_overrides(parsed, texts, "id")
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    want = {(i, f): ("not_found" if f == "phone" or i % 3 == 0 else "empty") if i % 4 == 0 else "kept" if f == "phone" or i % 3 == 0 else "added_from_text" for i in range(40) for f in ("email", "phone")}
    assert {(r.id, r.field): r.issue for r in found.collect()} == want


def test_jobs_are_read_in_their_document(spark):
    """No line is shuffled; contributions before and after their job, wrapped
    lines and lines that only read like headings go where they belong."""
    texts = [
        "Experience\nAcme Labs — Key Contributions\n• Built the cart\nData Engineer | Acme Labs\tJan 2020 - Present\n• Wrote jobs and\nothers.\nACME LABS - achievements\n• Cut costs\nTools: Spark\nNimbus — highlights\n• Ran it",
        "EXPERIENCE :\nQA Analyst\nZeta Bank\n03/2018 – 12/2019\n• Tested\nExperience the world\nSkills\nSQL\nEmployment\nTrainee\nTCS\n2015 - 2016", "Profile" + ":" * 60 + "\nExperience\nTrainee\nTCS\n2015 - 2016", None,
    ]
    found = layouts.experience(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    assert [(r.id, r.entry_no, r.title, r.company, r.technologies, r.bullets) for r in found.orderBy("id", "entry_no").collect()] == [
        (0, 1, None, "Acme Labs", ["Spark"], ["Built the cart", "Wrote jobs and others.", "Cut costs"]), (0, 2, None, "Nimbus", [], ["Ran it"]),
        (1, 1, "QA Analyst", "Zeta Bank", [], ["Tested", "Experience the world"]), (1, 2, "Trainee", "TCS", [], []), (2, 1, "Trainee", "TCS", [], []),
    ]


def test_rows_that_can_meet_are_found_without_shuffling_them(spark, monkeypatch):
    """The same merging whether titles are compared for all companies at once, or
    by company, and whether what is joined is small or not."""
    rng = random.Random(9)
    titles = ["data engineer platform", "data engineer platforms", "data engineer platformsx", "qa analyst", "qa", "", None]
    rows = []
    for i in range(300):
        at = rng.choice([None, datetime(2024, 1, 1) + timedelta(days=rng.randrange(150))])
        rows.append((i, rng.choice(["p", None]), rng.choice([None, str(rng.randrange(200))]), rng.choice(["c", "d", "e", "", None]), rng.choice(["Pune", "", None]), rng.choice(titles), rng.choice([None, "", f"h{rng.randrange(200)}"]), at, rng.random() < 0.5, rng.choice([None, "", "x" * rng.randrange(9)])))
    frame = spark.createDataFrame(rows, "id long, provider string, external_id string, company_key string, city string, title_key string, description_hash string, posted_at timestamp, truncated boolean, description string")
    assert "hashpartitioning" not in resolve.meeting(frame, "id")._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(resolve, "_TITLES", 3)
    monkeypatch.setattr(resolve, "_FEW", 0)
    assert "SortMergeJoin" in resolve.meeting(frame, "id")._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in resolve.greedy(frame, "id").collect()) == merged_by_loop(rows)


def test_a_table_that_meets_itself_is_counted_once(spark):
    rows = spark.createDataFrame([(i, i % 3, i % 5) for i in range(30)], "id int, k int, c int")
    again = rows.select("*")
    jobs = []
    for group, right in (("one", rows), ("two", again)):
        spark.sparkContext.setJobGroup(group, group)
        found = joins.any_key(rows, right, [["k"], ["c"]], "id", "id")
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
        assert found.count() == sum(a % 3 == b % 3 or a % 5 == b % 5 for a in range(30) for b in range(30))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs[0] < jobs[1]
