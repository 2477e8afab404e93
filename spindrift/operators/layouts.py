"""Jobs and degrees of career documents in any of the usual layouts.

Lines of a section are joined where they were wrapped, scored for each kind of
line by Columns, and labelled by the best path through the layouts' grammar. A
line of dates therefore claims the undated lines before it (or after it, where
dates come first) if that reads better than anything else. Fields are then taken
from the labelled lines by splits; no document is a group for Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import parse, text
from spindrift.functions.text import let
from spindrift.operators.documents import merge_wrapped, section_lines, stretches
from spindrift.operators.labelling import NEVER, Grammar, labels, score_items

# Words that say what a line, a field or a column holds.
TITLES = (
    r"(?i)\b(developer|engineer|manager|intern|designer|analyst|lead|architect|consultant|scientist|specialist|administrator|tester|programmer|director|head|officer|associate|executive|trainee|"
    r"founder|co-founder|cto|ceo|sde|swe|devops|qa|owner|coordinator|researcher|fellow|apprentice)\b"
)
TECH = r"(?i)^(?:technologies|technology|tech stack|tech|tools|stack|environment|skills used|built with|key skills)\s*[:–—-]\s*"
ADDED = r"(?i)^(.+?)\s+[—–-]\s+(?:key\s+)?(?:contributions|achievements|responsibilities|highlights)$"
ACTIONS = (
    r"(?i)^(built|developed|designed|implemented|created|led|managed|wrote|added|migrated|improved|reduced|worked|fixed|introduced|owned?|ran|moved|mentored|integrated|cut|shipped|launched|published|"
    r"used|maintained|optimi[sz]ed|automated|collaborated|delivered|set up|configured|tested|deployed|researched|analy[sz]ed|supported|handled|contributed|helped|\p{L}+ed)\b"
)
BULLET = r"^\s*[•●▪■◦‣∙*➢►▶✓✔–—-]+\s+"
FIRMS = r"(?i)\b(pvt|ltd|limited|inc|llp|llc|corp|gmbh|labs?|technologies|solutions|services|systems|software|consulting|university|bank|studios?|group|industries)\b"
COLUMNS = (("company", "company|company name|organi[sz]ation|employer|firm"), ("title", "role|title|job title|designation|position"), ("dates", r"duration|dates?|period|tenure|from\s*-\s*to|years?|timeline"), ("location", "location|city|place"))
EMPLOYMENT = (("full_time", r"full[\s-]?time|permanent|fte"), ("part_time", r"part[\s-]?time"), ("contract", "contract|contractor|contractual|c2h"), ("internship", "intern|internship|summer internship"), ("freelance", r"freelance|freelancer|self[\s-]employed"), ("temporary", "temporary|temp|seasonal"))
MODES = (("remote", "remote|work from home|wfh"), ("hybrid", "hybrid"), ("onsite", r"on[\s-]?site|in[\s-]?office|office"))
#: What stands between a title and a company, in order; after the last two the title always comes first.
BETWEEN = (r"\s+[—–]\s+", r"\s+\|\s+", r"\t", r",\s+", r"\s+-\s+")
AT = (r"\s+@\s+", r"(?i)\s+at\s+")
DEGREES = (
    r"(?i)\b(b\.?\s?tech|m\.?\s?tech|b\.?\s?sc|m\.?\s?sc|b\.?\s?com|m\.?\s?com|bca|mca|mba|pgdm|bba|b\.?\s?arch|b\.?\s?des|m\.?\s?des|ph\.?\s?d|bachelor(?:'s)?|master(?:'s)?|diploma|doctorate|hsc|ssc|"
    r"higher secondary|senior secondary|class\s+(?:x|xii|10|12)(?:th)?|10th|12th|intermediate|matriculation|llb|mbbs|b\.?\s?pharm)\b\.?|(?-i:(?:^|(?<=[\s(]))(?:[BM]\.\s?[EAS]\.?|BE|ME|BS|MS|BA|MA)(?=$|[\s(,]))"
)
SCHOOLS = r"(?i)\b(university|college|institute|institution|school|academy|iit|nit|iiit|bits|polytechnic|vidyalaya|vidyapeeth|campus)\b"
GRADES = r"(?i)\d+(?:\.\d+)?\s*(?:/\s*\d+(?:\.\d+)?)?\s*(?:cgpa|gpa|cpi|sgpa|%|percent(?:age)?)|(?:cgpa|gpa|cpi|percentage|score|grade|marks)\s*[:-]?\s*\d+(?:\.\d+)?(?:\s*/\s*\d+)?\s*%?|first class(?: with distinction)?|distinction"
_YEAR = r"\b(?:19|20)\d{2}\b"


def tidy(part: Column) -> Column:
    """A field without what parts it from the next; most stand alone already."""
    return F.when(part.rlike(r"^[\s·|•,;:(–—-]|[\s·|•,;:)–—-]$"), F.regexp_replace(part, r"^[\s·|•,;:(–—-]+|[\s·|•,;:)–—-]+$", "")).otherwise(part)


def _where(test: Column, points: float) -> Column:
    return F.when(test, F.lit(float(points))).otherwise(F.lit(0.0))


def _only(test: Column, score: Column) -> Column:
    return F.when(test, score).otherwise(F.lit(NEVER))


def _undated(line: Column) -> Column:
    return tidy(F.regexp_replace(line, parse.DATE_RANGE, " "))


def _cells(line: Column) -> Column:
    return F.transform(F.split(line, "\t"), lambda c: F.trim(c))


def column_kinds(line: Column, known: tuple = COLUMNS) -> Column:
    """The kind of each cell of a heading row, "" for others."""

    def kind(cell: Column) -> Column:
        out = F.lit("")
        for name, pattern in reversed(known):
            out = F.when(cell.rlike(rf"(?i)^(?:{pattern})$"), name).otherwise(out)
        return out

    return F.transform(_cells(line), kind)


def _heading_row(line: Column, known: tuple = COLUMNS) -> Column:
    return line.contains("\t") & (F.size(F.filter(column_kinds(line, known), lambda k: k != "")) >= 3)


#: Heads are lines of a title, a company or a place; ``dates`` closes them, or
#: opens an entry whose heads follow (``late``). ``whole`` has all on one line.
JOBS = Grammar(
    follows={
        "body": {"": -1, "body": 0, "tools": 0, "dates": 0, "late": 0, "whole": 0, "added": 0, "row": -1},
        "tools": {"body": 0, "dates": 0, "late": 0, "whole": 0, "added": 0, "tools": 0, "row": 0},
        "whole": {"": 0, "body": 0, "tools": 0, "dates": -1, "late": -1, "whole": -1, "row": 0},
        "head": {"": 0, "body": 0, "tools": 0, "dates": -1, "late": -1, "whole": -1, "row": 0},
        "head2": {"head": 0},
        "head3": {"head2": 0},
        "dates": {"head": 1, "head2": 1, "head3": 0.5},
        "first": {"": 0, "body": 0, "tools": 0, "late": -1, "whole": -1, "row": 0},
        "late": {"first": 0.5, "late": 0},
        "columns": {"": 0, "body": 0, "tools": 0, "row": 0},
        "row": {"columns": 0, "row": 0},
        "added": {"": 0, "body": 0, "tools": 0, "row": 0, "dates": 0, "late": 0, "whole": 0},
    },
    last=frozenset({"body", "tools", "whole", "dates", "late", "row", "added"}),
)


def _job_facts(lines: Column) -> Column:
    """What the scores of lines of jobs rest on, each worked out once and only
    where a score asks for it: a head is no dated line, bullet or list of tools,
    and what stands beside dates is of dated lines."""

    def seen(x: Column) -> Column:
        return F.struct(x.alias("x"), parse.has_date_range(x).alias("ranged"), x.rlike(BULLET).alias("bullet"), x.rlike(TECH).alias("tools"))

    def beside(s: Column) -> Column:
        plain = ~s["bullet"] & ~s["tools"]
        return F.struct(s["x"].alias("x"), s["ranged"].alias("ranged"), s["bullet"].alias("bullet"), s["tools"].alias("tools"), (plain & ~s["ranged"]).alias("head"), F.when(plain & s["ranged"], _undated(s["x"])).alias("rest"))

    def facts(s: Column) -> Column:
        x, rest = s["x"], s["rest"]
        return F.struct(
            s["ranged"].alias("ranged"), s["bullet"].alias("bullet"), s["tools"].alias("tools"), text.strip_bullet(x).rlike(ACTIONS).alias("action"), (x.rlike(r"[.!?]$") & ~F.substring(x, -9, 9).rlike(r"(?i)\b(ltd|inc|co|pvt)\.$")).alias("said"),
            (s["head"] & x.rlike(TITLES)).alias("job"), (s["head"] & x.rlike(FIRMS)).alias("firm"), text.word_count(x).alias("words"), text.word_count(rest).alias("rest"), rest.rlike(TITLES).alias("rest_job"), rest.rlike(ACTIONS).alias("rest_action"),
            rest.rlike(r"\s[|@—–·-]\s|,\s|\t|(?i)\sat\s").alias("parted"), _heading_row(x).alias("columns"), x.contains("\t").alias("tabbed"), (x.rlike("(?i)s$") & x.rlike(ADDED)).alias("added"),
        )

    return F.transform(F.transform(F.transform(lines, seen), beside), facts)


def _job_scores() -> dict:
    plain = lambda x: ~x["tools"] & ~x["bullet"]

    def head(x: Column) -> Column:
        points = _where(x["job"] | x["firm"], 2) + _where(x["words"] <= 8, 1) - _where(x["words"] > 12, 3) - _where(x["said"], 2) - _where(x["action"] & ~x["job"], 2)
        return _only(plain(x) & ~x["ranged"], points)

    def dates(x: Column) -> Column:
        return _only(plain(x) & x["ranged"] & (x["rest"] <= 6), F.lit(3.0) - _where(x["rest_job"], 2) - _where(x["rest_action"], 4))

    def whole(x: Column) -> Column:
        return _only(plain(x) & x["ranged"] & (x["rest"] > 0), F.lit(2.0) + _where(x["rest_job"], 2.5) + _where(x["parted"], 1) - _where(x["rest_action"], 4) - _where(x["rest"] > 14, 3))

    return {
        "body": lambda x: _where(x["bullet"], 4) + _where(x["said"], 1.5) + _where(x["action"], 1.5) + _where(x["words"] > 8, 1) - _where(x["ranged"] & (x["words"] <= 8) & ~x["bullet"], 2),
        "tools": lambda x: _only(x["tools"], F.lit(5.0)),
        "whole": whole,
        "head": head,
        "head2": head,
        "head3": lambda x: head(x) - 0.5,
        "dates": dates,
        "first": lambda x: dates(x) - _where(x["rest"] > 0, 1),
        "late": head,
        "columns": lambda x: _only(x["columns"], F.lit(8.0)),
        "row": lambda x: _only(x["tabbed"] & x["ranged"], F.lit(6.0)),
        "added": lambda x: _only(x["added"], F.lit(6.0)),
    }


#: A school may stand before or after its degree; ``both`` has them on one line.
STUDIES = Grammar(
    follows={
        "both": {"": 0, "both": 0, "more": 0, "degree": 0, "its school": 0, "its degree": 0, "row": 0},
        "degree": {"": 0, "both": 0, "more": 0, "degree": 0, "its school": 0, "its degree": 0, "row": 0},
        "its school": {"degree": 0.5, "more school": 0},
        "more school": {"degree": 0},
        "school": {"": 0, "both": 0, "more": 0, "degree": -1, "its school": 0, "its degree": 0, "row": 0},
        "its degree": {"school": 0.5, "more degree": 0},
        "more degree": {"school": 0},
        "more": {"": -2, "both": 0, "more": 0, "degree": 0, "its school": 0, "its degree": 0, "row": -1},
        "columns": {"": 0, "more": 0, "row": 0},
        "row": {"columns": 0, "row": 0},
    },
    last=frozenset({"both", "degree", "its school", "its degree", "more", "row"}),
)
STUDY_COLUMNS = (("degree", "degree|qualification|course|programme|program|class|standard"), ("school", "institution|institute|university|college|school|board|board/university"), ("dates", "years?|duration|dates?|period|passing year|year of passing"), ("grade", "score|grade|cgpa|gpa|percentage|marks|result"))


def _study_facts(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.struct(x.rlike(DEGREES).alias("degree"), x.rlike(SCHOOLS).alias("school"), (x.rlike(_YEAR) | x.rlike(GRADES)).alias("aside"), x.rlike(r"\t|\s[|·—–]\s").alias("parted"), _heading_row(x, STUDY_COLUMNS).alias("columns"), x.contains("\t").alias("tabbed")))


def _study_scores() -> dict:
    degree = lambda x: _only(x["degree"], F.lit(3.0) - _where(x["school"], 2))
    school = lambda x: F.lit(0.0) + _where(x["school"], 3) - _where(x["degree"], 3) - _where(x["aside"] & ~x["school"], 2)
    extra = lambda x: _where(x["aside"], 2) - _where(x["school"] | x["degree"], 3)
    return {
        "both": lambda x: _only(x["degree"], F.lit(2.0) + _where(x["school"] | x["parted"], 3)),
        "degree": degree, "its school": school, "more school": extra, "school": school, "its degree": degree, "more degree": extra, "more": extra,
        "columns": lambda x: _only(x["columns"], F.lit(8.0)), "row": lambda x: _only(x["tabbed"], F.lit(6.0)),
    }


#: Of each section: its grammar, what lines are judged by, and its scores.
SECTIONS = {"experience": (JOBS, _job_facts, _job_scores(), ("whole", "head", "first", "row", "added")), "education": (STUDIES, _study_facts, _study_scores(), ("both", "degree", "school", "row"))}


def labelled(documents: DataFrame, key: str, section: str) -> DataFrame:
    """Documents (key, text) with the lines of a section (of ``SECTIONS``), wrapped
    ones joined, and the number of each one's kind: key, lines, kinds. All is done
    in the document's row, so no line is shuffled."""
    grammar, facts, scores, _ = SECTIONS[section]
    whole = documents.select(key, merge_wrapped(section_lines(F.col("text"), section)).alias("lines"))
    return whole.select(key, "lines", labels(score_items(facts(F.col("lines")), grammar, scores), grammar).alias("kinds"))


def labelled_lines(documents: DataFrame, key: str, section: str) -> DataFrame:
    """Lines of ``labelled``: key, line_no, line, kind, entry_no (null before the
    first entry)."""
    grammar, _, _, starts = SECTIONS[section]
    names = F.array(*(F.lit(k) for k in grammar.kinds))
    lines = labelled(documents, key, section).select(key, F.posexplode(F.arrays_zip("lines", "kinds")).alias("line_no", "_z")).select(key, "line_no", F.col("_z.lines").alias("line"), F.get(names, F.col("_z.kinds")).alias("kind"))
    upto = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    number = F.sum(F.col("kind").isin(*starts).cast("int")).over(upto)
    return lines.withColumn("entry_no", F.when(number > 0, number))


def title_and_company(said: Column) -> Column:
    """A head as struct(title, company): parted by the first separator there is;
    the part that names a job is the title."""

    def made(title: Column, company: Column) -> Column:
        return F.struct(F.nullif(title, F.lit("")).alias("title"), F.nullif(company, F.lit("")).alias("company"))

    def parted(two: Column, ordered: bool) -> Column:
        swap = F.lit(False) if ordered else two["b"].rlike(TITLES) & ~two["a"].rlike(TITLES)
        return F.when((two["a"] != "") & (two["b"] != ""), F.when(swap, made(two["b"], two["a"])).otherwise(made(two["a"], two["b"])))

    def by(pattern: str, ordered: bool) -> Column:
        halves = let(F.split(said, pattern, 2), lambda x: F.struct(tidy(F.get(x, 0)).alias("a"), tidy(F.get(x, 1)).alias("b")))
        return F.when(said.rlike(pattern), let(halves, lambda two: parted(two, ordered)))

    whole = F.when(said.rlike(TITLES), made(tidy(said), F.lit(""))).otherwise(made(F.lit(""), tidy(said)))
    return F.coalesce(*(by(p, o) for p, o in (*((p, False) for p in BETWEEN[:3]), *((p, True) for p in AT), *((p, False) for p in BETWEEN[3:]))), whole)


def _facts(said: Column) -> Column:
    """Fields of a line about a job, "Full-time, Remote" as two."""
    known = "|".join(p for _, p in (*EMPLOYMENT, *MODES))
    fields = F.filter(F.transform(text.split_fields(said), tidy), lambda x: x != "")
    return F.flatten(F.transform(fields, lambda f: F.when(f.contains(",") & F.forall(F.split(f, r"\s*,\s*"), lambda p: p.rlike(rf"(?i)^(?:{known})$")), F.split(f, r"\s*,\s*")).otherwise(F.array(f))))


def _is(pattern: str):
    return lambda x: x.rlike(rf"(?i)^(?:{pattern})$")


def _known(facts: Column, names: tuple) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(names):
        out = F.when(F.size(F.filter(facts, _is(pattern))) > 0, name).otherwise(out)
    return out


def experience(documents: DataFrame, key: str) -> DataFrame:
    """Jobs of each document (key, text): key, entry_no, title, company,
    location, employment, mode, first, last, still, technologies, bullets.

    Layouts: all on one line; a title and a company on one line above one of
    dates, place and type; title, company and place on lines of their own above
    their dates, or below them; rows of a table with a heading row; and
    "<company> - key contributions" over bullets of a job named before, which is
    no entry of its own. Documents without the section have no rows; nulls and
    empty texts too.
    """
    numbers = {kind: at for at, kind in enumerate(JOBS.kinds)}

    def of(items: Column, *kinds: str) -> Column:
        return F.transform(F.filter(items, lambda x: x["k"].isin(*(numbers[k] for k in kinds))), lambda x: x["line"])

    def entries(row: Column) -> Column:
        def entry(w: Column) -> Column:
            start = F.get(w, 0)
            heading = F.try_element_at(F.filter(row["columns"], lambda c: c["at"] < start["at"]), F.lit(-1))["kinds"]
            return F.struct(
                of(w, "head", "head2", "head3", "late").alias("heads"), F.array_max(of(w, "dates", "first")).alias("dated"), F.get(of(w, "whole"), 0).alias("whole"), F.when(start["k"] == numbers["row"], F.struct(start["line"].alias("line"), heading.alias("_c"))).alias("row"),
                F.when(start["k"] == numbers["added"], tidy(F.regexp_extract(start["line"], ADDED, 1))).alias("added"), of(w, "body").alias("body"), of(w, "tools").alias("tools"),
            )

        return F.transform(stretches(row["items"], lambda x, i: x["k"].isin(*(numbers[k] for k in SECTIONS["experience"][3]))), entry)

    def cut(items: Column) -> Column:
        columns = F.transform(F.filter(items, lambda x: x["k"] == numbers["columns"]), lambda x: F.struct(x["at"].alias("at"), column_kinds(x["line"]).alias("kinds")))
        return let(F.struct(items.alias("items"), columns.alias("columns")), entries)

    items = F.transform(F.arrays_zip("lines", "kinds"), lambda z, i: F.struct(z["kinds"].alias("k"), z["lines"].alias("line"), i.alias("at")))
    # kinds are used twice, so Spark works them out once and below this
    rows = labelled(documents, key, "experience").select(key, let(items, cut).alias("_e"), F.array_contains("kinds", numbers["added"]).alias("_a"))
    found = rows.select(key, F.posexplode(F.when(F.col("_a"), _added_to_jobs(F.col("_e"))).otherwise(F.col("_e"))).alias("_i", "_e")).select(key, (F.col("_i") + 1).cast("long").alias("entry_no"), "_e.*")

    # a job on lines of its own: place and type stand beside its dates or by themselves
    found = found.withColumn("_l", _of_line(F.col("whole"))).withColumn("_o", _of_lines(F.col("heads")))
    facts = F.when(F.col("whole").isNotNull(), _facts(F.array_join("_l.beside", " · "))).otherwise(F.concat(_facts(_undated(F.coalesce("dated", F.lit("")))), "_o.places"))
    found = found.withColumn("_x", facts).withColumn("_s", parse.date_range(F.coalesce("whole", "dated", "row.line"))).withColumn("_h", _head(F.struct("heads", "whole", "row", "added"), F.col("_l"), F.col("_o")))
    kinds = "|".join(p for _, p in (*EMPLOYMENT, *MODES))
    location = F.when(F.col("row").isNotNull(), _cell(F.col("row"), "location")).otherwise(F.nullif(F.array_join(F.filter("_x", lambda x: ~x.rlike(rf"(?i)^(?:{kinds})$")), ", "), F.lit("")))
    return found.select(
        key, "entry_no", "_h.title", "_h.company", location.alias("location"), _known(F.col("_x"), EMPLOYMENT).alias("employment"), _known(F.col("_x"), MODES).alias("mode"), "_s.first", "_s.last", "_s.still",
        F.flatten(F.transform("tools", lambda t: text.split_list(F.regexp_replace(t, TECH, "")))).alias("technologies"), F.transform("body", text.strip_bullet).alias("bullets"),
    )


def _cell(row: Column, name: str) -> Column:
    """The cell of a table's row (line, _c) that is of a kind."""
    return F.nullif(F.get(_cells(row["line"]), F.array_position(row["_c"], name).cast("int") - 1), F.lit(""))


def _of_line(whole: Column) -> Column:
    """Fields of a job on one line: said (up to its company) and beside it; null
    where there is none."""

    def parted(s: Column) -> Column:
        apart = (F.size(s["j"]) == 1) & (F.size(s["f"]) > 1) & ~F.get(s["j"], 0).rlike(r"\s[—–]\s|\s@\s|,\s|(?i)\sat\s|\s-\s")
        n = F.when(apart, 2).when(F.size(s["j"]) == 0, 1)
        said = F.array_join(F.when(n.isNull(), s["j"]).otherwise(F.slice(s["f"], 1, n)), " — ")
        beside = F.when(n.isNull(), F.array_except(s["f"], s["j"])).otherwise(F.slice(s["f"], n + 1, 99))
        return F.struct(said.alias("said"), beside.alias("beside"))

    fields = F.filter(F.transform(text.split_fields(_undated(whole)), tidy), lambda x: x != "")
    named = let(fields, lambda f: F.struct(f.alias("f"), F.filter(f, lambda x: x.rlike(TITLES) | x.rlike(r"\s[—–]\s")).alias("j")))
    return F.when(whole.isNotNull(), let(named, parted))


def _of_lines(heads: Column) -> Column:
    """A job on lines of its own: the one that names it, its company, its places."""

    def named(t: Column) -> Column:
        return let(F.filter(heads, lambda x: x != t), lambda o: let(F.coalesce(F.get(F.filter(o, lambda x: x.rlike(FIRMS)), 0), F.get(o, 0)), lambda firm: F.struct(t.alias("t"), firm.alias("firm"), F.filter(o, lambda x: x != firm).alias("p"))))

    found = let(F.coalesce(F.get(F.filter(heads, lambda x: x.rlike(TITLES)), 0), F.get(heads, 0)), named)
    none = F.array().cast("array<string>")
    return let(F.when(F.size(heads) > 1, found), lambda s: F.struct(s["t"].alias("title"), s["firm"].alias("firm"), F.when(F.size(heads) > 1, s["p"]).otherwise(none).alias("places")))


def _head(e: Column, of_line: Column, of_lines: Column) -> Column:
    """Title and company of an entry, by ``_of_line`` and ``_of_lines`` of it."""
    row, added, whole = e["row"], e["added"], e["whole"]
    head = F.when(row.isNotNull(), F.struct(_cell(row, "title").alias("title"), _cell(row, "company").alias("company"))).when(added.isNotNull(), F.struct(F.lit(None).cast("string").alias("title"), added.alias("company")))
    head = head.when((F.size(e["heads"]) > 1) & whole.isNull(), F.struct(tidy(of_lines["title"]).alias("title"), tidy(of_lines["firm"]).alias("company")))
    return head.otherwise(let(F.coalesce(of_line["said"], F.get(e["heads"], 0), F.lit("")), title_and_company))


def _added_to_jobs(entries: Column) -> Column:
    """Contributions that stand apart join the first job at that company, in
    order; those of no job are an entry of their own."""

    def company(e: Column) -> Column:
        return F.lower(_head(e, _of_line(e["whole"]), _of_lines(e["heads"]))["company"])

    def goes_to(firms: Column) -> Column:
        """The place of the entry that each one joins."""
        jobs = F.filter(F.transform(firms, lambda f, i: F.struct(f["c"].alias("c"), f["added"].alias("added"), i.alias("i"))), lambda f: ~f["added"])
        return F.transform(firms, lambda f, i: F.when(f["added"], F.coalesce(F.get(F.filter(jobs, lambda j: j["c"] == f["c"]), 0)["i"], i)).otherwise(i))

    def joined(to: Column) -> Column:
        members = F.transform(F.array_sort(F.array_distinct(to)), lambda t: F.filter(F.transform(entries, lambda e, i: F.when(F.get(to, i) == t, e)), lambda e: e.isNotNull()))
        said = ("heads", "dated", "whole", "row", "added")
        return F.transform(members, lambda m: F.struct(*(F.get(m, 0)[c].alias(c) for c in said), F.flatten(F.transform(m, lambda e: e["body"])).alias("body"), F.flatten(F.transform(m, lambda e: e["tools"])).alias("tools")))

    firms = F.transform(entries, lambda e: F.struct(company(e).alias("c"), e["added"].isNotNull().alias("added")))
    return let(let(firms, goes_to), joined)


def education(documents: DataFrame, key: str) -> DataFrame:
    """Degrees of each document: key, entry_no, degree, field, school,
    grade, first, last. A school may stand above or below its degree, with the
    dates and the grade on lines of their own, in one line, or in a table."""
    lines = labelled_lines(documents, key, "education")
    before = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("_c", F.last(F.when(F.col("kind") == "columns", column_kinds(F.col("line"), STUDY_COLUMNS)), True).over(before)).where("kind <> 'columns' and entry_no is not null")
    fields = text.split_fields(F.regexp_replace(text.strip_bullet(F.col("line")), r"\s+[—–]\s+(?!\d)", " · "))
    parts = F.when((F.size(fields) == 1) & (F.length(F.regexp_replace("line", "[^,]", "")) >= 1) & ~F.col("kind").isin("school", "its school"), F.split("line", r"\s*,\s+")).otherwise(fields)
    found = lines.withColumn("_p", parts).groupBy(key, "entry_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "_p"))).alias("_t"), F.max(F.when(F.col("kind") == "row", F.struct("line", "_c"))).alias("row"))
    tokens = F.filter(F.transform(F.flatten(F.transform("_t", lambda x: x["_p"])), tidy), lambda x: x != "")
    rows = found.select(key, "entry_no", "row", tokens.alias("t"))
    cell = lambda name: F.nullif(F.get(_cells(F.col("row.line")), F.array_position("row._c", name).cast("int") - 1), F.lit(""))
    range_of = lambda x: x.rlike(parse.DATE_RANGE)
    grade = F.get(F.filter("t", lambda x: x.rlike(GRADES) & (text.word_count(x) <= 4) & ~range_of(x)), 0)
    dated = F.get(F.filter("t", range_of), 0)
    token = F.get(F.filter("t", lambda x: x.rlike(DEGREES) & ~range_of(x)), 0)
    year = F.get(F.filter("t", lambda x: x.rlike(_YEAR) & (text.word_count(x) <= 3) & ~range_of(x)), 0)
    rest = F.filter("t", lambda x: ~(x.eqNullSafe(grade) | x.eqNullSafe(dated) | x.eqNullSafe(token) | x.eqNullSafe(year)))
    school = F.coalesce(F.get(F.filter(rest, lambda x: x.rlike(SCHOOLS)), 0), F.get(rest, 0))
    rows = rows.select(key, "entry_no", F.coalesce(cell("degree"), token).alias("_d"), F.coalesce(cell("school"), school).alias("school"), F.coalesce(cell("grade"), grade).alias("grade"), parse.date_range(F.coalesce(dated, F.lit(""))).alias("_r"), F.get(parse.dates_in(F.coalesce(year, F.lit(""))), 0).alias("_y"))
    bracket, within = r"^(.*?)\s*\(([^)]+)\)\s*$", r"(?i)^(.+?)\s+in\s+(.+)$"
    word = F.regexp_extract("_d", DEGREES, 0)
    short = (word != "") & F.startswith("_d", word) & ~word.rlike("(?i)^(bachelor|master|diploma)")
    split = lambda pattern: (F.regexp_extract("_d", pattern, 1).rlike(DEGREES), F.struct(tidy(F.regexp_extract("_d", pattern, 1)).alias("degree"), tidy(F.regexp_extract("_d", pattern, 2)).alias("field")))
    (in_brackets, a), (in_words, b) = split(bracket), split(within)
    after = tidy(F.substring("_d", F.length(word) + 1, F.length("_d")))
    c = F.struct(F.trim(word).alias("degree"), F.nullif(after, F.lit("")).alias("field"))
    degree = F.when(in_brackets, a).when(in_words, b).when(short, c).otherwise(F.struct(F.nullif(tidy(F.col("_d")), F.lit("")).alias("degree"), F.lit(None).cast("string").alias("field")))
    rows = rows.select(key, "entry_no", degree.alias("_g"), "school", "grade", F.col("_r.first").alias("first"), F.coalesce("_r.last", "_y").alias("last"))
    return rows.select(key, F.col("entry_no"), "_g.degree", "_g.field", "school", "grade", "first", "last").where("degree is not null or school is not null")
