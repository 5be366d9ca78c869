from pyspark.sql import functions as F

from quire.functions import status as ST
from quire.operators import checking as C
from quire.operators import detection as D
from quire.operators import evaluation as V
from quire.operators import graphs as G
from quire.operators import timetables as TT


def both(spark, statuses):
    df = spark.createDataFrame([(s,) for s in statuses], "s string")
    return df.agg(ST.worst(F.col("s")), ST.across(F.col("s"))).first()


def test_statuses(spark):
    assert tuple(both(spark, ["met", "partly", "not-assessable"])) == ("partly", "partly")
    assert tuple(both(spark, ["met", "met"])) == ("met", "met")
    assert tuple(both(spark, ["missing", "not-assessable"])) == ("missing", "missing")
    assert tuple(both(spark, ["not-assessable"])) == ("not-assessable", "not-assessable")
    assert tuple(both(spark, ["met", "missing"])) == ("missing", "partly")


def test_judge_clauses(spark):
    def judge(rows):
        df = spark.createDataFrame(rows, "local boolean, national string, relation string")
        return tuple(df.agg(*ST.judge_clauses(F.col("local"), F.col("national"), F.col("relation"))).first())

    assert judge([(True, None, None), (False, None, None)]) == ("met", "adds-local-detail")
    assert judge([(False, "P1", "repeats")]) == ("missing", "restates")
    assert judge([(True, None, None), (False, "P1", "repeats")]) == ("partly", "partly-restates")
    assert judge([(True, "P1", "contradicts")]) == ("partly", "inconsistent")


def test_replies(ask):
    read = lambda t: ask(lambda c: F.to_json(C.reply_object(c)), t=t)
    assert read('```json\n{"a": [1, 2, ], }\n```') == '{"a":[1,2]}'
    assert read('Sure: {"a": 1} bye') == '{"a":1}'
    assert read("no braces") is None and read("[1, 2]") is None and read("} {") is None


def test_headings_name_policies(spark):
    heads = ["Policy NW1: Housing", "NW/H1: Land at Mill Lane", "Draft Policy AB-2 Title", "Policies 1 to 5", "Policy NW1: Again", "Site allocation SA4) The yard", "Policy ABCDEFGHIJKLM1", "Vision", "HO3 – Homes"]
    df = spark.createDataFrame([(1, i, 2, h, "text") for i, h in enumerate(heads)], "doc int, section_no int, level int, heading string, text string")
    got = {r.code: (r.title, r.entity) for r in D.detect_policies(df, "doc").collect()}
    assert got == {"NW1": ("Housing", "policy"), "NW/H1": ("Land at Mill Lane", "allocation"), "AB-2": ("Title", "policy"), "SA4": ("The yard", "allocation"), "HO3": ("Homes", "policy")}


def test_outcomes(spark):
    df = spark.createDataFrame([(1, 0, "Outcome 3: more homes", "MO4 | x\nO5: y\noutcome 123\nMeasurable outcome 3 again")], "doc int, section_no int, heading string, text string")
    assert {r.n: r.text for r in D.detect_outcomes(df, "doc").collect()} == {3: "Outcome 3: more homes", 4: "MO4", 5: "O5: y"}


def plan(spark, **values):
    cols = ", ".join(f"cast({v} as double) as {k}" for k, v in values.items() if k != "g1")
    return spark.sql(f"select 1 as k, date'{values['g1']}' as g1{', ' + cols if cols else ''}")


def test_timetable(spark):
    assert all(r.ok for r in TT.checks(plan(spark, g1="2027-01-04"), "k", "g1").collect())
    broken = plan(spark, g1="2027-01-04", content_w=5, plan_w=7, notice_m=3, pause_m=7)
    assert sorted(r.check for r in TT.checks(broken, "k", "g1").where("not ok").collect()) == ["content", "notice", "pause", "plan", "thirty"]
    m = {r.id: str(r.start) for r in TT.milestones(plan(spark, g1="2027-06-30"), "k", "g1").collect()}
    assert m["notice"] == "2027-02-28" and len(m) == 24
    assert TT.milestone_order(plan(spark, g1="2027-01-04"), "k", "g1").first().ok
    months = TT.months_to_adoption(plan(spark, g1="2027-01-04"), "k", "g1").first().months
    assert 24 < months <= 31
    d = lambda s, n: str(spark.range(1).select(TT.add_months(F.lit(s).cast("date"), F.lit(n))).first()[0])
    assert (d("2027-01-31", 1), d("2027-03-31", -1), d("2028-01-31", 1)) == ("2027-02-28", "2027-02-28", "2028-02-29")


def test_timetable_rows(spark):
    rows = TT.plan_timetable(plan(spark, g1="2027-01-04"), "k", "g1", F.lit("LP-X"), "2026-10-01").collect()
    assert len(rows) == 15 and rows[0]["reference"] == "LP-X-publish-notice-intention-commence" and all(r["event-date"] for r in rows)
    refs = ["LP-BRX-2024", "barnet-local-plan-2021-2036", "-x", "a b", "", "a" * 101]
    df = spark.createDataFrame([(i, r, "2027-02-28") for i, r in enumerate(refs)], "k int, reference string, date_text string")
    assert sorted(r.k for r in TT.input_errors(df, "k", []).collect()) == [2, 3, 4, 5]
    dates = spark.createDataFrame([(1, "a", "2027-02-30"), (2, "a", "2024-01-01"), (3, "a", "2100-12-31")], "k int, reference string, date_text string")
    assert sorted(r.k for r in TT.input_errors(dates, "k", []).collect()) == [1, 2]


def test_sentences(ask):
    said = ask(V.paragraphs, t="No. See reg. 5 and 3.5 of it, e.g. Part 2. [1] Then this! [2] [3] (And) that\n\n- **Item** one. 12\n2. Next.")
    assert said == [["No.", "See reg․ 5 and 3․5 of it, e․g․ Part 2. [1]", "Then this! [2] [3]", "(And) that"], ["Item one. 12"], ["Next."]]


def test_answer_checks(spark):
    rows = [(1, "It is so [1]. Yes. It may not be legal advice. This has no citation.", ["d#a", "e#b"], ["d#a"], None), (2, "All of it here. And later [2].", ["d#a", "e#b:2"], ["e#b"], None),
            (3, "I cannot help.", ["d#a"], ["d"], None), (4, "That is not covered.", ["d#a"], ["d"], "not covered"), (5, "So it is here [7].", ["d#a"], ["d"], None)]
    df = spark.createDataFrame(rows, "k int, answer string, passages array<string>, expect array<string>, decline string")
    got = {}
    for r in V.answer_checks(df, ["k"]).collect():
        got.setdefault(r.k, {})[r.check] = r.ok
    names = ["citations exist", "every sentence cites", "nothing left uncited", "expected sources cited", "not a refusal"]
    assert [got[1][n] for n in names] == [True, False, False, True, True]
    assert [got[2][n] for n in names] == [True, False, True, True, True]
    assert [got[3][n] for n in names] == [True, True, True, False, False]
    assert got[4] == {"citations exist": True, "declines (not covered)": True}
    assert [got[5][n] for n in names] == [False, True, True, False, True]


def test_paths(ask):
    go = lambda b, p: ask(lambda x, y: G.resolve_path(x, y), b=b, p=p)
    assert go("/a/b", "../c/./d/") == "/c/d" and go("/a/b", "") == "/a/b" and go("/a/b", "/x") == "/x" and go("/a/b", "c") == "/a/c"


def test_reach_stops_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "source int, target int")
    start = spark.createDataFrame([(1,)], "node int")
    assert sorted(r.node for r in G.reach(edges, start).collect()) == [1, 2, 3]
