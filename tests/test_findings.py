"""Findings of whole documents and items made from others."""

from quire.operators import findings as D


def test_documents_policies_and_national_policy(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,), (None,)], "doc int")
    policies = spark.createDataFrame([(1, i, f"Policy P{i}") for i in range(1, 6)] + [(2, 9, "Policy Q")] + [(None, 7, "Policy N")], "doc int, policy int, label string")
    judged = spark.createDataFrame([(1, "missing", "restates", "DM1, DM2"), (2, "met", "adds-local-detail", ""), (3, "partly", "inconsistent", "DM3"), (4, "missing", "restates", "")],
                                   "policy int, status string, finding string, codes string")
    got = {r.doc: r for r in D.restating_policies(docs, policies, judged, "doc", "policy").collect()}
    assert got[1].finding == ("2 of 5 policies duplicate, restate or contradict national decision-making policy: Policy P1 (DM1, DM2) and Policy P4. "
                              "1 partly restate it: Policy P3 (DM3). 1 add local detail only.")
    assert got[1].gaps == ("Policy P1: duplicates or restates national policy (DM1, DM2); Policy P4: duplicates or restates national policy; "
                           "Policy P3: inconsistent with national policy (DM3)")
    assert got[1].status == "partly" and (got[3].status, got[3].finding, got[3].gaps) == ("not-assessable", D.NO_POLICIES, "")
    assert (got[2].n, got[2].status, got[2].finding[:15]) == (1, "not-assessable", "0 of 1 policy d")
    few = {r.doc: r for r in D.restating_policies(docs, policies, judged, "doc", "policy", most=2).collect()}
    assert few[1].n == 2 and few[1].status == "partly"


def test_an_answer_without_a_found_clause_falls(spark):
    docs, policies = spark.createDataFrame([(1,)], "doc int"), spark.createDataFrame([(1, i, f"P{i}") for i in range(1, 5)], "doc int, policy int, label string")
    answers = spark.createDataFrame([(1, "met"), (2, "met"), (3, "partly")], "policy int, local_issue string")
    clauses = spark.createDataFrame([(1, True), (1, False), (2, False)], "policy int, verified boolean")
    (r,) = D.general_policies(docs, policies, answers, clauses, "doc", "policy").collect()
    assert r.finding == "1 of 4 policies clearly address a local issue or support allocated sites. 1 are general: P3." and r.gaps == "P3: no local reason given; P2: partly local"


def test_items_made_from_others(spark):
    results = spark.createDataFrame([("A1", "Vision", "met", [], ["e1", "e2"], "x"), ("A2", "Scope", "missing", ["g1", "g2"], ["e3"], "Do this."), ("A3", "Aims", "not-assessable", [], ["e4", "e5"], "")],
                                    "source string, title string, status string, gaps array<string>, evidence array<string>, action string")
    links = spark.createDataFrame([("E1", "A1", 1), ("E1", "A2", 2), ("E1", "A3", 3), ("E1", "none", 4), ("E2", "A1", 1)], "item string, source string, place int")
    got = {r["item"]: r for r in D.derived_results(links, "item", results, "source", "place").collect()}
    assert got["E1"].status == "missing" and got["E1"].finding == "Taken from items A1, A2 and A3: vision is met; scope is not met; aims is cannot assess."
    assert (got["E1"].evidence, got["E1"].gaps, got["E1"].actions) == ("e1; e2; e3; e4", "g1; g2; Aims (cannot assess)", "Do this.")
    assert (got["E2"].status, got["E2"].gaps, got["E2"].actions) == ("met", "", "")
