"""Answers about policies and sites: a row for each rule."""

from pyspark.sql import functions as F

from quire.operators import checking as C


def test_each_fault_of_a_policy_answer(spark):
    asked = [(1, True, "met"), (2, False, None), (3, True, "fine"), (4, True, "partly"), (5, True, "missing"), (6, True, "met"), (7, True, "met"), (8, True, None), (9, True, "met"), (10, None, "met")]
    said = [(1, 1, "q", True, "p 1", "repeats"), (1, 2, "q", False, None, None), (5, 1, "q", None, None, None), (6, 1, "q", True, "X9", "repeats"), (7, 1, "q", True, "P1", None), (9, 1, "q", True, "", None), (9, 2, "  ", True, None, None)]
    said += [(1, 20 + i, "", True, None, None) for i in range(15, 20)] + [(1, 2 + i, "q", True, None, None) for i in range(1, 15)] + [(99, 1, "", True, None, None)]
    got = C.validate_clauses(spark.createDataFrame(asked, "k int, answered boolean, local_issue string"),
                             spark.createDataFrame(said, "k int, o int, quote string, local boolean, national string, relation string"), "k", F.col("o"), spark.createDataFrame([("P1",)], "code string"))
    assert {r.k: r.reason for r in got.collect()} == {
        1: "", 2: "missing", 3: "localIssue not allowed", 4: "no clauses", 5: "a clause without a quote or a local flag", 6: "a clause names an unknown code", 7: "a clause needs a relation",
        8: "localIssue not allowed", 9: "a clause without a quote or a local flag", 10: "missing"}


def test_documents_without_sites_are_missing(spark):
    sites = spark.createDataFrame([(1, f"H{i:02}", i) for i in range(14)] + [(2, "E1", 1), (4, "X", 1)], "doc int, code string, n int")
    got = {r.doc: (r.n, r.status, r.finding) for r in C.presence_rule(spark.createDataFrame([(1,), (2,), (3,)], "doc int"), sites, "doc", "code", F.col("n")).collect()}
    assert got[2] == (1, "met", "The plan allocates 1 site: E1.") and got[3] == (0, "missing", C.NO_SITES)
    assert got[1][0] == 14 and got[1][2].endswith("H10 and H11 and others.") and set(got) == {1, 2, 3}
