"""Every rule of a report broken in turn, with the path where it stands."""

import copy
import json

import pytest

from quire import fixed
from quire.operators import reports

GOOD = {
    "schema": fixed.REPORT_SCHEMA, "version": 1, "generatedAt": "2026-01-01", "notice": "n", "document": {"name": "p.md", "type": "md", "bytes": 1, "characters": 2.0, "words": 0},
    "sections": [{"id": "s", "title": "S", "letter": "A", "items": [{
        "id": "A1", "title": "t", "status": "met", "finding": "f", "requirement": "r", "evidence": [{"quote": "q", "locator": "l"}], "gaps": ["g"],
        "citations": [{"label": "c", "href": "/reference/a/#b"}, {"label": "d", "href": None}], "instances": [{"label": "i", "status": "partly"}]}]}],
    "statements": {"compliance": {"title": "c", "parts": [{"heading": "h", "entries": [{"id": "1", "title": "t", "status": "met", "shows": "s", "evidence": [], "gaps": [], "action": "a"}]}]},
                   "soundness": {"title": "s", "entries": [{"id": "2", "title": "t", "status": "missing", "shows": "s", "evidence": [], "gaps": [], "questions": ["q"]}]}},
    "summary": {"counts": {"met": 1}}}
ITEM, ENTRY, SOUND = "sections[0].items[0]", "statements.compliance.parts[0].entries[0]", "statements.soundness.entries[0]"
TEXT, LIST = "expected text of at most {} characters", "expected a list of at most {}"
GONE = object()
CASES = [
    ("schema", "other", "not a plan check report"), ("schema", GONE, "not a plan check report"), ("version", 2, "expected 1"), ("version", "1", "expected 1"), ("generatedAt", "x" * 41, TEXT.format(40)),
    ("notice", 5, TEXT.format(2000)), ("document", GONE, "missing"), ("document", "x", "missing"), ("document.name", "x" * 201, TEXT.format(200)), ("document.type", "pdf", "unknown"),
    ("document.bytes", -1, "expected a whole number"), ("document.characters", 1.5, "expected a whole number"), ("document.words", "3", "expected a whole number"), ("sections", {}, LIST.format(12)),
    ("sections[0].id", "x" * 41, TEXT.format(40)), ("sections[0].title", None, TEXT.format(200)), ("sections[0].letter", "ABC", TEXT.format(2)), ("sections[0].items", [1] * 41, LIST.format(40)),
    (ITEM + ".id", "x" * 13, TEXT.format(12)), (ITEM + ".title", GONE, TEXT.format(300)), (ITEM + ".status", "fine", "unknown status"), (ITEM + ".finding", "x" * 4001, TEXT.format(4000)),
    (ITEM + ".action", "x" * 2001, TEXT.format(2000)), (ITEM + ".requirement", GONE, TEXT.format(2000)), (ITEM + ".evidence", [{"quote": "q", "locator": "l"}] * 21, LIST.format(20)),
    (ITEM + ".evidence[0]", "x", "not an object"), (ITEM + ".evidence[0].quote", "x" * 1501, TEXT.format(1500)), (ITEM + ".evidence[0].locator", GONE, TEXT.format(500)),
    (ITEM + ".gaps[0]", "x" * 1001, TEXT.format(1000)), (ITEM + ".gaps", GONE, LIST.format(20)), (ITEM + ".citations", "x", LIST.format(10)), (ITEM + ".citations[0].label", 1, TEXT.format(200)),
    (ITEM + ".citations[0].href", "https://x.org", "not a reference link"), (ITEM + ".instances", 1, LIST.format(120)), (ITEM + ".instances[0].label", "x" * 401, TEXT.format(400)),
    (ITEM + ".instances[0].status", None, "unknown status"), ("statements", GONE, "missing"), ("statements.compliance.title", 1, TEXT.format(200)), ("statements.compliance.parts", [1] * 9, LIST.format(8)),
    ("statements.compliance.parts[0].heading", GONE, TEXT.format(300)), ("statements.compliance.parts[0].entries", GONE, LIST.format(20)), (ENTRY + ".id", GONE, TEXT.format(12)),
    (ENTRY + ".status", "x", "unknown status"), (ENTRY + ".shows", "x" * 4001, TEXT.format(4000)), (ENTRY + ".evidence", GONE, LIST.format(20)), (ENTRY + ".gaps", ["x"] * 21, LIST.format(20)),
    (ENTRY + ".action", 1, TEXT.format(2000)), ("statements.soundness.title", GONE, TEXT.format(200)), ("statements.soundness.entries", "x", LIST.format(10)), (SOUND + ".title", "x" * 301, TEXT.format(300)),
    (SOUND + ".questions", ["q"] * 7, LIST.format(6)), (SOUND + ".questions[0]", "x" * 601, TEXT.format(600)), ("summary", GONE, "missing"), ("summary.counts", None, "missing"), ("summary.counts", 0, "missing")]


def broken(path, value):
    report = copy.deepcopy(GOOD)
    *way, last = [int(p) if p.isdigit() else p for p in path.replace("[", ".").replace("]", "").split(".")]
    at = report
    for p in way:
        at = at[p]
    if value is GONE:
        del at[last]
    else:
        at[last] = value
    return report


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, json.dumps(broken(path, value))) for i, (path, value, _) in enumerate(CASES)]
    rows += [(1000, json.dumps(GOOD)), (1001, "[]"), (1002, "no json"), (1003, None), (1004, "null"), (1005, json.dumps(GOOD | {"sections": [None, 3], "statements": {}}))]
    out = {}
    for r in reports.problems_of(spark.createDataFrame(rows, "k int, j string"), "k", "j").collect():
        out.setdefault(r.k, []).append((r.path, r.problem))
    return out


def test_each_rule_says_where_it_is_broken(found):
    want = {i: [("summary" if path.startswith("summary") else path, problem)] for i, (path, _, problem) in enumerate(CASES)}
    assert {i: found.get(i) for i in want} == want


def test_sound_reports_and_no_reports(found):
    assert 1000 not in found
    assert all(found[i] == [("", "the report is not an object")] for i in (1001, 1002, 1003, 1004))


def test_what_is_not_there_lacks_its_fields(found):
    said = found[1005]
    assert [p for p, _ in said if p.startswith("sections[0]")] == ["sections[0].id", "sections[0].title", "sections[0].letter", "sections[0].items"]
    assert ("sections[1].items", "expected a list of at most 40") in said and ("statements.compliance.parts", "expected a list of at most 8") in said and ("statements.soundness.title", "expected text of at most 200 characters") in said


def test_only_columns_travel_to_an_order(spark):
    """The texts of a report are made after its lines have met, not shuffled with them."""
    from quire.plans import checking

    plan = checking.report_problems(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    lists = [line for line in plan.splitlines() if "collect_list(" in line]
    assert lists and not any("repeat(" in line for line in lists)


def test_a_report_as_a_struct_is_checked_without_writing_it_as_text(spark):
    from quire.plans import checking

    plan = checking.report_problems(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "repeat(" in plan and not any(w in plan for w in ("to_json", "structstojson", "parse_json", "parseJson"))
    made = checking._reports(spark, "/root/testdata/sf0.001")
    assert made.schema["report"].dataType.typeName() == "struct"
    rows = lambda df: sorted(map(tuple, df.collect()))
    texts = reports.problems_of(made.selectExpr("o_orderkey", "to_json(report) as report"), "o_orderkey", "report")
    variants = reports.problems_in(made.selectExpr("o_orderkey", "to_variant_object(report) as report"), "o_orderkey", "report")
    want = rows(texts)
    assert want and rows(reports.problems_in(made, "o_orderkey", "report")) == want and rows(variants) == want


def test_a_struct_says_the_kinds_of_its_parts(spark):
    """Each part of another kind, null or not there at all in the schema; the same report as JSON says the same."""
    schema = """k int, r struct<schema: int, version: string, notice: string, document: array<int>, sections: array<struct<id: boolean, title: string, letter: string,
        items: array<struct<id: string, evidence: array<string>, gaps: string, citations: array<struct<label: string, href: int>>, instances: struct<a: int>>>>>,
        statements: struct<compliance: string, soundness: struct<title: string, entries: array<struct<id: string, shows: string>>>>, summary: struct<counts: string>>"""
    item = ("é" * 12, ["x", None], "g", [("l", None), (None, 3)], (1,))
    section = (True, "t", "AB", [item, None])
    rows = [(1, (1, "1", "é" * 2001, [1], [section, None], ("c", ("s", [("1", "é" * 4000), None])), ("",))), (2, None), (3, (None,) * 7)]
    df = spark.createDataFrame(rows, schema)
    said = lambda d: sorted(map(tuple, d.collect()))
    got = said(reports.problems_in(df, "k", "r"))
    assert got == said(reports.problems_of(df.selectExpr("k", "to_json(r) as j"), "k", "j"))
    paths = [p for k, p, _ in got if k == 1]
    assert (2, "", "the report is not an object") in got and "notice" in paths and "document.name" in paths and "summary" in paths
    assert "sections[0].items[0].id" not in paths and "sections[0].items[1].id" in paths and "sections[0].items[0].evidence[0]" in paths and "sections[0].items[0].citations[1].href" in paths
    assert "statements.soundness.entries[0].shows" not in paths and "statements.soundness.entries[1].shows" in paths
