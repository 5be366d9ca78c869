"""The upload chain on hand-written documents, and tables of pages with missing end tags and tables within tables."""

import pytest
from pyspark.sql import functions as F

from quire.operators import tables, uploads


@pytest.fixture
def sections(spark):
    def run(text, make=uploads.markdown_blocks):
        df = spark.createDataFrame([(1, text)], "doc int, text string").select("doc", make(F.col("text")).alias("blocks"))
        return uploads.assemble(df, "doc").collect()

    return run


@pytest.fixture
def blocks(spark):
    def run(text, make=uploads.markdown_blocks):
        df = spark.createDataFrame([(1, text)], "doc int, text string").select("doc", make(F.col("text")).alias("blocks"))
        return [(b.kind, b.level, b.text if b.rows is None else b.rows) for b in df.first().blocks]

    return run


def test_markdown_becomes_sections(sections):
    got = sections("---\ntitle: x\n---\n# Plan\n\n## 2 Vision\n\nBy **2040** the [area](http://x) will *change*.\n\nSecond line\n---\n\n| Ref | Site name |\n| --- | --- |\n| H1 | Land at Mill Lane |\n\n- Outcome 1: 500 homes\n- Outcome 2: 20 hectares")
    assert [(r.id, r.heading, r.level, r.path) for r in got] == [("s1", "Plan", 1, ["Plan"]), ("s2", "2 Vision", 2, ["2 Vision"]), ("s3", "Second line", 2, ["Second line"])]
    assert got[1].text == "By 2040 the area will change."
    assert got[2].tables == [[["Ref", "Site name"], ["H1", "Land at Mill Lane"]]]
    assert got[2].text == "Ref | Site name\nH1 | Land at Mill Lane\nOutcome 1: 500 homes\nOutcome 2: 20 hectares"


def test_plain_text_becomes_sections(sections):
    got = sections("NORTHWOLD LOCAL PLAN\n\n3. Spatial strategy\n\nGrowth will go to Wendbury.\nAnd on.\n\nPolicy NW1\n\nDevelopment must be well designed.", uploads.text_blocks)
    assert [(r.level, r.heading) for r in got] == [(1, "NORTHWOLD LOCAL PLAN"), (1, "3. Spatial strategy"), (3, "Policy NW1")]
    assert got[1].text == "Growth will go to Wendbury. And on." and got[2].locator == "3. Spatial strategy › Policy NW1"


def test_tables_in_code_and_comments_are_none(blocks):
    assert blocks("a\n```\n| x | y |\n|---|---|\n# no\n```\n<!--\n| p | q |\n|---|---|\n-->\n~~~\nopen to the end\n```") == [("para", 0, "a"), ("para", 0, "| x | y |\n|---|---|\n# no"), ("para", 0, "open to the end\n```")]


def test_blocks_of_every_kind(blocks):
    text = "###### Six ##\r\n> quoted\r\n> twice\r\n1) one\n  goes on\n* two\n\n***\nTop\n===\n--\nnot | a\n- item\n---\nx | y\n:---|---:\n | \n1 | 2\nafter\n#nohead\n####### seven"
    assert blocks(text) == [
        ("heading", 6, "Six"), ("para", 0, "quoted twice"), ("para", 0, "one goes on"), ("para", 0, "two"), ("heading", 1, "Top"), ("para", 0, "-- not | a"), ("para", 0, "item"),
        ("table", 0, [["x", "y"], [""], ["1", "2"]]), ("para", 0, "after #nohead ####### seven")]
    assert blocks("") == [] and blocks("<!-- x -->\n\n") == [] and blocks("| a |\n|---|") == [("table", 0, [["a"]])]


def test_paths_titles_and_openings(sections):
    got = sections("before\n# T\n## A\n#### B\n## C\n|x|\n|---|\n")
    assert [(r.heading, r.locator) for r in got] == [("", "Opening text"), ("T", "T"), ("A", "T › A"), ("B", "T › A › B"), ("C", "T › C")]
    assert [r.locator for r in sections("# T\n## A\n### B\n#### C\n##### D")] == ["T", "A", "A › B", "A › B › C", "B › C › D"]
    assert sections("# T\n# U\n## A")[2].path == ["U", "A"] and sections("") == []


def test_long_lines_are_whole(blocks):
    long = "w" * 500
    assert blocks(f"| Ref | {long}END |\n|---|---|\n| {long}MARK | 2 |") == [("table", 0, [["Ref", long + "END"], [long + "MARK", "2"]])]
    assert blocks(f"# {long}END") == [("heading", 1, long + "END")]


def cells(spark, html):
    found = tables.html_tables(spark.createDataFrame([(1, html)], "page int, html string"), "page").collect()
    out = {}
    for r in sorted(found, key=lambda r: (r.table_no, r.row_no, r.cell_no)):
        out.setdefault((r.table_no, r.row_no), []).append(r.text)
    return out


def test_html_tables(spark):
    html = "<p>x</p><TABLE class=a><thead><tr><th>Ref<th>Site &amp; name</thead><tr><td> H1 <b>x</b>\n y</td><td>a < b</td></tr><tr></tr></table><td>stray</td><table><td>implied<tr><td>open"
    assert cells(spark, html) == {(1, 0): ["Ref", "Site & name"], (1, 1): ["H1 x y", "a < b"], (2, 0): ["implied"], (2, 1): ["open"]}


def test_tables_within_tables(spark):
    html = "<table><tr><td>a<table><tr><td>b<td>c</table>d<td>e</tr><tr><td>f</table><script><table><tr><td>no</table></script>"
    assert cells(spark, html) == {(1, 0): ["abcd", "e"], (1, 1): ["b", "c"], (1, 2): ["f"]}
    text = tables.table_text(spark.createDataFrame([(1, html)], "page int, html string"), "page").collect()
    assert [r.text for r in text] == ["abcd | e\nb | c\nf"]
    assert cells(spark, "no table") == {} and cells(spark, "</table></tr><tr><td>x") == {}
