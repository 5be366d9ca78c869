import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import ranking as R
from quire.sources import files


@pytest.mark.parametrize("word, stem", [("policies", "policy"), ("boxes", "box"), ("cases", "case"), ("houses", "house"), ("plans", "plan"), ("class", "class"), ("building", "build"), ("ring", "ring"), ("gas", "gas")])
def test_stem(ask, word, stem):
    assert ask(T.stem, w=word) == stem


def test_normalise_folds_what_a_copy_may_change(ask):
    assert ask(T.normalise, t="  It’s “A\u00a0plan”—for\u200b now…\r\n•  x ") == "it's \"a plan\"-for now... x"


def test_quote_pieces(ask):
    assert ask(T.quote_pieces, t="“The plan … sets out: homes.” ") == ["the plan", "sets out: homes"]
    assert ask(T.quote_pieces, t=" … ") == []


@pytest.mark.parametrize("raw, bare", [
    ("**bold** and __too__", "bold and too"), ("an *em* and _em_ but snake_case_name", "an em and em but snake_case_name"), ("[text][ref] <https://x.y> \\*", "text https://x.y *"),
    ("~~gone~~ `a*b*c`", "gone a*b*c"), ("2 * 3 * 4", "2 * 3 * 4")])
def test_strip_inline(ask, raw, bare):
    assert ask(T.strip_inline, t=raw) == bare


def test_small_helpers(ask):
    assert ask(T.slug, t="The Council’s Plan: 2040!") == "the-councils-plan-2040"
    assert ask(T.file_slug, t="My Plan v2.DOCX") == "my-plan-v2"
    assert ask(T.file_slug, t=".docx") == "plan"
    assert ask(T.clean_name, t="C:\\up\\pl\x07an<1>.docx") == "plan1.docx"
    assert ask(T.clean_name, t="a/") == "document"
    assert ask(T.normalise_code, t="nw.h 1") == "NW/H1"
    assert ask(T.size_label, n=15 * 1024 * 1024) == "15MB"
    assert ask(T.size_label, n=64 * 1024) == "64KB"
    assert ask(T.human_list, t=["a", "b", "c"]) == "a, b and c"
    assert ask(T.human_list, t=["a"]) == "a"
    assert ask(lambda t: T.clip_list(t, 2, 3), t=[" ", "abcd", " e  f", "g"]) == ["abc", "e f"]


def test_decode(ask):
    assert ask(files.decode_text, b="é€".encode("cp1252")) == "é€"
    assert ask(files.decode_text, b=b"\xff\xfe" + "é".encode("utf-16le")) == "é"
    assert ask(files.decode_text, b=b"\xef\xbb\xbf" + "é".encode()) == "é"


def test_highlight(ask):
    assert ask(R.highlight, t="A plan, planning", w=["plan", "an"]) == "A <mark>plan</mark>, <mark>planning</mark>"
    assert ask(R.highlight, t="A+ plan", w=["an"]) == "A+ plan"


def test_snippet(ask):
    text = "word " * 100 + "needle " + "tail " * 100
    got = ask(R.snippet, t=text, w=["needle"])
    assert got.startswith("…word") and "needle" in got and got.endswith("tail…")
    assert ask(R.snippet, t="short text", w=["none"]) == "short text"


def test_snippet_ends_at_the_very_end(ask):
    text = "x " * 156 + "threha.\n" + "more " * 40  # the 320th letter is a line break: only that goes
    assert ask(R.snippet, t=text, w=["none"]) == text[:319] + "…"


def test_upper_keeps_the_length(ask):
    assert ask(T.upper, t="straße, ŉ ᾀ é") == "STRAẞE, ŉ ᾈ É"
    assert ask(T.upper, t="plain é") == "PLAIN É"


def test_csv_form(spark, tmp_path):
    rows = spark.createDataFrame([("LP-1", 'Adopted by "full" council, 3 Jan', "")], "plan string, notes string, actual string").coalesce(1)
    files.write_timetable_csv(rows, str(tmp_path / "a"))
    out = b"".join(p.read_bytes() for p in sorted((tmp_path / "a").glob("*.csv")))
    assert out == b'plan,notes,actual\r\nLP-1,"Adopted by ""full"" council, 3 Jan",\r\n'


def test_nested_content(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"id": "l1", "groups": [{"title": "G", "items": [{"id": "i1", "text": "T", "must": true}, {"id": "i2", "text": "U", "must": false}]}]}')
    lists = spark.read.json(str(tmp_path / "c.json"))
    assert [(r["list"], r.group, r.id, r.must) for r in files.checklist_items(lists).collect()] == [("l1", "G", "i1", True), ("l1", "G", "i2", False)]
    (tmp_path / "s.json").write_text('{\n"sources": [{"id": "a"},\n {"id": "b"}]}')
    assert [r.id for r in files.read_catalogue(spark, str(tmp_path / "s.json")).collect()] == ["a", "b"]
    flow = spark.sql("select map('q1', named_struct('options', array(named_struct('value', 'y', 'next', 'q2')))) as questions")
    assert [(r.question, r.next) for r in files.question_options(flow).collect()] == [("q1", "q2")]


def test_compressed_csv_reads_back(spark, tmp_path):
    rows = spark.createDataFrame([("LP-1", 'Adopted by "full" council, 3 Jan', "")], "plan string, notes string, actual string").coalesce(1)
    for write in (files.write_timetable_csv, files.write_milestone_csv):
        write(rows, str(tmp_path / write.__name__), compression="gzip")
        assert list((tmp_path / write.__name__).glob("*.csv.gz"))
        lines = spark.read.text(str(tmp_path / write.__name__), lineSep="\r\n").collect()
        assert len(lines) == 2 and 'Adopted by ""full"" council, 3 Jan' in lines[1].value
