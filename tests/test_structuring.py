import random

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import policy as PO
from quire.operators import structuring as S


def split_by_hand(text, target):
    """Passages as the rule reads: whole lines up to the target, long lines by sentence, very long pieces cut."""
    import re
    out, cur = [], ""
    for line in text.split("\n"):
        if len(line) > target:
            if cur.strip():
                out.append(cur.strip())
            cur, piece = "", ""
            for s in re.split(r"(?<=[.!?])\s+", line):
                if piece and len(piece) + len(s) > target:
                    out.append(piece.strip())
                    piece = ""
                piece = f"{piece} {s}" if piece else s
                while len(piece) > target * 1.5:
                    out.append(piece[:target])
                    piece = piece[target:]
            if piece.strip():
                out.append(piece.strip())
            continue
        if cur and len(cur) + len(line) + 1 > target:
            if cur.strip():
                out.append(cur.strip())
            cur = ""
        cur = f"{cur}\n{line}" if cur else line
    return out + ([cur.strip()] if cur.strip() else [])


def test_passage_split_matches_brute_force(spark):
    rnd = random.Random(7)
    texts = []
    for _ in range(60):
        words = [rnd.choice(["ab", "cde.", "f" * rnd.randint(1, 90), "g!", "\n", "\n\n", "hij"]) for _ in range(rnd.randint(0, 120))]
        texts.append(" ".join(words))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.p for r in df.select("i", S.passage_split(F.col("t"), 40).alias("p")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == split_by_hand(t, 40), t


def test_unique_ids_skip_taken_names(spark):
    ids = ["x", "x", "x-2", "x", "y", "x-2"]
    df = spark.createDataFrame([(1, n, v) for n, v in enumerate(ids)], "doc int, n int, id string")
    got = [r.anchor for r in S.unique_ids(df, "doc", "n").orderBy("n").collect()]
    assert got == ["x", "x-2", "x-2-2", "x-3", "y", "x-2-3"]


def test_sections_and_paths(spark):
    md = "intro\n# Title\n## A\n\ntext\n#### Deep\nmore\n## [Linked words](/f.pdf)\nbody\n#notheading\n### B"
    s = S.sectionise(spark.createDataFrame([(1, md)], "doc int, md string"))
    rows = {r.section_no: r for r in s.collect()}
    assert [rows[i].heading for i in sorted(rows)] == ["", "Title", "A", "Deep", "Linked words", "B"]
    assert rows[4].text == "[Linked words](/f.pdf)\n\nbody\n#notheading" and rows[3].level == 4 and rows[0].text == "intro"
    paths = {r.section_no: r.locator for r in S.heading_paths(s, "doc").collect()}
    assert paths == {0: "Opening text", 1: "Title", 2: "Title › A", 3: "Title › A › Deep", 4: "Title › Linked words", 5: "Title › Linked words › B"}
    titled = {r.section_no: r.locator for r in S.heading_paths(s.where("section_no > 0"), "doc").collect()}
    assert titled[1] == "Title" and titled[3] == "A › Deep"


def test_tables_keep_escaped_pipes(spark):
    md = "x | y\nno rule\n\n| Ref | Name |\n|:---|---|\n| 1 | a \\| b |\n| | |\n2 | c\nend\n---\n"
    rows = S.table_rows(spark.createDataFrame([(1, md)], "doc int, md string"), "doc", "md").orderBy("row_no").collect()
    assert [(r.table_no, r.row_no, r.cells) for r in rows] == [(1, 0, ["Ref", "Name"]), (1, 1, ["1", "a | b"]), (1, 3, ["2", "c"])]


def test_section_ids(ask):
    law = lambda h: ask(lambda c: S.section_id(c, F.lit("legislation")), h=h)
    assert [law(h) for h in ("32. Gateway 3", "15CA. Local plans", "Part 4 Rules", "SCHEDULE 2", "Schedule", "Explanatory Note", "7.", "Other")] == [
        "reg-32", "reg-15CA", "part-4", "schedule-2", "schedule", "explanatory-note", "para-7", "other"]
    assert ask(lambda c: S.section_id(c, F.lit("guidance")), h="!!!") == "section"


PRINTED = """1. Introduction ..... 2
2. Making plans (PM1 - 9) ..... 3
Annex B: Glossary ..... 9
Annex E: Green ..... 10
Annex F: Managing flood risk and coastal change ..... 11
1. Introduction
  The objective of
 this chapter.
1. First paragraph8 with a marker
 and a plan-
 making tail
8 A footnote’s text
  a. its own list
         12
 resumed after the page.
2. Making
plans
PM1: Local plans
1. They should set out:
  a. land allocations9, and
  h. eighth
  i. ninth letter
  i. roman one
  ii. roman two
 • a bullet
9 Second footnote
         13
  b. an item after the page
Short Heading
300 metres is not a note
loose words
Annex B: Glossary
Green Belt: open land
Annex E: Green
Words here
Table 1: Flood zones
A row""".split("\n")


def test_policy_text(spark):
    docs = spark.createDataFrame([(1, "\n".join(PRINTED))], "doc int, t string")
    found = PO.blocks(docs, "doc", "t").cache()
    got = [(r.chapter, r.type, r.marker, r.text) for r in found.orderBy("block_no").collect()]
    assert got == [
        ("ch-1", "objective", "", "The objective of this chapter."),
        ("ch-1", "para", "1", "First paragraph8 with a marker and a plan-making tail resumed after the page."),
        ("ch-1", "footnote", "8", "A footnote’s text a. its own list"),
        ("ch-2", "policy", "PM1", "Local plans"),
        ("ch-2", "para", "1", "They should set out:"),
        ("ch-2", "item1", "a", "land allocations9, and"),
        ("ch-2", "item1", "h", "eighth"),
        ("ch-2", "item1", "i", "ninth letter"),
        ("ch-2", "item2", "i", "roman one"),
        ("ch-2", "item2", "ii", "roman two"),
        ("ch-2", "bullet", "", "a bullet"),
        ("ch-2", "footnote", "9", "Second footnote"),
        ("ch-2", "item1", "b", "an item after the page Short Heading 300 metres is not a note loose words"),
        ("annex-b", "dl", "Green Belt", "open land"),
        ("annex-e", "para", "", "Words here"),
        ("annex-f", "para", "", "A row"),
    ]
    notes = {r.n: (r["at"], r.target, r.hangs_on) for r in PO.footnotes(found, "doc").collect()}
    assert notes == {8: ("", "ch-1-1", "First paragraph"), 9: ("PM1(1)(a)", "PM1-1", "land allocations")}
    chunks = {r.anchor: (r.heading, r.text) for r in PO.chunks(found, "doc").collect()}
    assert chunks["fn-9"] == ("2. Making › PM1: Local plans › footnote 9 on “land allocations”", "Footnote 9 to policy PM1(1)(a), on “land allocations”: Second footnote")
    assert chunks["PM1"][1].startswith("1. They should set out:\na. land allocations9, and\nh. eighth")


def test_heading_of_120_letters_in_capitals(ask):
    line = "aß" * 60
    assert ask(lambda t: S.heading_level(T.upper(t)), t=line) == 1  # with SS for ß it would have 180
    assert ask(S.heading_level, t="SITES OF THE PLAN.\r") == 1  # ends in a carriage return, not in the stop before it
