"""Work on a document grows with its length, and its text is worked out once."""

import random
import re
import time

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import detection as D
from quire.operators import policy as PO
from quire.operators import structuring as S
from quire.operators import uploads as U


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def table_by_hand(text):
    """(table, row, line) as a plain loop over lines finds them."""
    lines, out, mode, t, r, fence = text.split("\n"), [], "", 0, 0, ""
    for i, line in enumerate(lines):
        mark = re.match(r"\s*(```|~~~)", line)
        if mode == "rule":
            mode = "in"
        elif mode == "in" and "|" in line:
            r += 1
            out.append((t, r, line))
        elif mode == "code" and not (mark and mark[1] == fence):
            pass
        elif mode != "code" and mark:
            mode, fence = "code", mark[1]
        elif mode != "code" and "|" in line and i + 1 < len(lines) and re.match(r"^\|?-{3,}(\|-{3,})*\|?$", lines[i + 1]):
            mode, t, r = "rule", t + 1, 0
            out.append((t, 0, line))
        else:
            mode = ""
    return out


def test_tables_are_those_of_a_plain_loop(spark):
    rnd = random.Random(5)
    texts = ["\n".join(rnd.choice(["a|b", "a|b", "---|---", "---", "x", "", "```", " ~~~", "| |", "p"]) for _ in range(rnd.randint(0, 25))) for _ in range(300)]
    found = S.table_rows(spark.createDataFrame(list(enumerate(texts)), "doc int, md string"), "doc", "md").collect()
    got = sorted((r.doc, r.table_no, r.row_no) for r in found)
    cells = lambda line: [c.strip() for c in line.strip().removeprefix("|").removesuffix("|").split("|")]
    assert got == sorted((d, t, r) for d, text in enumerate(texts) for t, r, line in table_by_hand(text) if any(cells(line)))


def test_a_long_document_is_split_into_lines_once(spark):
    text = "| Ref | Site name |\n|---|---|\n" + "\n".join(f"| H{i} | Land {i} |" for i in range(30000))
    df = spark.createDataFrame([(1, text)], "doc int, md string")
    start = time.time()
    assert S.table_rows(df, "doc", "md").count() == 30001
    assert time.time() - start < 30


def test_schedules_are_read_once(spark):
    text = "| Ref | Site name |\n|---|---|\n| H1 | Mill Lane |\n| x | no number |\n\n| | |\n|---|---|\n| H2 | no head |\n\n| Site | Ref no |\n|---|---|\n| Farm | A/3 |"
    df = D.table_allocations(S.tables(spark.createDataFrame([(1, text)], "doc int, md string"), "doc", "md"), "doc")
    assert sorted((r.table_no, r.row_no, r.ref, r.name) for r in df.collect()) == [(1, 1, "H1", "Mill Lane"), (3, 1, "A/3", "Farm")]
    assert "Join" not in plan(df)


def test_markers_of_footnotes(spark):
    blocks = [(1, 0, "first, the words before a marker12 and more13. end14"), (1, 1, "again12 and 07x07 plain7"), (1, 2, "(one two’15)"), (1, 3, "no1234 place 8 here")]
    df = spark.createDataFrame(blocks, "doc int, block_no int, text string").withColumns({"at": F.lit("a"), "target": F.lit("t")})
    hung = S.footnote_attach(df, spark.createDataFrame([(1, n) for n in (7, 8, 12, 13, 14, 15, 99, 123)], "doc int, n int"), "doc")
    assert {r.n: (r.block_no, r.hangs_on) for r in hung.collect()} == {
        7: (1, "again12 and 07x07 plain"), 12: (0, "words before a marker"), 13: (0, "a marker12 and more"), 14: (0, "marker12 and more13. end"), 15: (2, "one two")}
    joins = [line for line in plan(hung).split("\n") if "Join" in line or "Aggregate" in line]
    assert joins and not [line for line in joins if re.search(r"\btext#", line)]  # no block's text goes where notes are met


def test_blocks_are_folded_once(spark):
    df = spark.createDataFrame([(1, "# A\n\nx  y  z")], "doc int, text string").select("doc", U.markdown_blocks(F.col("text")).alias("blocks"))
    rows = U.block_rows(df, "doc")
    assert [(r.kind, r.text) for r in rows.collect()] == [("heading", "A"), ("para", "x y z")]
    assert "Filter" not in plan(rows)


def test_printed_lines_come_of_one_split(spark):
    text = "\n".join(f"line {i}" for i in range(30000))
    df = spark.createDataFrame([(1, text)], "doc int, t string")
    start = time.time()
    assert PO._lines(df, "doc", "t").count() == 30000
    assert time.time() - start < 30


def test_squash_keeps_single_spaces(ask):
    assert ask(T.squash, t=" \ta b  c\td\n e\u000bf \n") == "a b c d e f"
