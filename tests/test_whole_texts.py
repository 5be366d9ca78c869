"""Queries see every character of their texts."""

import re

from quire.plans import evidence as PE
from quire.plans import policy as PP
from quire.plans import structuring as PS


def documents_of(spark, tmp_path, rows, schema="doc_id long, text string"):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_printed_policy_text_keeps_whole_lines(spark, tmp_path):
    said = [f"Ärger{i} (£{i}5.0%), überall: «é» №{i}; Ελλάδα 漢字 end{i}" for i in range(36)]
    folder = documents_of(spark, tmp_path, [(1, "\n".join(said))])
    blocks = PP.policy_blocks(spark, folder).collect()
    text = "\n".join(r.text for r in blocks)
    assert [l for l in said if l not in text] == []
    assert {"policy", "para", "item1", "item2", "bullet", "footnote", "objective", "h3", "dl"} <= {r.type for r in blocks}
    chunks = "\n".join(f"{r.heading}\n{r.text}" for r in PP.policy_chunks(spark, folder).collect())
    assert [l for l in said if l not in chunks] == []


def test_scoped_quotes_meet_no_group_of_all_sections(spark, tmp_path):
    text = "the quick brown fox jumps over the lazy dog again"
    long = "\n".join(f"filler line {i} with some words of its own {i * 7}" for i in range(200))
    folder = documents_of(spark, tmp_path, [(1, f"{text}\n{long}"), (2, f"{text}\n{long}"), (3, long)])
    spark.createDataFrame([(1, 0), (2, 1), (3, 0)], "doc_id long, quality long").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, text)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    df = PE.scoped_quotes(spark, folder)
    assert [tuple(r) for r in df.collect()] == [(2, 1, 0)]
    joins = re.findall(r"Join \w+.*", df._jdf.queryExecution().optimizedPlan().toString())
    assert joins and not [j for j in joins if "section_no" in j and "doc_id" not in j]


def test_cells_and_headings_hold_whole_lines(spark, tmp_path):
    said = [f"line {i} " + "word" * 120 + f" END{i}" for i in range(10)]
    folder = documents_of(spark, tmp_path, [(1, "\n".join(said))])
    rows = PS.table_extract(spark, folder).collect()
    assert [l for l in said if not any(l in r.flat for r in rows)] == []
    named = PE.table_allocations(spark, folder).collect()
    assert sorted(r.name for r in named) == sorted(said)
    assert {r.level for r in PS.heading_level(spark, folder).collect()} == {0}  # 500 characters are no heading in any form
