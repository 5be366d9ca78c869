"""Printed policy text: every line of a document, whole, is given one of the forms such a text has."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import policy as PO
from quire.operators import structuring as S
from quire.sources.tables import documents


def _printed(spark, sf):
    """A contents page, two chapters and an annex, with policies, items, footnotes and page numbers."""
    def line(l, i):
        n, k = i % 12, F.floor(i / 12)
        forms = [
            (0, F.concat(F.lit("PM"), k % 90 + 1, F.lit(": Policy "), l)), (1, F.concat(k + 1, F.lit(". First "), l, F.lit("x"), k + 1, F.lit(", then"))),
            (2, F.concat(F.lit(" continued "), l, F.lit(" plan-"))), (3, F.concat(F.lit(" making at the end "), l)), (4, F.concat(F.lit("  h. Letter "), l)),
            (5, F.concat(F.lit("  i. Letter again "), l)), (6, F.concat(F.lit("  i. Roman one "), l)), (7, F.concat(F.lit(" • Bullet "), l)), (8, F.concat(k + 1, F.lit(" Footnote "), l)),
            (9, F.concat(F.lit("  inside the footnote "), l)), (10, F.concat(F.lit("  still inside "), l, F.lit("\n         12"))), (11, F.concat(F.lit("  resumed "), l)),
        ]
        out = F.when(n == forms[0][0], forms[0][1])
        for f, c in forms[1:]:
            out = out.when(n == f, c)
        return out

    lines = F.array_join(F.transform(T.lines(F.col("text")), line), "\n")
    head = "1. Introduction ........ 2\n2. Plans (PM1 - 9) ........ 3\nAnnex B: Glossary ........ 9\n\n1. Introduction\n  The objective of it all\n1. Opening words\nSome Sub Heading\nFirst loose words\n2. Plans\n"
    tail = "\nAnnex B: Glossary\nGreen Belt: land kept open\nStep free: no steps"
    return documents(spark, sf).select("doc_id", F.concat(F.lit(head), lines, F.lit(tail)).alias("printed"))


def policy_blocks(spark, sf):
    return PO.blocks(_printed(spark, sf), "doc_id", "printed")


def policy_chunks(spark, sf):
    return PO.chunks(PO.blocks(_printed(spark, sf), "doc_id", "printed"), "doc_id")


def passage_split(spark, sf):
    """Whole documents and, so that long lines occur, whole documents as one line."""
    d = documents(spark, sf)
    both = F.array(F.struct(F.lit(0).alias("form"), F.col("text").alias("t")), F.struct(F.lit(1).alias("form"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("t")))
    return d.select("doc_id", F.inline(both)).select("doc_id", "form", F.posexplode(S.passage_split(F.col("t"))).alias("k", "part"))


QUERIES = {f.__name__: f for f in (policy_blocks, policy_chunks, passage_split)}
ORACLES = {}
