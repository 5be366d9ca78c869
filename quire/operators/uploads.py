"""Uploaded Markdown and plain text to typed blocks, and blocks to sections with their path, text and tables.

A document is one row: lines are folded into blocks, and blocks into sections, inside that
row. The fold keeps one state: the block that is open, and whether it is prose, code or a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import structuring as S

_BLOCK = "struct<kind:string,level:int,text:string>"
_NONE = "cast(array() as array<struct<kind:string,level:int,text:string,rows:array<array<string>>>>)"
# The marks of Markdown's blocks.
FENCE = r"^(```|~~~)"
HEADING = r"^(#{1,6})\s+(.*?)\s*#*\s*$"
UNDERLINE = r"^(={2,}|-{2,})\s*$"
BULLET = r"^[-*+]\s"
RULE = r"^(\*{3,}|-{3,}|_{3,})$"
ITEM = r"^(?:[-*+]|\d{1,3}[.)])\s+(.*)$"
# White space within a line; a lone space stays as it is.
_GAP = "\\t\\u00A0\\u2000-\\u200B\\u202F\\u205F\\u3000"
GAPS = f" [{_GAP} ]+|[{_GAP}][{_GAP} ]*"


def clean(c: Column) -> Column:
    """White space within lines collapsed, none round line ends or at the ends."""
    return T.strip(F.regexp_replace(F.regexp_replace(c, GAPS, " "), " *\n *", "\n"))


def _state(out, mode, fence, part) -> Column:
    return F.struct(out.alias("out"), mode.alias("mode"), fence.alias("fence"), part.alias("part"))


def _block(kind, level, text) -> Column:
    return F.struct(kind.alias("kind"), level.cast("int").alias("level"), text.alias("text"))


def _closed(acc: Column, kind: Column) -> Column:
    """The blocks with the open one behind them, if there is one."""
    return F.when(acc.part.isNull(), acc.out).otherwise(F.array_append(acc.out, _block(kind, F.lit(0), acc.part)))


def _looked_at(line: Column, following: Column) -> Column:
    """What a line is by itself: its kind, its words, a heading's level, and the level that a rule under it would give it."""
    def look(t):
        words = F.when(t.rlike(HEADING), F.regexp_extract(t, HEADING, 2)).when(t.rlike(ITEM), F.regexp_extract(t, ITEM, 1)).otherwise(F.regexp_replace(t, r"^>\s?", ""))
        kind = (F.when(t.rlike(FENCE), "fence").when(t == "", "blank").when(t.rlike(HEADING), "heading").when(t.contains("|") & following.rlike(S.TABLE_RULE), "table")
                .when(F.regexp_replace(t, r"\s", "").rlike(RULE), "rule").when(t.rlike(ITEM), "item").otherwise("text"))
        under = F.when(~T.strip(following).rlike(UNDERLINE) | t.rlike(BULLET) | t.contains("|"), 0).when(T.strip(following).startswith("="), 1).otherwise(2)
        return F.struct(line.alias("line"), t.alias("trimmed"), kind.alias("kind"), words.alias("words"), F.length(F.regexp_extract(t, HEADING, 1)).alias("level"), under.alias("under"))

    return T.once(T.strip(line), look)


def _markdown_step(acc: Column, x: Column) -> Column:
    none, nothing = F.lit(None).cast("string"), F.lit("")
    code = acc.mode == "code"
    ends = code & x.trimmed.startswith(acc.fence)
    stays = (code & ~ends) | ((acc.mode == "table") & x.trimmed.contains("|"))
    table = acc.mode == "table"  # and this line is none of its rows
    idle = table | acc.part.isNull()
    under = idle & (x.under > 0) & ~x.kind.isin("fence", "blank", "heading")
    closed = _closed(acc, F.when(table, "table").otherwise("para"))
    headed = F.array_append(closed, _block(F.lit("heading"), F.when(under, x.under).otherwise(x.level), F.when(under, x.trimmed).otherwise(x.words)))
    out = F.when(under | (x.kind == "heading"), headed).when((x.kind == "text") & ~table, acc.out).otherwise(closed)
    mode = F.when(under, "skip").when(x.kind == "fence", "code").when(x.kind == "table", "rule").otherwise("")
    part = (F.when(under, none).when(x.kind == "fence", "").when(x.kind == "table", x.trimmed).when(x.kind == "item", x.words)
            .when(x.kind == "text", F.concat_ws(" ", F.when(~table, acc.part), x.words)))
    return (
        F.when(stays, _state(acc.out, acc.mode, acc.fence, F.concat(acc.part, F.lit("\n"), x.line)))
        .when(acc.mode == "rule", _state(acc.out, F.lit("table"), nothing, acc.part))
        .when(ends | (acc.mode == "skip"), _state(F.when(ends, _closed(acc, F.lit("code"))).otherwise(acc.out), nothing, nothing, none))
        .otherwise(_state(out, mode, F.substring(x.trimmed, 1, 3), part))
    )


def markdown_blocks(text: Column) -> Column:
    """array<struct<kind, level, text, rows>>: headings, paragraphs (list items and code are some) and tables, in order.

    Front matter and comments are left out. A table's text is null and its rows are cells; rows
    keep their number, so an empty one is there too. Marks within code make no block.
    """
    flat = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"\A---\n(?s:.*?)\n---\n", "")
    flat = F.regexp_replace(flat, r"(?s)<!--.*?-->", "")
    lines = T.once(T.lines(flat), lambda ls: F.transform(ls, lambda line, i: _looked_at(line, F.coalesce(F.get(ls, i + 1), F.lit("")))))
    start = _state(F.expr(f"cast(array() as array<{_BLOCK}>)"), F.lit(""), F.lit(""), F.lit(None).cast("string"))

    def end(acc):
        return _closed(acc, F.when(acc.mode == "code", "code").when(acc.mode.isin("rule", "table"), "table").otherwise("para"))

    return _dressed(F.reduce(lines, start, _markdown_step, end))


def _dressed(blocks: Column) -> Column:
    """Blocks with their inline marks gone, those without words left out, and tables as cells."""
    def one(b):
        words = F.when(b.kind == "table", F.lit(None)).when((b.kind != "code") & b.text.rlike(T.MARKS), clean(T.strip_inline(b.text))).otherwise(clean(b.text))
        rows = F.when(b.kind == "table", F.transform(F.split(b.text, "\n"), lambda r: F.transform(S.split_row(r), clean)))
        return F.struct(F.when(b.kind == "code", "para").otherwise(b.kind).alias("kind"), b.level.alias("level"), words.alias("text"), rows.alias("rows"))

    return F.filter(F.transform(blocks, one), lambda b: (b.kind == "table") | (b.text != ""))


def text_blocks(text: Column) -> Column:
    """The same of plain text: groups of lines, of which one line alone may be a heading."""
    flat = F.regexp_replace(text, r"\r\n?", "\n")

    def group(g):
        return T.once(F.struct(clean(F.replace(T.strip(g), F.lit("\n"), F.lit(" "))).alias("words"), F.contains(T.strip(g), F.lit("\n")).alias("more")), lambda w: T.once(
            F.when(w.more, 0).otherwise(S.heading_level(w.words)), lambda level: F.struct(
                F.when(level > 0, "heading").otherwise("para").alias("kind"), level.cast("int").alias("level"), w.words.alias("text"),
                F.lit(None).cast("array<array<string>>").alias("rows"))))

    return F.filter(F.transform(S.line_groups(flat), group), lambda b: b.text != "")


def block_rows(docs: DataFrame, doc: str, blocks: str = "blocks") -> DataFrame:
    """One row per block: block_no, kind, level, text (a table's rows as lines of cells)."""
    # Of a bare column Spark would first ask whether it is empty, and to know that fold the whole text once more.
    rows = docs.select(doc, F.posexplode(F.coalesce(blocks, F.expr(_NONE))).alias("block_no", "b"))
    return rows.select(doc, "block_no", "b.kind", "b.level", F.coalesce("b.text", _lines(F.col("b.rows"))).alias("text"))


def _lines(rows: Column) -> Column:
    """A table's rows that hold anything, as lines."""
    return F.array_join(F.transform(F.filter(rows, lambda r: F.exists(r, lambda c: c != "")), lambda r: F.array_join(r, " | ")), "\n")


def table_cells(docs: DataFrame, doc: str, blocks: str = "blocks") -> DataFrame:
    """Rows of the blocks that are tables: table_no from 1, row_no (0 is the head), cells; rows without words are left out."""
    tables = F.filter(F.col(blocks), lambda b: b.kind == "table")
    rows = docs.select(doc, F.posexplode(tables).alias("t", "b")).select(doc, (F.col("t") + 1).alias("table_no"), F.posexplode("b.rows").alias("row_no", "cells"))
    return rows.where(F.exists("cells", lambda c: c != ""))


def assemble(docs: DataFrame, doc: str, blocks: str = "blocks", slides: Column | None = None) -> DataFrame:
    """Sections of documents: id, heading, level, path (headings above and its own), locator, text, tables.

    What stands before the first heading is a section of level 0. A lone heading of level 1
    that opens the document is its title and left out of the other sections' paths (not of ``slides``).
    """
    b = F.col(blocks)
    heads = F.filter(F.transform(b, lambda x, i: F.struct(i.alias("at"), x.kind.alias("kind"), x.level.alias("level"), x.text.alias("heading"))), lambda x: x.kind == "heading")
    kind = "struct<level:int,heading:string>"
    start = F.struct(F.expr(f"cast(array() as array<{kind}>)").alias("open"), F.expr("cast(array() as array<array<string>>)").alias("paths"))

    def step(acc, h):
        stack = F.array_append(F.filter(acc.open, lambda o: o.level < h.level), F.struct(h.level.alias("level"), h.heading.alias("heading")))
        return T.once(stack, lambda s: F.struct(s.alias("open"), F.array_append(acc.paths, F.transform(s, lambda o: o.heading)).alias("paths")))

    rows = docs.select(doc, b.alias("b"), heads.alias("heads"), (slides if slides is not None else F.lit(False)).alias("slides"))
    rows = rows.withColumn("paths", F.reduce("heads", start, step, lambda acc: acc.paths))
    first = F.array(F.struct(F.lit(0).alias("at"), F.lit("").alias("kind"), F.lit(0).alias("level"), F.lit("").alias("heading")))
    opens = F.when((F.size("b") > 0) & (F.get("b", F.lit(0)).kind != "heading"), True).otherwise(False)
    rows = rows.select(doc, "b", "slides", F.when(opens, F.concat(first, "heads")).otherwise(F.col("heads")).alias("heads"),
                       F.when(opens, F.concat(F.array(F.expr(S.STRINGS)), "paths")).otherwise(F.col("paths")).alias("paths"))
    top = F.get("heads", F.lit(0))
    titled = (top.level == 1) & (F.size(F.filter("heads", lambda h: h.level == 1)) == 1) & ~F.col("slides")
    rows = rows.select(doc, "b", "heads", titled.alias("titled"), top.heading.alias("title"), F.posexplode(F.arrays_zip("heads", "paths")).alias("i", "z"))
    path = F.when(F.col("titled") & (F.col("i") > 0) & (F.get("z.paths", F.lit(0)) == F.col("title")), F.expr("slice(z.paths, 2, size(z.paths))")).otherwise(F.col("z.paths"))
    to = F.coalesce(F.get("heads", F.col("i") + 1).at, F.size("b"))
    # A heading is not part of its section's text.
    body = F.filter(F.slice("b", F.col("z.heads.at") + 1, to - F.col("z.heads.at")), lambda x: x.kind != "heading")
    rows = rows.select(doc, F.concat(F.lit("s"), F.col("i") + 1).alias("id"), F.col("z.heads.heading").alias("heading"), F.col("z.heads.level").alias("level"), path.alias("path"), body.alias("body"))
    last3 = F.slice("path", F.greatest(F.lit(1), F.size("path") - 2), F.lit(3))
    full = F.filter("body", lambda x: (x.kind != "table") | (_lines(x.rows) != ""))
    rows = rows.withColumn("body", full)
    tables = F.transform(F.filter("body", lambda x: x.kind == "table"), lambda x: F.filter(x.rows, lambda r: F.exists(r, lambda c: c != "")))
    text = F.array_join(F.transform("body", lambda x: F.coalesce(x.text, _lines(x.rows))), "\n")
    rows = rows.where((F.col("heading") != "") | (F.size("body") > 0))
    return rows.select(doc, "id", "heading", "level", "path", F.when(F.size("path") == 0, "Opening text").otherwise(F.array_join(last3, " › ")).alias("locator"),
                       text.alias("text"), tables.alias("tables"))
