"""Tables of HTML pages as cells, by one fold over a page's table tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

# Parts of a page without text of its own, and the entities that are decoded.
HIDDEN = ("script", "style", "nav", "footer")
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
TAG = r"(?i)^<(/?(?:table|tr|td|th))\b"


def visible(html: Column) -> Column:
    """The page without hidden parts and comments."""
    for tag in HIDDEN:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    return F.regexp_replace(html, r"(?s)<!--.*?-->", "")


def decoded(text: Column) -> Column:
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def _cells(events: Column, n: Column) -> Column:
    """Cells as (table_no, row_no, cell_no, from, to) over the page's tokens.

    Open tables are a stack; each has its open row and where its open cell began. A cell, row
    or table that is not closed ends where the next begins or with what holds it. A table's rows are
    those of the tables within it too, in order, as its cells hold all their text.
    """
    top = "struct<row:int,cell:int,start:int>"
    cell = "struct<table_no:int,row_no:int,cell_no:int,from:int,to:int>"
    start = F.struct(F.expr(f"cast(array() as array<{top}>)").alias("open"), F.lit(0).alias("tables"), F.lit(0).alias("rows"), F.expr(f"cast(array() as array<{cell}>)").alias("out"))

    def found(acc, o, at):
        return F.struct(acc.tables.alias("table_no"), (o.row - 1).alias("row_no"), (o.cell - 1).alias("cell_no"), o.start.alias("from"), at.alias("to"))

    def step(acc, e):
        depth = F.size(acc.open)
        last = F.element_at(acc.open, -1)
        under = F.slice(acc.open, F.lit(1), F.greatest(depth - 1, F.lit(0)))
        kept = F.when((depth > 0) & (last.start >= 0), F.array_append(acc.out, found(acc, last, e.at))).otherwise(acc.out)
        opened = lambda row, no, start: F.array_append(under, F.struct(row.cast("int").alias("row"), no.cast("int").alias("cell"), start.cast("int").alias("start")))
        to = lambda stack, tables, rows, out: F.struct(stack.alias("open"), tables.alias("tables"), rows.alias("rows"), out.alias("out"))
        new_row = F.when(last.row > 0, acc.rows).otherwise(acc.rows + 1)
        nothing = F.lit(-1)
        return (
            F.when(e.tag == "table", to(F.array_append(acc.open, F.struct(F.lit(0).alias("row"), F.lit(0).alias("cell"), nothing.alias("start"))),
                                        F.when(depth == 0, acc.tables + 1).otherwise(acc.tables), F.when(depth == 0, 0).otherwise(acc.rows), acc.out))
            .when(depth == 0, acc)
            .when(e.tag == "/table", to(under, acc.tables, acc.rows, kept))
            .when(e.tag == "tr", to(opened(acc.rows + 1, F.lit(0), nothing), acc.tables, acc.rows + 1, kept))
            .when(e.tag == "/tr", to(opened(F.lit(0), F.lit(0), nothing), acc.tables, acc.rows, kept))
            .when(e.tag.isin("td", "th"), to(opened(F.when(last.row > 0, last.row).otherwise(new_row), last.cell + 1, e.at), acc.tables, new_row, kept))
            .otherwise(to(opened(last.row, last.cell, nothing), acc.tables, acc.rows, kept))
        )

    def end(acc):
        return F.concat(acc.out, F.transform(F.filter(acc.open, lambda o: o.start >= 0), lambda o: found(acc, o, n)))

    return F.reduce(events, start, step, end)


def html_tables(pages: DataFrame, page: str, html: str = "html") -> DataFrame:
    """page, table_no (from 1), row_no, cell_no, text of every cell of a page's outermost tables, white space as one space."""
    tokens = F.split(F.regexp_replace(visible(F.col(html)), r"(</?[A-Za-z][^>]*>)", "\u0001$1\u0001"), "\u0001")
    marked = F.transform(tokens, lambda t: F.struct(F.lower(F.regexp_extract(t, TAG, 1)).alias("tag"), F.when(t.rlike(r"^</?[A-Za-z]"), "").otherwise(t).alias("text")))
    rows = pages.select(page, marked.alias("tokens"))
    events = F.filter(F.transform("tokens", lambda t, i: F.struct(t.tag.alias("tag"), i.alias("at"))), lambda e: e.tag != "")
    rows = rows.where(F.exists("tokens", lambda t: t.tag == "table")).select(page, "tokens", F.explode(_cells(events, F.size("tokens"))).alias("c"))
    text = F.array_join(F.transform(F.slice("tokens", F.col("c.from") + 1, F.col("c.to") - F.col("c.from")), lambda t: t.text), "")
    return rows.select(page, "c.table_no", "c.row_no", "c.cell_no", T.squash(decoded(text)).alias("text"))


def table_text(pages: DataFrame, page: str, html: str = "html") -> DataFrame:
    """page, table_no, text: each table as lines of cells; rows without words are left out."""
    cells = html_tables(pages, page, html)
    lines = cells.groupBy(page, "table_no", "row_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("cell_no", "text"))), lambda c: c.text), " | ").alias("line"), F.max("text").alias("most"))
    whole = lines.where("most <> ''").groupBy(page, "table_no").agg(F.sort_array(F.collect_list(F.struct("row_no", "line"))).alias("l"))
    return whole.select(page, "table_no", F.array_join(F.transform("l", lambda x: x.line), "\n").alias("text"))


def html_blocks(pages: DataFrame, page: str, html: str = "html") -> DataFrame:
    """Headings, paragraphs, list items and outermost tables of a page, in order, as plain text; what stands within a table is part of it."""
    cut = F.split(F.regexp_replace(visible(F.col(html)), r"(?i)(</?(?:h[1-6]|p|li|ul|ol|article|div|table)\b[^>]*>)", "\u0001$1"), "\u0001")
    opened = F.transform(cut, lambda t: F.when(t.rlike(r"(?i)^<table\b"), 1).when(t.rlike(r"(?i)^</table\b"), -1).otherwise(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.expr("cast(array() as array<int>)").alias("out"))

    def step(acc, o):  # a piece's table: 0 outside of all, less than 0 where one begins
        depth = F.greatest(acc.depth + o, F.lit(0))
        n = F.when((o == 1) & (acc.depth == 0), acc.n + 1).otherwise(acc.n)
        mark = F.when((o == 1) & (acc.depth == 0), -n).when((acc.depth > 0) & (depth > 0), n).otherwise(0)
        return F.struct(depth.alias("depth"), n.alias("n"), F.array_append(acc.out, mark).alias("out"))

    within = F.when(F.exists(opened, lambda o: o == 1), F.reduce(opened, start, step, lambda acc: acc.out)).otherwise(F.transform(cut, lambda t: F.lit(0)))
    rows = pages.select(page, F.posexplode(F.arrays_zip(cut.alias("piece"), within.alias("table_no"))).alias("at", "z")).select(page, "at", "z.piece", "z.table_no")
    tag = F.lower(F.regexp_extract("piece", r"(?i)^<(h[1-6]|p|li)\b", 1))
    text = decoded(F.regexp_replace("piece", r"<[^>]*>", ""))
    kind = F.when(tag == "p", "para").when(tag == "li", "item").otherwise("heading")
    level = F.when(tag.rlike("^h"), F.substring(tag, 2, 1).cast("int")).otherwise(0)
    prose = rows.where((tag != "") & (F.col("table_no") == 0)).select(page, "at", kind.alias("kind"), level.alias("level"), T.squash(text).alias("text")).where("text <> ''")
    begins = rows.where("table_no < 0").select(page, "at", (-F.col("table_no")).alias("table_no"))
    grids = begins.join(table_text(pages, page, html), [page, "table_no"])
    return prose.unionByName(grids.select(page, "at", F.lit("table").alias("kind"), F.lit(0).alias("level"), "text"))
