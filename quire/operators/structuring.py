"""Documents to sections, chunks, blocks and tables.

A document is one row, so its structure is worked out inside that row with
array functions: nothing here shuffles text unless it joins another table.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quire import fixed
from quire.functions import text as T

# Fixed value: what counts as a heading.
HEADING = r"^(#{1,4})\s+(.+?)\s*$"
STRINGS = "cast(array() as array<string>)"


def sectionise(docs: DataFrame, body: str = "md") -> DataFrame:
    """One row per section: level, heading, text. Text before the first heading is section 0."""
    parts = F.split(F.col(body), r"\n(?=#{1,4}[^\S\n]+[^\n])")
    rest = [c for c in docs.columns if c != body]
    starts = F.col(body).rlike(r"^#{1,4}[^\S\n]+[^\n]")
    rows = docs.select(*rest, starts.cast("int").alias("_s"), F.posexplode(parts).alias("_p", "_t"))
    first = F.regexp_extract("_t", r"^[^\n]*", 0)
    is_heading = (F.col("_p") + F.col("_s")) > 0
    raw = F.regexp_extract(first, HEADING, 2)
    link = r"^\[([^\]]+)\]\(([^)\s]+)\)$"
    words = F.when(raw.rlike(link), F.regexp_extract(raw, link, 1)).otherwise(raw)
    heading = T.squash(F.replace(words, F.lit("\\."), F.lit(".")))
    after = F.regexp_replace("_t", r"^[^\n]*\n?", "")
    kept = F.when(raw.rlike(link), F.concat_ws(
        "\n", F.concat(F.lit("["), heading, F.lit("]("), F.regexp_extract(raw, link, 2), F.lit(")")),
        F.when(F.col("_t").contains("\n"), F.concat(F.lit("\n"), after)).otherwise(""))).otherwise(after)
    sections = rows.select(
        *rest, (F.col("_p") + F.col("_s")).alias("section_no"),
        F.when(is_heading, F.length(F.regexp_extract(first, HEADING, 1))).otherwise(0).alias("level"),
        F.when(is_heading, heading).otherwise("").alias("heading"),
        F.when(is_heading, kept).otherwise(F.col("_t")).alias("text"))
    return sections.where((F.col("heading") != "") | ~T.blank(F.col("text")))


def section_id(heading: Column, kind: Column, prefix: str = "reg") -> Column:
    """A readable id: by number for legislation, else the slug of the heading."""
    g = lambda p: F.regexp_extract(heading, p, 1)
    law = (
        F.when(heading.rlike(r"^\d+[A-Z]{0,3}\.\s"), F.concat(F.lit(prefix + "-"), g(r"^(\d+[A-Z]{0,3})\.\s")))
        .when(heading.rlike(r"(?i)^Part \d+(?![A-Za-z0-9_])"), F.concat(F.lit("part-"), g(r"(?i)^Part (\d+)")))
        .when(heading.rlike(r"(?i)^SCHEDULE \d+(?![A-Za-z0-9_])"), F.concat(F.lit("schedule-"), g(r"(?i)^SCHEDULE (\d+)")))
        .when(heading.rlike(r"(?i)^Schedule(?![A-Za-z0-9_])"), "schedule")
        .when(heading.rlike(r"(?i)^Explanatory Note"), "explanatory-note")
        .when(heading.rlike(r"^\d+\.\s*$"), F.concat(F.lit("para-"), F.regexp_replace(heading, r"\D", "")))
    )
    own = T.slug(heading)
    plain = F.when(own == "", "section").otherwise(own)
    return F.when(kind == "legislation", F.coalesce(law, plain)).otherwise(plain)


@F.pandas_udf(ArrayType(StringType()))
def _unique(lists: pd.Series) -> pd.Series:
    def name(ids):
        used, following, out = set(), {}, []
        for base in ids:
            new, n = base, following.get(base, 2)
            while new in used:
                new, n = f"{base}-{n}", n + 1
            following[base] = n
            used.add(new)
            out.append(new)
        return out

    return lists.map(name)


def unique_ids(sections: DataFrame, doc: str, order: str, name: str = "id") -> DataFrame:
    """Repeated ids of one document numbered -2, -3, … past any that are taken."""
    lists = sections.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct(order, name))).alias("s"))  # names only, no text
    named = lists.select(doc, F.inline(F.arrays_zip(F.col(f"s.{order}").alias(order), _unique(F.col(f"s.{name}")).alias("anchor"))))
    return sections.join(named, [doc, order])


def units(docs: DataFrame, doc: str, body: str = "md") -> DataFrame:
    """A long document cut at headings of level one and two; what comes before them is the preamble."""
    parts = F.split(F.col(body), r"\n(?=#{1,2}[^\S\n]+[^\n])")
    rows = docs.select(doc, F.posexplode(parts).alias("unit_no", "_t"))
    first = F.regexp_extract("_t", r"^[^\n]*", 0)
    opens = first.rlike(r"^#{1,2}\s+.")
    inner = F.regexp_count("_t", F.lit(r"(?m)^#{1,4}[^\S\n]+[^\n]"))
    lead = first.rlike(HEADING)
    before = F.split("_t", r"\n(?=#{1,4}[^\S\n]+[^\n])")[0]
    count = inner + F.when(~lead & ~T.blank(before), 1).otherwise(0)
    title = T.squash(F.regexp_replace(F.regexp_extract(first, HEADING, 2), r"^\[([^\]]+)\]\(([^)\s]+)\)$", "$1"))
    return rows.select(doc, "unit_no", F.when(opens, title).otherwise("Preamble").alias("title"),
                       count.cast("long").alias("sections")).where("sections > 0")


def chunk_pack(plain: Column) -> Column:
    """Paragraphs packed greedily into pieces of about the target length."""
    paras = F.filter(F.transform(T.lines(plain), T.strip), lambda p: p != "")
    start = F.struct(F.expr(STRINGS).alias("out"), F.lit("").alias("cur"))

    def step(acc, p):
        over = (acc.cur != "") & (F.length(acc.cur) + F.length(p) > fixed.CHUNK_LIMIT)
        out = F.when(over, F.array_append(acc.out, acc.cur)).otherwise(acc.out)
        cur = F.when(over | (acc.cur == ""), p).otherwise(F.concat(acc.cur, F.lit("\n"), p))
        full = F.length(cur) >= fixed.CHUNK_TARGET
        return F.struct(F.when(full, F.array_append(out, cur)).otherwise(out).alias("out"),
                        F.when(full, F.lit("")).otherwise(cur).alias("cur"))

    end = lambda acc: F.when(acc.cur == "", acc.out).otherwise(F.array_append(acc.out, acc.cur))
    return F.reduce(paras, start, step, end)


def passage_split(text: Column, target: int = fixed.PASSAGE_TARGET) -> Column:
    """Pieces of at most about the target, at lines, then sentences, then by cutting."""
    top = int(target * 1.5)

    def sentences(line):
        start = F.struct(F.expr(STRINGS).alias("out"), F.lit("").alias("cur"))

        def step(acc, s):
            over = (acc.cur != "") & (F.length(acc.cur) + F.length(s) > target)
            out = F.when(over, F.array_append(acc.out, T.strip(acc.cur))).otherwise(acc.out)
            cur = F.when(over | (acc.cur == ""), s).otherwise(F.concat(acc.cur, F.lit(" "), s))
            cuts = F.greatest(F.lit(0), F.ceil((F.length(cur) - top) / target).cast("int"))
            pieces = F.when(cuts > 0, F.transform(F.sequence(F.lit(0), cuts - 1), lambda i: F.substring(cur, i * target + 1, F.lit(target)))).otherwise(F.expr(STRINGS))
            return F.struct(F.concat(out, pieces).alias("out"), F.substring(cur, cuts * target + 1, F.length(cur)).alias("cur"))

        end = lambda acc: F.when(T.blank(acc.cur), acc.out).otherwise(F.array_append(acc.out, T.strip(acc.cur)))
        return F.reduce(F.split(line, r"(?<=[.!?])\s+"), start, step, end)

    start = F.struct(F.expr(STRINGS).alias("out"), F.lit("").alias("cur"))
    pushed = lambda out, cur: F.when(T.blank(cur), out).otherwise(F.array_append(out, T.strip(cur)))

    def step(acc, line):
        long = F.length(line) > target
        over = (acc.cur != "") & (F.length(acc.cur) + F.length(line) + 1 > target)
        grown = F.when(acc.cur == "", line).otherwise(F.concat(acc.cur, F.lit("\n"), line))
        return (
            F.when(long, F.struct(F.concat(pushed(acc.out, acc.cur), sentences(line)).alias("out"), F.lit("").alias("cur")))
            .when(over, F.struct(pushed(acc.out, acc.cur).alias("out"), line.alias("cur")))
            .otherwise(F.struct(acc.out.alias("out"), grown.alias("cur")))
        )

    return F.reduce(T.lines(text), start, step, lambda acc: pushed(acc.out, acc.cur))


def corpus_chunks(sections: DataFrame, doc: str, title: str) -> DataFrame:
    """Search units of sections that already carry an anchor and a route."""
    rows = sections.select(doc, "anchor", "route", F.when(F.col("heading") == "", F.col(title)).otherwise(F.col("heading")).alias("heading"),
                           F.posexplode(chunk_pack(T.md_to_plain(F.col("text")))).alias("k", "chunk"))
    suffix = F.when(F.col("k") > 0, F.concat(F.lit(":"), F.col("k"))).otherwise("")
    return rows.where(~T.blank(F.col("chunk"))).select(
        F.concat(F.col(doc), F.lit("#"), "anchor", suffix).alias("id"), doc, "anchor", "route", "heading", F.col("chunk").alias("text"))


def toc_titles(docs: DataFrame, doc: str, body: str) -> DataFrame:
    """Contents-page lines, which stand in the first 120 lines, as a chapter table."""
    rows = docs.select(doc, F.posexplode(F.slice(T.lines(F.col(body)), 1, 120)).alias("line_no", "line"))
    chapter = r"^\s*(\d{1,2})\.\s+(.+?)\s*\.{3,}\s*\d+\s*$"
    annex = r"^\s*Annex ([A-F]):\s+(.+?)\s*\.{3,}\s*\d+\s*$"
    g = lambda p, i: F.regexp_extract("line", p, i)
    bare = T.strip(F.regexp_replace(g(chapter, 2), r"\s*\([A-Z]{1,2}\d+\s*-\s*\d+\)\s*$", ""))
    codes = F.regexp_extract(g(chapter, 2), r"\(([A-Z]{1,2})\d+\s*-\s*\d+\)", 1)
    is_chapter = F.col("line").rlike(chapter)
    return rows.where(is_chapter | F.col("line").rlike(annex)).select(
        doc, "line_no", g(chapter, 1).alias("num"), g(annex, 1).alias("annex"),
        F.when(is_chapter, bare).otherwise(T.strip(g(annex, 2))).alias("title"), codes.alias("codes"))


def footnote_sequence(numbers: Column) -> Column:
    """The numbers that count: above the last that counted, and at most twenty above."""
    start = F.struct(F.expr("cast(array() as array<int>)").alias("out"), F.lit(0).alias("last"))
    step = lambda acc, n: F.when(
        (n > acc.last) & (n <= acc.last + 20), F.struct(F.array_append(acc.out, n).alias("out"), n.alias("last"))).otherwise(acc)
    return F.reduce(numbers, start, step, lambda acc: acc.out)


MARKER = r"(?<=[a-z’”)])(?=\d{1,3}(?:[\s.,;:)’”]|$))"  # the place before a marker


def _markers(text: Column) -> Column:
    """Every marker of a block in order: its digits and the words before it, back to the last of ``,;:(``."""
    start = F.struct(F.expr("cast(array() as array<struct<digits:string,clause:string>>)").alias("out"), F.lit("").alias("clause"))

    def step(acc, x):
        out = F.when(x.i == 0, acc.out).otherwise(F.array_append(acc.out, F.struct(F.regexp_extract(x.part, r"^\d+", 0).alias("digits"), acc.clause.alias("clause"))))
        last = F.element_at(F.split(x.part, r"[,;:(]"), -1)
        return F.struct(out.alias("out"), F.when(x.part.rlike(r"[,;:(]"), last).otherwise(F.concat(acc.clause, x.part)).alias("clause"))

    parts = F.transform(F.split(text, MARKER), lambda p, i: F.struct(i.alias("i"), p.alias("part")))
    return F.reduce(parts, start, step, lambda acc: acc.out)


def _hangs_on(clause: Column) -> Column:
    """The last four words of a clause."""
    last = T.once(F.split(T.strip(clause), r"\s+"), lambda w: F.slice(w, F.greatest(F.lit(1), F.size(w) - 3), F.lit(4)))
    return F.regexp_replace(F.array_join(last, " "), r"[’”)]+$", "")


def footnote_attach(blocks: DataFrame, notes: DataFrame, doc: str) -> DataFrame:
    """Each footnote with the first block that carries its marker and the words it hangs on.

    A block is cut once at its markers, and the words before each go with it, so footnotes
    meet blocks on (document, number) and no block's text leaves its task.
    """
    marked = blocks.select(doc, "block_no", "at", "target", F.posexplode(_markers(F.col("text"))).alias("i", "m"))
    n = F.col("m.digits").cast("int")
    # A marker such as 07 names note 7, but the words are those before a plain 7.
    on = F.when(F.col("m.digits") == n.cast("string"), _hangs_on(F.col("m.clause")))
    first = marked.select(doc, n.alias("n"), F.struct("block_no", on.isNull().alias("odd"), "i").alias("o"), F.struct("block_no", "at", "target", on.alias("hangs_on")).alias("b"))
    first = first.groupBy(doc, "n").agg(F.min_by("b", "o").alias("b"))
    return first.join(notes.select(doc, "n"), [doc, "n"], "left_semi").select(doc, "n", "b.block_no", "b.at", "b.target", "b.hangs_on")


def heading_paths(sections: DataFrame, doc: str) -> DataFrame:
    """The open headings above each section; a lone document title is left out of the others' paths."""
    item = F.struct("section_no", "level", "heading")
    lists = sections.groupBy(doc).agg(F.sort_array(F.collect_list(item)).alias("s"))
    start = F.struct(F.expr("cast(array() as array<struct<level:int,heading:string>>)").alias("stack"),
                     F.expr("cast(array() as array<array<string>>)").alias("paths"))

    def step(acc, x):
        own = F.struct(x.level.alias("level"), x.heading.alias("heading"))
        stack = F.array_append(F.filter(acc.stack, lambda h: h.level < x.level), own)
        shown = F.when(x.level == 0, acc.stack).otherwise(stack)
        path = F.when(x.level == 0, F.expr(STRINGS)).otherwise(F.transform(stack, lambda h: h.heading))
        return F.struct(shown.alias("stack"), F.array_append(acc.paths, path).alias("paths"))

    folded = lists.withColumn("paths", F.reduce("s", start, step, lambda acc: acc.paths))
    titled = (F.col("s")[0].level == 1) & (F.size(F.filter("s", lambda x: x.level == 1)) == 1)
    rows = folded.select(doc, titled.alias("titled"), F.col("s")[0].heading.alias("title"),
                         F.posexplode(F.arrays_zip(F.col("s"), F.col("paths"))).alias("i", "z"))
    path = F.col("z.paths")
    drop = F.col("titled") & (F.col("i") > 0) & (F.size(path) > 0) & (F.get(path, F.lit(0)) == F.col("title"))
    path = F.when(drop, F.expr("slice(z.paths, 2, size(z.paths))")).otherwise(path)
    last3 = F.slice(path, F.greatest(F.lit(1), F.size(path) - 2), F.lit(3))
    return rows.select(doc, F.col("z.s.section_no").alias("section_no"), F.size(path).alias("depth"), F.when(
        F.size(path) == 0, "Opening text").otherwise(F.array_join(last3, " › ")).alias("locator"))


# Fixed value: the rule under a table's head.
TABLE_RULE = r"^\s*\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)*\|?\s*$"


def split_row(line: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(T.strip(line), r"^\|", ""), r"\|$", "")
    cells = F.transform(F.split(bare, r"(?<!\\)\|"), T.strip)
    # Most cells have no inline mark and need no more looking at.
    return F.transform(cells, lambda c: F.when(c.rlike(T.MARKS), T.strip(T.strip_inline(c))).otherwise(c))


def tables(docs: DataFrame, doc: str, body: str) -> DataFrame:
    """Pipe tables, one row each: (table_no, rows of (row_no, cells)); row 0 is the header, empty rows and the rule line are left out, and code and comments have none.

    A document is split into lines once; the fold over them keeps where tables start and end, no lines.
    """
    def look(lines):  # the next line is looked at only where a header may stand
        return F.transform(lines, lambda l, i: F.struct(
            i.alias("i"), l.contains("|").alias("piped"), F.regexp_extract(l, r"^\s*(```|~~~)", 1).alias("mark"),
            (l.contains("|") & F.coalesce(F.get(lines, i + 1), F.lit("")).rlike(TABLE_RULE)).alias("head")))

    start = F.struct(F.expr("cast(array() as array<struct<at:int,to:int>>)").alias("out"), F.lit(0).alias("mode"), F.lit(0).alias("at"), F.lit("").alias("fence"))

    def step(acc, x):  # modes: outside, at the rule, within a table, within code
        ended = F.when(acc.mode == 2, F.array_append(acc.out, F.struct(acc.at.alias("at"), x.i.alias("to")))).otherwise(acc.out)
        state = lambda o, m, at, fence: F.struct(o.alias("out"), F.lit(m).alias("mode"), at.alias("at"), fence.alias("fence"))
        return (
            F.when(acc.mode == 1, state(acc.out, 2, acc.at, acc.fence))
            .when(((acc.mode == 2) & x.piped) | ((acc.mode == 3) & (x.mark != acc.fence)), acc)
            .when((acc.mode != 3) & (x.mark != ""), state(ended, 3, acc.at, x.mark))
            .when((acc.mode != 3) & x["head"], state(ended, 1, x.i, acc.fence))
            .otherwise(state(ended, 0, acc.at, acc.fence))
        )

    def found(lines):
        end = lambda acc: F.when(acc.mode == 2, F.array_append(acc.out, F.struct(acc.at.alias("at"), F.size(lines).alias("to")))).otherwise(acc.out)
        return F.transform(F.reduce(look(lines), start, step, end), lambda t, k: F.struct((k + 1).alias("table_no"), rows(lines, t).alias("rows")))

    def rows(lines, t):
        kept = F.concat(F.slice(lines, t["at"] + 1, F.lit(1)), F.slice(lines, t["at"] + 3, t["to"] - t["at"] - 2))
        return F.filter(F.transform(kept, lambda l, r: F.struct(r.alias("row_no"), split_row(l).alias("cells"))), lambda x: F.exists(x.cells, lambda c: c != ""))

    lines = T.lines(F.regexp_replace(F.col(body), r"(?s)<!--.*?-->", ""))
    return docs.select(doc, F.inline(T.once(lines, found)))


def table_rows(docs: DataFrame, doc: str, body: str) -> DataFrame:
    """The rows of all pipe tables: (table_no, row_no, cells)."""
    return tables(docs, doc, body).select(doc, "table_no", F.inline("rows"))


def heading_level(line: Column) -> Column:
    """How a plain-text line ranks as a heading, 0 for none."""
    numbered = r"^(\d{1,2}(?:\.\d{1,2}){0,3})\.?\s+[A-Z]"
    letters = F.regexp_replace(line, r"[^A-Za-z]", "")
    words = F.split(line, r"\s+")
    long = F.filter(words, lambda w: F.length(w) > 3)
    capital = F.filter(long, lambda w: w.rlike("^[A-Z]"))
    return (
        F.when((F.length(line) > 120) | ~line.rlike("[A-Za-z]") | line.rlike(r"[.,;:]\z"), 0)
        .when(line.rlike(r"(?i)^(chapter|part|appendix|annex|schedule)\s+[A-Za-z0-9_]"), 1)
        .when(line.rlike(r"(?i)^(strategic\s+)?policy\s+[A-Z]{0,6}[\s/-]?\d"), 3)
        .when(line.rlike(numbered), F.least(F.lit(4), F.size(F.split(F.regexp_extract(line, numbered, 1), r"\."))))
        .when((F.length(letters) >= 4) & (letters == F.upper(letters)), 1)
        .when((F.size(words) <= 10) & line.rlike("^[A-Z]") & (F.size(long) > 0)
              & (F.size(capital) / F.size(long) >= 0.6), 2)
        .otherwise(0)
    )


def line_groups(flat: Column) -> Column:
    """The lines of a text as groups, each a text of its own."""
    lines = T.lines(flat)
    blanks = F.size(F.filter(lines, T.blank))
    per_line = (F.size(lines) > 20) & (blanks / F.size(lines) < 0.05)
    return F.when(per_line, lines).otherwise(F.split(flat, r"\n(?:[^\S\n]*\n)+"))


def paragraph_groups(text: Column) -> Column:
    """Groups of lines: one per line in a long text with hardly a blank line, else between blank lines."""
    groups = line_groups(F.regexp_replace(text, r"\r\n?", "\n"))
    joined = F.transform(groups, lambda g: T.strip(F.regexp_replace(g, r"\s*\n\s*", " ")))
    return F.filter(joined, lambda g: g != "")


def section_select(md: Column, keep: list[str], drop: str | None) -> Column:
    """The level-2 sections whose heading starts with a wanted word, without the level-3 parts that match."""
    wanted = lambda u: F.array_contains(F.transform(F.array(*[F.lit(k.lower()) for k in keep]), lambda k: F.lower(F.regexp_extract(u, r"^## ([^\n]*)", 1)).startswith(k)), True)
    kept = F.filter(F.split(md, r"\n(?=## )"), lambda u: u.rlike("^## ") & wanted(u))
    if drop:
        trim = lambda u: F.array_join(F.filter(
            F.split(u, r"\n(?=### )"), lambda s: ~(s.rlike("^### ") & F.regexp_extract(s, r"^### ([^\n]*)", 1).rlike(drop))), "\n")
        kept = F.transform(kept, trim)
    return F.array_join(kept, "\n")


def provision_slice(sections: DataFrame, wanted: DataFrame, doc: str) -> DataFrame:
    """Sections from one id to another, both included. `wanted` holds (document, from_id, to_id)."""
    known = sections.join(wanted, doc)
    bounds = known.groupBy(doc).agg(
        F.min(F.when(F.col("id") == F.col("from_id"), F.col("section_no"))).alias("a"),
        F.min(F.when(F.col("id") == F.col("to_id"), F.col("section_no"))).alias("b"))
    return sections.join(bounds, doc).where("section_no between a and b").drop("a", "b")


def absolute_links(md: Column, url: Column, site: str) -> Column:
    """Fragments the document does not have, and root-relative links, made absolute."""
    heads = F.regexp_extract_all(md, F.lit(r"(?m)^#{1,4}[^\S\n]+([^\n]+?)[^\S\n]*$"), F.lit(1))
    ids = F.transform(heads, lambda h: T.slug(F.replace(h, F.lit("\\."), F.lit("."))))
    parts = F.split(md, r"\]\(#")

    def join(p, i):
        frag = F.regexp_extract(p, r"^([^)\s]+)\)", 1)
        away = (frag != "") & ~F.array_contains(ids, frag)
        return F.when(i == 0, p).when(away, F.concat(F.lit("]("), url, F.lit("#"), p)).otherwise(F.concat(F.lit("](#"), p))

    return F.regexp_replace(F.array_join(F.transform(parts, join), ""), r"\]\(/(?!/)", "](" + site + "/")


def heading_outline(sections: DataFrame, doc: str, budget: int = 4000) -> DataFrame:
    """Headings indented by level until the budget is spent, then an ellipsis."""
    line = F.concat(F.repeat(F.lit("  "), F.greatest(F.lit(0), F.least(F.lit(4), F.col("level")) - 1)), F.col("heading"))
    lists = sections.where("heading <> ''").groupBy(doc).agg(
        F.sort_array(F.collect_list(F.struct("section_no", line.alias("line")))).alias("s"))
    start = F.struct(F.expr(STRINGS).alias("out"), F.lit(0).alias("used"), F.lit(False).alias("stop"))

    def step(acc, x):
        over = acc.used + F.length(x.line) > budget
        return F.when(acc.stop, acc).when(over, F.struct(F.array_append(acc.out, F.lit("…")).alias("out"), acc.used.alias("used"), F.lit(True).alias("stop"))).otherwise(
            F.struct(F.array_append(acc.out, x.line).alias("out"), (acc.used + F.length(x.line) + 1).alias("used"), F.lit(False).alias("stop")))

    return lists.select(doc, F.reduce("s", start, step, lambda acc: F.array_join(acc.out, "\n")).alias("outline"))


def summary(text: Column, ext: Column) -> Column:
    """What a file says of itself: its first comment, or its first line of prose."""
    comment = F.regexp_extract(text, r"^(?://[^\n]*\n)+", 0)
    flat = T.squash(F.regexp_replace(comment, r"(?m)^// ?", ""))
    code = F.substring(F.array_join(F.slice(F.split(flat, r"(?<=\.)\s"), 1, 2), " "), 1, 260)
    prose = F.filter(T.lines(text), lambda l: ~T.blank(l) & ~l.startswith("#"))
    return F.when(ext == "md", F.coalesce(F.substring(F.get(prose, F.lit(0)), 1, 200), F.lit(""))).otherwise(code)
