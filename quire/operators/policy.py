"""Policy text, as extracted from a printed page, to chapters, policies, paragraphs, items and footnotes.

Lines are classed by their own form first. What a line means beyond that depends
on the lines before it in its document, which windows over the document's lines
supply: the chapter it stands in, whether a footnote is open, whether a page has
turned since, and which block is open. A document is bounded by admission.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators.structuring import footnote_attach, toc_titles
from quire.session import written

# The forms a line can have.
POLICY = r"^([A-Z]{1,2}\d{1,2}):\s+(.+)$"
FOOTNOTE = r"^(\d{1,3})(?: |(?=[A-Z‘“]))(\S.*)$"
PARA = r"^(\d{1,3})\.\s+(.+)$"
LETTER = r"^([a-z])\.\s+(.+)$"
ROMAN = r"^(i|ii|iii|iv|v|vi|vii|viii|ix|x|xi|xii)\.\s+(.+)$"
BULLET = r"^•\s+(.+)$"
TERM = r"^([A-Z][^:]{2,70}):\s+(.+)$"
SUBHEADING = r"^[A-Z][A-Za-z ,'’()\-]{3,80}$"
GAPS, ENDS = "\t\n\u000b\f\r", "\u0085\u2028\u2029"  # white space but for the space, and what else can end a line
AFTER_SUBHEADING = r"^(\s*\d{1,3}\.\s|\s*[A-Z]{1,2}\d{1,2}:\s|\s*[A-Z][a-z])"


def _any(test, chars: str) -> Column:
    return reduce(or_, [test(F.lit(x)) for x in chars])


def _tight(c: Column) -> Column:
    """squash() of a column; most lines are so already, and to see that no pattern is needed."""
    odd = c.contains("  ") | c.startswith(" ") | c.endswith(" ") | _any(c.contains, GAPS + ENDS)
    return F.when(odd, T.squash(c)).otherwise(c)


def _is(c: Column, pattern: str, opening: str) -> Column:
    """Whether a line has a form; of most lines the first letters tell that they have not, and the rest is not read."""
    return F.left(c, F.lit(12)).rlike(opening) & c.rlike(pattern)


def _lines(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """Lines that are not blank, from where the body starts; of what follows each, only what is asked of it: the line below a chapter's, and whether the next may stand after a heading."""
    def body(lines):
        intro = F.transform(lines, lambda l, i: (i > 60) & l.rlike(r"^\s*1\.\s+Introduction\s*$"))
        below = lambda l, i: F.when(l.rlike(r"^\s*(\d{1,2}\.|Annex [A-F]:)\s"), F.coalesce(F.get(lines, i + 1), F.lit(""))).otherwise("")
        rows = F.transform(lines, lambda l, i: F.struct(i.alias("no"), l.alias("raw"), below(l, i).alias("below")))
        said = T.once(F.greatest(F.array_position(intro, True) - 1, F.lit(0)), lambda begins: F.filter(rows, lambda x: (x.no >= begins) & ~T.blank(x.raw)))
        after = lambda x, k, all_: F.coalesce(F.get(all_, k + 1).raw.rlike(AFTER_SUBHEADING), F.lit(False))
        return T.once(said, lambda all_: F.transform(all_, lambda x, k: F.struct(x.no.alias("no"), x.raw.alias("raw"), x.below.alias("below"), after(x, k, all_).alias("leads"))))

    rows = docs.select(doc, F.inline(T.once(T.lines(F.replace(F.col(text), F.lit("\f"), F.lit("\n"))), body)))
    raw = F.col("raw")
    loose = _any(raw.endswith, " " + GAPS) | _any(raw.contains, ENDS)
    rows = rows.select(doc, "no", "below", "leads", F.when(loose, F.regexp_replace(raw, r"\s+$", "")).otherwise(raw).alias("flush"))
    line = F.ltrim("flush", F.lit(" " + GAPS))
    return rows.withColumn("line", line).withColumn("indented", F.col("flush") != F.col("line"))


def _chapters(rows: DataFrame, titles: DataFrame, doc: str) -> DataFrame:
    """Adds the chapter each line stands in; a heading may be wrapped over two lines."""
    named = F.when(F.col("annex") != "", F.concat(F.lit("Annex "), "annex", F.lit(": "), "title")).otherwise(F.concat("num", F.lit(". "), "title"))
    # A document's contents list is short: one map per document, joined where its lines already are.
    heads = titles.select(doc, F.struct(named.alias("key"), F.struct("num", "annex").alias("value")).alias("e")).distinct()
    heads = heads.groupBy(doc).agg(F.map_from_entries(F.collect_list("e")).alias("_heads"))
    pair = T.squash(F.concat_ws(" ", "line", F.trim("below")))
    hit = rows.withColumn("pair", F.when(F.left("line", F.lit(10)).rlike(r"^(\d{1,2}\.|Annex [A-F]:)\s"), pair).otherwise("")).join(heads, doc, "left")
    hit = hit.withColumn("_h", F.try_element_at("_heads", F.col("line"))).withColumn("_h2", F.try_element_at("_heads", F.col("pair")))
    hit = hit.withColumns({"_num": F.col("_h.num"), "_annex": F.col("_h.annex"), "_num2": F.col("_h2.num"), "_annex2": F.col("_h2.annex")})
    last_annex = F.coalesce(F.exists(F.map_values("_heads"), lambda v: v.annex == "F"), F.lit(False))
    hit = hit.withColumn("_is", F.when(F.col("_h").isNotNull(), True)).withColumn("_is2", F.when(F.col("_h2").isNotNull(), True)).withColumn("_lists_f", last_annex).drop("_h", "_h2", "_heads")
    w = Window.partitionBy(doc).orderBy("no")
    two = F.col("_is").isNull() & F.col("_is2").isNotNull()
    hit = hit.withColumn("starts", F.col("_is").isNotNull() | F.col("_is2").isNotNull()).withColumn("_two", two)
    hit = hit.withColumn("_skip", F.lag("_two", 1, False).over(w)).where(~F.col("_skip"))
    hit = hit.withColumn("_annex", F.coalesce("_annex", "_annex2", F.lit(""))).withColumn("_num", F.coalesce("_num", "_num2", F.lit("")))
    # The last annex, if the contents list it, has no heading of its own: its first table marks it.
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.last(F.when(F.col("starts"), F.col("_annex")), True).over(past)
    hit = hit.withColumn("_table", ~F.col("starts") & F.col("_lists_f") & (inside == "E") & F.col("line").rlike("(?i)^Table 1: Flood zones"))
    hit = hit.withColumn("_since", F.last(F.when(F.col("starts"), F.col("no")), True).over(w))
    first = F.row_number().over(Window.partitionBy(doc, "_since", "_table").orderBy("no")) == 1
    hit = hit.withColumn("_f", F.col("_table") & first).withColumn("starts", F.col("starts") | F.col("_f"))
    hit = hit.withColumn("_annex", F.when(F.col("_f"), "F").otherwise(F.col("_annex")))
    ident = F.when(F.col("_annex") != "", F.concat(F.lit("annex-"), F.lower("_annex"))).otherwise(F.concat(F.lit("ch-"), "_num"))
    hit = hit.withColumn("chapter", F.last(F.when(F.col("starts"), F.struct(F.col("no").alias("at"), ident.alias("id"), F.col("_annex").alias("annex"), F.col("line").alias("heading"))), True).over(w))
    return hit.where("chapter is not null").select(doc, "no", "line", "flush", "indented", "leads", "starts", "chapter")


def blocks(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(document, chapter, block_no, type, marker, text, policy) in reading order; block_no is the block's first line."""
    rows = _chapters(_lines(docs, doc, text), toc_titles(docs, doc, text), doc)
    w = Window.partitionBy(doc).orderBy("no")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    line, flush, level0 = F.col("line"), F.col("flush"), ~F.col("indented")
    letter_, roman_, bullet_ = _is(line, LETTER, r"^[a-z]\."), _is(line, ROMAN, r"^[ivx]{1,4}\."), _is(line, BULLET, "^•")
    is_page = (F.length("line") <= 5) & flush.rlike(r"^\s*\d{1,3}\s*$")
    is_policy = level0 & _is(line, POLICY, r"^[A-Z]{1,2}\d")
    noted = _is(flush, FOOTNOTE, r"^\d") & ~F.left("flush", F.lit(12)).rlike(r"^\d{1,3}\. ") & ~is_policy & ~is_page & ~F.col("starts")
    rows = rows.withColumn("page", is_page & ~F.col("starts")).withColumn("_fn", F.when(noted, F.regexp_extract("flush", FOOTNOTE, 1).cast("int")))

    # A footnote's number counts only in sequence through the whole document. Numbers and lines are read apart, so all above is worked out once and written.
    rows = written(rows, "lines")
    cand = rows.where("_fn is not null").groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("no", "_fn"))).alias("c"))
    start = F.struct(F.expr("cast(array() as array<int>)").alias("out"), F.lit(0).alias("last"))
    step = lambda a, x: F.when((x["_fn"] > a.last) & (x["_fn"] <= a.last + 20), F.struct(F.array_append(a.out, x.no).alias("out"), x["_fn"].alias("last"))).otherwise(a)
    good = cand.select(doc, F.reduce("c", start, step, lambda a: a.out).alias("_good"))
    rows = rows.join(good, doc, "left").withColumn("foot", F.coalesce(F.array_contains("_good", F.col("no")), F.lit(False))).drop("_good")

    annex = F.col("chapter.annex")
    sub = level0 & ~annex.isin("C", "E", "F") & (F.length("line") <= 90) & line.rlike(SUBHEADING) & ~line.endswith(".") & F.col("leads")
    own = (F.when(F.col("starts"), "chapter").when(F.col("page"), "page").when(is_policy, "policy").when(F.col("foot"), "footnote")
           .when(level0 & _is(flush, PARA, r"^\d{1,3}\."), "para").when(level0 & (annex == "B") & line.rlike(TERM) & ~letter_ & ~bullet_, "dl")
           .when(level0 & line.startswith("Step ") & line.rlike(r"^Step \d+:") & ~(annex == "B"), "h3").when(sub & ~letter_, "h3"))
    rows = rows.withColumn("form", own).withColumn("itemish", F.col("form").isNull() & (letter_ | roman_ | bullet_))

    # Inside a footnote until its page turns; the first indented line after that leaves it.
    turning = ["chapter", "policy", "footnote", "para", "dl", "h3"]
    rows = rows.withColumn("reg", F.last(F.when(F.col("form").isin(turning) | (F.col("itemish") & level0), F.col("no")), True).over(w))
    rows = rows.withColumn("_infoot", F.first("form").over(Window.partitionBy(doc, "reg").orderBy("no")) == "footnote")
    r = Window.partitionBy(doc, "reg")
    rows = rows.withColumn("_p", F.min(F.when(F.col("page"), F.col("no"))).over(r))
    rows = rows.withColumn("_l", F.min(F.when(F.col("indented") & ~F.col("page") & (F.col("no") > F.col("_p")), F.col("no"))).over(r))
    held = F.col("_infoot") & F.col("form").isNull() & (F.col("_l").isNull() | (F.col("no") < F.col("_l")))
    rows = rows.withColumn("held", held).withColumn("back", F.col("_infoot") & (F.col("no") == F.col("_l")) & ~F.col("itemish"))
    rows = rows.where(~F.col("page"))

    # "i.", "v." and "x." are letters only straight after h, u and w.
    candidate = F.col("itemish") & ~F.col("held") & letter_
    rows = rows.withColumn("_c", F.when(candidate, F.left("line", F.lit(1))))
    plain = F.col("_c").isNotNull() & ~F.col("_c").isin("i", "v", "x")
    rows = rows.withColumn("_reset", F.last(F.when(F.col("form").isin("chapter", "policy", "para"), F.col("no")), True).over(w))
    rows = rows.withColumn("_seen", F.last(F.when(plain, F.struct("no", "_c", "_reset")), True).over(w))
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(doc, "_seen.no", "_c").orderBy("no")))
    follows = F.col("_seen._reset").eqNullSafe(F.col("_reset")) & (F.ascii("_c") == F.ascii("_seen._c") + 1) & (F.col("_nth") == 1)
    letter = F.col("_c").isNotNull() & (plain | F.coalesce(follows, F.lit(False)))
    form = (F.when(F.col("form").isNotNull(), F.col("form")).when(F.col("held"), "more").when(F.col("back"), "back")
            .when(letter, "item1").when(F.col("itemish") & roman_, "item2").when(F.col("itemish") & bullet_, "bullet").otherwise("more"))
    rows = rows.withColumn("form", form)

    # A line with no block open before it opens one: an objective under a chapter heading, else a paragraph.
    opens = ["footnote", "para", "dl", "item1", "item2", "bullet"]
    mark = F.last(F.when(F.col("form").isin("chapter", "policy", "h3"), F.col("no")), True).over(past)
    last_open = F.last(F.when(F.col("form").isin(opens + ["back"]), F.col("no")), True).over(past)
    rows = rows.withColumn("_mark", mark).withColumn("_closed", last_open.isNull() | (last_open < mark))
    first = F.row_number().over(Window.partitionBy(doc, "_mark", "form", "_closed").orderBy("no")) == 1
    bare = (F.col("form") == "more") & F.col("_closed") & first
    under = F.col("_mark") == F.col("chapter.at")
    rows = rows.withColumn("form", F.when(bare & under & F.col("indented"), "objective").when(bare, "loose").otherwise(F.col("form")))

    body = ["para", "dl", "item1", "item2", "bullet", "objective", "loose"]
    rows = rows.withColumn("_body", F.last(F.when(F.col("form").isin(body), F.struct("no", F.col("chapter.at").alias("ch"))), True).over(past))
    resumed = F.when(F.col("_body.ch") == F.col("chapter.at"), F.col("_body.no"))
    opened = F.when(F.col("form").isin(opens + ["objective", "loose", "policy", "h3"]), F.col("no")).when(F.col("form") == "back", resumed)
    rows = rows.withColumn("block_no", F.last(opened, True).over(w)).where("form <> 'chapter'")
    rows = rows.withColumn("policy", F.last(F.when(F.col("form") == "policy", F.struct(F.regexp_extract("line", POLICY, 1).alias("code"), F.regexp_extract("line", POLICY, 2).alias("title"), F.col("chapter.at").alias("ch"))), True).over(w))

    said = (F.when(F.col("form") == "policy", F.regexp_extract("line", POLICY, 2)).when(F.col("form") == "footnote", F.regexp_extract("flush", FOOTNOTE, 2))
            .when(F.col("form") == "para", F.regexp_extract("line", PARA, 2)).when(F.col("form") == "item1", F.regexp_extract("line", LETTER, 2))
            .when(F.col("form") == "item2", F.regexp_extract("line", ROMAN, 2)).when(F.col("form") == "bullet", F.regexp_extract("line", BULLET, 1))
            .when(F.col("form") == "dl", F.regexp_extract("line", TERM, 2)).otherwise(line))
    marker = (F.when(F.col("form") == "policy", F.regexp_extract("line", POLICY, 1)).when(F.col("form") == "footnote", F.regexp_extract("flush", FOOTNOTE, 1))
              .when(F.col("form") == "para", F.regexp_extract("line", PARA, 1)).when(F.col("form") == "item1", F.left("line", F.lit(1)))
              .when(F.col("form") == "item2", F.regexp_extract("line", ROMAN, 1)).when(F.col("form") == "dl", F.regexp_extract("line", TERM, 1)).otherwise(""))
    item = F.struct("no", "form", marker.alias("marker"), "policy", "chapter")
    rows = rows.withColumn("_said", said)
    grouped = rows.groupBy(doc, "block_no").agg(F.sort_array(F.collect_list(F.struct("no", _tight(F.col("_said")).alias("t")))).alias("l"), F.min_by(item, "no").alias("h"))
    step = lambda a, x: F.when(a == "", x.t).when(a.endswith("-") & x.t.rlike("^[a-z]"), F.concat(a, x.t)).otherwise(F.concat(a, F.lit(" "), x.t))
    joined = F.regexp_replace(F.reduce("l", F.lit(""), step), r"(\w)- (\w)", "$1-$2")
    kind = F.when(F.col("h.form") == "loose", "para").otherwise(F.col("h.form"))
    same = F.col("h.policy.ch") == F.col("h.chapter.at")
    return grouped.select(
        doc, F.col("h.chapter.id").alias("chapter"), F.col("h.chapter.heading").alias("chapter_heading"), "block_no", kind.alias("type"), F.col("h.marker").alias("marker"),
        joined.alias("text"), F.when(same, F.col("h.policy.code")).alias("policy"), F.when(same, F.col("h.policy.title")).alias("policy_title"))


def placed(found: DataFrame, doc: str) -> DataFrame:
    """Adds to body blocks where they stand: 'PM2(1)(b)' and the anchor of their paragraph."""
    w = Window.partitionBy(doc, "chapter").orderBy("block_no")
    rows = found.where("type <> 'footnote'")
    rows = rows.withColumn("_pol", F.last(F.when(F.col("type") == "policy", F.col("block_no")), True).over(w))
    v = Window.partitionBy(doc, "chapter", "_pol").orderBy("block_no")
    numbered = (F.col("type") == "para") & (F.col("marker") != "")
    rows = rows.withColumn("_para", F.last(F.when(numbered, F.struct("block_no", "marker")), True).over(v))
    u = Window.partitionBy(doc, "chapter", "_pol", "_para.block_no").orderBy("block_no")
    rows = rows.withColumn("_one", F.last(F.when(F.col("type") == "item1", F.struct("block_no", "marker")), True).over(u))
    x = Window.partitionBy(doc, "chapter", "_pol", "_para.block_no", "_one.block_no").orderBy("block_no")
    rows = rows.withColumn("_two", F.last(F.when(F.col("type") == "item2", F.col("marker")), True).over(x))
    bracket = lambda c: F.when(c.isNotNull(), F.concat(F.lit("("), c, F.lit(")"))).otherwise("")
    para = F.col("_para.marker")
    at = F.when(F.col("policy").isNotNull(), F.concat("policy", bracket(para), bracket(F.col("_one.marker")), bracket(F.col("_two"))))
    base = F.coalesce("policy", "chapter")
    target = F.when(para.isNotNull(), F.concat(base, F.lit("-"), para)).otherwise(base)
    return rows.withColumn("at", F.coalesce(at, F.lit(""))).withColumn("target", target).drop("_pol", "_para", "_one", "_two")


def footnotes(found: DataFrame, doc: str) -> DataFrame:
    """Footnotes with the block that carries their marker, where there is one in their chapter."""
    key = [doc, "chapter"]
    notes = found.where("type = 'footnote'").select(*key, F.col("marker").cast("int").alias("n"), "text", "chapter_heading")
    body = placed(found, doc).where("type not in ('policy', 'h3')").withColumn("k", F.struct(*key))
    hung = footnote_attach(body.select("k", "block_no", "at", "target", "text"), notes.select(F.struct(*key).alias("k"), "n"), "k")
    where = body.select("k", "block_no", "policy", "policy_title")
    hung = hung.join(where, ["k", "block_no"]).select(F.col(f"k.{doc}").alias(doc), F.col("k.chapter").alias("chapter"), "n", "at", "target", "hangs_on", "policy", "policy_title")
    return notes.join(hung, [*key, "n"], "left")


def chunks(found: DataFrame, doc: str) -> DataFrame:
    """One chunk per policy or heading, then one per footnote with its policy in the heading."""
    found = written(found, "blocks")  # read four times below
    w = Window.partitionBy(doc, "chapter").orderBy("block_no")
    body = found.where("type <> 'footnote'").withColumn("scope", F.last(F.when(F.col("type").isin("policy", "h3"), F.struct(
        "block_no", F.when(F.col("type") == "policy", F.col("marker")).otherwise(T.slug(F.col("text"))).alias("anchor"),
        F.when(F.col("type") == "policy", F.concat("marker", F.lit(": "), "text")).otherwise(F.col("text")).alias("name"))), True).over(w))
    dot = F.when(F.col("marker") != "", F.concat("marker", F.lit(". "), "text")).otherwise(F.col("text"))
    part = (F.when(F.col("type").isin("para", "item1", "item2"), dot).when(F.col("type") == "bullet", F.concat(F.lit("• "), "text"))
            .when(F.col("type") == "dl", F.concat("marker", F.lit(": "), "text")).otherwise(F.col("text")))
    rows = body.where("type not in ('policy', 'h3')").groupBy(doc, "chapter", "chapter_heading", "scope").agg(
        F.sort_array(F.collect_list(F.struct("block_no", part.alias("t")))).alias("l"))
    heading = F.concat("chapter_heading", F.coalesce(F.concat(F.lit(" › "), "scope.name"), F.lit("")))
    text = rows.select(doc, "chapter", F.coalesce("scope.anchor", "chapter").alias("anchor"), heading.alias("heading"), F.array_join("l.t", "\n").alias("text"))
    f = footnotes(found, doc)
    on = F.when(F.coalesce("hangs_on", F.lit("")) != "", F.col("hangs_on"))
    own = F.concat("chapter_heading", F.lit(" › "), F.coalesce(F.concat("policy", F.lit(": "), "policy_title", F.lit(" › ")), F.lit("")), F.lit("footnote "), "n",
                   F.coalesce(F.concat(F.lit(" on “"), on, F.lit("”")), F.lit("")))
    said = F.concat(F.lit("Footnote "), "n", F.when(F.coalesce("at", F.lit("")) != "", F.concat(F.lit(" to policy "), "at")).otherwise(""),
                    F.coalesce(F.concat(F.lit(", on “"), on, F.lit("”")), F.lit("")), F.lit(": "), "text")
    return text.unionByName(f.select(doc, "chapter", F.concat(F.lit("fn-"), "n").alias("anchor"), own.alias("heading"), said.alias("text")))
