"""Policies, site allocations and numbered outcomes in sections and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import fixed
from quire.functions import text as T
from quire.operators.ranking import top_k

# How headings name a policy, an allocation or an outcome.
CODE = r"([A-Z]{1,6}(?:[/.-]?[A-Z]{1,6})?[\s/.-]?\d{1,3}[a-z]?)"
PREFIX = r"(?:(?:Strategic|STRATEGIC|Draft|DRAFT|Proposed|PROPOSED|Development [Mm]anagement|Local|LOCAL)\s+)?"
KIND = r"(Policy|POLICY|Policies|Site [Aa]llocation|SITE ALLOCATION|Allocation|ALLOCATION|Site|SITE)"
POLICY_HEADING = rf"^{PREFIX}{KIND}\s+{CODE}(?![\w/])\s*[:.)–—-]?\s*(.*)$"
CODE_FIRST = rf"^{CODE}\s*[:–—-]\s+(\S.*)$"
LAND_WORDS = (
    r"land\s+(?:at|to|off|of|by|near|behind|between|adjacent|adjoining|north|south|east|west|rear)|site|sites|farm|quarter|"
    r"garden village|urban extension|village extension|depot|maltings|works|yard|former|barracks|airfield|mill|wharf|"
    r"business park extension|employment area|brickworks|hospital site"
)
ALLOCATION_WORDS = r"site (?:area|reference|capacity|requirements?)|allocated for"
REF_COLUMN = r"(?i)^(site\s*)?ref(erence)?\.?(\s*(no|number|code))?$|^site\s*(id|code)$|^allocation(\s*(ref|reference|code))?$"
NAME_COLUMN = "site|name|location|address"
OUTCOME = r"(?i)^(?:measurable\s+)?outcome\s*(\d{1,2})(?![A-Za-z0-9_])|^MO\s?(\d{1,2})(?![A-Za-z0-9_])|^O(\d{1,2})\s*[:.]"


def word(pattern: str) -> str:
    """A whole-word, case-blind pattern with ASCII word edges."""
    return rf"(?i)(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


def names_policy(heading: Column) -> Column:
    return heading.rlike(POLICY_HEADING) | heading.rlike(CODE_FIRST)


def block_scope(sections: DataFrame, doc: str, wanted: Column | None = None) -> DataFrame:
    """Sections (those `wanted` by their heading) with the deeper ones under them: (section_no, members, heading, block).

    The block ends before the next section of the same or a higher level, or the
    next policy heading. Ends come from a document's levels alone; texts then join
    the blocks they belong to, at most once for each level above them.
    """
    want = F.lit(True) if wanted is None else wanted
    item = F.struct("section_no", "level", names_policy(F.col("heading")).alias("own"), want.alias("want"))
    lists = sections.groupBy(doc).agg(F.sort_array(F.collect_list(item)).alias("s"))
    rest = lambda i: F.slice("s", i + 2, F.size("s"))
    stop = lambda x, i: F.array_position(F.transform(rest(i), lambda n: (n.level <= x.level) | n.own), True)
    inner = lambda x, i: F.when(stop(x, i) == 0, rest(i)).otherwise(F.slice(rest(i), F.lit(1), (stop(x, i) - 1).cast("int")))
    scopes = F.transform("s", lambda x, i: F.struct(x.section_no.alias("top"), x.want.alias("want"), F.concat(F.array(x.section_no), inner(x, i).section_no).alias("parts")))
    rows = lists.select(doc, F.explode(F.filter(scopes, lambda x: x.want)).alias("e")).select(doc, F.col("e.top").alias("top"), F.explode("e.parts").alias("section_no"))
    parts = rows.join(sections.select(doc, "section_no", "heading", "text"), [doc, "section_no"])
    own = F.col("section_no") == F.col("top")
    words = F.struct("section_no", F.when(own, F.col("text")).otherwise(F.concat_ws("\n", "heading", "text")).alias("t"))
    blocks = parts.groupBy(doc, "top").agg(F.count("*").alias("members"), F.max(F.when(own, F.col("heading"))).alias("heading"), F.sort_array(F.collect_list(words)).alias("l"))
    return blocks.select(doc, F.col("top").alias("section_no"), "members", "heading", T.strip(F.array_join("l.t", "\n")).alias("block"))


def detect_policies(sections: DataFrame, doc: str) -> DataFrame:
    """One row per code, at its first heading: code, title and whether it is a policy or an allocation."""
    h = F.col("heading")
    g = lambda p, i: F.regexp_extract(h, p, i)
    first = h.rlike(POLICY_HEADING)
    kind = F.when(first, g(POLICY_HEADING, 1)).otherwise("")
    code = F.when(first, g(POLICY_HEADING, 2)).otherwise(g(CODE_FIRST, 1))
    title = F.when(first, g(POLICY_HEADING, 3)).otherwise(g(CODE_FIRST, 2))
    rows = block_scope(sections, doc, (code != "") & ~kind.rlike("(?i)^policies$")).select(
        doc, "section_no", "members", "block", code.alias("raw"), kind.alias("kind"),
        T.strip(F.regexp_replace(title, r"^[:–—-]\s*", "")).alias("title"), T.normalise_code(code).alias("key"))
    land = F.col("title").rlike(word(LAND_WORDS)) | F.col("block").rlike(word(ALLOCATION_WORDS))
    is_site = F.col("kind").rlike("(?i)site|allocation") | land
    rows = rows.select(doc, "key", F.struct(
        "section_no", F.regexp_replace("raw", r"\s+", "").alias("code"), "title", "members",
        F.when(is_site, "allocation").otherwise("policy").alias("entity")).alias("e"))
    best = rows.groupBy(doc, "key").agg(F.min_by("e", "e.section_no").alias("e"))
    return best.select(doc, "key", "e.*")


def table_allocations(tables: DataFrame, doc: str) -> DataFrame:
    """Rows of tables (of structuring.tables) that have a reference column and a name column."""
    top = F.get("rows", F.lit(0))
    heads = tables.select(doc, "table_no", "rows", F.when(top.row_no == 0, top.cells).alias("head"))
    at = lambda test: F.array_position(F.transform("head", test), True).cast("int")
    heads = heads.withColumn("ref_at", at(lambda c: F.trim(c).rlike(REF_COLUMN)))
    heads = heads.withColumn("name_at", at(lambda c, i: c.rlike(word(NAME_COLUMN)) & (i + 1 != F.col("ref_at"))))
    body = heads.where("ref_at > 0 and name_at > 0").select(doc, "table_no", "ref_at", "name_at", F.inline("rows")).where("row_no > 0")
    found = body.select(doc, "table_no", "row_no", T.strip(F.coalesce(F.get("cells", F.col("ref_at") - 1), F.lit(""))).alias("ref"),
                        T.strip(F.coalesce(F.get("cells", F.col("name_at") - 1), F.lit(""))).alias("name"))
    return found.where((F.col("ref") != "") & (F.length("ref") <= 20) & F.col("ref").rlike(r"\d"))


def merge_allocations(headed: DataFrame, listed: DataFrame, doc: str) -> DataFrame:
    """Allocations from headings and schedules as one numbered list per document.

    `headed` is the output of detect_policies; `listed` holds (document, ref, name,
    place). A row whose code is a policy is left out, one whose code is an
    allocation is attached to it, and any other becomes a new allocation.
    """
    rows = listed.withColumn("key", T.normalise_code(F.col("ref"))).groupBy(doc, "key").agg(
        F.min_by(F.struct("ref", "name"), "place").alias("r"), F.min("place").alias("place"), F.count("*").alias("n"))
    both = headed.join(rows, [doc, "key"], "full").where("entity is null or entity = 'allocation'")
    merged = both.select(
        doc, F.coalesce("code", "r.ref").alias("code"), F.coalesce("title", "r.name").alias("title"),
        F.coalesce("n", F.lit(0)).alias("table_rows"), F.least(F.col("section_no").cast("double"), "place").alias("place"))
    w = Window.partitionBy(doc).orderBy("place", "code")
    return merged.withColumn("id", F.concat(F.lit("S"), F.row_number().over(w)))


def detect_outcomes(sections: DataFrame, doc: str) -> DataFrame:
    """The first line that gives each numbered outcome."""
    lines = F.concat(F.array("heading"), T.lines(F.col("text")))
    rows = sections.select(doc, "section_no", F.posexplode(lines).alias("i", "line")).where(F.col("line").rlike(OUTCOME))
    n = F.coalesce(*[F.expr(f"nullif(regexp_extract(line, r'{OUTCOME}', {i}), '')") for i in (1, 2, 3)]).cast("int")
    text = F.substring(F.element_at(F.split("line", r" \| "), 1), 1, 300)
    best = rows.select(doc, n.alias("n"), F.struct("section_no", "i", text.alias("text")).alias("e"))
    return best.groupBy(doc, "n").agg(F.min_by("e", "e").alias("e")).select(doc, "n", "e.section_no", "e.text")


def accept_suggestions(suggested: DataFrame, sections: DataFrame, keys: list[str], group: list[str], order: list[Column]) -> DataFrame:
    """Suggested sections that exist, the first eighty of each kind."""
    return top_k(suggested.join(sections, keys, "left_semi"), group, order, fixed.MAX_SUGGESTIONS)


def focus_sections(sections: DataFrame, outcomes: DataFrame, doc: str, most: int = 4) -> DataFrame:
    """(document, focus, section_no): the first sections about the vision and monitoring, and those of the lowest outcomes in order of number."""
    h = F.col("heading")
    tagged = sections.select(doc, "section_no", F.explode(F.array_compact(F.array(
        F.when(h.rlike(word("vision")), F.lit("vision")), F.when(h.rlike("(?i)monitor"), F.lit("monitoring"))))).alias("focus"))
    marked = outcomes.groupBy(doc, "section_no").agg(F.min("n").alias("_n")).withColumn("focus", F.lit("outcomes"))
    both = tagged.withColumn("_n", F.lit(0)).unionByName(marked)
    return top_k(both, [doc, "focus"], [F.asc("_n"), F.asc("section_no")], most, "place").drop("_n")


def cap_entities(entities: DataFrame, group: list[str], order: Column, most: int) -> DataFrame:
    """Adds `checked`: whether a row is among the first of its group.

    Only the last place that counts is looked up per group, so a group of any
    size is never sorted whole. Ties in `order` go by the other columns; rows that
    are alike in all of them share their answer.
    """
    named = F.struct(*[F.col(c).alias(f"g{i}") for i, c in enumerate(group)])  # never null, so rows of a null group meet their own
    rows = entities.withColumns({"_o": F.struct(order.alias("o"), *[F.col(c) for c in entities.columns]), "_g": named})
    last = top_k(rows, ["_g"], [F.asc("_o")], most, "_r").groupBy("_g").agg(F.max("_o").alias("_last"))
    return rows.join(last, "_g").withColumn("checked", F.col("_o") <= F.col("_last")).drop("_o", "_last", "_g")
