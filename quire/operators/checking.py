"""Recorded answers to findings: validation, rules, coverage and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import fixed
from quire.functions import status as ST
from quire.functions import text as T
from quire.operators.ranking import top_k
from quire.operators.scale import numbered

# What a rubric item may say.
ASSESS = ["model", "rule", "derived", "officer"]
RELATIONS = ["repeats", "contradicts"]


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def violations(df: DataFrame, key: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """(key, problem) for every rule a row breaks, in one pass over the rows."""
    said = F.array_compact(F.array(*[F.when(broken, F.lit(problem)) for problem, broken in rules]))
    return df.select(key, F.explode(said).alias("problem"))


def rubric_problems(items: DataFrame, key: str, sources: DataFrame) -> DataFrame:
    """Every way rubric items (id, assess, title, requirement, cites, source, derive_from) are unsound."""
    own = violations(items, key, [
        ("unknown assess", ~F.col("assess").isin(ASSESS)),
        ("needs a title and a requirement", F.col("title").isNull() | F.col("requirement").isNull()),
        ("cites nothing", F.col("cites") == 0),
    ])
    first = items.groupBy("id").agg(F.min(key).alias("_first"))
    repeated = items.join(first, "id").where(F.col(key) > F.col("_first")).select(key, F.lit("duplicate id").alias("problem"))
    stray = items.join(sources, "source", "left_anti").select(key, F.lit("unknown source").alias("problem"))
    known = items.select(F.col("id").alias("derive_from")).distinct()
    orphan = items.where("derive_from is not null").join(known, "derive_from", "left_anti").select(key, F.lit("derives from unknown item").alias("problem"))
    return _union([own, repeated, stray, orphan])


def resolve_citations(cites: DataFrame, passages: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Citations with the route of the first passage they name; `resolved` is false where there is none."""
    first = passages.groupBy(*keys).agg(F.min_by(F.struct("route", "title"), order).alias("p"))
    joined = cites.join(first, keys, "left")
    return joined.withColumn("resolved", F.col("p").isNotNull()).withColumn(
        "route", F.coalesce("p.route", F.lit(""))).withColumn("title", F.coalesce("p.title", F.lit(""))).drop("p")


def reply_object(reply: Column) -> Column:
    """The JSON object in a reply with fences, prose or trailing commas round it, as a variant; null if none."""
    bare = F.regexp_replace(F.regexp_replace(reply, r"(?i)^\s*```(?:json)?\s*", ""), r"\s*```\s*$", "")
    start, back = F.instr(bare, "{"), F.instr(F.reverse(bare), "}")
    end = F.length(bare) - back + 1
    body = F.when((start > 0) & (back > 0) & (end > start), F.substring(bare, start, end - start + 1))
    return F.coalesce(F.try_parse_json(body), F.try_parse_json(F.regexp_replace(body, r",\s*([}\]])", "$1")))


ITEM_SCHEMA = ("items array<struct<id:string,status:string,finding:string,evidence:array<string>,"
               "conditions:array<struct<n:int,answer:string,quote:string>>,facts:struct<planEnd:int>>>")


def validate_items(replies: DataFrame, wanted: DataFrame, batch: str, conditions: int) -> DataFrame:
    """(batch, id, problem) for every wanted id of a batch; the problem is empty where the answer is usable.

    `replies` holds (batch, reply JSON), `wanted` (batch, id). Each item needs
    `conditions` yes-or-no answers and, where given, a year that can be one.
    """
    parsed = replies.select(batch, F.from_json("reply", ITEM_SCHEMA).alias("r"))
    got = parsed.select(batch, F.posexplode("r.items").alias("place", "e"))
    finding = T.clip_text(F.coalesce("e.finding", F.lit("")), 700)
    given = F.col("e.conditions")  # the first answer to each counts, whatever comes later
    firsts = F.filter(given, lambda c, i: ~F.exists(F.slice(given, F.lit(1), i), lambda o: o.n == c.n))
    answered = F.size(F.filter(firsts, lambda c: c.answer.isin("yes", "no") & c.n.between(1, conditions)))
    year = F.col("e.facts.planEnd")
    problem = (F.when(~F.coalesce("e.status", F.lit("")).isin(fixed.STATUSES), "a status that is not allowed")
               .when(finding == "", "no finding").when(answered < conditions, 'every condition needs a "yes" or "no"')
               .when(year.isNotNull() & ~year.between(1990, 2100), "facts must be years or null").otherwise(""))
    # The first sound entry of an id counts, or else its first unsound one.
    rows = got.select(batch, F.col("e.id").alias("id"), F.struct((problem != "").alias("bad"), "place", problem.alias("problem")).alias("p"))
    best = rows.groupBy(batch, "id").agg(F.min("p").alias("p"))
    return wanted.join(best, [batch, "id"], "left").select(batch, "id", F.coalesce("p.problem", F.lit("missing")).alias("problem"))


def validate_grid(entities: DataFrame, key: str, fields: list[int], got: DataFrame) -> DataFrame:
    """(entity, field, problem) of an entity x field grid; `got` holds (entity, field, status, place).

    An entity nobody answered is one problem, not one per field.
    """
    cells = got.groupBy(key, "field").agg(
        F.min(F.when(F.col("status").isin(fixed.STATUSES), F.col("place"))).alias("good"),
        F.min(F.when(~F.col("status").isin(fixed.STATUSES), F.col("place"))).alias("bad"))
    seen = got.select(key).distinct()
    absent = entities.join(seen, key, "left_anti").select(key, F.lit(0).alias("field"), F.lit("missing").alias("problem"))
    expected = entities.join(seen, key, "left_semi").select(key, F.explode(F.array(*[F.lit(f) for f in fields])).alias("field"))
    grid = expected.join(cells, [key, "field"], "left")
    said = F.array_compact(F.array(
        F.when(F.col("bad").isNotNull() & (F.col("good").isNull() | (F.col("bad") < F.col("good"))), F.lit("status not allowed")),
        F.when(F.col("good").isNull(), F.lit("missing"))))
    return absent.unionByName(grid.select(key, "field", F.explode(said).alias("problem")))


def validate_clauses(policies: DataFrame, clauses: DataFrame, key: str, order: Column, codes: DataFrame) -> DataFrame:
    """(policy, reason) for every policy asked about: empty where the answer is usable.

    `policies` holds (key, answered, local_issue), `clauses` quote, local, national and relation.
    Only the first sixteen clauses count. A code is compared in capitals and without white space; an
    empty one is none; one outside `codes` makes the whole answer unusable.
    """
    first = top_k(clauses.withColumn("_o", order), [key], [F.asc("_o")], 16, "_n")
    code = F.upper(F.regexp_replace("national", r"\s+", ""))
    first = first.withColumn("national", F.when(F.col("national") != "", code))
    named = first.join(codes.select(F.col("code").alias("national"), F.lit(True).alias("known")), "national", "left")
    reason = (F.when((T.squash(F.coalesce("quote", F.lit(""))) == "") | F.col("local").isNull(), "a clause without a quote or a local flag")
              .when(F.col("national").isNotNull() & F.col("known").isNull(), "a clause names an unknown code")
              .when(F.col("national").isNotNull() & ~F.coalesce("relation", F.lit("")).isin(RELATIONS), "a clause needs a relation"))
    why = named.withColumn("_why", reason).groupBy(key).agg(F.min_by(F.when(F.col("_why").isNotNull(), F.col("_why")), F.when(F.col("_why").isNotNull(), F.col("_n"))).alias("_why"), F.lit(True).alias("_any"))
    known = F.coalesce("local_issue", F.lit("")).isin(*fixed.STATUS_RANK)
    said = F.when(~F.coalesce("answered", F.lit(False)), "missing").when(~known, "localIssue not allowed").when(F.col("_any").isNull(), "no clauses").otherwise(F.coalesce("_why", F.lit("")))
    return policies.join(why, key, "left").select(key, said.alias("reason"))


def merge_attempts(answers: DataFrame, keys: list[str], order: Column, tries: int = 2) -> DataFrame:
    """The latest valid answer among the first tries of each key."""
    rows = top_k(answers.withColumn("_o", order), keys, [F.asc("_o")], tries, "attempt")
    latest = F.max_by(F.when(F.col("valid"), F.col("answer")), F.when(F.col("valid"), F.col("attempt")))
    return rows.groupBy(*keys).agg(latest.alias("answer"), F.max("attempt").alias("tries")).where("answer is not null")


def count_rule(counts: DataFrame, n: str, most: int = 10) -> DataFrame:
    c = F.col(n)
    # The findings' words.
    finding = (F.when(c == 0, "No measurable outcomes could be found in the plan.")
               .when(c <= most, F.concat(F.lit("The plan sets out "), T.counted(c, "measurable outcome"), F.lit(f", within the limit of {most}.")))
               .otherwise(F.concat(F.lit("The plan sets out "), c, F.lit(f" outcomes, more than the {most} allowed."))))
    return counts.withColumn("status", F.when(c.between(1, most), "met").otherwise("missing")).withColumn("finding", finding)


def period_rule(facts: DataFrame, check_year: Column, years: int = 10) -> DataFrame:
    """Adds span and status from plan_end and adoption years; adoption is assumed two years on where not given."""
    span = F.col("plan_end") - F.coalesce("adoption", check_year + 2)
    status = F.when(F.col("plan_end").isNull(), "missing").when(span >= years, "met").otherwise("partly")
    return facts.withColumn("span", F.coalesce(span, F.lit(0))).withColumn("status", status)


# Fixed value: what is said of a document without entities.
NO_SITES = "No site allocations could be identified from the plan's headings or tables."


def presence_rule(docs: DataFrame, entities: DataFrame, doc: str, code: str, order: Column) -> DataFrame:
    """For every document: how many entities it has, its status, and the codes of the first twelve."""
    total = entities.groupBy(doc).agg(F.count("*").alias("n"))
    first = top_k(entities.withColumn("_o", order), [doc], [F.asc("_o")], 12, "_n")
    names = first.groupBy(doc).agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", code))), lambda x: x[code]).alias("codes"))
    more = F.when(F.col("n") > 12, " and others").otherwise("")
    found = F.concat(F.lit("The plan allocates "), T.counted(F.col("n"), "site"), F.lit(": "), T.human_list(F.col("codes")), more, F.lit("."))
    rows = docs.select(doc).join(total.join(names, doc), doc, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return rows.select(doc, "n", F.when(F.col("n") > 0, "met").otherwise("missing").alias("status"), F.coalesce(found, F.lit(NO_SITES)).alias("finding"))


def field_coverage(cells: DataFrame, doc: str, entities: DataFrame, fields: list[int], most: int = fixed.MAX_ALLOCATIONS) -> DataFrame:
    """Per field over a document's checked entities: how many give it, and which do not.

    `entities` holds (document, entity, label), the first `most` of which are
    checked; `cells` holds (entity, field, status); `fields` are the rubric's. Lists are therefore bounded.
    """
    checked = top_k(entities, [doc], [F.asc("entity")], most, "_n")
    expected = checked.select(doc, "entity", "label", F.explode(F.array(*[F.lit(i) for i in fields])).alias("field"))
    grid = expected.join(cells, ["entity", "field"], "left").withColumn("status", F.coalesce("status", F.lit(ST.NONE)))
    listed = lambda s: T.human_list(F.transform(F.sort_array(F.collect_list(F.when(F.col("status") == s, F.struct("entity", "label")))), lambda x: x.label))
    out = grid.groupBy(doc, "field").agg(
        F.count_if(F.col("status") == "met").alias("met"), F.count("*").alias("n"), listed("partly").alias("thin"),
        listed("missing").alias("absent"), listed(ST.NONE).alias("unassessed"), ST.across(F.col("status")).alias("status"))
    part = lambda lead, c: F.when(F.col(c) != "", F.concat(F.lit(lead), F.col(c), F.lit(".")))
    return out.select(doc, "field", "status", F.concat_ws(
        " ", F.concat(F.lit("Given for "), "met", F.lit(" of "), T.counted(F.col("n"), "allocation"), F.lit(".")),
        part("Thin for ", "thin"), part("Not given for ", "absent"), part("Not assessed for ", "unassessed")).alias("finding"))


def entity_findings(clauses: DataFrame, key: str) -> DataFrame:
    """Per policy, from its verified clauses only; a dropped clause caps it at partly.

    `clauses` holds local, national, relation and verified, at most sixteen per policy.
    """
    kept = F.col("verified")
    local, national = F.when(kept, F.col("local")), F.when(kept, F.col("national"))
    own = F.count_if(kept & (F.col("local") | F.col("national").isNull()))
    n = F.count_if(kept)
    clash = F.coalesce(F.bool_or(kept & (F.col("relation") == "contradicts")), F.lit(False))
    named = F.collect_set(F.when((national.isNotNull() & ~local) | (kept & (F.col("relation") == "contradicts")), national))
    g = clauses.groupBy(key).agg(own.alias("own"), n.alias("n"), F.count("*").alias("all"), clash.alias("clash"), F.array_join(F.sort_array(named), ", ").alias("codes"))
    status = F.when(F.col("own") == 0, "missing").when((F.col("own") == F.col("n")) & ~F.col("clash"), "met").otherwise("partly")
    finding = (F.when(F.col("clash"), "inconsistent").when(status == "met", "adds-local-detail").when(status == "missing", "restates").otherwise("partly-restates"))
    none = F.col("n") == 0
    dropped = F.col("all") - F.col("n")
    return g.select(key, dropped.alias("dropped"), F.when(none, "").otherwise(finding).alias("finding"), F.when(none, "").otherwise(F.col("codes")).alias("codes"),
                    F.when(none, ST.NONE).when((status == "met") & (dropped > 0), "partly").otherwise(status).alias("status"))


def derived_items(links: DataFrame, key: str, results: DataFrame, source: str, order: str) -> DataFrame:
    """An item made from others: worst status, first six gaps of those not met, and all their actions.

    `links` holds (item, source item, place); an item is derived from a few named others.
    """
    rows = links.join(results, source)
    not_met = F.col("status") != "met"
    worst = rows.groupBy(key).agg(ST.worst(F.col("status")).alias("status"), F.count("*").alias("sources"))
    gaps = top_k(rows.where(not_met), [key], [F.asc(order), F.asc(source)], 6, "_n").groupBy(key).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "gap"))), lambda x: x.gap), "; ").alias("gaps"))
    placed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(source).alias("s"), "action")))
    actions = rows.where(not_met).groupBy(key).agg(F.array_join(F.transform(placed, lambda x: x.action), " ").alias("actions"))
    return worst.join(gaps, key, "left").join(actions, key, "left").select(key, "status", "sources", F.coalesce("gaps", F.lit("")).alias("gaps"), F.coalesce("actions", F.lit("")).alias("actions"))


def summarise(items: DataFrame, section: str) -> DataFrame:
    """Counts per status, zero where none, for each section and for all ('')."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in fixed.STATUSES]
    table = items.rollup(section).agg(*counts, F.grouping(section).alias("g"))
    entry = F.array(*[F.struct(F.lit(s).alias("status"), F.col(f"`{s}`").alias("n")) for s in fixed.STATUSES])
    return table.select(F.when(F.col("g") == 1, "").otherwise(F.col(section)).alias(section), F.inline(entry))


def coverage_matrix(cells: DataFrame, entity: str, fields: list[int], order: Column) -> DataFrame:
    """One row per entity, one column per field; the first status given counts."""
    wide = cells.withColumn("_o", order).groupBy(entity).pivot("field", fields).agg(F.min_by("status", "_o"))
    return wide.select(entity, *[F.coalesce(F.col(f"`{f}`"), F.lit("")).alias(f"field_{f}") for f in fields])


def incomplete_entities(cells: DataFrame, entity: str) -> DataFrame:
    """Entities with a field that is not met, and which."""
    worst = cells.groupBy(entity, "field").agg(ST.worst(F.col("status")).alias("status")).where("status <> 'met'")
    return worst.groupBy(entity).agg(F.array_join(F.sort_array(F.collect_set("field")), ", ").alias("fields"))


def officer_actions(items: DataFrame, key: str, found: DataFrame, order: Column, most: int = fixed.MAX_ALLOCATIONS) -> DataFrame:
    """What only the authority can complete, with the entities found in the draft appended."""
    first = top_k(found.withColumn("_o", order), [key], [F.asc("_o")], most, "_n")
    labels = first.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "label"))), lambda x: x.label), "; ").alias("labels"))
    return items.join(labels, key, "left").select(key, F.concat("action", F.coalesce(
        F.concat(F.lit(" Found in the draft: "), "labels", F.lit(".")), F.lit(""))).alias("action"))


# The parts of the draft statements and the items each holds, in order.
STATEMENT_PARTS = [
    (1, ["E1", "E2", "E3", "E4", "E5", "E6", "E7", "E8", "E9", "E10", "E11", "E12"], None),
    (2, ["A9"], "If the plan supersedes no existing policy, explain here why."),
    (3, ["E13"], None),
    (4, ["E14"], None),
    (5, ["F1", "F2", "F3", "F4", "F5"], None),
]


def statement_parts(results: DataFrame, run: str) -> DataFrame:
    """Results (run, item, status) in the order the statements need; the note shows only where not met."""
    rows = [(p, i, item, note) for p, items, note in STATEMENT_PARTS for i, item in enumerate(items)]
    layout = results.sparkSession.createDataFrame(rows, "part int, place int, item string, note string")
    joined = results.join(F.broadcast(layout), "item")  # twenty rows, fixed above
    note = F.when(F.col("status") != "met", F.coalesce("note", F.lit(""))).otherwise("")
    return joined.select(run, "part", "place", "item", "status", note.alias("note"))


def evidence_base(named: DataFrame, group: str, place: str) -> DataFrame:
    """Documents named, whatever their case: the last spelling, at the place of the first."""
    one = named.groupBy(group, F.lower("name").alias("key")).agg(F.max_by("name", place).alias("name"), F.min(place).alias("place"))
    return one.select(group, "name", "place")


def work_batches(items: DataFrame, section: str, key: str, size: int) -> DataFrame:
    """Batches of a fixed size within each section, in key order."""
    n = numbered(items, [section], F.col(key), [key], "_n", cheap=True)
    return n.withColumn("batch", F.floor((F.col("_n") - 1) / size).cast("long")).drop("_n")


def run_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Per level (item or instance): statuses, how many differ, and whether both runs have the same keys."""
    joined = a.withColumnRenamed("status", "a").join(b.withColumnRenamed("status", "b"), keys, "full")
    return joined.groupBy("level").agg(
        F.count_if(F.col("a").isNotNull()).alias("statuses"),
        F.count_if(F.col("a").isNotNull() & ~F.col("a").eqNullSafe(F.col("b"))).alias("differ"),
        (F.count_if(F.col("a").isNull() | F.col("b").isNull()) == 0).alias("same_keys"))


def call_stats(calls: DataFrame, run: str) -> DataFrame:
    return calls.groupBy(run).agg(F.count("*").alias("calls"), F.count_if("retry").alias("retries"),
                                  F.count_if("unanswered").alias("unanswered"), F.max("ms").alias("slowest"))


def report_rows(sections: DataFrame, items: DataFrame, evidence: DataFrame, gaps: DataFrame) -> DataFrame:
    """A report as lines with their reading order: (section, item, kind, place, line).

    Sections hold (section, title), items (section, item, title, status), evidence
    and gaps (section, item, place, text).
    """
    words = F.create_map(*[F.lit(x) for pair in zip(fixed.STATUSES, ["Met", "Partly met", "Not met", "Cannot assess"]) for x in pair])
    md = T.escape_markdown
    row = lambda df, item, kind, place, line: df.select("section", item.alias("item"), F.lit(kind).alias("kind"), place.alias("place"), line.alias("line"))
    zero = F.lit(0).cast("long")
    return _union([
        row(sections, zero, 0, zero, F.concat(F.lit("## "), md(F.col("title")))),
        row(items, F.col("item"), 1, zero, F.concat(F.lit("### "), md(F.col("title")), F.lit(": "), words[F.col("status")])),
        row(evidence, F.col("item"), 2, F.col("place").cast("long"), F.concat(F.lit("> "), md(F.col("text")))),
        row(gaps, F.col("item"), 3, F.col("place").cast("long"), F.concat(F.lit("- "), md(F.col("text")))),
    ])
