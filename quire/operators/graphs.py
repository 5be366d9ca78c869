"""Links, references, stages and question flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.session import shared_dir

EXTERNAL = r"^(https?:|mailto:|data:|javascript:|#$)"


def page_links(pages: DataFrame, page: str, html: str = "html") -> DataFrame:
    """Internal links of a page outside code samples: path, query and fragment."""
    shown = F.regexp_replace(F.col(html), r"<pre[\s\S]*?</pre>", "")
    found = F.regexp_extract_all(shown, F.lit(r"\s(?:href|src)=\"([^\"]+)\""), F.lit(1))
    rows = pages.select(page, F.posexplode(found).alias("at", "raw")).where(~F.col("raw").rlike(EXTERNAL))
    before = F.substring_index("raw", "#", 1)
    frag = F.when(F.contains("raw", F.lit("#")), F.regexp_extract("raw", r"^[^#]*#([^#]*)", 1)).otherwise("")
    return rows.select(page, "at", "raw", F.substring_index(before, "?", 1).alias("path"), frag.alias("frag"))


def page_ids(pages: DataFrame, path: str, html: str = "html") -> DataFrame:
    return pages.select(path, F.explode(F.array_distinct(F.regexp_extract_all(html, F.lit(r"\sid=\"([^\"]+)\""), F.lit(1)))).alias("frag"))


def resolve_path(base: Column, path: Column) -> Column:
    """A link's path from the root: relative parts followed, no slash at the end."""
    folder = F.regexp_replace(base, r"[^/]*$", "")
    full = F.when(path == "", base).when(path.startswith("/"), path).otherwise(F.concat(folder, path))
    parts = F.filter(F.split(full, "/"), lambda p: (p != "") & (p != "."))
    step = lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.lit(0), F.size(acc) - 1))).otherwise(F.array_append(acc, p))
    return F.concat(F.lit("/"), F.array_join(F.reduce(parts, F.expr("cast(array() as array<string>)"), step), "/"))


def broken_links(links: DataFrame, pages: DataFrame, ids: DataFrame) -> DataFrame:
    """Links with what is wrong: '' , 'missing' page or 'no id'.

    `links` holds (target, frag), `pages` (target), `ids` (target, frag). Only
    distinct targets are looked up, so a link on every page costs one lookup.
    """
    asked = links.select("target", "frag").distinct()
    known = pages.select("target", F.lit(True).alias("page")).distinct()
    named = ids.select("target", "frag", F.lit(True).alias("id")).distinct()
    looked = asked.join(known, "target", "left").join(named, ["target", "frag"], "left")
    fault = F.when(F.col("page").isNull(), "missing").when((F.col("frag") != "") & F.col("id").isNull(), "no id").otherwise("")
    return links.join(looked.select("target", "frag", fault.alias("fault")), ["target", "frag"])


def resolve_refs(refs: DataFrame, sources: DataFrame, anchors: DataFrame) -> DataFrame:
    """References (doc, anchor) with their link and state: ok, source only, unknown source or missing anchor."""
    s = sources.select("doc", F.col("route").alias("home"))
    joined = refs.join(s, "doc", "left").join(anchors.select("doc", "anchor", "route"), ["doc", "anchor"], "left")
    state = (F.when(F.col("home").isNull(), "unknown source").when(F.col("anchor").isNull(), "source")
             .when(F.col("route").isNull(), "missing").otherwise("ok"))
    href = F.when(state == "unknown source", "#").when(state == "ok", F.concat("route", F.lit("#"), "anchor")).otherwise(F.col("home"))
    return joined.select(*refs.columns, href.alias("href"), state.alias("state"))


def stage_neighbours(stages: DataFrame, phases: DataFrame) -> DataFrame:
    """(stage, direction, place, other): next stages that exist, in order, the stages before, and phases without a stage."""
    ids = stages.select(F.col("stage").alias("other"))
    after = stages.select("stage", F.posexplode("next").alias("place", "other")).join(ids, "other", "left_semi")
    forward = after.select("stage", F.lit("next").alias("direction"), "place", "other")
    back = after.select(F.col("other").alias("stage"), F.lit("previous").alias("direction"), F.lit(0).alias("place"), F.col("stage").alias("other"))
    unused = phases.join(stages.select("phase"), "phase", "left_anti").select(F.col("phase").alias("stage"), F.lit("unused phase").alias("direction"), F.lit(0).alias("place"), F.lit("").alias("other"))
    return forward.unionByName(back.distinct()).unionByName(unused)


def reach(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Every node that can be reached from the start nodes.

    One pass over the edges per step away from the start; each pass is written to
    the checkpoint folder, so a lost executor costs one pass and the plan stays short.
    """
    shared_dir(edges.sparkSession)
    seen = start.select("node").distinct().checkpoint()
    front = seen
    while not front.isEmpty():
        ahead = front.join(edges, front.node == edges.source).select(F.col("target").alias("node")).distinct()
        front = ahead.join(seen, "node", "left_anti").checkpoint()
        seen = seen.unionByName(front)
    return seen


def flow_faults(options: DataFrame, start: DataFrame) -> DataFrame:
    """(node, fault) of a question flow: options (question, target) that go nowhere, questions out of reach or with one option."""
    questions = options.select(F.col("question").alias("node")).distinct()
    edges = options.select(F.col("question").alias("source"), "target").join(questions.select(F.col("node").alias("target")), "target", "left_semi").distinct()
    lost = questions.join(reach(edges, start), "node", "left_anti").select("node", F.lit("unreachable").alias("fault"))
    nowhere = options.join(questions.select(F.col("node").alias("target")), "target", "left_anti").select(F.col("question").alias("node"), F.lit("goes nowhere").alias("fault")).distinct()
    few = options.groupBy("question").agg(F.count("*").alias("n")).where("n < 2").select(F.col("question").alias("node"), F.lit("fewer than two options").alias("fault"))
    return lost.unionByName(nowhere).unionByName(few)


def route_table(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """One list of routes from several tables of (name, title)."""
    out = None
    for kind, df in parts:
        rows = df.select(F.lit(kind).alias("kind"), F.concat(F.lit(f"/{kind}/"), T.slug(F.col("name")), F.lit("/")).alias("route"), "title")
        out = rows if out is None else out.unionByName(rows)
    return out


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once whatever their case."""
    return rows.groupBy(F.lower(key).alias("key")).agg(F.count("*").alias("n")).where("n > 1")


def checklist_progress(items: DataFrame, ticks: DataFrame, checklist: str, item: str) -> DataFrame:
    """Ticked of all, and ticked must-items of all must-items, per checklist."""
    done = items.join(ticks.select(item, F.lit(True).alias("ticked")).distinct(), item, "left").withColumn("ticked", F.coalesce("ticked", F.lit(False)))
    return done.groupBy(checklist).agg(
        F.count_if("ticked").alias("done"), F.count("*").alias("total"), F.count_if(F.col("ticked") & F.col("must")).alias("must_done"), F.count_if("must").alias("must_total"))
