"""URL verdicts from rules, and from a tree of path templates per host where no rule fits.

A path's segments are generalised from the left, all of them. A segment with digits is a
wildcard, which keeps a file ending. Other values stay words if they hold enough of their
parent's pages; of these, branches whose labelled block rate does not differ from their
siblings' are merged into one. The tree grows level by level until no path of a branch with
enough pages goes on; below such a branch no value can be common, so every segment is a
wildcard. A template is rejected if its smoothed labelled purity, the share of blocked among
its labelled pages, is high.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import lower_ascii, skewed_join
from quire.session import written

#: Pages a segment value needs to stay a word, and its least share of the parent's, in %.
SUPPORT, SHARE = 20, 1
#: Standard deviations within which a branch counts as like its siblings.
LIKE = 1.96
#: Pages the overall block rate counts for in a template's purity, and the purity that rejects.
PRIOR, REJECT = 4.0, 0.8
#: (host, path, verdict); a rule fits its host and all subdomains.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null. ``rules`` is a short list."""
    longest = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = [F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in longest]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def segments(path: Column) -> Column:
    """A path's segments, those with digits generalised; none for an empty path."""
    def general(s):
        return F.when(s.rlike("[0-9]"), F.concat(F.lit("*"), F.regexp_extract(s, r"(\.[A-Za-z]+)$", 1))).otherwise(s)

    return F.transform(F.slice(F.split(path, "/", -1), 2, F.greatest(F.lit(1), F.size(F.split(path, "/", -1)))), general)


def _is_wild(s: Column) -> Column:
    return (s == "") | F.startswith(s, F.lit("*"))


def template_tree(paths: DataFrame) -> DataFrame:
    """``template`` for every row of (host, segments, n, allowed, blocked)."""
    here, done, level = paths.withColumn("template", F.lit("")), [], 0
    sums = [F.sum(c).alias(c) for c in ("n", "allowed", "blocked")]
    while True:
        # Sums by branch are small beside the rows: a host's rows are never gathered, only its distinct next segments.
        rows = here.withColumn("next", F.get("segments", F.lit(level)))  # null where the path ends
        branch = rows.groupBy("host", "template", "next").agg(*sums)
        parent = branch.groupBy("host", "template").agg(*[F.sum(c).alias(f"all_{c}") for c in ("n", "allowed", "blocked")])
        labelled, pool = F.col("allowed") + F.col("blocked"), F.col("all_allowed") + F.col("all_blocked")
        rate, usual = F.col("blocked") / labelled, F.col("all_blocked") / pool
        like = (labelled > 0) & (F.abs(rate - usual) <= LIKE * F.sqrt(usual * (1 - usual) / labelled))
        common = (F.col("n") >= SUPPORT) & (F.col("n") * 100 >= F.col("all_n") * SHARE)
        mark = F.when(_is_wild(F.col("next")), F.col("next")).when(~common, F.lit("*")).when(like, F.lit("+")).otherwise(F.col("next"))
        marks = branch.filter(F.col("next").isNotNull()).join(parent, ["host", "template"]).select("host", "template", "next", mark.alias("mark"))
        marked = rows.filter(F.col("next").isNotNull()).join(marks, ["host", "template", "next"])
        marked = marked.select("host", "segments", "n", "allowed", "blocked", F.concat_ws("/", "template", "mark").alias("template"))
        full = marked.groupBy("host", "template").agg((F.sum("n") >= SUPPORT).alias("grows"))
        marked = written(marked.join(full, ["host", "template"]), "level")
        level += 1
        done.append(rows.filter(F.col("next").isNull()).drop("next"))
        wild = F.transform(F.slice("segments", level + 1, F.greatest(F.lit(1), F.size("segments"))), lambda s: F.when(_is_wild(s), s).otherwise(F.lit("*")))
        done.append(marked.filter(~F.col("grows")).withColumn("template", F.array_join(F.concat(F.array("template"), wild), "/")).drop("grows"))
        here = marked.filter("grows").drop("grows")
        if here.filter(F.size("segments") > level).isEmpty():
            break
    done.append(here)
    return functools.reduce(DataFrame.unionByName, done)


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """The input's columns with host, path, rule, verdict, template and purity (which replace columns of these names).

    Host and path of a null url or one without "://" are empty. Where a rule fits, its
    verdict counts; else the template's, "allow" unless its purity is at least REJECT.
    The rules' verdicts are the labels. Rows that repeat count each time. An empty table
    gives an empty result; without any label, purity is 0.5 and nothing is rejected.
    """
    made = ("host", "path", "rule", "verdict", "template", "purity")
    rest = [c for c in pages.columns if c not in made]
    rows = pages.select(F.struct(*rest).alias("q_row"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("q_rule", rule_for(F.col("host"), F.col("path"), rules))
    keys = ["host", "segments"]
    rows = rows.withColumn("segments", segments(F.col("path")))
    label = F.col("q_rule.verdict")
    paths = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count(F.when(label == "allow", 1)).alias("allowed"), F.count(F.when(label == "block", 1)).alias("blocked"))
    paths = written(paths, "paths")
    total, allowed, blocked = paths.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "allowed", "blocked")]).first()
    prior = blocked / (allowed + blocked) if allowed + blocked else 0.5
    tree = written(template_tree(paths), "templates")
    sums = tree.groupBy("host", "template").agg(F.sum("allowed").alias("all_allowed"), F.sum("blocked").alias("all_blocked"))
    purity = (F.col("all_blocked") + F.lit(PRIOR * prior)) / (F.col("all_allowed") + F.col("all_blocked") + F.lit(PRIOR))
    verdicts = tree.join(sums, ["host", "template"]).select(*keys, "n", "template", purity.alias("purity"))
    judged = skewed_join(rows, verdicts, keys, "n", total)
    verdict = F.coalesce(label, F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise(F.lit("allow")))
    return judged.select("q_row.*", "host", "path", F.col("q_rule.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")
