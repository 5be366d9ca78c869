"""Findings of a whole document from the findings on its policies, and items made from other items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import fixed
from quire.functions import status as ST
from quire.functions import text as T
from quire.operators.ranking import top_k

# How statuses and findings are worded.
STATUS_WORDS = {"met": "met", "partly": "partly met", "missing": "not met", ST.NONE: "cannot assess"}
FINDING_WORDS = {"adds-local-detail": "adds local detail", "partly-restates": "partly restates national policy", "restates": "duplicates or restates national policy", "inconsistent": "inconsistent with national policy"}
NO_POLICIES = "No locally specific policies were found, so this could not be checked."


def _worded(c: Column, words: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in words.items() for x in pair])[c]


def _checked(docs: DataFrame, entities: DataFrame, judged: DataFrame, doc: str, entity: str, most: int) -> DataFrame:
    """Each document's first ``most`` entities with what was found on them; a row with a null entity for a document without any."""
    first = top_k(entities, [doc], [F.asc(entity)], most, "place").join(judged, entity, "left")
    first = first.withColumn("status", F.coalesce("status", F.lit(ST.NONE)))
    return docs.select(doc).join(first, doc, "left")


def _listed(status: str, value: Column) -> Column:
    """Aggregate: the values of rows with a status, in the entities' order. At most the entities checked per document."""
    return F.transform(F.sort_array(F.collect_list(F.when(F.col("status") == status, F.struct("place", value.alias("said"))))), lambda x: x.said)


def _findings(rows: DataFrame, doc: str, name: Column, gap_missing: Column, gap_partly: Column) -> DataFrame:
    n = F.count("place")
    return rows.groupBy(doc).agg(
        n.alias("n"), F.count_if(F.col("status") == "met").alias("met"), _listed("missing", name).alias("failing"), _listed("partly", name).alias("thin"),
        F.concat(_listed("missing", gap_missing), _listed("partly", gap_partly)).alias("all_gaps"), ST.across(F.col("status")).alias("status"))


def _whole(found: DataFrame, doc: str, finding: Column) -> DataFrame:
    none = F.col("n") == 0
    return found.select(doc, "n", "met", F.when(none, ST.NONE).otherwise(F.col("status")).alias("status"), F.when(none, NO_POLICIES).otherwise(finding).alias("finding"),
                        F.array_join("all_gaps", "; ").alias("gaps"))


def restating_policies(docs: DataFrame, policies: DataFrame, judged: DataFrame, doc: str, policy: str, most: int = fixed.MAX_POLICIES) -> DataFrame:
    """For every document: how its policies stand to national policy, with the status over all, a finding and gaps.

    ``policies`` holds (document, policy, label), of which the first ``most`` of a document are
    checked; ``judged`` is the result of ``checking.entity_findings`` by policy. A policy without
    one is not assessed. A document without policies cannot be checked.
    """
    codes = F.coalesce("codes", F.lit(""))
    name = F.when(codes != "", F.concat("label", F.lit(" ("), codes, F.lit(")"))).otherwise(F.col("label"))
    gap = F.concat("label", F.lit(": "), _worded(F.col("finding"), FINDING_WORDS), F.when(codes != "", F.concat(F.lit(" ("), codes, F.lit(")"))).otherwise(""))
    found = _findings(_checked(docs, policies, judged.select(policy, "status", "finding", "codes"), doc, policy, most), doc, name, gap, gap)
    failing, thin = F.size("failing"), F.size("thin")
    return _whole(found, doc, F.concat_ws(
        " ", F.concat(failing.cast("string"), F.lit(" of "), T.counted(F.col("n"), "policy", "policies"), F.lit(" duplicate, restate or contradict national decision-making policy"),
                      F.when(failing > 0, F.concat(F.lit(": "), T.human_list(F.col("failing")))).otherwise(""), F.lit(".")),
        F.when(thin > 0, F.concat(thin.cast("string"), F.lit(" partly restate it: "), T.human_list(F.col("thin")), F.lit("."))),
        F.concat(F.col("met").cast("string"), F.lit(" add local detail only."))))


def general_policies(docs: DataFrame, policies: DataFrame, answers: DataFrame, clauses: DataFrame, doc: str, policy: str, most: int = fixed.MAX_POLICIES) -> DataFrame:
    """For every document: which of its policies address a local issue, with the status over all, a finding and gaps.

    ``answers`` holds (policy, local_issue), the status that was answered; it stands only as far as a
    clause of the policy was found (``clauses``: policy, verified), and falls by one without.
    """
    kept = clauses.groupBy(policy).agg(F.count_if("verified").alias("kept"))
    judged = answers.join(kept, policy, "left").select(policy, ST.settle(F.col("local_issue"), F.coalesce("kept", F.lit(0))).alias("status"))
    rows = _checked(docs, policies, judged, doc, policy, most)
    found = _findings(rows, doc, F.col("label"), F.concat("label", F.lit(": no local reason given")), F.concat("label", F.lit(": partly local")))
    general = F.size("failing")
    return _whole(found, doc, F.concat(
        F.col("met").cast("string"), F.lit(" of "), T.counted(F.col("n"), "policy", "policies"), F.lit(" clearly address a local issue or support allocated sites."),
        F.when(general > 0, F.concat(F.lit(" "), general.cast("string"), F.lit(" are general: "), T.human_list(F.col("failing")), F.lit("."))).otherwise("")))


def derived_results(links: DataFrame, key: str, results: DataFrame, source: str, place: str, most_gaps: int = 6, most_evidence: int = 4) -> DataFrame:
    """Items made from others: the worst status, what each source is, the first gaps of those not met, the first evidence of all, and the actions.

    ``links`` holds (item, source, place): an item is made from a few named others. ``results`` holds
    (source, title, status, gaps, evidence, action); a source that is not met and gives no gap counts as one itself.
    """
    said = _worded(F.col("status"), STATUS_WORDS)
    own = F.when(F.size("gaps") > 0, F.col("gaps")).otherwise(F.array(F.concat("title", F.lit(" ("), said, F.lit(")"))))
    what = F.concat(F.lower(F.substring("title", 1, 1)), F.expr("substring(title, 2)"), F.lit(" is "), said)
    rows = links.join(results, source).select(
        key, "status", F.struct(F.col(place).alias("o"), F.col(source).alias("s"), what.alias("what"), F.when(F.col("status") != "met", own).alias("gaps"), "evidence",
                                F.when((F.col("status") != "met") & (F.col("action") != ""), F.col("action")).alias("action")).alias("r"))
    g = rows.groupBy(key).agg(ST.worst(F.col("status")).alias("status"), F.sort_array(F.collect_list("r")).alias("r"))
    parts = lambda f: F.transform("r", lambda x: x[f])
    flat = lambda f: F.flatten(F.filter(parts(f), lambda x: x.isNotNull()))
    names = T.human_list(F.transform("r", lambda x: x.s.cast("string")))
    finding = F.concat(F.lit("Taken from "), F.when(F.size("r") > 1, "items ").otherwise("item "), names, F.lit(": "), F.array_join(parts("what"), "; "), F.lit("."))
    return g.select(key, "status", finding.alias("finding"), F.array_join(F.slice(flat("evidence"), 1, most_evidence), "; ").alias("evidence"),
                    F.array_join(F.slice(flat("gaps"), 1, most_gaps), "; ").alias("gaps"), F.array_join(parts("action"), " ").alias("actions"))
