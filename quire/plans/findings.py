"""Findings per document on the test tables: customers are documents, their orders policies, order lines clauses."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import status as ST
from quire.operators import checking as C
from quire.operators import findings as D
from quire.plans import checking as P
from quire.sources.tables import table


def _policies(spark, sf):
    docs = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"))  # a third have no orders
    orders = table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("Policy P"), "o_orderkey").alias("label"))
    return docs, orders


def restating_policies(spark, sf):
    docs, policies = _policies(spark, sf)
    judged = C.entity_findings(P._clauses(spark, sf).where("l_orderkey % 7 <> 0"), "l_orderkey")
    return D.restating_policies(docs, policies, judged, "o_custkey", "l_orderkey")


def general_policies(spark, sf):
    docs, policies = _policies(spark, sf)
    status = F.translate("o_orderstatus", "FOP", "ANR")
    answers = table(spark, sf, "orders").where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("l_orderkey"), ST.flagged(status).alias("local_issue"))
    clauses = P._clauses(spark, sf).select("l_orderkey", (F.col("verified") & (F.col("l_partkey") % 2 == 0)).alias("verified"))
    return D.general_policies(docs, policies, answers, clauses, "o_custkey", "l_orderkey")


def derived_results(spark, sf):
    """An order is made from the parts on its lines; a part has none to two gaps and pieces of evidence."""
    size = F.col("p_size") % 4
    some = lambda n, c: F.slice(F.array(c, "p_brand"), F.lit(1), n.cast("int"))
    results = table(spark, sf, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.initcap("p_name").alias("title"), F.when(size == 0, ST.NONE).when(size == 1, "missing").when(size == 2, "partly").otherwise("met").alias("status"),
        some(F.col("p_size") % 3, "p_name").alias("gaps"), some(F.col("p_partkey") % 3, "p_type").alias("evidence"), F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.col("p_type")).alias("action"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return D.derived_results(lines, "l_orderkey", results, "l_partkey", "l_linenumber")


QUERIES = {f.__name__: f for f in (restating_policies, general_policies, derived_results)}

_FIRST = """k AS (SELECT o_custkey, o_orderkey AS l_orderkey, 'Policy P' || o_orderkey AS label, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders QUALIFY place <= 60)"""
_NAMES = "CASE WHEN len({0}) <= 1 THEN coalesce({0}[1], '') ELSE array_to_string({0}[:-2], ', ') || ' and ' || {0}[-1] END"


def _grouped(name: str, missing: str, partly: str) -> str:
    def listed(status, value):
        return f"coalesce(list({value} ORDER BY place) FILTER (WHERE status = '{status}'), [])"

    return f"""g AS (SELECT c_custkey AS o_custkey, count(place) AS n, count(*) FILTER (WHERE status = 'met') AS met, {listed('missing', name)} AS failing, {listed('partly', name)} AS thin,
      list_concat({listed('missing', missing)}, {listed('partly', partly)}) AS all_gaps, {P._ACROSS('status')} AS status FROM customer LEFT JOIN j ON o_custkey = c_custkey GROUP BY ALL)"""


_WHOLE = """SELECT o_custkey, n, met, CASE WHEN n = 0 THEN 'not-assessable' ELSE status END AS status,
  CASE WHEN n = 0 THEN 'No locally specific policies were found, so this could not be checked.' ELSE {} END AS finding, array_to_string(all_gaps, '; ') AS gaps FROM g"""
_KINDS = "CASE finding WHEN 'adds-local-detail' THEN 'adds local detail' WHEN 'partly-restates' THEN 'partly restates national policy' WHEN 'restates' THEN 'duplicates or restates national policy' WHEN 'inconsistent' THEN 'inconsistent with national policy' END"
_COUNTED = "n || CASE WHEN n = 1 THEN ' policy' ELSE ' policies' END"
_CODES = "CASE WHEN coalesce(codes, '') <> '' THEN ' (' || codes || ')' ELSE '' END"
_SAID = "CASE s WHEN 'met' THEN 'met' WHEN 'partly' THEN 'partly met' WHEN 'missing' THEN 'not met' ELSE 'cannot assess' END"

ORACLES = {
    "restating_policies": f"""WITH {_FIRST}, f AS ({P.ORACLES['entity_findings'].replace('FROM lineitem)', 'FROM lineitem WHERE l_orderkey % 7 <> 0)')}),
      j AS (SELECT k.*, finding, codes, coalesce(status, 'not-assessable') AS status FROM k LEFT JOIN f USING (l_orderkey)), {_grouped(f"label || {_CODES}", *[f"label || ': ' || {_KINDS} || {_CODES}"] * 2)}
      {_WHOLE.format(f"len(failing) || ' of ' || {_COUNTED} || ' duplicate, restate or contradict national decision-making policy' || CASE WHEN len(failing) > 0 THEN ': ' || {_NAMES.format('failing')} ELSE '' END || '.' || CASE WHEN len(thin) > 0 THEN ' ' || len(thin) || ' partly restate it: ' || {_NAMES.format('thin')} || '.' ELSE '' END || ' ' || met || ' add local detail only.'")}""",
    "general_policies": f"""WITH {_FIRST}, v AS (SELECT l_orderkey, count(*) FILTER (WHERE l_quantity >= 10 AND l_partkey % 2 = 0) AS kept FROM lineitem GROUP BY ALL),
      a AS (SELECT o_orderkey AS l_orderkey, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END AS r FROM orders WHERE o_orderkey % 5 <> 0),
      s AS (SELECT l_orderkey, ['missing', 'partly', 'met'][(CASE WHEN coalesce(kept, 0) = 0 THEN greatest(r - 1, 0) ELSE r END) + 1] AS status FROM a LEFT JOIN v USING (l_orderkey)),
      j AS (SELECT k.*, coalesce(status, 'not-assessable') AS status FROM k LEFT JOIN s USING (l_orderkey)), {_grouped("label", "label || ': no local reason given'", "label || ': partly local'")}
      {_WHOLE.format(f"met || ' of ' || {_COUNTED} || ' clearly address a local issue or support allocated sites.' || CASE WHEN len(failing) > 0 THEN ' ' || len(failing) || ' are general: ' || {_NAMES.format('failing')} || '.' ELSE '' END")}""",
    "derived_results": f"""WITH r AS (SELECT l_orderkey, l_linenumber AS o, l_partkey AS k, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || lower(substring(w, 2))), ' ') AS title,
        CASE p_size % 4 WHEN 0 THEN 'not-assessable' WHEN 1 THEN 'missing' WHEN 2 THEN 'partly' ELSE 'met' END AS s, [p_name, p_brand][:p_size % 3] AS gaps, [p_type, p_brand][:(p_partkey % 3)::INT] AS evidence,
        CASE WHEN p_partkey % 5 <> 0 THEN p_type END AS action FROM lineitem JOIN part ON p_partkey = l_partkey),
      g AS (SELECT l_orderkey, {P._WORST('s')} AS status, list(k::VARCHAR ORDER BY o, k) AS names, string_agg(lower(left(title, 1)) || substring(title, 2) || ' is ' || {_SAID}, '; ' ORDER BY o, k) AS what,
        flatten(list(evidence ORDER BY o, k)) AS e, flatten(list(CASE WHEN len(gaps) > 0 THEN gaps ELSE [title || ' (' || {_SAID} || ')'] END ORDER BY o, k) FILTER (WHERE s <> 'met')) AS gp,
        coalesce(string_agg(action, ' ' ORDER BY o, k) FILTER (WHERE s <> 'met'), '') AS actions FROM r GROUP BY ALL)
      SELECT l_orderkey, status, 'Taken from ' || CASE WHEN len(names) > 1 THEN 'items ' ELSE 'item ' END || {_NAMES.format('names')} || ': ' || what || '.' AS finding,
        array_to_string(e[:4], '; ') AS evidence, coalesce(array_to_string(gp[:6], '; '), '') AS gaps, actions FROM g""",
}
