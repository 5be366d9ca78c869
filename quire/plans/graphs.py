"""Links between pages, references, flows and checklists."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import graphs as G
from quire.sources.tables import pages, table


def _site(spark, sf):
    """Pages under /p/<id>, each with an id, a code sample and a link to the next page added."""
    i = F.col("page_id")
    extra = F.concat(F.lit('<p id="s'), i % 7, F.lit('"></p><pre> href="/not-a-link"</pre><a href="../p/./'), i + 1, F.lit("?q=1#s"), i % 5, F.lit('"></a><a href="#s'), i % 3, F.lit('"></a>'))
    return pages(spark, sf).select("page_id", F.concat("html", extra).alias("html"), F.concat(F.lit("/p/"), i).alias("target"))


def page_links(spark, sf):
    return G.page_links(_site(spark, sf), "page_id")


def broken_links(spark, sf):
    site = _site(spark, sf)
    links = G.page_links(site, "page_id").withColumn("target", G.resolve_path(F.concat(F.lit("/p/"), "page_id"), F.col("path")))
    return G.broken_links(links, site, G.page_ids(site, "target")).select("page_id", "at", "target", "frag", "fault")


def resolve_refs(spark, sf):
    """Line items refer to parts by key and size; suppliers' lines without discount name no anchor."""
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", (F.col("l_partkey") * 2 - 500).alias("doc"), F.when(F.col("l_discount") > 0, F.col("l_suppkey") % 50).alias("anchor"))
    p = table(spark, sf, "part")
    route = F.concat(F.lit("/part/"), "p_partkey", F.lit("/"))
    return G.resolve_refs(l, p.select(F.col("p_partkey").alias("doc"), route.alias("route")), p.select(F.col("p_partkey").alias("doc"), F.col("p_size").cast("bigint").alias("anchor"), route.alias("route"))).select(
        "l_orderkey", "l_linenumber", "doc", "href", "state")


def stage_neighbours(spark, sf):
    n = F.col("n_nationkey")
    stages = table(spark, sf, "nation").select(
        n.cast("string").alias("stage"), F.array(*[x.cast("string") for x in (n + 1, n + 5, n * 2)]).alias("next"), F.col("n_regionkey").cast("string").alias("phase"))
    r = F.col("r_regionkey")
    phases = table(spark, sf, "region").select(F.explode(F.array(r.cast("string"), (r + 5).cast("string"))).alias("phase"))
    return G.stage_neighbours(stages, phases)


def flow_reach(spark, sf):
    """A user's events are a question's options; where one leads depends on k, and never from even to odd."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    u = F.col("user_id")
    options = table(spark, sf, "events").select(u.alias("question"), (2 * ((u * 3 + k * k) % 85) + u % 2).alias("target")).distinct()
    start = options.agg(F.min("question").alias("node"))
    return G.flow_faults(options, start)


def route_table(spark, sf):
    t = lambda n, c: table(spark, sf, n).select(F.col(c).alias("name"), F.col(c).alias("title"))
    return G.route_table([("stage", t("nation", "n_name")), ("phase", t("region", "r_name")), ("result", t("customer", "c_name")), ("reference", t("supplier", "s_name"))])


def duplicate_keys(spark, sf):
    p = table(spark, sf, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("term"))
    return G.duplicate_keys(p, "term")


def checklist_progress(spark, sf):
    items = table(spark, sf, "orders").select("o_orderpriority", "o_orderkey", (F.col("o_orderstatus") == "P").alias("must"))
    ticks = table(spark, sf, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"))
    return G.checklist_progress(items, ticks, "o_orderpriority", "o_orderkey")


QUERIES = {f.__name__: f for f in (page_links, broken_links, resolve_refs, stage_neighbours, flow_reach, route_table, duplicate_keys, checklist_progress)}

_LINKS = r"""WITH s AS (SELECT page_id, html || '<p id="s' || (page_id % 7) || '"></p><pre> href="/not-a-link"</pre><a href="../p/./' || (page_id + 1) || '?q=1#s' || (page_id % 5) || '"></a><a href="#s' || (page_id % 3) || '"></a>' AS html FROM pages),
  x AS (SELECT page_id, regexp_extract_all(regexp_replace(html, '<pre[\s\S]*?</pre>', '', 'g'), '\s(?:href|src)="([^"]+)"', 1) AS l FROM s),
  r AS (SELECT page_id, generate_subscripts(l, 1) - 1 AS at_, unnest(l) AS raw FROM x),
  links AS (SELECT page_id, at_, raw, string_split(string_split(raw, '#')[1], '?')[1] AS path, coalesce(string_split(raw, '#')[2], '') AS frag FROM r WHERE NOT regexp_matches(raw, '^(https?:|mailto:|data:|javascript:|#$)'))"""

ORACLES = {
    "page_links": f'{_LINKS} SELECT page_id, at_ AS "at", raw, path, frag FROM links',
    "broken_links": rf"""{_LINKS}, t AS (SELECT *, CASE WHEN path = '' THEN '/p/' || page_id WHEN path LIKE '../p/./%' THEN '/p/' || path[8:] ELSE '/' || array_to_string(list_filter(string_split(path, '/'), lambda p: p <> ''), '/') END AS target FROM links),
      ids AS (SELECT DISTINCT '/p/' || page_id AS target, unnest(regexp_extract_all(html, '\sid="([^"]+)"', 1)) AS frag FROM s)
      SELECT page_id, at_ AS "at", target, frag, CASE WHEN target NOT IN (SELECT '/p/' || page_id FROM pages) THEN 'missing' WHEN frag <> '' AND (target, frag) NOT IN (SELECT (target, frag) FROM ids) THEN 'no id' ELSE '' END AS fault FROM t""",
    "resolve_refs": """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey * 2 - 500 AS doc, CASE WHEN l_discount > 0 THEN l_suppkey % 50 END AS anchor FROM lineitem),
      j AS (SELECT l.*, p_partkey, p_size, CASE WHEN p_partkey IS NULL THEN 'unknown source' WHEN anchor IS NULL THEN 'source' WHEN anchor <> p_size THEN 'missing' ELSE 'ok' END AS state FROM l LEFT JOIN part ON p_partkey = doc)
      SELECT l_orderkey, l_linenumber, doc, CASE state WHEN 'unknown source' THEN '#' WHEN 'ok' THEN '/part/' || doc || '/#' || anchor ELSE '/part/' || doc || '/' END AS href, state FROM j""",
    "stage_neighbours": """WITH s AS (SELECT n_nationkey AS n, n_regionkey AS r FROM nation), e AS (SELECT n, generate_subscripts([1, 2, 3], 1) - 1 AS place, unnest([n + 1, n + 5, n * 2]) AS o FROM s), f AS (SELECT * FROM e WHERE o IN (SELECT n FROM s))
      SELECT n::VARCHAR AS stage, 'next' AS direction, place, o::VARCHAR AS other FROM f UNION ALL SELECT DISTINCT o::VARCHAR, 'previous', 0, n::VARCHAR FROM f UNION ALL SELECT (r_regionkey + 5)::VARCHAR, 'unused phase', 0, '' FROM region""",
    "flow_reach": """WITH RECURSIVE o AS (SELECT DISTINCT user_id AS q, 2 * ((user_id * 3 + k * k) % 85) + user_id % 2 AS t FROM (SELECT user_id, json_extract(props, '$.k')::BIGINT AS k FROM events)),
      e AS (SELECT q, t FROM o WHERE t IN (SELECT q FROM o)), r AS (SELECT min(q) AS n FROM o UNION SELECT t FROM e JOIN r ON e.q = r.n)
      SELECT DISTINCT q AS node, 'unreachable' AS fault FROM o WHERE q NOT IN (SELECT n FROM r) UNION ALL SELECT DISTINCT q, 'goes nowhere' FROM o WHERE t NOT IN (SELECT q FROM o) UNION ALL SELECT q, 'fewer than two options' FROM o GROUP BY q HAVING count(*) < 2""",
    "route_table": """WITH r AS (SELECT 'stage' AS kind, n_name AS n FROM nation UNION ALL SELECT 'phase', r_name FROM region UNION ALL SELECT 'result', c_name FROM customer UNION ALL SELECT 'reference', s_name FROM supplier)
      SELECT kind, '/' || kind || '/' || regexp_replace(regexp_replace(lower(n), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') || '/' AS route, n AS title FROM r""",
    "duplicate_keys": "SELECT lower(p_name) AS key, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1",
    "checklist_progress": """WITH i AS (SELECT o_orderpriority, o_orderstatus = 'P' AS must, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A') AS t FROM orders)
      SELECT o_orderpriority, count(*) FILTER (WHERE t) AS done, count(*) AS total, count(*) FILTER (WHERE t AND must) AS must_done, count(*) FILTER (WHERE must) AS must_total FROM i GROUP BY ALL""",
}
