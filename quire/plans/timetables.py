"""Timetables: an order is a plan, its date the anchor, its key gives the durations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire import fixed
from quire.operators import timetables as TT
from quire.sources import files
from quire.sources.tables import table

K, G = "o_orderkey", "g1"


def _plans(spark, sf):
    """Durations from the key; those left out take their defaults."""
    k = F.col(K)
    return table(spark, sf, "orders").select(
        K, F.to_date("o_orderdate").alias(G), (2 + k % 4).cast("double").alias("notice_m"), F.when(k % 2 == 0, 5 + k % 4 + 0.5).alias("content_w"),
        (3 + k % 5).cast("double").alias("gateway2_w"), F.when(k % 3 == 0, F.lit(7.0)).alias("plan_w"), (k % 8).cast("double").alias("pause_m"),
        F.when(k % 5 == 0, 20.0).alias("scoping_w"))


def _text(df, *dates):
    return df.withColumns({d: F.col(d).cast("string") for d in dates})


def schedule_milestones(spark, sf):
    m = TT.milestones(_plans(spark, sf), K, G).select(K, "place", "id", "start", "end", "phase", "kind")
    return _text(m, "start", "end")


def month_week_maths(spark, sf):
    k, d = F.col(K), F.to_date("o_orderdate")
    m = table(spark, sf, "orders").select(K, TT.add_months(d, k % 25 - 12).alias("month"), TT.add_weeks(d, (k % 30) / 4).alias("week"), F.date_add(d, (k % 99).cast("int")).alias("day"))
    return _text(m, "month", "week", "day")


def months_to_adoption(spark, sf):
    return TT.months_to_adoption(_plans(spark, sf), K, G).select(K, F.round("months", 6).alias("months"))


def schedule_checks(spark, sf):
    return TT.checks(_plans(spark, sf), K, G)


def milestone_order(spark, sf):
    return TT.milestone_order(_plans(spark, sf), K, G)


def _timetable(spark, sf):
    return TT.plan_timetable(_plans(spark, sf), K, G, F.concat(F.lit("LP-"), K), "2026-10-01")


def plan_timetable(spark, sf):
    return _timetable(spark, sf).select("reference", "plan", F.col("plan-event").alias("event"), F.col("event-date").alias("event_date"))


def missing_events(spark, sf):
    """A line numbered n reports the plan's event 2n."""
    names = F.array(*[F.lit(e) for e, *_ in fixed.PLAN_EVENTS])
    present = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias(K), F.get(names, (F.col("l_linenumber") * 2 % 15).cast("int")).alias("event"))
    return TT.missing_events(table(spark, sf, "orders").select(K), K, present)


def input_rules(spark, sf):
    k = F.col(K)
    date = F.format_string("%d-%02d-%02d", 2000 + k % 120, k % 13, k % 32)
    plans = table(spark, sf, "orders").select(K, F.when(k % 4 == 0, F.concat(F.lit("LP BRX "), K)).when(k % 4 == 1, F.concat(F.lit("-lp"), K)).otherwise(F.concat(F.lit("barnet_plan-"), K)).alias("reference"),
                                              date.alias("date_text"), (k % 150 - 5).alias("notice_m"), F.when(k % 9 != 0, k % 125).alias("plan_w"))
    return TT.input_errors(plans, K, ["notice_m", "plan_w"])


def phase_spans(spark, sf):
    return _text(TT.phase_spans(_plans(spark, sf), K, G), "first", "last", "clock_end")


def calendar_quarters(spark, sf):
    return _text(TT.calendar_quarters(_plans(spark, sf), K, G), "quarter")


def timetable_csv_sink(spark, sf):
    """The dataset written as CSV and its lines read back, without the header each file starts with."""
    path = files.scratch(spark, "timetable")
    files.write_timetable_csv(_timetable(spark, sf), path, compression="gzip")
    return spark.read.text(path, lineSep="\r\n").where("value not like 'reference,%'").select(F.col("value").alias("line"))


def milestone_csv_sink(spark, sf):
    path = files.scratch(spark, "milestones")
    m = TT.milestones(_plans(spark, sf), K, G)
    files.write_milestone_csv(m.select(F.col(K).cast("string").alias("Plan"), F.col("label").alias("Milestone"), F.col("start").cast("string").alias("Start"), F.col("end").cast("string").alias("End")), path, compression="gzip")
    return spark.read.text(path, lineSep="\r\n").where("value not like '\"Plan\"%'").select(F.col("value").alias("line"))


QUERIES = {f.__name__: f for f in (
    schedule_milestones, month_week_maths, months_to_adoption, schedule_checks, milestone_order, plan_timetable, missing_events, input_rules, phase_spans,
    calendar_quarters, timetable_csv_sink, milestone_csv_sink)}

_M = lambda d, n: f"CAST({d} + to_months(({n})::INT) AS DATE)"
_W = lambda d, n: f"({d} + floor(({n}) * 7 + 0.5)::INT)"
_CHAIN = f"""p AS (SELECT o_orderkey, o_orderkey AS k, o_orderdate::DATE AS g1, 2 + o_orderkey % 4 AS notice_m, CASE WHEN o_orderkey % 2 = 0 THEN 5 + o_orderkey % 4 + 0.5 ELSE 6 END AS content_w,
    3 + o_orderkey % 5 AS gateway2_w, CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE 8 END AS plan_w, o_orderkey % 8 AS pause_m, CASE WHEN o_orderkey % 5 = 0 THEN 20 ELSE 4 END AS scoping_w FROM orders),
  c1 AS (SELECT *, {_M('g1', '-notice_m')} AS notice, {_W('g1', '26')} AS content FROM p), c2 AS (SELECT *, {_W('notice', 'scoping_w')} AS scoping_end, {_W('content', 'content_w')} AS content_end FROM c1),
  c3 AS (SELECT *, content_end + 14 AS content_summary, content_end + 14 + 140 AS g2 FROM c2), c4 AS (SELECT *, {_W('g2', 'gateway2_w')} AS g2_end FROM c3),
  c5 AS (SELECT *, g2_end + 7 AS g2_publish, g2_end + 63 AS plan FROM c4), c6 AS (SELECT *, {_W('plan', 'plan_w')} AS plan_end FROM c5), c7 AS (SELECT *, plan_end + 21 AS plan_summary, plan_end + 49 AS g3 FROM c6),
  c8 AS (SELECT *, g3 + 28 AS g3_end, g3 + 49 AS submission FROM c7), c9 AS (SELECT *, {_M(_M('submission', '6'), 'pause_m')} AS exam_end FROM c8), c AS (SELECT *, exam_end + 28 AS adoption FROM c9)"""
_DATES = {
    "timetable": ("notice", "notice"), "notice": ("notice", "notice"), "scoping": ("notice", "scoping_end"), "gateway-1": ("g1", "g1"), "scoping-summary": ("g1 + 7", "g1 + 7"),
    "content": ("content", "content_end"), "sea-scope": ("content + 35", "content + 35"), "content-summary": ("content_summary",) * 2, "g2-notice": (_M("g2", "-3"),) * 2,
    "gateway-2": ("g2", "g2_end"), "g2-publish": ("g2_publish",) * 2, "plan": ("plan", "plan_end"), "plan-summary": ("plan_summary",) * 2, "g3-notice": (_M("g3", "-3"),) * 2,
    "gateway-3": ("g3", "g3_end"), "submission": ("submission",) * 2, "examination": ("submission", "exam_end"), "hearing-notice": (_M("submission", "3") + " - 42",) * 2,
    "report": ("exam_end",) * 2, "report-publish": ("exam_end + 7",) * 2, "adoption": ("adoption",) * 2, "policies-map": (_M("adoption", "1"),) * 2,
    "evaluation": (_M("adoption", "48"),) * 2, "next-plan": (_M("adoption", "60"),) * 2,
}
_Q = lambda s: s.replace("'", "''")
_MS = f"""WITH {_CHAIN}, ms AS ({" UNION ALL ".join(f"SELECT k, g1, {n} AS seq, '{i}' AS id, '{_Q(label)}' AS label, '{phase}' AS phase, '{kind}' AS kind, {_DATES[i][0]} AS s, {_DATES[i][1]} AS e FROM c" for n, (i, label, phase, kind) in enumerate(fixed.MILESTONES))})"""
_EVENTS = ", ".join(f"('{e}', '{m}', '{side}', {needed}, {n})" for n, (e, m, side, needed) in enumerate(fixed.PLAN_EVENTS))
_TIMETABLE = f"""{_MS}, ev AS (FROM (VALUES {_EVENTS}) t(event, mid, side, needed, n)),
  tt AS (SELECT 'LP-' || k || '-' || event AS reference, 'LP-' || k AS plan, event, (CASE WHEN side = 'end' THEN e ELSE s END)::VARCHAR AS event_date FROM ms JOIN ev ON id = mid)"""
_LATE = " + ".join(f"({_DATES[b][0]} < {_DATES[a][0]})::INT" for a, b in zip(TT.LEGAL_ORDER, TT.LEGAL_ORDER[1:]))

ORACLES = {
    "schedule_milestones": f'{_MS} SELECT k AS o_orderkey, (row_number() OVER (PARTITION BY k ORDER BY s, seq) - 1)::INT AS place, id, s::VARCHAR AS start, e::VARCHAR AS "end", phase, kind FROM ms',
    "month_week_maths": f"""SELECT o_orderkey, ({_M('o_orderdate::DATE', 'o_orderkey % 25 - 12')})::VARCHAR AS month, ({_W('o_orderdate::DATE', '(o_orderkey % 30) / 4')})::VARCHAR AS week, (o_orderdate::DATE + (o_orderkey % 99)::INT)::VARCHAR AS day FROM orders""",
    "months_to_adoption": f"WITH {_CHAIN} SELECT o_orderkey, round((adoption - g1) / 30.4375::DOUBLE, 6) AS months FROM c",
    "schedule_checks": f"""WITH {_CHAIN} SELECT o_orderkey, 'notice' AS "check", notice_m >= 4 AS ok FROM c UNION ALL SELECT o_orderkey, 'scoping', scoping_end < g1 FROM c UNION ALL SELECT o_orderkey, 'scoping-length', scoping_w * 7 >= 21 FROM c
      UNION ALL SELECT o_orderkey, 'content', content_w >= 6 FROM c UNION ALL SELECT o_orderkey, 'plan', plan_w >= 8 FROM c UNION ALL SELECT o_orderkey, 'g2', gateway2_w BETWEEN 4 AND 6 FROM c UNION ALL SELECT o_orderkey, 'g3', true FROM c
      UNION ALL SELECT o_orderkey, 'pause', pause_m <= 6 FROM c UNION ALL SELECT o_orderkey, 'exam', true FROM c UNION ALL SELECT o_orderkey, 'thirty', (adoption - g1) / 30.4375 <= 31 FROM c""",
    "milestone_order": f"WITH {_CHAIN}, l AS (SELECT o_orderkey, {_LATE} AS out_of_order FROM c) SELECT *, out_of_order = 0 AS ok FROM l",
    "plan_timetable": f"{_TIMETABLE} FROM tt",
    "missing_events": f"""WITH ev AS (FROM (VALUES {_EVENTS}) t(event, mid, side, needed, n)), x AS (SELECT o_orderkey, event, n FROM orders CROSS JOIN ev WHERE needed)
      SELECT o_orderkey, event FROM x WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber * 2 % 15 = n)""",
    "input_rules": """WITH i AS (SELECT o_orderkey AS k, try_cast(printf('%d-%02d-%02d', 2000 + o_orderkey % 120, o_orderkey % 13, o_orderkey % 32) AS DATE) AS d FROM orders)
      SELECT k AS o_orderkey, 'reference' AS field FROM i WHERE k % 4 < 2 UNION ALL SELECT k, 'gateway1' FROM i WHERE d IS NULL OR year(d) NOT BETWEEN 2025 AND 2100
      UNION ALL SELECT k, 'notice_m' FROM i WHERE k % 150 - 5 NOT BETWEEN 0 AND 120 UNION ALL SELECT k, 'plan_w' FROM i WHERE k % 9 = 0 OR k % 125 > 120""",
    "phase_spans": f"""{_MS}, g AS (SELECT k, phase, min(s) AS first, max(e) AS last, count(*)::INT AS n, {_M('any_value(g1)', '30')} AS clock_end FROM ms WHERE phase <> 'monitor' GROUP BY k, phase)
      SELECT k AS o_orderkey, phase, first::VARCHAR AS first, last::VARCHAR AS last, n, clock_end::VARCHAR AS clock_end, last > clock_end AS overrun FROM g""",
    "calendar_quarters": f"""{_MS}, r AS (SELECT k, min(s) AS a, greatest(max(e), {_M('any_value(g1)', '30')}) + 20 AS b FROM ms WHERE phase <> 'monitor' GROUP BY k),
      q AS (SELECT k, a, b, unnest(generate_series(date_trunc('quarter', a)::TIMESTAMP, b::TIMESTAMP, INTERVAL 3 MONTH))::DATE AS quarter FROM r)
      SELECT k AS o_orderkey, quarter::VARCHAR AS quarter, month(quarter) = 1 AS new_year FROM q WHERE (a - quarter) * 760 <= b - a""",
    "timetable_csv_sink": f"{_TIMETABLE} SELECT reference || ',' || plan || ',' || event || ',' || event_date || ',2026-10-01,,' AS line FROM tt",
    "milestone_csv_sink": f"""{_MS} SELECT '"' || k || '","' || label || '","' || s || '","' || e || '"' AS line FROM ms""",
}
