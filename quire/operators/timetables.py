"""One date per plan to a statutory timetable. Every plan is one row; nothing shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import fixed


def add_weeks(d: Column, weeks: Column) -> Column:
    """Whole days, halves rounded up."""
    return F.date_add(d, F.floor(weeks * 7 + F.lit(0.5)).cast("int"))


def add_months(d: Column, months: Column) -> Column:
    """Clamped to the end of the month."""
    return F.add_months(d, months.cast("int"))


def months_between(a: Column, b: Column) -> Column:
    return F.datediff(b, a) / F.lit(30.4375)


def _dates(plans: DataFrame, anchor: str) -> tuple[DataFrame, dict[str, tuple[Column, Column]]]:
    """Each step of the chain as its own column, so that no expression is repeated inside another."""
    have = set(plans.columns)
    df = plans.withColumns({
        f"_{k}": F.coalesce(F.col(k), F.lit(float(v))) if k in have else F.lit(float(v)) for k, v in fixed.DURATIONS.items()})
    d = lambda k: F.col(f"_{k}")
    g1 = F.col(anchor)
    steps = [
        ("notice", add_months(g1, -d("notice_m"))),
        ("scoping_end", add_weeks(F.col("_d_notice"), d("scoping_w"))),
        ("content", add_weeks(g1, d("prep_w"))),
        ("content_end", add_weeks(F.col("_d_content"), d("content_w"))),
        ("content_summary", F.date_add("_d_content_end", 14)),
        ("g2", add_weeks(F.col("_d_content_summary"), d("collate_w"))),
        ("g2_end", add_weeks(F.col("_d_g2"), d("gateway2_w"))),
        ("g2_publish", F.date_add("_d_g2_end", 7)),
        ("plan", add_weeks(F.col("_d_g2_publish"), d("revise_w"))),
        ("plan_end", add_weeks(F.col("_d_plan"), d("plan_w"))),
        ("plan_summary", F.date_add("_d_plan_end", 21)),
        ("g3", add_weeks(F.col("_d_plan_summary"), d("finalise_w"))),
        ("g3_end", add_weeks(F.col("_d_g3"), d("gateway3_w"))),
        ("submission", F.date_add("_d_g3_end", 21)),
        ("exam_end", add_months(add_months(F.col("_d_submission"), d("exam_m")), d("pause_m"))),
        ("adoption", add_weeks(F.col("_d_exam_end"), d("adoption_w"))),
    ]
    for name, date in steps:
        df = df.withColumn(f"_d_{name}", date)
    at = lambda k: F.col(f"_d_{k}")
    one = lambda c: (c, c)
    m = F.lit
    return df, {
        "timetable": one(at("notice")), "notice": one(at("notice")), "scoping": (at("notice"), at("scoping_end")), "gateway-1": one(g1),
        "scoping-summary": one(F.date_add(g1, 7)), "content": (at("content"), at("content_end")), "sea-scope": one(F.date_add(at("content"), 35)),
        "content-summary": one(at("content_summary")), "g2-notice": one(add_months(at("g2"), m(-3))), "gateway-2": (at("g2"), at("g2_end")),
        "g2-publish": one(at("g2_publish")), "plan": (at("plan"), at("plan_end")), "plan-summary": one(at("plan_summary")),
        "g3-notice": one(add_months(at("g3"), m(-3))), "gateway-3": (at("g3"), at("g3_end")), "submission": one(at("submission")),
        "examination": (at("submission"), at("exam_end")), "hearing-notice": one(F.date_add(add_months(at("submission"), m(3)), -42)),
        "report": one(at("exam_end")), "report-publish": one(F.date_add(at("exam_end"), 7)), "adoption": one(at("adoption")),
        "policies-map": one(add_months(at("adoption"), m(1))), "evaluation": one(add_months(at("adoption"), m(48))),
        "next-plan": one(add_months(at("adoption"), m(60))),
    }


def milestones(plans: DataFrame, key: str, anchor: str) -> DataFrame:
    """One row per milestone in date order, ties in creation order. Missing durations take their defaults.

    Dates stay in plain arrays and the order in one number per milestone, so a
    plan's 24 rows come from a sort of 24 integers.
    """
    df, dates = _dates(plans, anchor)
    starts = F.array(*[dates[i][0] for i, *_ in fixed.MILESTONES])
    ends = F.array(*[dates[i][1] for i, *_ in fixed.MILESTONES])
    df = df.select(key, starts.alias("_s"), ends.alias("_e"))
    order = F.sort_array(F.transform("_s", lambda d, n: F.unix_date(d) * 32 + n))
    # The outer form, so that no test for an empty list is pushed through the whole chain of dates.
    rows = df.select(key, "_s", "_e", F.posexplode_outer(order).alias("place", "_k")).withColumn("seq", F.pmod("_k", F.lit(32)))
    word = lambda n: F.get(F.array(*[F.lit(m[n]) for m in fixed.MILESTONES]), F.col("seq"))
    return rows.select(key, "place", word(0).alias("id"), word(1).alias("label"), F.get("_s", F.col("seq")).alias("start"),
                       F.get("_e", F.col("seq")).alias("end"), word(2).alias("phase"), word(3).alias("kind"), "seq")


def months_to_adoption(plans: DataFrame, key: str, anchor: str) -> DataFrame:
    df, _ = _dates(plans, anchor)
    return df.select(key, months_between(F.col(anchor), F.col("_d_adoption")).alias("months"))


def checks(plans: DataFrame, key: str, anchor: str) -> DataFrame:
    """(plan, check, ok) for the ten statutory checks."""
    df, _ = _dates(plans, anchor)
    d = lambda k: F.col(f"_{k}")
    rules = [
        ("notice", d("notice_m") >= 4), ("scoping", F.col("_d_scoping_end") < F.col(anchor)), ("scoping-length", d("scoping_w") * 7 >= 21),
        ("content", d("content_w") >= 6), ("plan", d("plan_w") >= 8), ("g2", d("gateway2_w").between(4, 6)), ("g3", d("gateway3_w").between(4, 6)),
        ("pause", d("pause_m") <= 6), ("exam", d("exam_m") <= 6), ("thirty", months_between(F.col(anchor), F.col("_d_adoption")) <= 31),
    ]
    return df.select(key, F.inline(F.array(*[F.struct(F.lit(n).alias("check"), ok.alias("ok")) for n, ok in rules])))


# The order the law lays down.
LEGAL_ORDER = ["timetable", "notice", "scoping", "gateway-1", "scoping-summary", "content", "content-summary", "gateway-2", "g2-publish", "plan",
               "plan-summary", "gateway-3", "submission", "examination", "report", "adoption", "policies-map", "next-plan"]


def milestone_order(plans: DataFrame, key: str, anchor: str) -> DataFrame:
    """Whether the legally ordered milestones start in that order, and how many do not."""
    df, dates = _dates(plans, anchor)
    late = [F.when(dates[b][0] < dates[a][0], 1).otherwise(0) for a, b in zip(LEGAL_ORDER, LEGAL_ORDER[1:])]
    total = late[0]
    for x in late[1:]:
        total = total + x
    return df.select(key, total.alias("out_of_order")).withColumn("ok", F.col("out_of_order") == 0)


def plan_timetable(plans: DataFrame, key: str, anchor: str, plan: Column, entry_date: str) -> DataFrame:
    """The published dataset: one row per plan event, dated from a milestone."""
    df, dates = _dates(plans, anchor)
    event = F.array(*[F.struct(F.lit(e).alias("event"), dates[m][1 if side == "end" else 0].alias("date")) for e, m, side, _ in fixed.PLAN_EVENTS])
    rows = df.select(plan.alias("plan"), F.inline(event))
    date = F.col("date")
    return rows.select(
        F.concat("plan", F.lit("-"), "event").alias("reference"), "plan", F.col("event").alias("plan-event"), date.cast("string").alias("event-date"),
        F.lit(entry_date).alias("entry-date"), F.lit("").alias("actual-date"), F.lit("").alias("notes"))


def missing_events(plans: DataFrame, key: str, present: DataFrame) -> DataFrame:
    """Required events a plan lacks."""
    required = F.array(*[F.lit(e) for e, _, _, needed in fixed.PLAN_EVENTS if needed])
    return plans.select(key, F.explode(required).alias("event")).join(present, [key, "event"], "left_anti")


def input_errors(plans: DataFrame, key: str, durations: list[str]) -> DataFrame:
    """(plan, field) for every input that cannot be used: reference, date text, or a duration."""
    date = F.try_to_date(F.col("date_text"), "yyyy-MM-dd")
    broken = [("reference", ~F.col("reference").rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,99}$")),
              ("gateway1", date.isNull() | ~F.year(date).between(2025, 2100))]
    broken += [(c, F.col(c).isNull() | ~F.col(c).between(0, 120)) for c in durations]
    return plans.select(key, F.explode(F.array_compact(F.array(*[F.when(b, F.lit(n)) for n, b in broken]))).alias("field"))


def phase_spans(plans: DataFrame, key: str, anchor: str) -> DataFrame:
    """First and last date and size of each phase, the end of the 30 months, and whether the plan overruns it."""
    df, dates = _dates(plans, anchor)
    clock = F.add_months(anchor, 30)
    of = {p: [dates[i] for i, _, phase, _ in fixed.MILESTONES if phase == p] for p in fixed.PHASES}
    spans = F.array(*[F.struct(F.lit(p).alias("phase"), F.least(*[d[0] for d in of[p]]).alias("first"),
                               F.greatest(*[d[1] for d in of[p]]).alias("last"), F.lit(len(of[p])).alias("n")) for p in fixed.PHASES])
    rows = df.select(key, clock.alias("clock_end"), F.inline(spans))
    return rows.withColumn("overrun", F.col("last") > F.col("clock_end"))


def calendar_quarters(plans: DataFrame, key: str, anchor: str) -> DataFrame:
    """Quarter starts across the plotted range, with the years marked."""
    df, dates = _dates(plans, anchor)
    shown = [dates[i] for i, _, phase, _ in fixed.MILESTONES if phase in fixed.PHASES]
    a = F.least(*[d[0] for d in shown])
    b = F.date_add(F.greatest(*[d[1] for d in shown], F.add_months(anchor, 30)), 20)
    r = df.select(key, a.alias("a"), b.alias("b"))
    # A gridline may stand at most one of the chart's 760 units left of its start.
    seen = F.filter(F.expr("sequence(cast(trunc(a, 'quarter') as date), b, interval 3 months)"),
                    lambda q: F.datediff(F.col("a"), q) * 760 <= F.datediff(F.col("b"), F.col("a")))
    r = r.select(key, F.explode_outer(seen).alias("quarter"))
    return r.select(key, "quarter", (F.month("quarter") == 1).alias("new_year"))
