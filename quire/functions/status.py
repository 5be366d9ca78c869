"""Statuses and the rules that combine them, as column expressions and aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire import fixed

NONE = "not-assessable"


def rank(status: Column) -> Column:
    """0 missing, 1 partly, 2 met; null where nothing was judged."""
    return F.coalesce(*[F.when(status == s, r) for s, r in fixed.STATUS_RANK.items()])


def named(r: Column) -> Column:
    return F.coalesce(*[F.when(r == n, s) for s, n in fixed.STATUS_RANK.items()], F.lit(NONE))


def worst(status: Column) -> Column:
    """Aggregate: the lowest judged status."""
    return named(F.min(rank(status)))


def across(status: Column) -> Column:
    """Aggregate: met if all are, missing if none is, otherwise partly."""
    r = rank(status)
    return F.when(F.count(r) == 0, NONE).when(F.min(r) == 2, "met").when(F.max(r) == 0, "missing").otherwise("partly")


def settle(status: Column, kept: Column) -> Column:
    """Without a quote that was found, met becomes partly and partly becomes missing."""
    bare = kept == 0
    return F.when(bare & (status == "met"), "partly").when(bare & (status == "partly"), "missing").otherwise(status)


def judge_clauses(local: Column, national: Column, relation: Column) -> tuple[Column, Column]:
    """Aggregates over one policy's clauses: its status and its finding."""
    own = F.count_if(local | national.isNull())
    clash = F.coalesce(F.bool_or(relation == "contradicts"), F.lit(False))
    status = F.when(own == 0, "missing").when((own == F.count("*")) & ~clash, "met").otherwise("partly")
    finding = (F.when(clash, "inconsistent").when(status == "met", "adds-local-detail")
               .when(status == "missing", "restates").otherwise("partly-restates"))
    return status, finding


def across_conditions(yes: Column, total: Column) -> Column:
    return F.when(yes == total, "met").when(yes == 0, "missing").otherwise("partly")


def labelled(quality: Column, toxic: Column) -> Column:
    """The judged status a label stands for."""
    return F.when(quality.isNull(), NONE).when((quality == 1) & (toxic == 0), "met").when(quality == 1, "partly").otherwise("missing")


def flagged(flag: Column) -> Column:
    """The judged status a return flag stands for."""
    return F.when(flag == "A", "met").when(flag == "N", "partly").otherwise("missing")
