"""Are recorded answers cited and grounded?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

EDGE = r"(?<![A-Za-z0-9_])"
DOT = "․"  # stands for a full stop that ends no sentence
# Words whose full stop ends no sentence before a number, and phrases that decline.
SHORT = "para|paras|reg|regs|s|ss|no|nos|art|sch|ch"
DECLINE = (
    r"do(?:es)? not (?:answer|cover|say|set|give|include|contain|address|provide|mention|specify)|don['’]t|doesn['’]t|cannot|can['’]t|unable|not able|"
    r"not covered|outside (?:\w+ )?scope|only help|not about|no information|nothing in the|isn['’]t covered|not something"
)


def paragraphs(answer: Column) -> Column:
    """An answer as an array of paragraphs, each an array of sentences."""
    text = F.regexp_replace(answer, r"\*\*|__|`", "")
    for pattern, into in ((rf"(?i){EDGE}(e)\.(g)\.", f"$1{DOT}$2{DOT}"), (rf"(?i){EDGE}(i)\.(e)\.", f"$1{DOT}$2{DOT}"),
                          (rf"(?i){EDGE}(cf|approx)\.", f"$1{DOT}"), (rf"(?i){EDGE}({SHORT})\.(?=\s*\d)", f"$1{DOT}"), (r"(\d)\.(\d)", f"$1{DOT}$2")):
        text = F.regexp_replace(text, pattern, into)
    marked = F.regexp_replace(text, r"([.!?](?:[^\S\n]*\[\d+\])*)[^\S\n]+(?=[A-Z“\"‘(])", "$1\u0001")
    bare = lambda s: T.strip(F.regexp_replace(s, r"^\s*(?:[-*•]|\d+\.)\s+", ""))
    each = F.transform(F.split(marked, r"\n+"), lambda p: F.filter(F.transform(F.split(p, "\u0001"), bare), lambda s: s.rlike("[A-Za-z]{2}")))
    return F.filter(each, lambda p: F.size(p) > 0)


def cites(s: Column) -> Column:
    return s.rlike(r"\[\d+\]")


def exempt(s: Column) -> Column:
    return s.rlike("(?i)legal advice") | (F.size(F.split(s, r"\s+")) < 4)


def citations(answer: Column) -> Column:
    return F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda n: n.cast("int"))


def declines(answer: Column) -> Column:
    return answer.rlike(rf"(?i){EDGE}(?:{DECLINE})(?![A-Za-z0-9_])")


def answer_checks(answers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, check, ok). `answers` holds answer, passages (ids in order), expect (ids or documents) and decline (null or why)."""
    df = answers.withColumn("_p", paragraphs(F.col("answer"))).withColumn("_c", citations(F.col("answer")))
    n = F.size("passages")
    exist = F.forall("_c", lambda c: (c >= 1) & (c <= n))
    bare = F.flatten(F.transform("_p", lambda p: F.filter(p, lambda s: ~cites(s) & ~exempt(s))))
    # A sentence is followed by a citation if one stands anywhere later in its paragraph.
    orphans = F.flatten(F.transform("_p", lambda p: F.filter(p, lambda s, i: ~cites(s) & ~exempt(s) & ~F.exists(F.slice(p, i + 2, F.size(p)), cites))))
    ids = F.array_compact(F.transform(F.array_distinct("_c"), lambda c: F.get("passages", c - 1)))
    good = lambda i, e: F.when(e.contains("#"), (i == e) | i.startswith(F.concat(e, F.lit(":")))).otherwise(i.startswith(F.concat(e, F.lit("#"))))
    expected = F.exists(ids, lambda i: F.exists("expect", lambda e: good(i, e)))
    refusal = declines(F.col("answer"))
    check = lambda name, ok: F.struct(F.lit(name).alias("check"), ok.alias("ok"))
    asked = F.array(check("citations exist", exist), check("every sentence cites", F.size(bare) == 0), check("nothing left uncited", F.size(orphans) == 0),
                    check("expected sources cited", expected), check("not a refusal", ~(refusal & (F.size("_c") == 0))))
    turned = F.array(check("citations exist", exist), F.struct(F.concat(F.lit("declines ("), "decline", F.lit(")")).alias("check"), refusal.alias("ok")))
    return df.select(*keys, F.inline(F.when(F.col("decline").isNotNull(), turned).otherwise(asked)))


def tally(checks: DataFrame, keys: list[str]) -> DataFrame:
    """Passes of each check, and answers that pass all of theirs."""
    each = checks.groupBy("check").agg(F.count_if("ok").alias("passed"), F.count("*").alias("total"))
    whole = checks.groupBy(*keys).agg(F.bool_and("ok").alias("ok")).agg(F.count_if("ok").alias("passed"), F.count("*").alias("total"))
    return each.unionByName(whole.select(F.lit("every check").alias("check"), "passed", "total"))


def recheck(cases: DataFrame, saved: DataFrame, order: str) -> DataFrame:
    """Cases (question, expect, decline) with the first saved answer to the same question."""
    first = saved.groupBy("question").agg(F.min_by(F.struct("answer", "passages"), order).alias("s"))
    return cases.join(first, "question").select(*cases.columns, "s.answer", "s.passages")
