"""Are quoted words really in a document?"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quire import fixed
from quire.functions import text as T
from quire.operators.terms import candidate_pairs


def usable_quotes(quotes: DataFrame, quote: str, min_length: int = 4, max_length: int = 1200) -> DataFrame:
    """Quotes with their pieces; too short or too long ones are out."""
    q = quotes.withColumn("pieces", T.quote_pieces(F.col(quote)))
    joined = F.length(F.array_join("pieces", ""))
    return q.where((F.size("pieces") > 0) & (joined >= min_length) & (F.length(F.array_join("pieces", " ")) <= max_length))


def in_order(norm: Column, pieces: Column) -> Column:
    """Every piece found, each after the one before."""
    def step(at, p):
        here = F.call_function("locate", p, norm, at)
        return F.when((at == 0) | (here == 0), 0).otherwise(here + F.length(p))

    return F.reduce(pieces, F.lit(1), step) > 0


# What a character folds to before lower case, as in T.normalise.
_FOLDS = (dict.fromkeys(fixed.FOLD_APOSTROPHE, "'") | dict.fromkeys(fixed.FOLD_QUOTE, '"') | dict.fromkeys(fixed.FOLD_DASH, "-")
          | dict.fromkeys(fixed.FOLD_NOTHING, "") | dict.fromkeys(fixed.FOLD_SPACE, " ") | {fixed.FOLD_ELLIPSIS: "..."})


def _folded(text: str) -> tuple[str, list[int]]:
    """A text folded, lowered and squeezed as the comparison does, and where each character of it came from."""
    kept = [(x, i) for i, c in enumerate(text) for x in _FOLDS.get(c, c)]
    places = [i for x, i in kept for _ in x.lower()]
    low = "".join([x for x, _ in kept]).lower()  # as a whole: what a letter becomes can depend on its neighbours, how long it gets cannot
    stays = [k for k, x in enumerate(low) if x != " " or (k and low[k - 1] != " ")]
    return "".join([low[k] for k in stays]), [places[k] for k in stays]


@F.pandas_udf(StringType())
def own_words(original: pd.Series, pieces: pd.Series) -> pd.Series:
    """The document's own words at the place of the pieces; elided pieces joined by an ellipsis."""
    def cut(text, parts):
        folded, places = _folded(text)
        at, shown = 0, []
        for p in parts:
            here = folded.find(p, at)
            if here < 0:
                return None
            at = here + len(p)
            shown.append(re.sub(r"\s+", " ", text[places[here]:places[at - 1] + 1]).strip())
        return " … ".join(shown)

    return pd.Series([cut(t, p) for t, p in zip(original, pieces)])


def verify_quotes(sections: DataFrame, doc: str, section: str, quotes: DataFrame, qkey: str, quote: str = "quote",
                  scope: DataFrame | None = None, min_length: int = 4, max_length: int = 1200) -> DataFrame:
    """(quote, document, section, pieces): the first section that holds all pieces of a quote in order.

    `sections` holds (document, section, text). With a `scope` of (quote,
    document, section) a quote is looked for in those sections only. Sections meet
    quotes on a rare word of the quote's longest piece, never pair by pair.
    """
    norm = sections.select(doc, section, T.normalise(F.col("text")).alias("norm")).withColumn("_s", F.struct(doc, section))
    q = usable_quotes(quotes, quote, min_length, max_length)
    longest = F.reduce("pieces", F.lit(""), lambda a, p: F.when(F.length(p) > F.length(a), p).otherwise(a))
    needles = q.select(qkey, longest.alias("needle"))
    if scope is not None:
        norm = norm.join(scope.select(doc, section).distinct(), [doc, section], "left_semi")
    pairs = candidate_pairs(norm, "_s", "norm", needles, qkey, "needle")
    if scope is not None:
        pairs = pairs.select(qkey, "_s", F.col(f"_s.{doc}").alias(doc), F.col(f"_s.{section}").alias(section)).join(
            scope, [qkey, doc, section], "left_semi").select(qkey, "_s")
    full = pairs.join(norm.select("_s", "norm"), "_s").join(q.select(qkey, "pieces"), qkey)
    good = full.where(in_order(F.col("norm"), F.col("pieces")))
    first = good.groupBy(qkey, F.col(f"_s.{doc}").alias(doc)).agg(F.min(F.col(f"_s.{section}")).alias(section), F.first("pieces").alias("pieces"))
    return first


def show_quotes(found: DataFrame, sections: DataFrame, doc: str, section: str) -> DataFrame:
    """Adds the document's own words; only sections that hold a quote are read for it."""
    return found.join(sections.select(doc, section, "text"), [doc, section]).withColumn(
        "shown", own_words(F.col("text"), F.col("pieces"))).drop("text", "pieces")


def quote_lists(quotes: DataFrame, found: DataFrame, lkey: str, qkey: str) -> DataFrame:
    """Per list: distinct quotes kept, and how many were not found. `found` holds one (quote, shown) per quote."""
    rows = quotes.join(found.withColumn("_found", F.lit(True)), qkey, "left")
    words = F.when(F.col("_found"), F.coalesce(T.normalise(F.col("shown")), F.concat(F.lit("#"), F.col(qkey).cast("string"))))
    return rows.groupBy(lkey).agg(F.count_distinct(words).alias("kept"), F.count_if(F.col("_found").isNull()).alias("dropped"))
