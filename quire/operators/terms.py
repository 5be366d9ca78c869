"""Terms, postings and vocabulary joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import fixed
from quire.functions import text as T
from quire.operators.scale import small
from quire.session import written


def split_heading(docs: DataFrame) -> DataFrame:
    """The first line as the heading, the rest as the body."""
    return docs.withColumn("heading", F.regexp_extract("text", r"^[^\n]*", 0)).withColumn(
        "body", F.regexp_replace("text", r"^[^\n]*\n?", "")
    )


def term_rows(df: DataFrame, keys: list[str], text: Column, kept_as: str = "term") -> DataFrame:
    """One row per stemmed term occurrence; filter and stem run in generated code after the explode."""
    raw = df.select(*keys, F.explode(T.words(text)).alias("_w"))
    kept = raw.where((F.length("_w") > 1) & ~F.col("_w").isin(fixed.STEM_STOP))
    return kept.withColumn(kept_as, T.stem(F.col("_w"))).drop("_w")


def index_rows(df: DataFrame, keys: list[str], text: Column, kept_as: str = "term") -> DataFrame:
    """One row per index term occurrence."""
    raw = df.select(*keys, F.explode(T.tokens(F.lower(text))).alias(kept_as))
    return raw.where((F.length(kept_as) > 1) & ~F.col(kept_as).isin(fixed.INDEX_STOP))


def counted(text: Column) -> Column:
    """array<struct<term, tf>> of a text's index terms, counted inside the row: its words sorted, then cut where the next one begins."""
    def cut(words):
        starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)))
        run = lambda at: F.transform(at, lambda i, j: F.struct(
            F.get(words, i).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(words)) - i).alias("tf")))
        return T.once(starts, run)

    runs = T.once(F.sort_array(T.tokens(F.lower(text))), cut)
    return F.filter(runs, lambda x: (F.length(x["term"]) > 1) & ~x["term"].isin(fixed.INDEX_STOP))


MARK = "\u0000"


def marker(key: str) -> Column:
    """A term no vocabulary holds, one of many, so that every passage leaves a row and none share one join key."""
    return F.concat(F.lit(MARK), F.pmod(F.xxhash64(key), F.lit(4096)).cast("string"))


def in_vocabulary(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Terms outside the vocabulary become null, so that what is counted per passage stays whole."""
    known = vocabulary.select("term", F.lit(True).alias("_in"))
    return rows.join(known, "term", "left").withColumn("term", F.when(F.col("_in"), F.col("term"))).drop("_in")


def weighted_postings(passages: DataFrame, key: str, vocabulary: DataFrame | None = None) -> DataFrame:
    """(passage, len, term, tf): text terms count once, heading terms three times.

    One pass over the text gives both the postings and each passage's weighted
    length. With a vocabulary all other terms of a passage fall into one row
    without a term before the shuffle; every passage has at least one row.
    """
    wanted = lambda text: F.filter(T.words(F.col(text)), lambda w: (F.length(w) > 1) & ~w.isin(fixed.STEM_STOP))
    split = passages.select(key, wanted("body").alias("_b"), wanted("heading").alias("_h"))
    length = F.size("_b") + F.size("_h") * fixed.HEADING_WEIGHT
    sides = F.array(F.struct(F.array_append("_b", marker(key)).alias("words"), F.lit(1).alias("w")), F.struct(F.col("_h").alias("words"), F.lit(fixed.HEADING_WEIGHT).alias("w")))
    raw = split.select(key, length.cast("long").alias("len"), F.inline(sides)).select(key, "len", "w", F.explode("words").alias("_w"))
    mark = F.col("_w").startswith(MARK)
    rows = raw.select(key, "len", F.when(mark, 0).otherwise(F.col("w")).alias("weight"), F.when(mark, F.col("_w")).otherwise(T.stem(F.col("_w"))).alias("term"))
    if vocabulary is not None:
        rows = in_vocabulary(rows, vocabulary)
    else:
        rows = rows.withColumn("term", F.when(~F.col("term").startswith(MARK), F.col("term")))
    return rows.groupBy(key, "len", "term").agg(F.sum("weight").alias("tf"))


def query_terms(queries: DataFrame, key: str, text: str = "text") -> DataFrame:
    return term_rows(queries, [key], F.col(text)).distinct()


def vocabulary_prefixes(query_side: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(qterm, term) where the vocabulary term starts with a longer-than-itself query term.

    Every vocabulary term is cut to its prefixes no longer than the longest
    query term, so the match is an equi join.
    """
    longest = query_side.agg(F.max(F.length("qterm")).alias("m")).select("m").scalar()
    cuts = F.sequence(F.lit(1), F.least(F.length("term") - 1, longest))
    prefixes = vocabulary.where(F.length("term") > 1).select("term", F.explode(cuts).alias("n"))
    prefixes = prefixes.select("term", F.left("term", F.col("n")).alias("qterm"))
    return prefixes.join(small(written(query_side, "query-terms")), "qterm").select("qterm", "term")


def vocabulary_near(query_side: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(qterm, term, distance) within round(0.15 x length) edits, at most six.

    A term within d edits keeps one of d + 1 pieces of the query term whole, at
    most d places from where it was, so candidates come from an equi join on
    (length, place, piece); the edit distance then decides.
    """
    q = query_side.withColumn("n", F.length("qterm")).withColumn(
        "d", F.least(F.lit(fixed.FUZZY_MAX), F.floor(F.col("n") * fixed.FUZZY_FRACTION + 0.5).cast("int"))
    ).where("d > 0")
    q = q.select("qterm", "n", "d", F.explode(F.sequence(F.lit(0), F.col("d"))).alias("i"))
    q = q.withColumn("a", F.expr("cast(i * n div (d + 1) as int)")).withColumn(
        "k", F.expr("cast((i + 1) * n div (d + 1) as int) - cast(i * n div (d + 1) as int)"))
    q = q.withColumn("piece", F.substring("qterm", F.col("a") + 1, F.col("k")))
    q = q.withColumn("len", F.explode(F.sequence(F.col("n") - F.col("d"), F.col("n") + F.col("d"))))
    q = q.withColumn("at", F.explode(F.sequence(F.greatest(F.lit(0), F.col("a") - F.col("d")), F.col("a") + F.col("d"))))
    q = written(q.where("at + k <= len").select("qterm", "d", "len", "at", "piece").distinct(), "query-pieces")
    sizes = q.agg(F.collect_set(F.length("piece")).alias("s")).select("s").scalar()
    v = vocabulary.select("term", F.length("term").alias("len"), F.explode(sizes).alias("k")).where("k <= len")
    v = v.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("len") - F.col("k"))))
    v = v.select("term", "len", "at", F.substring("term", F.col("at") + 1, F.col("k")).alias("piece"))
    pairs = v.join(small(q), ["len", "at", "piece"]).select("qterm", "term", "d").distinct()  # the vocabulary's pieces are many times its terms and stay where they are
    far = F.levenshtein(F.col("qterm"), F.col("term"))
    return pairs.withColumn("distance", far).where("distance between 1 and d").select("qterm", "term", "distance")


def expansions(query_side: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(qterm, term, weight): the term itself, longer terms it starts, and near misses."""
    n, m = F.length("term"), F.length("qterm")
    query_side = written(query_side, "query-terms")
    exact = vocabulary.join(small(query_side), F.col("term") == F.col("qterm")).select("qterm", "term", F.lit(1.0).alias("weight"))
    starts = vocabulary_prefixes(query_side, vocabulary).select(
        "qterm", "term", (fixed.PREFIX_WEIGHT * n / (n + 0.3 * (n - m))).alias("weight"))
    near = vocabulary_near(query_side, vocabulary).where(~F.col("term").startswith(F.col("qterm"))).select(
        "qterm", "term", (fixed.FUZZY_WEIGHT * n / (n + F.col("distance"))).alias("weight"))
    return exact.unionByName(starts).unionByName(near)


def candidate_pairs(hay: DataFrame, key: str, body: str, needles: DataFrame, nkey: str, needle: str) -> DataFrame:
    """(key, nkey) for every body that can hold a needle, and few others.

    Words inside a needle, between two blanks, must occur whole in any body that
    holds it, so a pair is a candidate only if the needle's rarest inner word
    is a word of the body. A needle of one or two words has no inner word: its
    longest word is matched against the words that contain it instead.
    """
    parts = F.split(F.col(needle), r"\s+")
    n = needles.select(nkey, parts.alias("parts")).where("parts[0] <> '' or size(parts) > 1")
    inner = n.where(F.size("parts") > 2).select(
        nkey, F.explode(F.array_distinct(F.expr("slice(parts, 2, size(parts) - 2)"))).alias("word"))
    longest = F.reduce("parts", F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
    edge = n.where(F.size("parts") <= 2).select(nkey, longest.alias("sub")).where("sub <> ''")

    words = hay.select(key, F.explode(F.array_distinct(F.split(F.col(body), r"\s+"))).alias("word"))
    # Where the needles' own words stand: one pass over the bodies, then only this is read.
    places = written(words.join(inner.select("word").distinct(), "word", "left_semi"), "word-places")
    df = places.groupBy("word").agg(F.count("*").alias("df"))
    rare = inner.join(df, "word", "left").groupBy(nkey).agg(
        F.min_by("word", F.struct(F.coalesce("df", F.lit(0)), "word")).alias("word"))
    pairs = places.join(rare, "word").select(key, nkey)
    # Needles without an inner word are few; while there are none, no body is read for them.
    sizes = edge.agg(F.collect_set(F.length("sub")).alias("k")).scalar()
    some = hay.where(F.size(sizes) > 0)
    words = some.select(key, F.explode(F.array_distinct(F.split(F.col(body), r"\s+"))).alias("word"))
    subs = words.select("word").distinct().select("word", F.explode(sizes).alias("k")).where(F.col("k") <= F.length("word"))
    subs = subs.select("word", "k", F.explode(F.sequence(F.lit(1), F.length("word") - F.col("k") + 1)).alias("at"))
    subs = subs.select("word", F.substring("word", F.col("at"), F.col("k")).alias("sub")).distinct()
    within = words.join(subs.join(edge, "sub").select(nkey, "word").distinct(), "word").select(key, nkey)
    return pairs.unionByName(within.distinct())


def contains_pairs(hay: DataFrame, key: str, body: str, needles: DataFrame, nkey: str, needle: str) -> DataFrame:
    """(key, nkey) where the needle occurs in the body. Only candidates are compared."""
    pairs = candidate_pairs(hay, key, body, needles, nkey, needle)
    found = hay.select(key, body).join(pairs, key).join(needles.select(nkey, needle), nkey)
    return found.where(F.contains(F.col(body), F.col(needle))).select(key, nkey)
