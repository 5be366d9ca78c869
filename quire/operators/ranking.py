"""Scoring, top-k and passage selection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quire import fixed
from quire.functions import text as T
from quire.operators import terms
from quire.operators.scale import BROADCAST_ROWS, small
from quire.session import written

PLACES = 4


def _bm25_parts(passages: DataFrame, key: str, queries: DataFrame, qkey: str, text: str) -> DataFrame:
    """(query, passage, score) for every term they share. Postings go to their passage's task, the terms' figures to all, so a frequent term meets in no one task."""
    q = terms.query_terms(queries, qkey, text)
    postings = written(terms.weighted_postings(passages, key, q.select("term").distinct()), "postings")
    tf = postings.where("term is not null")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    sized = postings.groupBy(key).agg(F.first("len").alias("len"))
    stats = sized.agg(F.struct(F.count("*").alias("n"), F.avg("len").alias("avg")).alias("s")).select("s").scalar()
    total, avg = stats.getField("n"), stats.getField("avg")
    idf = F.ln(1 + (total - F.col("df") + 0.5) / (F.col("df") + 0.5))
    k1, b = fixed.BM25_K1, fixed.BM25_B
    part = idf * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * ((1 - b) + b * F.col("len") / avg))
    asked = small(written(df.join(q, "term"), "asked-terms"))
    return tf.repartition(key).join(asked, "term").select(qkey, key, part.alias("score"))


def bm25(passages: DataFrame, key: str, queries: DataFrame, qkey: str, text: str = "text") -> DataFrame:
    """(query, passage, score), unrounded. Passage text never enters a shuffle."""
    return _bm25_parts(passages, key, queries, qkey, text).groupBy(qkey, key).agg(F.sum("score").alias("score"))


def phrase_bonus(passages: DataFrame, key: str, queries: DataFrame, qkey: str, text: str = "text") -> DataFrame:
    """(query, passage, score): two points where a query of several words occurs whole."""
    hay = passages.select(key, F.lower(F.concat_ws("\n", "heading", "body")).alias("hay"))
    needles = queries.select(qkey, F.lower(text).alias("needle")).where(F.contains("needle", F.lit(" ")))
    pairs = terms.contains_pairs(hay, key, "hay", needles, qkey, "needle")
    return pairs.select(qkey, key, F.lit(fixed.PHRASE_BONUS).alias("score"))


def scores(passages: DataFrame, key: str, queries: DataFrame, qkey: str, text: str = "text") -> DataFrame:
    """BM25 plus phrase bonus, rounded so that ties are the same on every run."""
    both = _bm25_parts(passages, key, queries, qkey, text).unionByName(phrase_bonus(passages, key, queries, qkey, text).repartition(qkey))  # few rows
    total = both.groupBy(qkey, key).agg(F.round(F.sum("score"), PLACES).alias("score"))
    return total.where("score > 0")


def top_k(scored: DataFrame, partition: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The k first rows of each partition; Spark limits each task's rows before it shuffles."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return scored.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def budget_candidates(scored: DataFrame, qkey: str, order: list[Column], size: str, budget: int, most: int) -> DataFrame:
    """The rows a greedy fill can reach, and no others.

    A row is out of reach if `most` rows of exactly its size rank above it: were
    one of them refused for size, this one would be refused too, and if none
    was, the fill is already complete. So at most `most` rows per size remain.
    """
    near = scored.where(F.col(size) <= budget)
    w = Window.partitionBy(qkey, size).orderBy(*order)
    return near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def budget_retrieve(scored: DataFrame, qkey: str, key: str, budget: int = fixed.EXTRACT_BUDGET,
                    most: int = fixed.EXTRACT_MAX, required: DataFrame | None = None) -> DataFrame:
    """Greedy fill of a character budget by rank, required passages first, result in document order.

    `scored` holds (query, passage, score, size, locator_size). `required`, with
    the same columns but score, is taken first in passage order; one that does
    not fit is left out unless nothing has been chosen yet.
    """
    if required is not None:
        scored = scored.join(required.select(qkey, key), [qkey, key], "left_anti")
    ranked = budget_candidates(scored, qkey, [F.desc("score"), F.asc(key)], "size", budget, most)
    item = F.struct(F.lit(1).alias("tier"), (-F.col("score")).alias("rank"), F.col(key).cast("long").alias("id"),
                    F.col("size").cast("long").alias("size"), F.col("locator_size").cast("long").alias("extra"))
    rows = ranked.select(qkey, item.alias("item"))
    if required is not None:
        first = F.struct(F.lit(0).alias("tier"), F.lit(0.0).alias("rank"), F.col(key).cast("long").alias("id"),
                         F.col("size").cast("long").alias("size"), F.col("locator_size").cast("long").alias("extra"))
        rows = rows.unionByName(required.select(qkey, first.alias("item")))
    lists = rows.groupBy(qkey).agg(F.sort_array(F.collect_list("item")).alias("items"))
    start = F.struct(F.expr("cast(array() as array<bigint>)").alias("ids"), F.lit(0).cast("long").alias("used"))

    def step(acc, x):
        fits = acc.used + x.size <= budget
        take = F.when(x.tier == 0, fits | (F.size(acc.ids) == 0)).otherwise((F.size(acc.ids) < most) & fits)
        grown = F.struct(F.array_append(acc.ids, x.id).alias("ids"), (acc.used + x.size + x.extra).alias("used"))
        return F.when(take, grown).otherwise(acc)

    chosen = lists.select(qkey, F.sort_array(F.reduce("items", start, step).ids).alias("ids"))
    return chosen.select(qkey, F.posexplode("ids").alias("place", key))


def merge_passages(lists: DataFrame, gkey: str, list_no: str, key: str, budget: int = fixed.MERGE_BUDGET) -> DataFrame:
    """Several short ranked lists merged round-robin under one budget.

    `lists` holds (group, list_no, rank, passage, size); a passage counts where
    its turn first comes. Lists are at most a dozen long, so a group is small.
    """
    turn = F.struct("rank", list_no)
    first = lists.groupBy(gkey, key).agg(F.min(turn).alias("turn"), F.first("size").alias("size"))
    item = F.struct("turn", F.col(key).cast("long").alias("id"), F.col("size").cast("long").alias("size"))
    queues = first.groupBy(gkey).agg(F.sort_array(F.collect_list(item)).alias("items"))
    start = F.struct(F.expr("cast(array() as array<bigint>)").alias("ids"), F.lit(0).cast("long").alias("used"))
    step = lambda acc, x: F.when(
        acc.used + x.size <= budget,
        F.struct(F.array_append(acc.ids, x.id).alias("ids"), (acc.used + x.size).alias("used"))).otherwise(acc)
    return queues.select(gkey, F.posexplode(F.sort_array(F.reduce("items", start, step).ids)).alias("place", key))


def field_scores(passages: DataFrame, key: str, expanded: DataFrame, many: bool = False) -> DataFrame:
    """(passage, qterm, score) of the fielded search, once for all queries that share a term.

    `passages` holds text, heading and title; `expanded` (qterm, term, weight). Each field has its own lengths and document counts. The score of a
    match is weight x boost x idf x (d + tf (k + 1) / (tf + k (1 - b + b len / avg))). With ``many`` expansions all terms are counted
    rather than each occurrence looked up, and only the figures of frequent terms go to all tasks.
    """
    if many:
        postings = written(field_postings(passages, key), "field-postings")
        return posting_scores(postings, key, written(field_counts(postings), "field-counts"), expanded)
    k, b, d = fixed.FIELD_K, fixed.FIELD_B, fixed.FIELD_D
    sized = _field_rows(passages, key).withColumn("value", F.lower("value"))
    raw = sized.select(key, "field", "boost", "len", F.explode(F.array_append(T.tokens(F.col("value")), terms.marker(key))).alias("term"))
    kept = raw.where((F.length("term") > 1) & ~F.col("term").isin(fixed.INDEX_STOP))
    known = terms.in_vocabulary(kept, expanded.select("term").distinct())
    counts = known.groupBy(key, "field", "boost", "len", "term").agg(F.count("*").alias("tf"))
    postings = written(counts, "field-postings")
    tf = postings.where("term is not null")
    df = tf.groupBy("field", "term").agg(F.count("*").alias("df"))
    per_field = postings.groupBy(key, "field").agg(F.first("len").alias("len"))
    average = per_field.groupBy("field").agg(F.avg("len").alias("avg"), F.count("*").alias("n"))
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = d + F.col("tf") * (k + 1) / (F.col("tf") + k * (1 - b + b * F.col("len") / F.col("avg")))
    # A field is a row and three fields are all: no passage is dealt by its field, nor by a frequent term.
    asked = written(df.join(F.broadcast(average), "field").join(expanded, "term"), "asked-terms")
    joined = tf.repartition(key).join(small(asked), ["field", "term"])
    return joined.groupBy(key, "qterm").agg(F.sum(F.col("weight") * F.col("boost") * idf * gain).alias("score"))


def _field_rows(passages: DataFrame, key: str) -> DataFrame:
    """(passage, field, boost, value, len): a row per field; its length is the number of its distinct words."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(boost).alias("boost"), F.col(f).alias("value"))
                       for f, boost in fixed.FIELD_BOOST.items()])
    rows = passages.select(key, F.inline(fields))
    return rows.withColumn("len", F.size(F.array_distinct(T.tokens(F.col("value")))))


def field_postings(passages: DataFrame, key: str) -> DataFrame:
    """(passage, field, len, words, tfs): a row per field with all its terms, one to a line, and their counts. Nothing is shuffled."""
    rows = _field_rows(passages, key).where("value is not null").select(key, "field", "len", terms.counted(F.col("value")).alias("_t"))
    return rows.select(key, "field", "len", F.array_join("_t.term", "\n").alias("words"), F.col("_t.tf").alias("tfs"))


def _postings_of() -> Column:
    """array<struct<term, tf>> of such a row, null where there is none."""
    return F.when(F.size("tfs") > 0, F.arrays_zip(F.split("words", "\n").alias("term"), F.col("tfs").alias("tf")))


def field_counts(postings: DataFrame) -> DataFrame:
    """For each term in how many passages it stands, a column per field."""
    each = postings.where(F.size("tfs") > 0).select("field", F.explode(F.split("words", "\n")).alias("term"))
    return each.groupBy("term").agg(*[F.count(F.when(F.col("field") == f, 1)).alias(f) for f in fixed.FIELD_BOOST])


#: A term in more than this share of the postings is frequent, so there are fewer than 1 / share of them.
FREQUENT = 2.5e-6


def posting_scores(postings: DataFrame, key: str, counts: DataFrame, expanded: DataFrame) -> DataFrame:
    """``field_scores`` from written postings and counts, however many expansions there are.

    The figures of frequent terms go to all tasks. Rare terms' occurrences meet theirs by term and travel on as scores, in one
    shuffle by passage with the postings, so that all sums of a passage are made in its task.
    """
    k, b, d = fixed.FIELD_K, fixed.FIELD_B, fixed.FIELD_D
    average = F.broadcast(postings.groupBy("field").agg(F.avg("len").alias("avg"), F.count("*").alias("n")))
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    boosts = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(boost).alias("boost"), F.col(f).alias("df")) for f, boost in fixed.FIELD_BOOST.items()])
    pairs = counts.join(expanded, "term").select("qterm", "term", "weight", F.inline(boosts)).where("df > 0").join(average, "field")
    asked = written(pairs.select("field", "term", "qterm", "df", (F.col("weight") * F.col("boost") * idf).alias("factor")), "asked-terms")
    rows = postings.join(average, "field").select(key, "field", (k * (1 - b + b * F.col("len") / F.col("avg"))).alias("norm"), "words", "tfs")
    part = F.col("factor") * (d + F.col("tf") * (k + 1) / (F.col("tf") + F.col("norm")))

    if asked.count() <= BROADCAST_ROWS:
        heavy, dealt = asked, rows.withColumns({"qterm": F.lit(None).cast(expanded.schema["qterm"].dataType), "score": F.lit(None).cast("double")})
    else:
        total = counts.agg(F.sum(sum(F.col(f) for f in fixed.FIELD_BOOST))).first()[0]
        often = F.col("df") > int(total * FREQUENT)
        heavy, light = asked.where(often), asked.where(~often)
        each = rows.select(key, "field", "norm", F.inline(_postings_of()))
        rare = each.join(F.broadcast(heavy.select("field", "term").distinct()), ["field", "term"], "left_anti")
        met = rare.join(light.hint("merge"), ["field", "term"]).select(key, "qterm", part.alias("score"))
        dealt = rows.unionByName(met, allowMissingColumns=True)
    # A row holds a field's terms, or a score; the terms are looked up, the score stays.
    each = dealt.repartition(key).select(key, "field", "norm", "qterm", "score", F.inline_outer(_postings_of()))
    figures = F.broadcast(heavy.select("field", "term", F.col("qterm").alias("_qterm"), "factor"))
    scored = each.join(figures, ["field", "term"], "left").select(key, F.coalesce("qterm", "_qterm").alias("qterm"), F.coalesce("score", part).alias("score"))
    return scored.where("qterm is not null").groupBy(key, "qterm").agg(F.sum("score").alias("score"))


def index_query(queries: DataFrame, qkey: str, text: str = "text") -> DataFrame:
    return terms.index_rows(queries, [qkey], F.col(text), "qterm").distinct()


def index_vocabulary(passages: DataFrame) -> DataFrame:
    values = F.array(*[F.col(f) for f in fixed.FIELD_BOOST])
    return terms.index_rows(passages.select(F.explode(values).alias("v")), [], F.col("v")).distinct()


def search(passages: DataFrame, key: str, queries: DataFrame, qkey: str, text: str = "text",
           only: DataFrame | None = None, expand: bool = True) -> DataFrame:
    """(query, passage, score, matched, tier): tier 0 where every query term matched.

    `only` restricts the passages offered, not the statistics, as a filter inside
    the search does.
    """
    q = index_query(queries, qkey, text)
    asked = q.select("qterm").distinct()
    if expand:
        postings = written(field_postings(passages, key), "field-postings")
        counts = written(field_counts(postings), "field-counts")
        # Sums are kept per passage and query term, so the term is a number there.
        numbers = small(written(asked.withColumn("no", F.monotonically_increasing_id()), "query-terms"))
        grown = terms.expansions(asked, counts.select("term")).join(numbers, "qterm")
        expanded = written(grown.select(F.col("no").alias("qterm"), "term", "weight"), "expansions")
        q = q.join(numbers, "qterm").select(qkey, F.col("no").alias("qterm"))
        parts = posting_scores(postings, key, counts, expanded)
    else:
        parts = field_scores(passages, key, asked.select("qterm", F.col("qterm").alias("term"), F.lit(1.0).alias("weight")))
    if only is not None:
        parts = parts.join(only, key, "left_semi")
    wanted = q.groupBy(qkey).agg(F.count("*").alias("wanted"))
    wanting = small(written(q.join(wanted, qkey), "wanted-terms"))
    found = parts.join(wanting, "qterm").groupBy(qkey, key).agg(F.sum("score").alias("sum"), F.count("*").alias("matched"), F.max("wanted").alias("wanted"))
    return found.select(
        qkey, key, F.round(F.col("sum") * F.col("matched"), PLACES).alias("score"), "matched",
        F.when(F.col("matched") == F.col("wanted"), 0).otherwise(1).alias("tier"))


def top_up(found: DataFrame, qkey: str, key: str, limit: int) -> DataFrame:
    """Full matches first, then partial ones, in score order."""
    return top_k(found, [qkey], [F.asc("tier"), F.desc("score"), F.asc(key)], limit)


def unique_anchor(found: DataFrame, qkey: str, key: str, anchor: list[str], limit: int) -> DataFrame:
    """The best passage of each anchor, among all full matches and partial ones up to three times the limit."""
    order = F.struct("tier", (-F.col("score")).alias("neg"), F.col(key).alias("id"))
    # The first of each anchor are all that can be among the first or an anchor's best; written, so that the pairs are worked out once.
    rows = written(top_k(found.withColumn("o", order), [qkey, *anchor], [F.asc("o")], limit * 3, "_n").drop("_n"), "anchored")
    near = top_k(rows, [qkey], [F.asc("o")], limit * 3, "_p").where("tier = 1").drop("_p")
    offered = rows.where("tier = 0").unionByName(near)
    best = offered.groupBy(qkey, *anchor).agg(F.min("o").alias("o"))
    ranked = top_k(best, [qkey], [F.asc("o")], limit)
    return ranked.select(qkey, "rank", F.col("o.id").alias(key), *anchor, F.col("o.tier").alias("tier"),
                         (-F.col("o.neg")).alias("score"))


def snippet(text: Column, found_terms: Column, width: int = 320) -> Column:
    """The text around the first matched term, cut at blanks, with ellipses. Its end is the very end: a `$` would also stand before a last line break."""
    low = F.lower(text)
    places = F.filter(F.transform(found_terms, lambda t: F.instr(low, t) - 1), lambda i: i >= 0)
    at = F.coalesce(F.array_min(places), F.lit(0))
    start = F.greatest(F.lit(0), at - width // 3)
    before = F.left(text, start + 1)
    space = F.length(before) - F.instr(F.reverse(before), F.lit(" "))
    has = F.contains(before, F.lit(" ")) & (space > 0) & (start > 0)
    start = F.when(has, space + 1).otherwise(start)
    piece = F.substring(text, start + 1, F.lit(width))
    cut = F.when(start + width < F.length(text), F.concat(F.regexp_replace(piece, r"[\t\n\f\r ][^\t\n\f\r ]*\z", ""), F.lit("…"))).otherwise(piece)
    return F.when(start > 0, F.concat(F.lit("…"), cut)).otherwise(cut)


def highlight(escaped: Column, found_terms: Column) -> Column:
    """Marks round every word that starts with one of the terms longer than two letters."""
    safe = F.transform(F.filter(found_terms, lambda t: F.length(t) > 2),
                       lambda t: F.regexp_replace(t, r"([.*+?^${}()|\[\]\\])", r"\\$1"))
    edge = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"  # an ASCII word edge; \b here would know accented letters
    pattern = F.concat(F.lit(f"(?iu){edge}(?:"), F.array_join(safe, "|"), F.lit(r")\w*"))
    return F.when(F.size(safe) == 0, escaped).otherwise(F.regexp_replace(escaped, pattern, F.lit("<mark>$0</mark>")))


def pick_passages(requests: DataFrame, rkey: str, place: str, chunks: DataFrame, most: int = 6, width: int = 1500) -> DataFrame:
    """Clean requested ids: well-formed, first mention only, six at most, joined to their chunks in order."""
    good = requests.where((F.length("id") <= 160) & F.col("id").rlike(r"^[a-z0-9-]+#[A-Za-z0-9._:-]+$"))
    first = good.groupBy(rkey, "id").agg(F.min(place).alias("place"))
    kept = top_k(first, [rkey], [F.asc("place"), F.asc("id")], most, "n")
    return kept.join(chunks, "id").select(rkey, "n", "id", F.substring("text", 1, width).alias("text"))


@F.pandas_udf(ArrayType(StringType()))
def _fit(texts: pd.Series, most: pd.Series) -> pd.Series:
    def shrink(items, room):
        items = list(items)
        while items and sum(map(len, items)) > room:
            longest = max(range(len(items)), key=lambda i: (len(items[i]), -i))
            if len(items[longest]) <= 600:
                items.pop()
                continue
            head = items[longest][: int(len(items[longest]) * 0.7)]
            cut = max((i for i, c in enumerate(head) if c.isspace()), default=-1)
            items[longest] = (head[:cut] if cut >= 0 else head) + "…"
        return items

    return pd.Series([shrink(t, m) for t, m in zip(texts, most)])


def fit_passages(hits: DataFrame, qkey: str, most: int = 5200) -> DataFrame:
    """Shorten a question's few passages until they fit: the longest by 30 %, or the last dropped."""
    lists = hits.groupBy(qkey).agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("items"))
    fitted = lists.select(qkey, _fit(F.col("items.text"), F.lit(most)).alias("texts"))
    return fitted.select(qkey, F.posexplode("texts").alias("place", "text"))


def nearest_sections(scored: DataFrame, qkey: str, key: str, section: str, k: int = 4) -> DataFrame:
    """The first k distinct sections among the 3k best passages."""
    best = top_k(scored, [qkey], [F.desc("score"), F.asc(key)], 3 * k)
    firsts = best.groupBy(qkey, section).agg(F.min("rank").alias("first_rank"))
    return top_k(firsts, [qkey], [F.asc("first_rank")], k, "place")
