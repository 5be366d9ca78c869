"""Terms, ranking and passage selection over documents (as passages) and benchmark texts (as queries)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import ranking as R
from quire.operators import terms as TM
from quire.plans import sql as S
from quire.sources.tables import documents, table

KEY, Q = "doc_id", "item_id"


def _passages(spark, sf):
    return TM.split_heading(documents(spark, sf).select("doc_id", "source", "lang", "text"))


def _fielded(spark, sf):
    p = _passages(spark, sf)
    return p.select("doc_id", F.col("body").alias("text"), "heading", F.col("source").alias("title"))


def _queries(spark, sf):
    return table(spark, sf, "benchmark")


def _scores(spark, sf):
    return R.scores(_passages(spark, sf), KEY, _queries(spark, sf), Q)


def _search(spark, sf, **kw):
    return R.search(_fielded(spark, sf), KEY, _queries(spark, sf), Q, **kw)


def stem_terms(spark, sf):
    rows = TM.term_rows(documents(spark, sf), ["doc_id"], F.col("text"))
    return rows.groupBy("doc_id", "term").agg(F.count("*").alias("n"))


def index_terms(spark, sf):
    docs = TM.index_rows(documents(spark, sf), ["doc_id"], F.col("text"))
    return docs.groupBy("doc_id", "term").agg(F.count("*").alias("n"))


def term_stats(spark, sf):
    tf = TM.weighted_postings(_passages(spark, sf), KEY).where("term is not null")
    return tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"), F.max("tf").alias("max_tf"))


def bm25_scores(spark, sf):
    s = R.bm25(_passages(spark, sf), KEY, _queries(spark, sf), Q)
    return s.select(Q, KEY, F.round("score", R.PLACES).alias("score"))


def phrase_bonus(spark, sf):
    return R.phrase_bonus(_passages(spark, sf), KEY, _queries(spark, sf), Q)


def rank_passages(spark, sf):
    return R.top_k(_scores(spark, sf), [Q], [F.desc("score"), F.asc(KEY)], 6)


def _sized(spark, sf):
    sizes = documents(spark, sf).select(
        "doc_id", F.length("text").alias("size"), F.length("source").alias("locator_size"))
    return _scores(spark, sf).join(sizes, KEY)


def budget_retrieve(spark, sf):
    scored = _sized(spark, sf)
    required = _required(spark, sf)
    return R.budget_retrieve(scored, Q, KEY, required=required)


def _required(spark, sf):
    """The documents whose id is the query's, as the sections a query insists on."""
    docs = documents(spark, sf).select(
        "doc_id", F.length("text").alias("size"), F.length("source").alias("locator_size"))
    return _queries(spark, sf).select(Q).join(docs, F.col(Q) == F.col("doc_id"))


def merge_passages(spark, sf):
    """Groups of four queries share one budget; each query's passages come in document order, as retrieved."""
    sizes = documents(spark, sf).select("doc_id", F.length("text").alias("size"))
    lists = R.budget_retrieve(_sized(spark, sf), Q, KEY).withColumnRenamed("place", "rank").join(sizes, KEY)
    grouped = lists.withColumn("batch", F.expr("item_id div 4"))
    return R.merge_passages(grouped, "batch", Q, KEY)


def fielded_bm25(spark, sf):
    return _search(spark, sf, expand=False).select(Q, KEY, "score", "matched")


def prefix_expand(spark, sf):
    q = R.index_query(_queries(spark, sf), Q).select("qterm").distinct()
    return TM.vocabulary_prefixes(q, R.index_vocabulary(_fielded(spark, sf)))


def fuzzy_expand(spark, sf):
    q = R.index_query(_queries(spark, sf), Q).select("qterm").distinct()
    return TM.vocabulary_near(q, R.index_vocabulary(_fielded(spark, sf)))


def and_or_topup(spark, sf):
    return R.top_up(_search(spark, sf), Q, KEY, 25).select(Q, KEY, "rank", "tier", "score")


def doc_filter(spark, sf):
    only = documents(spark, sf).where(F.col("source").isin("src1", "src4", "src7")).select("doc_id")
    return R.top_up(_search(spark, sf, only=only, expand=False), Q, KEY, 6).select(Q, KEY, "rank", "tier", "score")


def unique_anchor(spark, sf):
    anchors = documents(spark, sf).select("doc_id", "source", "lang")
    return R.unique_anchor(_search(spark, sf).join(anchors, KEY), Q, KEY, ["source", "lang"], 6)


def _hits(spark, sf):
    """The six best documents of each query, by exact terms, with their text and matched terms."""
    best = R.top_up(_search(spark, sf, expand=False), Q, KEY, 6).select(Q, KEY, "rank")
    texts = documents(spark, sf).select("doc_id", "text")
    terms_ = _queries(spark, sf).select(Q, F.array_distinct(T.index_array(F.col("text"))).alias("terms"))
    return best.join(texts, KEY).join(terms_, Q)


def snippet(spark, sf):
    return _hits(spark, sf).select(Q, KEY, R.snippet(F.col("text"), F.col("terms")).alias("piece"))


def highlight(spark, sf):
    piece = R.snippet(F.col("text"), F.col("terms"))
    return _hits(spark, sf).select(Q, KEY, R.highlight(T.escape_html(piece), F.col("terms")).alias("html"))


def ask_passages(spark, sf):
    """A conversation's turns ask for chunks; system turns send ids that are not well formed."""
    turns = table(spark, sf, "conversations").withColumn("d", F.expr("conv_id * 2 + turn div 2"))
    asked = turns.select("conv_id", "turn", F.when(F.col("role") == "system", F.concat(F.lit("Bad id "), "d")).otherwise(
        F.concat(F.lit("src"), F.expr("d % 20"), F.lit("#d"), "d")).alias("id"))
    chunks = documents(spark, sf).select(F.concat("source", F.lit("#d"), "doc_id").alias("id"), "text")
    return R.pick_passages(asked, "conv_id", "turn", chunks)


def fit_passages(spark, sf):
    return R.fit_passages(_hits(spark, sf).select(Q, "rank", "text"), Q)


def citation_map(spark, sf):
    """The answer numbered its passages by score, the page by document id."""
    best = rank_passages(spark, sf)
    page = best.groupBy(Q).agg(F.sort_array(F.collect_list(KEY)).alias("ids"))
    shown = page.select(Q, F.posexplode("ids").alias("p", KEY))
    return best.join(shown, [Q, KEY]).select(Q, F.col("rank").alias("n"), (F.col("p") + 1).alias("page_n"))


def nearest_sections(spark, sf):
    sections = documents(spark, sf).select("doc_id", "source")
    return R.nearest_sections(_scores(spark, sf).join(sections, KEY), Q, KEY, "source")


def hit_at_k(spark, sf):
    """Wanted: the documents that hold the benchmark text whole. Rank 0 means not in the first six."""
    best = R.top_k(_search(spark, sf, expand=False), [Q], [F.asc("tier"), F.desc("score"), F.asc(KEY)], 6)
    hay = documents(spark, sf).select("doc_id", F.lower("text").alias("hay"))
    needles = _queries(spark, sf).select(Q, F.lower("text").alias("needle"))
    wanted = TM.contains_pairs(hay, KEY, "hay", needles, Q, "needle")
    hit = best.join(wanted, [Q, KEY]).groupBy(Q).agg(F.min("rank").alias("rank"))
    cases = wanted.groupBy(Q).agg(F.count("*").alias("wanted"))
    return cases.join(hit, Q, "left").select(Q, "wanted", F.coalesce("rank", F.lit(0)).alias("rank"))


QUERIES = {f.__name__: f for f in (
    stem_terms, index_terms, term_stats, bm25_scores, phrase_bonus, rank_passages, budget_retrieve, merge_passages,
    fielded_bm25, prefix_expand, fuzzy_expand, and_or_topup, doc_filter, unique_anchor, snippet, highlight,
    ask_passages, fit_passages, citation_map, nearest_sections, hit_at_k)}

_BEST6 = "(SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, score FROM scored QUALIFY rank <= 6)"
_EXACT = "(SELECT item_id, qterm, qterm AS term, 1.0 AS weight FROM iq)"
_FIELDS = S.EXPANSIONS[:S.EXPANSIONS.index("vocab AS")].rstrip().rstrip(",")
_SEARCH_EXACT = f"WITH {S.PASSAGES}, {_FIELDS}, {S.fielded(_EXACT)}"
_SEARCH_FULL = f"WITH {S.PASSAGES}, {S.EXPANSIONS}, {S.fielded('(SELECT item_id, qterm, term, weight FROM iq JOIN grown USING (qterm))')}"
_ORDER = "ORDER BY tier, score DESC, doc_id"


def _fold(items: str, budget: int, step: str) -> str:
    """A greedy fill in DuckDB: items and state share one struct type."""
    return (f"list_sort(list_reduce({items}, lambda a, x: {step}, "
            "{'ids': []::BIGINT[], 'used': 0::BIGINT, 'tier': 0, 'id': 0::BIGINT, 'size': 0::BIGINT, 'extra': 0::BIGINT}).ids)")


_STATE = "{'ids': []::BIGINT[], 'used': 0::BIGINT, 'tier': tier, 'id': doc_id, 'size': size, 'extra': extra}"
_GROWN = "{'ids': list_append(a.ids, x.id), 'used': a.used + x.size + x.extra, 'tier': 0, 'id': 0::BIGINT, 'size': 0::BIGINT, 'extra': 0::BIGINT}"
_TAKE = f"CASE WHEN (x.tier = 0 AND (a.used + x.size <= 12000 OR len(a.ids) = 0)) OR (x.tier = 1 AND len(a.ids) < 12 AND a.used + x.size <= 12000) THEN {_GROWN} ELSE a END"
_MERGE = f"CASE WHEN a.used + x.size <= 24000 THEN {_GROWN} ELSE a END"

_SNIPPET = rf"""{_SEARCH_EXACT},
      best AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id {_ORDER}) AS rank FROM found QUALIFY rank <= 6),
      hit AS (SELECT b.item_id, b.doc_id, d.text, coalesce(min(nullif(instr(lower(d.text), qterm), 0)) - 1, 0) AS at_
        FROM best b JOIN documents d USING (doc_id) LEFT JOIN iq USING (item_id) GROUP BY ALL),
      s0 AS (SELECT *, greatest(0, at_ - 106) AS s FROM hit),
      s1 AS (SELECT *, left(text, s + 1) AS before FROM s0),
      s2 AS (SELECT item_id, doc_id, text, CASE WHEN s > 0 AND contains(before, ' ') AND length(before) - instr(reverse(before), ' ') > 0
        THEN length(before) - instr(reverse(before), ' ') + 1 ELSE s END AS s FROM s1),
      pieces AS (SELECT item_id, doc_id, CASE WHEN s > 0 THEN '…' ELSE '' END || CASE WHEN s + 320 < length(text)
        THEN regexp_replace(substring(text, s + 1, 320), '\s\S*$', '') || '…' ELSE substring(text, s + 1, 320) END AS piece FROM s2)"""

ORACLES = {
    "stem_terms": f"SELECT doc_id, term, count(*) AS n FROM ({S.term_rows('documents', 'doc_id', 'text')}) GROUP BY ALL",
    "index_terms": f"SELECT doc_id, term, count(*) AS n FROM ({S.index_rows('documents', 'doc_id', 'text')}) GROUP BY ALL",
    "term_stats": f"WITH {S.BM25} SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf, max(tf) AS max_tf FROM tf GROUP BY ALL",
    "bm25_scores": f"WITH {S.BM25} SELECT item_id, doc_id, round(score, 4) AS score FROM bm",
    "phrase_bonus": f"WITH {S.BM25} FROM bonus",
    "rank_passages": f"WITH {S.BM25} SELECT * FROM {_BEST6}",
    "budget_retrieve": f"""WITH {S.BM25},
      req AS (SELECT item_id, doc_id, 0 AS tier, 0.0 AS score FROM benchmark JOIN documents ON item_id = doc_id),
      items AS (SELECT item_id, doc_id, tier, score, length(text)::BIGINT AS size, length(source)::BIGINT AS extra
        FROM (FROM req UNION ALL SELECT item_id, doc_id, 1, score FROM scored ANTI JOIN req USING (item_id, doc_id)) JOIN documents USING (doc_id)),
      lists AS (SELECT item_id, list({_STATE} ORDER BY tier, score DESC, doc_id) AS l FROM items GROUP BY ALL),
      chosen AS (SELECT item_id, {_fold('l', 12000, _TAKE)} AS ids FROM lists)
      SELECT item_id, (generate_subscripts(ids, 1) - 1)::INT AS place, unnest(ids) AS doc_id FROM chosen""",
    "merge_passages": f"""WITH {S.BM25},
      fit AS (SELECT item_id, doc_id, 1 AS tier, score, length(text)::BIGINT AS size, length(source)::BIGINT AS extra FROM scored JOIN documents USING (doc_id)),
      own AS (SELECT item_id, list({_STATE} ORDER BY tier, score DESC, doc_id) AS l FROM fit GROUP BY ALL),
      taken AS (SELECT item_id, {_fold('l', 12000, _TAKE)} AS ids FROM own),
      ranked AS (SELECT item_id, generate_subscripts(ids, 1) - 1 AS rank, unnest(ids) AS doc_id FROM taken),
      items AS (SELECT item_id // 4 AS batch, doc_id, min((rank, item_id)) AS turn FROM ranked GROUP BY ALL),
      lists AS (SELECT batch, list({{'ids': []::BIGINT[], 'used': 0::BIGINT, 'tier': 0, 'id': doc_id, 'size': length(text)::BIGINT, 'extra': 0::BIGINT}} ORDER BY turn) AS l
        FROM items JOIN documents USING (doc_id) GROUP BY ALL),
      chosen AS (SELECT batch, {_fold('l', 24000, _MERGE)} AS ids FROM lists)
      SELECT batch, (generate_subscripts(ids, 1) - 1)::INT AS place, unnest(ids) AS doc_id FROM chosen""",
    "fielded_bm25": f"{_SEARCH_EXACT} SELECT item_id, doc_id, score, matched FROM found",
    "prefix_expand": f"WITH {S.PASSAGES}, {S.EXPANSIONS} SELECT qterm, term FROM starts",
    "fuzzy_expand": f"WITH {S.PASSAGES}, {S.EXPANSIONS} SELECT qterm, term, distance FROM near_",
    "and_or_topup": f"{_SEARCH_FULL} SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id {_ORDER}) AS rank, tier, score FROM found QUALIFY rank <= 25",
    "doc_filter": f"""{_SEARCH_EXACT} SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id {_ORDER}) AS rank, tier, score
      FROM found JOIN documents USING (doc_id) WHERE source IN ('src1', 'src4', 'src7') QUALIFY rank <= 6""",
    "unique_anchor": f"""{_SEARCH_FULL},
      placed AS (SELECT *, row_number() OVER (PARTITION BY item_id {_ORDER}) AS pos FROM found JOIN documents USING (doc_id)),
      best AS (SELECT * FROM placed WHERE tier = 0 OR pos <= 18 QUALIFY row_number() OVER (PARTITION BY item_id, source, lang ORDER BY pos) = 1)
      SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS rank, doc_id, source, lang, tier, score FROM best QUALIFY rank <= 6""",
    "snippet": f"{_SNIPPET} SELECT * FROM pieces",
    "highlight": rf"""{_SNIPPET},
      raw AS (SELECT item_id, lower(unnest(l)) AS t, generate_subscripts(l, 1) AS i FROM (SELECT item_id, regexp_split_to_array(text, '[\n\r\p{{Z}}\p{{P}}]+') AS l FROM benchmark)),
      one AS (SELECT item_id, t, min(i) AS i FROM raw WHERE length(t) > 2 AND t NOT IN ({S.INDEX_STOP}) GROUP BY ALL),
      alts AS (SELECT item_id, string_agg(regexp_replace(t, '([.*+?^${{}}()|\[\]\\])', '\\\1', 'g'), '|' ORDER BY i) AS alt FROM one GROUP BY item_id),
      safe AS (SELECT item_id, doc_id, alt, replace(replace(replace(replace(piece, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS e FROM pieces LEFT JOIN alts USING (item_id))
      SELECT item_id, doc_id, CASE WHEN alt IS NULL THEN e ELSE regexp_replace(e, '(?i)\b(?:' || alt || ')\w*', '<mark>\0</mark>', 'g') END AS html FROM safe""",
    "fit_passages": rf"""{_SEARCH_EXACT.replace('WITH', 'WITH RECURSIVE', 1)},
      best AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id {_ORDER}) AS rank FROM found QUALIFY rank <= 6),
      r AS (SELECT item_id, list(text ORDER BY rank) AS l FROM best JOIN documents USING (doc_id) GROUP BY ALL UNION ALL
        SELECT item_id, CASE WHEN m <= 600 THEN l[:-2] ELSE list_transform(l, lambda t, i: CASE WHEN i = p THEN regexp_replace(left(t, floor(m * 0.7::DOUBLE)::INT), '\s\S*$', '') || '…' ELSE t END) END
        FROM (SELECT item_id, l, list_max(list_transform(l, lambda t: length(t))) AS m, list_position(list_transform(l, lambda t: length(t)), list_max(list_transform(l, lambda t: length(t)))) AS p
          FROM r WHERE list_sum(list_transform(l, lambda t: length(t))) > 5200)),
      done AS (SELECT item_id, l FROM r WHERE len(l) > 0 AND list_sum(list_transform(l, lambda t: length(t))) <= 5200)
      SELECT item_id, (generate_subscripts(l, 1) - 1)::INT AS place, unnest(l) AS text FROM done""",
    "ask_passages": r"""WITH t AS (SELECT *, conv_id * 2 + turn // 2 AS d FROM conversations),
      a AS (SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'Bad id ' || d ELSE 'src' || (d % 20) || '#d' || d END AS id FROM t),
      f AS (SELECT conv_id, id, min(turn) AS place FROM a WHERE length(id) <= 160 AND regexp_matches(id, '^[a-z0-9-]+#[A-Za-z0-9._:-]+$') GROUP BY ALL),
      k AS (SELECT conv_id, id, row_number() OVER (PARTITION BY conv_id ORDER BY place, id) AS n FROM f QUALIFY n <= 6)
      SELECT conv_id, n, id, substring(text, 1, 1500) AS text FROM k JOIN (SELECT source || '#d' || doc_id AS id, text FROM documents) USING (id)""",
    "citation_map": f"WITH {S.BM25} SELECT item_id, rank AS n, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS page_n FROM {_BEST6}",
    "nearest_sections": f"""WITH {S.BM25},
      r AS (SELECT item_id, source, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored JOIN documents USING (doc_id) QUALIFY rank <= 12),
      f AS (SELECT item_id, source, min(rank) AS first_rank FROM r GROUP BY ALL)
      SELECT item_id, source, first_rank, row_number() OVER (PARTITION BY item_id ORDER BY first_rank) AS place FROM f QUALIFY place <= 4""",
    "hit_at_k": f"""{_SEARCH_EXACT},
      best AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id {_ORDER}) AS rank FROM found QUALIFY rank <= 6),
      w AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text)))
      SELECT item_id, count(*) AS wanted, coalesce(min(rank), 0) AS rank FROM w LEFT JOIN best USING (item_id, doc_id) GROUP BY ALL""",
}
