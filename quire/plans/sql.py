"""Fragments shared by the DuckDB twins."""

from __future__ import annotations

from quire import fixed


def words_in(items) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in items)


STEM_STOP = words_in(fixed.STEM_STOP)
INDEX_STOP = words_in(fixed.INDEX_STOP)


def stem(w: str) -> str:
    return (
        f"CASE WHEN length({w}) > 5 AND {w} LIKE '%ies' THEN left({w}, length({w}) - 3) || 'y' "
        f"WHEN length({w}) > 4 AND {w} LIKE '%es' AND {w} NOT LIKE '%ses' THEN left({w}, length({w}) - 2) "
        f"WHEN length({w}) > 3 AND {w} LIKE '%s' AND {w} NOT LIKE '%ss' THEN left({w}, length({w}) - 1) "
        f"WHEN length({w}) > 6 AND {w} LIKE '%ing' THEN left({w}, length({w}) - 3) ELSE {w} END"
    )


def term_rows(source: str, keys: str, text: str, extra: str = "") -> str:
    """One row per stemmed term occurrence."""
    return (
        f"SELECT {keys}, {stem('w')} AS term{extra} FROM (SELECT {keys}, "
        f"unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS w FROM {source}) "
        f"WHERE length(w) > 1 AND w NOT IN ({STEM_STOP})"
    )


def index_rows(source: str, keys: str, text: str) -> str:
    """One row per index term occurrence."""
    return (
        f"SELECT {keys}, w AS term FROM (SELECT {keys}, "
        rf"lower(unnest(regexp_split_to_array({text}, '[\n\r\p{{Z}}\p{{P}}]+'))) AS w FROM {source}) "
        f"WHERE length(w) > 1 AND w NOT IN ({INDEX_STOP})"
    )


PASSAGES = r"""
p AS (SELECT doc_id, source, lang, text, regexp_extract(text, '^[^\n]*') AS heading,
      regexp_replace(text, '^[^\n]*\n?', '') AS body FROM documents)"""

BM25 = f"""{PASSAGES},
rows_ AS ({term_rows('p', 'doc_id', 'body', ', 1 AS wt')} UNION ALL {term_rows('p', 'doc_id', 'heading', ', 3 AS wt')}),
tf AS (SELECT doc_id, term, sum(wt)::BIGINT AS tf FROM rows_ GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
lens AS (SELECT p.doc_id, coalesce(sum(tf), 0)::BIGINT AS len FROM p LEFT JOIN tf USING (doc_id) GROUP BY ALL),
stats AS (SELECT count(*) AS n, avg(len) AS avg FROM lens),
q AS (SELECT DISTINCT * FROM ({term_rows('benchmark', 'item_id', 'text')})),
bm AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * (len / avg)))) AS score
       FROM tf JOIN lens USING (doc_id) JOIN df USING (term) JOIN q USING (term), stats GROUP BY ALL),
bonus AS (SELECT item_id, doc_id, 2.0::DOUBLE AS score FROM benchmark b JOIN p ON contains(lower(p.heading || chr(10) || p.body), lower(b.text)) WHERE contains(b.text, ' ')),
scored AS (SELECT item_id, doc_id, round(sum(score), 4) AS score FROM (FROM bm UNION ALL FROM bonus) GROUP BY ALL)"""

LETTERS = "'éèêçíóñßäöü', 'ABCDEFGHIJK'"  # one byte per letter, for a byte-wise edit distance

EXPANSIONS = f"""
iq AS (SELECT DISTINCT item_id, term AS qterm FROM ({index_rows('benchmark', 'item_id', 'text')})),
fields AS (SELECT doc_id, 'text' AS field, 1.0 AS boost, body AS value FROM p UNION ALL
           SELECT doc_id, 'heading', 3.0, heading FROM p UNION ALL SELECT doc_id, 'title', 0.5, source FROM p),
occ AS ({index_rows('fields', 'doc_id, field, boost', 'value')}),
vocab AS (SELECT DISTINCT term FROM occ),
qt AS (SELECT DISTINCT qterm FROM iq),
starts AS (SELECT qterm, term, 0.375 * length(term) / (length(term) + 0.3 * (length(term) - length(qterm))) AS weight
           FROM qt JOIN vocab ON starts_with(term, qterm) AND term <> qterm),
near_ AS (SELECT qterm, term, levenshtein(translate(qterm, {LETTERS}), translate(term, {LETTERS})) AS distance
         FROM (SELECT qterm, least(6, floor(length(qterm) * 0.15 + 0.5)) AS d FROM qt) JOIN vocab
         ON abs(length(term) - length(qterm)) <= d AND d > 0
         WHERE levenshtein(translate(qterm, {LETTERS}), translate(term, {LETTERS})) BETWEEN 1 AND d),
grown AS (SELECT qterm, qterm AS term, 1.0 AS weight FROM qt JOIN vocab ON term = qterm UNION ALL FROM starts UNION ALL
          SELECT qterm, term, 0.45 * length(term) / (length(term) + distance) FROM near_ WHERE NOT starts_with(term, qterm))"""


def fielded(expanded: str) -> str:
    """The fielded score per (query, document) over a table of (item_id, qterm, term, weight)."""
    return rf"""
sized AS (SELECT doc_id, field, length(list_distinct(regexp_split_to_array(value, '[\n\r\p{{Z}}\p{{P}}]+'))) AS len FROM fields),
ftf AS (SELECT doc_id, field, boost, term, count(*) AS tf FROM occ GROUP BY ALL),
fdf AS (SELECT field, term, count(*) AS df FROM ftf GROUP BY ALL),
favg AS (SELECT field, avg(len) AS avg FROM sized GROUP BY ALL),
parts AS (SELECT item_id, doc_id, qterm, sum(weight * boost * ln(1 + ((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5))
            * (0.5 + tf * 2.2 / (tf + 1.2 * (0.6 + 0.4 * len / avg)))) AS score
          FROM ftf JOIN fdf USING (field, term) JOIN sized USING (doc_id, field) JOIN favg USING (field)
          JOIN {expanded} x USING (term) GROUP BY ALL),
found AS (SELECT item_id, doc_id, round(sum(score) * count(*), 4) AS score, count(*) AS matched,
            CASE WHEN count(*) = any_value(wanted) THEN 0 ELSE 1 END AS tier
          FROM parts JOIN (SELECT item_id, count(*) AS wanted FROM iq GROUP BY ALL) USING (item_id) GROUP BY ALL)"""
