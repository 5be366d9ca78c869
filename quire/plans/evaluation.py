"""Conversations as questions and recorded answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import evaluation as V
from quire.sources.tables import table

KEYS = ["conv_id", "turn"]


def _answers(spark, sf):
    """Turns of assistants with citations put in: at every stop, at every second one, or nowhere."""
    c, t = F.col("conv_id"), F.col("text")
    cited = F.when(c % 3 == 0, F.regexp_replace(t, r"\.", F.concat(F.lit(" ["), c % 8, F.lit("]."))))
    cited = cited.when(c % 3 == 1, F.regexp_replace(t, r"\. ", ". [2] ")).otherwise(t)
    lead = F.when(c % 7 == 0, "No. The text does not cover this. ").otherwise("See e.g. reg. 5 and 3.5 of **this** guide. ")
    ids = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda n: F.concat(F.lit("src"), (c + n) % 20, F.lit("#d"), n))
    return table(spark, sf, "conversations").where("role = 'assistant'").select(
        *KEYS, F.concat(lead, cited).alias("answer"), ids.alias("passages"), F.array(F.concat(F.lit("src"), (c + 2) % 20), F.lit("src9#d1")).alias("expect"),
        F.when(c % 5 == 0, "off-topic").alias("decline"))


def sentence_split(spark, sf):
    return _answers(spark, sf).select(*KEYS, F.posexplode(V.paragraphs(F.col("answer"))).alias("para", "p")).select(*KEYS, "para", F.posexplode("p").alias("place", "sentence"))


def citations_in(spark, sf):
    a = _answers(spark, sf).select(*KEYS, F.posexplode(V.citations(F.col("answer"))).alias("place", "n"))
    return a.withColumn("in_range", F.col("n").between(1, 6))


def answer_checks(spark, sf):
    return V.answer_checks(_answers(spark, sf), KEYS)


def eval_tally(spark, sf):
    return V.tally(answer_checks(spark, sf), KEYS)


def recheck_saved(spark, sf):
    """The first turn of a user is the question, and every assistant's turn after it a saved answer."""
    q = table(spark, sf, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"))
    a = _answers(spark, sf)
    saved = a.join(q, "conv_id").select("question", "answer", "passages", F.struct(*KEYS).alias("o"))
    cases = q.select("conv_id", "question", F.array(F.lit("src3"), F.lit("src9#d1")).alias("expect"), F.lit(None).cast("string").alias("decline"))
    return V.answer_checks(V.recheck(cases, saved, "o"), ["conv_id"])


QUERIES = {f.__name__: f for f in (sentence_split, citations_in, answer_checks, eval_tally, recheck_saved)}

_A = r"""a AS (SELECT conv_id, turn, CASE WHEN conv_id % 7 = 0 THEN 'No. The text does not cover this. ' ELSE 'See e.g. reg. 5 and 3.5 of **this** guide. ' END ||
    CASE WHEN conv_id % 3 = 0 THEN replace(text, '.', ' [' || (conv_id % 8) || '].') WHEN conv_id % 3 = 1 THEN replace(text, '. ', '. [2] ') ELSE text END AS answer,
    CASE WHEN conv_id % 5 = 0 THEN 'off-topic' END AS decline FROM conversations WHERE role = 'assistant')"""


def _sentences(answers: str) -> str:
    c = r"regexp_replace(answer, '\*\*|__|`', '', 'g')"
    for pattern, into in ((r"(?i)\b(e)\.(g)\.", r"\1․\2․"), (r"(?i)\b(i)\.(e)\.", r"\1․\2․"), (r"(?i)\b(cf|approx)\.", r"\1․"), (rf"(?i)\b({V.SHORT})\.(\s*\d)", r"\1․\2"), (r"(\d)\.(\d)", r"\1․\2")):
        c = f"regexp_replace({c}, '{pattern}', '{into}', 'g')"
    return rf"""pa AS (SELECT * EXCLUDE (l), generate_subscripts(l, 1) AS pn, unnest(l) AS para FROM (SELECT *, regexp_split_to_array({c}, '\n+') AS l FROM {answers})),
  se AS (SELECT * EXCLUDE (l), generate_subscripts(l, 1) AS sn, unnest(l) AS raw FROM (SELECT *, string_split(regexp_replace(para, '([.!?](?:\s*\[\d+\])*)\s+([A-Z“"‘(])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS l FROM pa)),
  ss AS (SELECT * EXCLUDE (para), regexp_replace(regexp_replace(raw, '^\s*(?:[-*•]|\d+\.)\s+', ''), '^\s+|\s+$', '', 'g') AS s FROM se),
  sen AS (SELECT *, regexp_matches(s, '\[\d+\]') AS cites, regexp_matches(s, '(?i)legal advice') OR len(regexp_split_to_array(s, '\s+')) < 4 AS exempt FROM ss WHERE regexp_matches(s, '[A-Za-z]{{2}}'))"""


def _checks(keys: str, expect: str) -> str:
    """The check rows over sen (sentences) and ans (answers), in SQL."""
    on = ", ".join(keys.split())
    return rf"""oo AS (SELECT *, coalesce(bool_or(cites) OVER (PARTITION BY {on}, pn ORDER BY sn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false) AS later FROM sen),
  k AS (SELECT {on}, count(*) FILTER (WHERE NOT cites AND NOT exempt) AS bare, count(*) FILTER (WHERE NOT cites AND NOT exempt AND NOT later) AS orphan FROM oo GROUP BY ALL),
  z AS (SELECT *, list_transform(regexp_extract_all(answer, '\[(\d+)\]', 1), lambda n: n::INT) AS c, regexp_matches(answer, '(?i)\b(?:{V.DECLINE.replace("'", "''")})\b') AS refuses FROM ans),
  y AS (SELECT z.*, coalesce(bare, 0) AS bare, coalesce(orphan, 0) AS orphan, len(list_filter(c, lambda n: n < 1 OR n > 6)) = 0 AS exist, len(list_filter(c, lambda n: n BETWEEN 1 AND 6 AND ({expect}))) > 0 AS hit FROM z LEFT JOIN k USING ({on})),
  chk AS (SELECT {on}, 'citations exist' AS "check", exist AS ok FROM y UNION ALL SELECT {on}, 'declines (' || decline || ')', refuses FROM y WHERE decline IS NOT NULL UNION ALL
    SELECT {on}, 'every sentence cites', bare = 0 FROM y WHERE decline IS NULL UNION ALL SELECT {on}, 'nothing left uncited', orphan = 0 FROM y WHERE decline IS NULL UNION ALL
    SELECT {on}, 'expected sources cited', hit FROM y WHERE decline IS NULL UNION ALL SELECT {on}, 'not a refusal', NOT (refuses AND len(c) = 0) FROM y WHERE decline IS NULL)"""


_EVAL = f"WITH {_A}, ans AS (FROM a), {_sentences('a')}, {_checks('conv_id turn', 'n = 2 OR (n = 1 AND (conv_id + 1) % 20 = 9)')}"

ORACLES = {
    "sentence_split": f"""WITH {_A}, {_sentences('a')} SELECT conv_id, turn, (dense_rank() OVER (PARTITION BY conv_id, turn ORDER BY pn) - 1)::INT AS para, (row_number() OVER (PARTITION BY conv_id, turn, pn ORDER BY sn) - 1)::INT AS place, s AS sentence FROM sen""",
    "citations_in": rf"""WITH {_A}, l AS (SELECT conv_id, turn, regexp_extract_all(answer, '\[(\d+)\]', 1) AS l FROM a), n AS (SELECT conv_id, turn, generate_subscripts(l, 1) - 1 AS place, unnest(l)::INT AS n FROM l) SELECT *, n BETWEEN 1 AND 6 AS in_range FROM n""",
    "answer_checks": f"{_EVAL} FROM chk",
    "eval_tally": f"""{_EVAL} SELECT "check", count(*) FILTER (WHERE ok) AS passed, count(*) AS total FROM chk GROUP BY ALL UNION ALL
      SELECT 'every check', count(*) FILTER (WHERE ok), count(*) FROM (SELECT bool_and(ok) AS ok FROM chk GROUP BY conv_id, turn)""",
    "recheck_saved": f"""WITH {_A}, q AS (SELECT conv_id, arg_min(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY ALL), sv AS (SELECT question, arg_min(answer, (conv_id, turn)) AS answer, arg_min(conv_id, (conv_id, turn)) AS src FROM a JOIN q USING (conv_id) GROUP BY ALL),
      ans AS (SELECT conv_id, answer, src, NULL::VARCHAR AS decline FROM q JOIN sv USING (question)), {_sentences('ans')}, {_checks('conv_id', '(src + n) % 20 = 3 OR (n = 1 AND (src + 1) % 20 = 9)')} FROM chk""",
}
