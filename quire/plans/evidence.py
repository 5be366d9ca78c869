"""Detection and evidence over sections of documents, with benchmark texts as quotes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire import fixed
from quire.functions import status as ST
from quire.functions import text as T
from quire.operators import detection as D
from quire.operators import evidence as E
from quire.operators import structuring as S
from quire.plans import structuring as P
from quire.sources.tables import documents, table


def _headed(spark, sf):
    """Sections whose headings name policies, sites, outcomes and themes in turn."""
    n, h = F.col("section_no"), F.col("heading")
    made = (F.when(h == "", h).when(n % 7 == 0, F.concat(F.lit("Policy AB"), n % 9 + 1, F.lit(": "), h))
            .when(n % 7 == 1, F.concat(F.lit("NW/H"), n % 4, F.lit(" - Land at "), h)).when(n % 7 == 2, F.concat(F.lit("Draft Site allocation SA "), n % 5, F.lit(") "), h))
            .when(n % 7 == 3, F.concat(F.lit("Outcome "), n % 4, F.lit(" | "), h)).when(n % 7 == 4, F.concat(F.lit("Our Vision "), h))
            .when(n % 7 == 5, F.concat(F.lit("Monitoring of "), h)).otherwise(h))
    return S.sectionise(P._markdown(spark, sf)).select("doc_id", "section_no", "level", made.alias("heading"), "text")


def detect_policies(spark, sf):
    return D.detect_policies(_headed(spark, sf), "doc_id")


def block_scope(spark, sf):
    return D.block_scope(_headed(spark, sf), "doc_id").select("doc_id", "section_no", "members", T.sha256(F.col("block")).alias("block_hash"))


def table_allocations(spark, sf):
    return D.table_allocations(S.tables(P._tabled(spark, sf), "doc_id", "md"), "doc_id")


def merge_allocations(spark, sf):
    listed = table_allocations(spark, sf).select("doc_id", "ref", "name", (100000 + F.col("row_no") / 1000).alias("place"))
    return D.merge_allocations(D.detect_policies(_headed(spark, sf), "doc_id"), listed, "doc_id").select("doc_id", "id", "code", "title", "table_rows")


def detect_outcomes(spark, sf):
    return D.detect_outcomes(_headed(spark, sf), "doc_id")


def accept_suggestions(spark, sf):
    """Line items suggest sections of the document numbered like their order."""
    suggested = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("section_no"), F.col("l_linestatus").alias("kind"), F.col("l_partkey").alias("part"))
    known = S.sectionise(P._markdown(spark, sf)).select("doc_id", "section_no")
    return D.accept_suggestions(suggested, known, ["doc_id", "section_no"], ["doc_id", "kind"], [F.asc("section_no"), F.asc("part")])


def focus_sections(spark, sf):
    s = _headed(spark, sf)
    return D.focus_sections(s, D.detect_outcomes(s, "doc_id"), "doc_id").select("doc_id", "focus", "section_no", "place")


def cap_entities(spark, sf):
    """A supplier's lines: the first sixty of a status are compared, the rest only listed."""
    lines = table(spark, sf, "lineitem").select("l_suppkey", "l_linestatus", "l_orderkey", "l_linenumber", "l_partkey")
    return D.cap_entities(lines, ["l_suppkey", "l_linestatus"], F.struct("l_orderkey", "l_linenumber", "l_partkey"), fixed.MAX_POLICIES)


def normalise_text(spark, sf):
    dressed = F.concat(F.lit("  “It’s” a​—B…\t• "), "text")
    return documents(spark, sf).select("doc_id", T.normalise(dressed).alias("norm"))


def _quotes(spark, sf, elided=True):
    """Every benchmark text as a quote, whole and, where wanted, with its middle elided."""
    b = table(spark, sf, "benchmark")
    whole = b.select((F.col("item_id") * 2).alias("quote_id"), F.concat(F.lit("“"), "text", F.lit("”")).alias("quote"))
    if not elided:
        return whole
    cut = F.concat(F.lit("- "), F.left("text", F.lit(40)), F.lit("… "), F.right("text", F.lit(40)), F.lit("."))
    return whole.unionByName(b.select((F.col("item_id") * 2 + 1).alias("quote_id"), cut.alias("quote")))


def quote_pieces(spark, sf):
    return _quotes(spark, sf).select("quote_id", F.posexplode(T.quote_pieces(F.col("quote"))).alias("k", "piece"))


def _passages(spark, sf):
    return documents(spark, sf).select("doc_id", F.posexplode(S.chunk_pack(F.col("text"))).alias("section_no", "text"))


def _found(spark, sf, elided=True, **kw):
    return E.verify_quotes(_passages(spark, sf), "doc_id", "section_no", _quotes(spark, sf, elided), "quote_id", **kw)


def verify_quotes(spark, sf):
    shown = E.show_quotes(_found(spark, sf), _passages(spark, sf), "doc_id", "section_no")
    return shown.select("quote_id", "doc_id", "section_no", T.normalise(F.col("shown")).alias("words"))


def scoped_quotes(spark, sf):
    """A quote may only stand in the section numbered like the document's quality label, and like its own parity.

    Quotes are found in all sections first, each section on its own; the scope then keeps some of the hits.
    """
    scope = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("section_no"))
    sections = _passages(spark, sf).withColumn("place", F.struct("doc_id", "section_no"))
    hits = E.verify_quotes(sections, "place", "section_no", _quotes(spark, sf), "quote_id").select("quote_id", "place.doc_id", "section_no")
    return hits.where(F.col("section_no") == F.col("quote_id") % 2).join(scope, ["doc_id", "section_no"], "left_semi").select("quote_id", "doc_id", "section_no")


def verify_quote_lists(spark, sf):
    """Lists of four benchmark texts, each quote looked for in every document."""
    q = _quotes(spark, sf).withColumn("list_id", F.expr("quote_id div 8"))
    first = _found(spark, sf).groupBy("quote_id").agg(F.min_by(F.struct("doc_id", "section_no", "pieces"), F.struct("doc_id", "section_no")).alias("f"))
    shown = E.show_quotes(first.select("quote_id", "f.*"), _passages(spark, sf), "doc_id", "section_no").select("quote_id", "shown")
    return E.quote_lists(q.select("list_id", "quote_id"), shown, "list_id", "quote_id")


def settle_status(spark, sf):
    """A labelled document keeps its status only if some quote was found in it."""
    kept = _found(spark, sf).groupBy("doc_id").agg(F.count("*").alias("kept"))
    judged = table(spark, sf, "labels").select("doc_id", ST.labelled(F.col("quality"), F.col("toxic")).alias("status"))
    rows = judged.join(kept, "doc_id", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    return rows.select("doc_id", "status", "kept", ST.settle(F.col("status"), F.col("kept")).alias("settled"))


QUERIES = {f.__name__: f for f in (
    detect_policies, block_scope, table_allocations, merge_allocations, detect_outcomes, accept_suggestions, focus_sections, cap_entities,
    normalise_text, quote_pieces, verify_quotes, scoped_quotes, verify_quote_lists, settle_status)}

_HEADED = P._MD + r""",
 hd AS (SELECT doc_id, section_no, level, text, CASE WHEN heading = '' THEN '' WHEN section_no % 7 = 0 THEN 'Policy AB' || (section_no % 9 + 1) || ': ' || heading
   WHEN section_no % 7 = 1 THEN 'NW/H' || (section_no % 4) || ' - Land at ' || heading WHEN section_no % 7 = 2 THEN 'Draft Site allocation SA ' || (section_no % 5) || ') ' || heading
   WHEN section_no % 7 = 3 THEN 'Outcome ' || (section_no % 4) || ' | ' || heading WHEN section_no % 7 = 4 THEN 'Our Vision ' || heading
   WHEN section_no % 7 = 5 THEN 'Monitoring of ' || heading ELSE heading END AS heading FROM sec)"""
_CODE = r"([A-Z]{1,6}(?:[/.-]?[A-Z]{1,6})?[\s/.-]?\d{1,3}[a-z]?)"
_POLICY = rf"^{D.PREFIX}{D.KIND}\s+{_CODE}([^\w/].*)?$"
_FIRST = rf"^{_CODE}\s*[:–—-]\s+(\S.*)$"
_BLOCKS = rf"""{_HEADED},
 pol AS (SELECT *, regexp_extract(heading, '{_POLICY}', ['kind', 'code', 'title']) AS a, regexp_extract(heading, '{_FIRST}', ['code', 'title']) AS b FROM hd),
 own AS (SELECT *, a.code <> '' OR b.code <> '' AS own FROM pol),
 scope AS (SELECT x.doc_id, x.section_no, coalesce(min(n.section_no), 1000000) AS stop FROM own x LEFT JOIN own n ON n.doc_id = x.doc_id AND n.section_no > x.section_no AND (n.level <= x.level OR n.own) GROUP BY ALL),
 blocks AS (SELECT s.doc_id, s.section_no, count(*) AS members, {P._STRIP("string_agg(CASE WHEN m.section_no = s.section_no THEN m.text ELSE m.heading || chr(10) || m.text END, chr(10) ORDER BY m.section_no)")} AS block
   FROM scope s JOIN own m ON m.doc_id = s.doc_id AND m.section_no >= s.section_no AND m.section_no < s.stop GROUP BY ALL)"""
_DETECTED = rf"""{_BLOCKS},
 cand AS (SELECT doc_id, section_no, members::INT AS members, block, CASE WHEN a.code <> '' THEN a.kind ELSE '' END AS kind, CASE WHEN a.code <> '' THEN a.code ELSE b.code END AS raw,
   CASE WHEN a.code <> '' THEN regexp_replace(a.title, '^\s*[:.)–—-]?\s*', '') ELSE b.title END AS t FROM own JOIN blocks USING (doc_id, section_no) WHERE a.code <> '' OR b.code <> ''),
 ent AS (SELECT doc_id, translate(regexp_replace(upper(raw), '\s+', '', 'g'), '.-', '//') AS key, section_no, regexp_replace(raw, '\s+', '', 'g') AS code, {P._STRIP("regexp_replace(t, '^[:–—-]\\s*', '')")} AS title, members,
   CASE WHEN regexp_matches(kind, '(?i)site|allocation') OR regexp_matches({P._STRIP("regexp_replace(t, '^[:–—-]\\s*', '')")}, '(?i)\b({D.LAND_WORDS})\b') OR regexp_matches(block, '(?i)\b({D.ALLOCATION_WORDS})\b') THEN 'allocation' ELSE 'policy' END AS entity
   FROM cand WHERE kind <> 'Policies'),
 det AS (SELECT * FROM ent QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY section_no) = 1)"""
_LISTED = rf"""(SELECT doc_id, 1 AS table_no, i + 1 AS row_no, 'NW/H' || i AS ref, trim({P._BARE}) AS name FROM {P._LINES})"""



def _norm(c: str) -> str:
    spaces = "'" + "".join(ch for ch in fixed.FOLD_SPACE if ch > "~") + "' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    quotes = (fixed.FOLD_APOSTROPHE + fixed.FOLD_QUOTE + fixed.FOLD_DASH)
    into = "''" * len(fixed.FOLD_APOSTROPHE) + '"' * len(fixed.FOLD_QUOTE) + "-" * len(fixed.FOLD_DASH)
    return (f"trim(regexp_replace(lower(translate(replace({c}, '…', '...'), '{quotes}' || {spaces} || '{fixed.FOLD_NOTHING}', "
            f"'{into}' || repeat(' ', {len(fixed.FOLD_SPACE)}))), ' +', ' ', 'g'))")


def _pieces(c: str) -> str:
    return (rf"list_filter(list_transform(regexp_split_to_array({_norm(c)}, '\.{{3,}}'), lambda p: regexp_replace(regexp_replace(p, "
            r"""'^[\s"''\-*•>:;,.]+', ''), '[\s"''\-*•:;,.]+$', '')), lambda p: p <> '')""")


_QUOTES = f"""q AS (SELECT item_id * 2 AS quote_id, '“' || text || '”' AS quote FROM benchmark UNION ALL SELECT item_id * 2 + 1, '- ' || left(text, 40) || '… ' || right(text, 40) || '.' FROM benchmark),
 qp AS (SELECT quote_id, {_pieces('quote')} AS pieces FROM q)"""
_SEEN = f"""{_QUOTES}, pk AS (SELECT doc_id, {P._pack('text')} AS s FROM documents), pl AS (SELECT doc_id, CASE WHEN s.c = '' THEN s.o ELSE list_append(s.o, s.c) END AS l FROM pk),
 pn AS (SELECT doc_id, section_no, {_norm('t')} AS norm FROM (SELECT doc_id, generate_subscripts(l, 1) - 1 AS section_no, unnest(l) AS t FROM pl)),
 hits AS (SELECT quote_id, doc_id, section_no, pieces FROM pn JOIN qp ON len(pieces) > 0 AND contains(norm, pieces[1])
   WHERE length(array_to_string(pieces, '')) >= 4 AND length(array_to_string(pieces, ' ')) <= 1200 AND
   list_reduce(list_transform(pieces, lambda p: {{'p': p, 'f': 1::BIGINT}}), lambda a, x: CASE WHEN a.f = 0 OR instr(substring(norm, a.f), x.p) = 0 THEN {{'p': '', 'f': 0::BIGINT}}
     ELSE {{'p': '', 'f': a.f + instr(substring(norm, a.f), x.p) - 1 + length(x.p)}} END, {{'p': '', 'f': 1::BIGINT}}).f > 0),
 seen AS (SELECT quote_id, doc_id, min(section_no) AS section_no, any_value(pieces) AS pieces FROM hits GROUP BY ALL)"""
_SEEN = _SEEN.replace("any_value(pieces) AS pieces FROM hits GROUP BY ALL", "any_value(pieces) AS pieces FROM hits GROUP BY quote_id, doc_id")

ORACLES = {
    "detect_policies": f"WITH {_DETECTED} FROM det",
    "block_scope": f"WITH {_BLOCKS} SELECT doc_id, section_no, members, sha256(block) AS block_hash FROM blocks",
    "table_allocations": f"SELECT * FROM {_LISTED}",
    "merge_allocations": f"""WITH {_DETECTED}, l AS (SELECT doc_id, ref AS key, name, 100000 + row_no / 1000 AS place FROM {_LISTED}),
      m AS (SELECT doc_id, coalesce(code, l.key) AS code, coalesce(title, name) AS title, (l.key IS NOT NULL)::INT::BIGINT AS table_rows, least(section_no, place) AS place FROM det FULL JOIN l USING (doc_id, key) WHERE entity IS NULL OR entity = 'allocation')
      SELECT doc_id, 'S' || row_number() OVER (PARTITION BY doc_id ORDER BY place, code) AS id, code, title, table_rows FROM m""",
    "detect_outcomes": rf"""WITH {_HEADED}, l AS (SELECT doc_id, section_no, -1 AS i, heading AS line FROM hd UNION ALL SELECT doc_id, section_no, generate_subscripts(string_split(text, chr(10)), 1), unnest(string_split(text, chr(10))) FROM hd),
      o AS (SELECT *, regexp_extract(line, '(?i)^(?:measurable\s+)?outcome\s*(\d{{1,2}})\b|^MO\s?(\d{{1,2}})\b|^O(\d{{1,2}})\s*[:.]', ['x', 'y', 'z']) AS m FROM l)
      SELECT doc_id, coalesce(nullif(m.x, ''), nullif(m.y, ''), m.z)::INT AS n, section_no, substring(string_split(line, ' | ')[1], 1, 300) AS text FROM o WHERE m.x || m.y || m.z <> ''
      QUALIFY row_number() OVER (PARTITION BY doc_id, n ORDER BY section_no, i) = 1""",
    "accept_suggestions": f"""WITH {P._MD} SELECT l_orderkey AS doc_id, l_linenumber AS section_no, l_linestatus AS kind, l_partkey AS part, row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY l_linenumber, l_partkey) AS rank
      FROM lineitem SEMI JOIN sec ON doc_id = l_orderkey AND section_no = l_linenumber QUALIFY rank <= 80""",
    "focus_sections": rf"""WITH {_HEADED}, l AS (SELECT doc_id, section_no, -1 AS i, heading AS line FROM hd UNION ALL SELECT doc_id, section_no, generate_subscripts(string_split(text, chr(10)), 1), unnest(string_split(text, chr(10))) FROM hd),
      o AS (SELECT doc_id, section_no, i, regexp_extract(line, '(?i)^(?:measurable\s+)?outcome\s*(\d{{1,2}})\b|^MO\s?(\d{{1,2}})\b|^O(\d{{1,2}})\s*[:.]', ['x', 'y', 'z']) AS m FROM l),
      f AS (SELECT doc_id, section_no, coalesce(nullif(m.x, ''), nullif(m.y, ''), m.z)::INT AS n FROM o WHERE m.x || m.y || m.z <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, n ORDER BY section_no, i) = 1),
      u AS (SELECT doc_id, 'vision' AS focus, section_no, 0 AS n FROM hd WHERE regexp_matches(heading, '(?i)\bvision\b') UNION ALL SELECT doc_id, 'monitoring', section_no, 0 FROM hd WHERE regexp_matches(heading, '(?i)monitor')
        UNION ALL SELECT doc_id, 'outcomes', section_no, min(n) FROM f GROUP BY doc_id, section_no)
      SELECT doc_id, focus, section_no, row_number() OVER (PARTITION BY doc_id, focus ORDER BY n, section_no) AS place FROM u QUALIFY place <= 4""",
    "cap_entities": "SELECT l_suppkey, l_linestatus, l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_suppkey, l_linestatus ORDER BY l_orderkey, l_linenumber, l_partkey) <= 60 AS checked FROM lineitem",
    "normalise_text": "SELECT doc_id, " + _norm("'  “It’s” a' || chr(8203) || '—B…' || chr(9) || '• ' || text") + " AS norm FROM documents",
    "quote_pieces": f"WITH {_QUOTES} SELECT quote_id, generate_subscripts(pieces, 1) - 1 AS k, unnest(pieces) AS piece FROM qp",
    "verify_quotes": f"WITH {_SEEN} SELECT quote_id, doc_id, section_no, array_to_string(pieces, ' ... ') AS words FROM seen",
    "scoped_quotes": f"""WITH {_SEEN} SELECT quote_id, doc_id, section_no FROM hits JOIN labels USING (doc_id) WHERE section_no = quality AND quality = quote_id % 2""",
    "verify_quote_lists": f"""WITH {_SEEN}, f AS (SELECT quote_id, arg_min(pieces, (doc_id, section_no)) AS pieces FROM seen GROUP BY ALL)
      SELECT q.quote_id // 8 AS list_id, count(DISTINCT array_to_string(f.pieces, ' ... ')) AS kept, count(*) FILTER (WHERE f.quote_id IS NULL) AS dropped FROM q LEFT JOIN f USING (quote_id) GROUP BY ALL""",
    "settle_status": f"""WITH {_SEEN}, k AS (SELECT doc_id, count(*) AS kept FROM seen GROUP BY ALL), s AS (SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'met' WHEN quality = 1 THEN 'partly' ELSE 'missing' END AS status, coalesce(kept, 0) AS kept FROM labels LEFT JOIN k USING (doc_id))
      SELECT doc_id, status, kept, CASE WHEN kept > 0 THEN status WHEN status = 'met' THEN 'partly' WHEN status = 'partly' THEN 'missing' ELSE status END AS settled FROM s""",
}
