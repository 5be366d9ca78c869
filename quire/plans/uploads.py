"""The upload chain over documents dressed as Markdown or taken as plain text, and blocks and tables of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import structuring as S
from quire.operators import tables as H
from quire.operators import uploads as U
from quire.plans import structuring as P
from quire.sources.tables import documents, pages


def _markdown(spark, sf):
    """Whole lines of documents, without markup of their own, in twelve forms of Markdown."""
    def form(l, i):
        bare, k = P._bare(l), i % 12
        cell = F.replace(bare, F.lit("|"), F.lit("\\|"))
        c = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
        return (
            F.when(k == 0, c(F.repeat(F.lit("#"), (F.floor(i / 12) % 6 + 1).cast("int")), " ", bare, " ##")).when(k == 2, c(bare, "\n----"))
            .when(k == 3, c("- ", bare)).when(k == 4, c("```\n| ", bare, " | x\n|---|---|\n# ", bare, "\n```"))
            .when(k == 5, c("| Ref | ", cell, "\n|---|:---:|\n| ", cell, " | NW ", i.cast("string"), " |\n| | |")).when(k == 6, F.lit(" "))
            .when(k == 7, c("> ", bare)).when(k == 8, c("<!-- ", bare, "\n# no -->", bare)).when(k == 9, c("2. ", bare)).when(k == 10, F.lit("* * *"))
            .when(k == 11, c(bare, "\n=====")).otherwise(bare))

    md = F.concat(F.lit("---\nsource: x\n---\n"), F.array_join(F.transform(T.lines(F.col("text")), form), "\n"))
    return documents(spark, sf).select("doc_id", U.markdown_blocks(md).alias("blocks"))


def upload_blocks(spark, sf):
    return U.block_rows(_markdown(spark, sf), "doc_id")


def upload_sections(spark, sf):
    sections = U.assemble(_markdown(spark, sf), "doc_id")
    return sections.select("doc_id", "id", "heading", "level", F.array_join("path", " / ").alias("path"), "locator", "text", F.size("tables").alias("n_tables"))


def text_upload_blocks(spark, sf):
    """A third of the documents get blank lines between their lines."""
    text = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("\n"), F.lit("\n \n"))).otherwise(F.col("text"))
    return U.block_rows(documents(spark, sf).select("doc_id", U.text_blocks(text).alias("blocks")), "doc_id").where("text <> ''")


def _tabled(spark, sf):
    """Pages with their own paragraphs in a table: whole rows, rows without end tags, and tables within cells; every second table stays open."""
    paras = F.regexp_extract_all("html", F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1))

    def row(p, i):
        words, c = F.regexp_replace(p, r"<[^>]*>", ""), lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
        n = i.cast("string")
        return (F.when(i % 3 == 0, c("<tr><td>", n, "</td>\n<td> ", words, " </td></tr>")).when(i % 3 == 1, c("<TR class='a'><th>", n, "<td><b>", words, "</b>"))
                .otherwise(c("<tr><td>", n, "</td><td>in: <table><tr><td>", words, "<td>", n, "</table></td></tr>")))

    table = F.concat(F.lit("<table><tbody>"), F.array_join(F.transform(paras, row), ""), F.when(F.col("page_id") % 2 == 0, "</tbody></table>").otherwise(""))
    return pages(spark, sf).select("page_id", F.concat("html", F.lit("\n<div></div>"), table).alias("html"))


def html_tables(spark, sf):
    return H.html_tables(_tabled(spark, sf), "page_id")


def html_blocks(spark, sf):
    return H.html_blocks(_tabled(spark, sf), "page_id")


QUERIES = {f.__name__: f for f in (upload_blocks, upload_sections, text_upload_blocks, html_tables, html_blocks)}

_FORMS = f"""forms AS (SELECT doc_id, i, {P._BARE} AS b, replace({P._BARE}, '|', '\\|') AS c FROM {P._LINES}),
 dressed AS (SELECT doc_id, i, CASE i % 12 WHEN 0 THEN repeat('#', ((i // 12) % 6 + 1)::INT) || ' ' || b || ' ##' WHEN 2 THEN b || chr(10) || '----' WHEN 3 THEN '- ' || b
   WHEN 4 THEN '```' || chr(10) || '| ' || b || ' | x' || chr(10) || '|---|---|' || chr(10) || '# ' || b || chr(10) || '```'
   WHEN 5 THEN '| Ref | ' || c || chr(10) || '|---|:---:|' || chr(10) || '| ' || c || ' | NW ' || i || ' |' || chr(10) || '| | |' WHEN 6 THEN ' ' WHEN 7 THEN '> ' || b WHEN 8 THEN b
   WHEN 9 THEN '2. ' || b WHEN 10 THEN '* * *' WHEN 11 THEN b || chr(10) || '=====' ELSE b END AS d FROM forms),
 md AS (SELECT doc_id, string_split(string_agg(d, chr(10) ORDER BY i), chr(10)) AS ls FROM dressed GROUP BY doc_id)"""

_T = P._STRIP
_CLEAN = lambda c: _T(rf"regexp_replace(regexp_replace({c}, '[\t\x{{00A0}}\x{{2000}}-\x{{200B}}\x{{202F}}\x{{205F}}\x{{3000}} ]+', ' ', 'g'), ' *\n *', chr(10), 'g')")

# One recursive step a line, with the same few states.
_BLOCKS = rf"""WITH RECURSIVE {_FORMS},
 raw AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line, unnest(list_append(ls[2:], '')) AS following, len(ls) AS n FROM md),
 bare AS (SELECT *, {_T('line')} AS t, {_T('following')} AS f FROM raw),
 seen AS (SELECT *, CASE WHEN regexp_matches(t, '^(```|~~~)') THEN 'fence' WHEN t = '' THEN 'blank' WHEN regexp_matches(t, '^#{{1,6}}\s+.*$') THEN 'heading'
   WHEN contains(t, '|') AND regexp_matches(following, '^\s*\|?\s*:?-{{3,}}:?\s*(\|\s*:?-{{3,}}:?\s*)*\|?\s*$') THEN 'table' WHEN regexp_matches(regexp_replace(t, '\s', '', 'g'), '^(\*{{3,}}|-{{3,}}|_{{3,}})$') THEN 'rule'
   WHEN regexp_matches(t, '^([-*+]|\d{{1,3}}[.)])\s+.*$') THEN 'item' ELSE 'text' END AS kind,
   CASE WHEN NOT regexp_matches(f, '^(={{2,}}|-{{2,}})\s*$') OR regexp_matches(t, '^[-*+]\s') OR contains(t, '|') THEN 0 WHEN starts_with(f, '=') THEN 1 ELSE 2 END AS under FROM bare),
 lines AS (SELECT *, CASE kind WHEN 'heading' THEN regexp_extract(t, '^(#{{1,6}})\s+(.*?)\s*#*\s*$', 2) WHEN 'item' THEN regexp_extract(t, '^([-*+]|\d{{1,3}}[.)])\s+(.*)$', 2) ELSE regexp_replace(t, '^>\s?', '') END AS words FROM seen),
 run AS (SELECT doc_id, 0::BIGINT AS i, '' AS mode, '' AS fence, NULL::VARCHAR AS part, []::STRUCT(kind VARCHAR, level BIGINT, text VARCHAR)[] AS made FROM md
  UNION ALL SELECT doc_id, i, CASE WHEN stays THEN mode WHEN mode = 'rule' THEN 'table' WHEN ends OR mode = 'skip' THEN '' WHEN headed THEN 'skip' WHEN kind = 'fence' THEN 'code' WHEN kind = 'table' THEN 'rule' ELSE '' END,
    CASE WHEN stays THEN fence ELSE left(t, 3) END,
    CASE WHEN stays THEN part || chr(10) || line WHEN mode = 'rule' THEN part WHEN ends OR mode = 'skip' OR headed THEN NULL WHEN kind = 'fence' THEN '' WHEN kind = 'table' THEN t WHEN kind = 'item' THEN words
      WHEN kind = 'text' THEN concat_ws(' ', CASE WHEN mode <> 'table' THEN part END, words) END,
    CASE WHEN stays OR mode IN ('rule', 'skip') THEN [] WHEN ends THEN [{{'kind': 'code', 'level': 0, 'text': part}}] ELSE
      list_concat(CASE WHEN part IS NULL OR (kind = 'text' AND mode <> 'table' AND NOT headed) THEN [] ELSE [{{'kind': CASE WHEN mode = 'table' THEN 'table' ELSE 'para' END, 'level': 0, 'text': part}}] END,
        CASE WHEN headed THEN [{{'kind': 'heading', 'level': under, 'text': t}}] WHEN kind = 'heading' THEN [{{'kind': 'heading', 'level': length(regexp_extract(t, '^#+')), 'text': words}}] ELSE [] END) END
  FROM (SELECT run.doc_id, l.i, run.mode, run.fence, run.part, l.line, l.t, l.kind, l.words, l.under, (run.mode = 'code' AND NOT starts_with(l.t, run.fence)) OR (run.mode = 'table' AND contains(l.t, '|')) AS stays,
    run.mode = 'code' AND starts_with(l.t, run.fence) AS ends, (run.part IS NULL OR run.mode = 'table') AND l.under > 0 AND l.kind NOT IN ('fence', 'blank', 'heading') AS headed FROM run JOIN lines l ON l.doc_id = run.doc_id AND l.i = run.i + 1)),
 last AS (SELECT run.doc_id, run.i + 1 AS i, [{{'kind': CASE WHEN mode = 'code' THEN 'code' WHEN mode IN ('rule', 'table') THEN 'table' ELSE 'para' END, 'level': 0, 'text': part}}] AS made FROM run JOIN md ON run.doc_id = md.doc_id AND run.i = len(ls) WHERE part IS NOT NULL),
 found AS (SELECT doc_id, i, k, b.kind AS kind, b.level AS level, b.text AS raw FROM (SELECT doc_id, i, unnest(made) AS b, generate_subscripts(made, 1) AS k FROM (SELECT doc_id, i, made FROM run UNION ALL SELECT doc_id, i, made FROM last))),
 grid AS (SELECT doc_id, i, k, string_agg(cells, chr(10) ORDER BY r) AS text FROM (SELECT doc_id, i, k, r, array_to_string(list_transform(cells, lambda c: {_CLEAN("replace(c, chr(1), '|')")}), ' | ') AS cells FROM
   (SELECT doc_id, i, k, unnest(range(len(string_split(raw, chr(10))))) AS r, string_split(replace(regexp_replace(regexp_replace({_T('unnest(string_split(raw, chr(10)))')}, '^\|', ''), '\|$', ''), chr(92) || chr(124), chr(1)), '|') AS cells FROM found WHERE kind = 'table'))
   WHERE regexp_matches(cells, '[^ |]') GROUP BY ALL),
 blocks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1 AS block_no, CASE WHEN kind = 'code' THEN 'para' ELSE kind END AS kind, level, text FROM
   (SELECT f.doc_id, f.i, f.k, f.kind, f.level, CASE WHEN f.kind = 'table' THEN coalesce(grid.text, '') ELSE {_CLEAN('raw')} END AS text FROM found f LEFT JOIN grid ON f.doc_id = grid.doc_id AND f.i = grid.i AND f.k = grid.k) WHERE kind = 'table' OR text <> '')"""

_LEVEL = P.level_sql("para")
_GROUPS = P.ORACLES["paragraph_groups"].rsplit("SELECT doc_id, (row_number()", 1)[0]

_PARAS = r"""paras AS (SELECT page_id, unnest(range(len(l))) AS i, unnest(l) AS raw FROM (SELECT page_id, regexp_extract_all(html, '(?is)<p\b[^>]*>(.*?)</p>', 1) AS l FROM pages)),
 said AS (SELECT page_id, i, i + i // 3 AS r, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(raw, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS w FROM paras),
 cells AS (SELECT page_id, r AS row_no, 0 AS cell_no, i::VARCHAR AS text FROM said
   UNION ALL SELECT page_id, r, 1, CASE WHEN i % 3 = 2 THEN rtrim('in: ' || w || i) ELSE w END FROM said
   UNION ALL SELECT page_id, r + 1, 0, w FROM said WHERE i % 3 = 2 UNION ALL SELECT page_id, r + 1, 1, i::VARCHAR FROM said WHERE i % 3 = 2)"""

_PAGE = r"""b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style>', ' ', 'g'),
    '(?is)<nav\b[^>]*>.*?</nav>', ' ', 'g'), '(?is)<footer\b[^>]*>.*?</footer>', ' ', 'g'), '(?s)<!--.*?-->', '', 'g') AS h FROM pages),
 c AS (SELECT page_id, string_split(regexp_replace(h, '(?i)(</?(?:h[1-6]|p|li|ul|ol|article|div)\b[^>]*>)', chr(1) || '\1', 'g'), chr(1)) AS l FROM b),
 r AS (SELECT page_id, generate_subscripts(l, 1) - 1 AS at_, unnest(l) AS piece FROM c), t AS (SELECT *, lower(regexp_extract(piece, '(?i)^<(h[1-6]|p|li)\b', 1)) AS tag FROM r),
 x AS (SELECT page_id, at_, tag, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(piece, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM t WHERE tag <> '')"""

ORACLES = {
    "upload_blocks": f"{_BLOCKS} SELECT doc_id, block_no::INT AS block_no, kind, level::INT AS level, text FROM blocks",
    "upload_sections": f"""{_BLOCKS}, numbered AS (SELECT *, sum((kind = 'heading')::INT) OVER (PARTITION BY doc_id ORDER BY block_no) AS s FROM blocks),
 sec AS (SELECT doc_id, s, coalesce(max(text) FILTER (WHERE kind = 'heading'), '') AS heading, coalesce(max(level) FILTER (WHERE kind = 'heading'), 0)::INT AS level,
   coalesce(string_agg(text, chr(10) ORDER BY block_no) FILTER (WHERE kind <> 'heading' AND (kind <> 'table' OR text <> '')), '') AS text, count(*) FILTER (WHERE kind = 'table' AND text <> '') AS n_tables FROM numbered GROUP BY ALL),
 heads AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS no, count(*) FILTER (WHERE level = 1) OVER (PARTITION BY doc_id) AS ones FROM sec WHERE heading <> '' OR text <> ''),
 above AS (SELECT a.doc_id, a.s, h.s AS hs, h.heading FROM heads a JOIN heads h ON a.doc_id = h.doc_id AND h.level > 0 AND (h.s = a.s OR (h.s < a.s AND h.level < a.level AND NOT EXISTS
   (SELECT 1 FROM heads g WHERE g.doc_id = a.doc_id AND g.s > h.s AND g.s < a.s AND g.level <= h.level)))),
 paths AS (SELECT doc_id, s, list(heading ORDER BY hs) AS path FROM above GROUP BY ALL),
 titles AS (SELECT doc_id, heading AS title, level = 1 AND ones = 1 AS titled FROM heads WHERE no = 1),
 cut AS (SELECT h.*, CASE WHEN titled AND no > 1 AND path[1] = title THEN path[2:] ELSE coalesce(path, []) END AS path FROM heads h JOIN titles USING (doc_id) LEFT JOIN paths p ON h.doc_id = p.doc_id AND h.s = p.s)
 SELECT doc_id, 's' || no AS id, heading, level, array_to_string(path, ' / ') AS path, CASE WHEN len(path) = 0 THEN 'Opening text' ELSE array_to_string(path[greatest(1, len(path) - 2):], ' › ') END AS locator, text, n_tables::INT AS n_tables FROM cut""",
    "text_upload_blocks": f"""{_GROUPS.replace("min(i) AS i,", "min(i) AS i, count(*) AS n_lines, any_value(per) AS per,")}, cleaned AS (SELECT doc_id, i, {_CLEAN('para')} AS para, n_lines FROM g),
 lv AS (SELECT doc_id, i, para, CASE WHEN n_lines = 1 THEN {_LEVEL} ELSE 0 END AS level FROM cleaned WHERE para <> '')
 SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS block_no, CASE WHEN level > 0 THEN 'heading' ELSE 'para' END AS kind, level::INT AS level, para AS text FROM lv""",
    "html_tables": f"WITH {_PARAS} SELECT page_id, 1 AS table_no, row_no::INT AS row_no, cell_no::INT AS cell_no, text FROM cells",
    "html_blocks": f"""WITH {_PARAS}, {_PAGE}, rows_ AS (SELECT page_id, row_no, string_agg(text, ' | ' ORDER BY cell_no) AS line FROM cells GROUP BY ALL)
 SELECT page_id, at_ AS "at", CASE tag WHEN 'p' THEN 'para' WHEN 'li' THEN 'item' ELSE 'heading' END AS kind, CASE WHEN tag LIKE 'h%' THEN substring(tag, 2, 1)::INT ELSE 0 END AS level, text FROM x WHERE text <> ''
 UNION ALL SELECT page_id, any_value(n) AS at_, 'table', 0, string_agg(line, chr(10) ORDER BY row_no) FROM rows_ JOIN (SELECT page_id, len(l) + 2 AS n FROM c) USING (page_id) GROUP BY page_id""",
}
