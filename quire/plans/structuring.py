"""Sources and document structure over documents and pages; Markdown is derived from their own lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import structuring as S
from quire.sources import files
from quire.sources.tables import documents, pages, table


def _markdown(spark, sf):
    """Every fourth line of a document becomes a heading, one in four of those a link."""
    def mark(line, i):
        words = F.when((F.floor(i / 4) % 4) == 2, F.concat(F.lit("["), line, F.lit("](/l/"), i, F.lit(")"))).otherwise(line)
        return F.when(i % 4 == 0, F.concat(F.repeat(F.lit("#"), (F.floor(i / 4) % 4 + 1).cast("int")), F.lit(" "), words)).otherwise(line)

    md = F.array_join(F.transform(T.lines(F.col("text")), mark), "\n")
    kind = F.when(F.col("doc_id") % 2 == 0, "legislation").otherwise("guidance")
    return documents(spark, sf).select("doc_id", "source", kind.alias("kind"), md.alias("md"))


def _sections(spark, sf):
    """Sections with statute-like headings mixed in, so that every kind of id occurs."""
    n, h = F.col("section_no"), F.col("heading")
    varied = (F.when(h == "", h).when(n % 6 == 0, F.concat(n, F.lit(". "), h)).when(n % 6 == 1, F.concat(F.lit("Part "), n))
              .when(n % 6 == 2, F.concat(F.lit("SCHEDULE "), F.floor(n / 12))).when(n % 6 == 3, "Explanatory Note").otherwise(h))
    s = S.sectionise(_markdown(spark, sf)).withColumn("heading", varied)
    return s.withColumn("id", S.section_id(F.col("heading"), F.col("kind")))


def _anchored(spark, sf):
    s = S.unique_ids(_sections(spark, sf), "doc_id", "section_no")
    return s.withColumn("route", F.concat(F.lit("/reference/d"), "doc_id", F.lit("/")))


def source_catalogue(spark, sf):
    """Nations list the sources; each source's first document holds its front matter."""
    listed = table(spark, sf, "nation").select(
        F.concat(F.lit("src"), "n_nationkey").alias("id"), F.col("n_name").alias("short"), F.lit("guidance").alias("kind"),
        F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("title"), F.lit(None).cast("string").alias("publisher"),
        F.when(F.col("n_regionkey") == 1, F.concat(F.lit("https://example.org/"), "n_nationkey")).alias("url"),
        F.when(F.col("n_nationkey") % 3 == 0, "2026-08-13T00:00:00Z").alias("updated"))
    own = documents(spark, sf).groupBy(F.col("source").alias("id")).agg(
        F.min_by(F.regexp_extract("text", r"^[^\n]*", 0), "doc_id").alias("title"), F.min_by("lang", "doc_id").alias("publisher"),
        F.concat(F.lit("https://example.com/"), F.min("doc_id")).alias("url"), F.lit("2026-01-02T03:04:05Z").alias("updated"))
    return files.source_catalogue(listed, own)


def document_scan(spark, sf):
    return documents(spark, sf).select("doc_id", F.length("text").alias("characters"), T.sha256(F.col("text")).alias("sha256"))


def front_matter(spark, sf):
    head = F.concat(F.lit("---\nsource: "), "source", F.lit("\nlang:"), "lang", F.lit("\nno colon\nurl: https://x.org/"), "doc_id",
                    F.lit("\nlang: again "), "lang", F.lit("\n---\n"), "text")
    return files.front_matter(documents(spark, sf).select("doc_id", head.alias("text")), "doc_id")


def content_json(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.explode(F.from_json("props", "map<string,bigint>")).alias("key", "value"))
    return e.groupBy("key", "value").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


def admission(spark, sf):
    ends = F.array(*[F.lit(e) for e in (".docx", ".pptx", ".md", ".MD", ".txt", ".pdf", ".markdown")])
    name = F.concat("source", F.lit("/plan "), "doc_id", F.get(ends, (F.col("doc_id") % 7).cast("int")))
    up = documents(spark, sf).select("doc_id", name.alias("name"), F.octet_length("text").alias("bytes"), F.length("text").alias("characters"))
    return files.admission(up, max_bytes=30000, max_chars=20000).select("doc_id", "type", "verdict")


def charset_decode(spark, sf):
    mark = lambda h, c: F.concat(F.unhex(F.lit(h)), F.encode("text", c))
    k = F.col("doc_id") % 4
    data = F.when(k == 0, mark("FFFE", "UTF-16LE")).when(k == 1, mark("FEFF", "UTF-16BE")).when(k == 2, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    return documents(spark, sf).select("doc_id", files.decode_text(data).alias("text"))


def usage_log_source(spark, sf):
    """Events written as call records in JSON lines and read back."""
    path = files.scratch(spark, "usage")
    files.append_usage(_usage(spark, sf), path)
    u = files.read_usage(spark, path)
    return u.groupBy("feature", "ok").agg(F.count("*").alias("calls"), F.max("ms").alias("slowest"), F.sum("tokensIn").alias("tokens"))


def _usage(spark, sf):
    ok = F.col("event_type") != "error"
    return table(spark, sf, "events").select(
        F.col("ts").alias("at"), F.col("event_type").alias("feature"), F.concat(F.lit("c"), F.col("user_id") % 3).alias("connection"),
        F.lit("azure").alias("kind"), F.concat(F.lit("m"), F.col("user_id") % 2).alias("model"), F.col("value").alias("ms"), ok.alias("ok"),
        F.when(ok, F.get_json_object("props", "$.k").cast("bigint")).alias("tokensIn"))


def corpus_sink(spark, sf):
    chunks = _chunks(spark, sf).join(documents(spark, sf).select("doc_id", F.col("lang").alias("kind")), "doc_id")
    return files.write_corpus(chunks, files.scratch(spark, "corpus"))


def snapshot_diff(spark, sf):
    """The stored copy lacks toxic documents, has others edited where quality is 0, and holds extra pages."""
    docs = documents(spark, sf).select(F.concat(F.lit("d"), "doc_id").alias("id"), "text", "doc_id")
    kept = docs.join(table(spark, sf, "labels"), "doc_id", "left").where("coalesce(toxic, 0) = 0")
    stored = kept.select("id", F.when(F.col("quality") == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")).alias("text"))
    extra = pages(spark, sf).select(F.concat(F.lit("p"), "page_id").alias("id"), F.col("html").alias("text"))
    return files.snapshot_diff(docs.select("id", "text"), stored.unionByName(extra), "id")


def sectionise(spark, sf):
    return S.sectionise(_markdown(spark, sf)).select("doc_id", "section_no", "level", "heading", "text")


def section_ids(spark, sf):
    return _sections(spark, sf).select("doc_id", "section_no", "id")


def unique_section_ids(spark, sf):
    return _anchored(spark, sf).select("doc_id", "section_no", "anchor")


def unit_split(spark, sf):
    return S.units(_markdown(spark, sf), "doc_id")


def md_to_plain(spark, sf):
    dressed = F.concat(F.lit("# *Title* `x`\n\n- [one](/a) ![i](p.png)\n* two | three\n\n"), "text")
    return documents(spark, sf).select("doc_id", T.md_to_plain(dressed).alias("plain"))


def chunk_pack(spark, sf):
    return documents(spark, sf).select("doc_id", F.posexplode(S.chunk_pack(F.col("text"))).alias("k", "chunk"))


def _chunks(spark, sf):
    return S.corpus_chunks(_anchored(spark, sf).withColumn("title", F.col("source")), "doc_id", "title")


def corpus_chunks(spark, sf):
    return _chunks(spark, sf).drop("doc_id")


def anchor_map(spark, sf):
    a = _anchored(spark, sf)
    return a.select("doc_id", "anchor", "route", ((F.col("level") <= 3) & (F.col("heading") != "")).alias("in_contents"))


def toc_titles(spark, sf):
    def line(l, i):
        chapter = F.concat(i + 1, F.lit(". "), l, F.lit(" (PM"), i, F.lit(" - "), i + 3, F.lit(") ..... "), i * 3)
        return F.when(i % 3 == 0, chapter).when(i % 3 == 1, F.concat(F.lit("  Annex B: "), l, F.lit("....... 7"))).otherwise(l)

    docs = documents(spark, sf).select("doc_id", F.array_join(F.transform(T.lines(F.col("text")), line), "\n").alias("toc"))
    return S.toc_titles(docs, "doc_id", "toc")


def footnote_sequence(spark, sf):
    """Line lengths stand in for the numbers that start lines."""
    numbers = F.transform(T.lines(F.col("text")), lambda l, i: (F.length(l) % 40 + i).cast("int"))
    return documents(spark, sf).select("doc_id", F.posexplode(S.footnote_sequence(numbers)).alias("place", "n"))


def footnote_attach(spark, sf):
    """Each line carries its number as a marker after its last word, and some carry the next one's too."""
    docs = documents(spark, sf)
    words = lambda l: F.regexp_replace(l, r"[^a-z ]", "")
    blocks = docs.select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("block_no", "l")).select(
        "doc_id", "block_no", F.concat(words(F.col("l")), F.lit("x"), F.col("block_no") % 900, F.lit(", and y"), F.col("block_no") % 900 + 2, F.lit(".")).alias("text"),
        F.concat(F.lit("PM"), "block_no").alias("at"), F.concat(F.lit("a-"), "block_no").alias("target"))
    notes = docs.select("doc_id", F.explode(F.sequence(F.lit(1), F.size(T.lines(F.col("text"))))).alias("n"))
    return S.footnote_attach(blocks, notes, "doc_id")


def heading_paths(spark, sf):
    return S.heading_paths(S.sectionise(_markdown(spark, sf)), "doc_id")


def _bare(line):
    """A line without markup of its own."""
    return F.regexp_replace(line, r"[*_`~<>\[\]\\]", "")


def _tabled(spark, sf):
    def row(l, i):
        return F.concat(F.lit("| NW/H"), i, F.lit(" | "), F.replace(_bare(l), F.lit("|"), F.lit("\\|")), F.lit(" |  "), F.length(l), F.lit(" |"))

    rows = F.array_join(F.transform(T.lines(F.col("text")), row), "\n")
    md = F.concat("text", F.lit("\n\n| Ref | Site name | Area |\n|---|:---:|---|\n"), rows, F.lit("\n\nEnd of schedule.\n"))
    return documents(spark, sf).select("doc_id", md.alias("md"))


def table_extract(spark, sf):
    rows = S.table_rows(_tabled(spark, sf), "doc_id", "md")
    return rows.select("doc_id", "table_no", "row_no", F.array_join("cells", " | ").alias("flat"))


def strip_inline(spark, sf):
    """Each line of a document with a link, an image, code and emphasis put round it."""
    lines = documents(spark, sf).select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("line_no", "l"))
    dressed = F.concat(F.lit("![pic](a.png) [link](/x) **bold** `code` ~~gone~~ <b>tag</b> \\* "), _bare("l"))
    return lines.select("doc_id", "line_no", T.strip_inline(dressed).alias("text"))


def heading_level(spark, sf):
    def vary(l, i):
        return F.when(i % 5 == 1, F.concat(F.lit("Chapter "), l)).when(i % 5 == 2, F.concat(i, F.lit(".2 Then "), l)).when(
            i % 5 == 3, T.upper(l)).when(i % 5 == 4, F.initcap(l)).otherwise(l)

    docs = documents(spark, sf).select("doc_id", F.posexplode(F.transform(T.lines(F.col("text")), vary)).alias("line_no", "line"))
    return docs.select("doc_id", "line_no", S.heading_level(F.col("line")).alias("level"))


def paragraph_groups(spark, sf):
    """A third of the documents get blank lines between their lines."""
    text = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("\n"), F.lit("\n \n"))).otherwise(F.col("text"))
    return documents(spark, sf).select("doc_id", F.posexplode(S.paragraph_groups(text)).alias("place", "para"))


def section_select(spark, sf):
    md = S.section_select(F.col("md"), ["the", "le", "der", "un", "a", "e"], r"^[A-M]")
    return _markdown(spark, sf).select("doc_id", md.alias("kept"))


def provision_slice(spark, sf):
    s = _sections(spark, sf)
    wanted = s.groupBy("doc_id").agg(F.min("id").alias("from_id"), F.max("id").alias("to_id"))
    return S.provision_slice(s, wanted, "doc_id").select("doc_id", "section_no", "id")


def prospective_mark(spark, sf):
    flags = table(spark, sf, "labels").select("doc_id", (F.col("toxic") == 1).alias("prospective"))
    s = _sections(spark, sf).join(flags, "doc_id", "left")
    shown = F.when(F.coalesce("prospective", F.lit(False)), F.concat("heading", F.lit(" (prospective: not yet in force)"))).otherwise(F.col("heading"))
    return s.select("doc_id", "section_no", shown.alias("heading"))


def link_absolutise(spark, sf):
    def line(l, i):
        link = F.when(i % 4 == 1, F.lit(" [see](#missing)")).when(i % 4 == 2, F.lit(" [home](/guide) [cdn](//cdn)")).otherwise("")
        own = F.concat(F.lit("## Part "), i, F.lit("\n"), l, F.lit(" [here](#part-"), i, F.lit(")"))
        return F.when(i % 4 == 0, own).otherwise(F.concat(l, link))

    md = F.array_join(F.transform(T.lines(F.col("text")), line), "\n")
    url = F.concat(F.lit("https://example.org/d/"), "doc_id")
    return documents(spark, sf).select("doc_id", S.absolute_links(md, url, "https://example.org").alias("md"))


def doc_stats(spark, sf):
    return documents(spark, sf).select(
        "doc_id", F.length("text").alias("characters"), F.regexp_count("text", F.lit(r"\S+")).alias("words"),
        F.size(T.lines(F.col("text"))).alias("sections"), T.sha256(F.col("text")).alias("sha256"))


def heading_outline(spark, sf):
    return S.heading_outline(S.sectionise(_markdown(spark, sf)), "doc_id")


def file_inventory(spark, sf):
    ext = F.when(F.col("doc_id") % 2 == 0, "md").otherwise("mjs")
    text = F.when(ext == "md", F.concat(F.lit("# T\n\n"), "text")).otherwise(F.concat(F.lit("// "), F.regexp_replace("text", "\n", "\n// "), F.lit("\nlet a;")))
    df = documents(spark, sf).select("doc_id", text.alias("t"), ext.alias("ext"))
    listed = df.select("doc_id", F.size(T.lines(F.col("t"))).alias("lines"), S.summary(F.col("t"), F.col("ext")).alias("summary"))
    total = listed.agg(F.sum("lines").alias("n")).select("n").scalar()
    return listed.withColumn("total_lines", total)


QUERIES = {f.__name__: f for f in (
    source_catalogue, document_scan, front_matter, content_json, admission, charset_decode, usage_log_source, corpus_sink,
    snapshot_diff, sectionise, section_ids, unique_section_ids, unit_split, md_to_plain, chunk_pack, corpus_chunks, anchor_map,
    toc_titles, footnote_sequence, footnote_attach, heading_paths, table_extract, strip_inline, heading_level, paragraph_groups,
    section_select, provision_slice, prospective_mark, link_absolutise, doc_stats, heading_outline, file_inventory)}

_MD = r"""
md_lines AS (SELECT doc_id, source, i - 1 AS i, l FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
marked AS (SELECT doc_id, source, i, CASE WHEN i % 4 = 0 THEN repeat('#', ((i // 4) % 4 + 1)::INT) || ' ' || CASE WHEN (i // 4) % 4 = 2 THEN '[' || l || '](/l/' || i || ')' ELSE l END ELSE l END AS line FROM md_lines),
flagged AS (SELECT *, regexp_matches(line, '^#{1,4}\s+.') AS h, regexp_extract(line, '^(#{1,4})\s+(.+?)\s*$', 2) AS raw FROM marked),
numbered AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY i) AS no FROM flagged),
grouped AS (SELECT doc_id, any_value(source) AS source, no::INT AS section_no,
    coalesce(max(length(regexp_extract(line, '^#{1,4}'))) FILTER (WHERE h), 0)::INT AS level, coalesce(max(raw) FILTER (WHERE h), '') AS raw,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT h), '') AS body, count(*) FILTER (WHERE NOT h) AS n_body FROM numbered GROUP BY doc_id, no),
named AS (SELECT *, regexp_matches(raw, '^\[[^\]]+\]\([^)\s]+\)$') AS linked,
    trim(regexp_replace(replace(CASE WHEN regexp_matches(raw, '^\[[^\]]+\]\([^)\s]+\)$') THEN regexp_extract(raw, '^\[([^\]]+)\]', 1) ELSE raw END, '\.', '.'), '\s+', ' ', 'g')) AS heading FROM grouped),
sec AS (SELECT doc_id, source, section_no, level, heading,
    CASE WHEN linked THEN '[' || heading || '](' || regexp_extract(raw, '\]\(([^)\s]+)\)$', 1) || ')' || chr(10) || CASE WHEN n_body > 0 THEN chr(10) || body ELSE '' END ELSE body END AS text
    FROM named WHERE heading <> '' OR regexp_matches(body, '\S')),
varied AS (SELECT * REPLACE (CASE WHEN heading = '' THEN '' WHEN section_no % 6 = 0 THEN section_no || '. ' || heading WHEN section_no % 6 = 1 THEN 'Part ' || section_no
    WHEN section_no % 6 = 2 THEN 'SCHEDULE ' || (section_no // 12) WHEN section_no % 6 = 3 THEN 'Explanatory Note' ELSE heading END AS heading),
    CASE WHEN doc_id % 2 = 0 THEN 'legislation' ELSE 'guidance' END AS kind FROM sec),
slugged AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(heading), '[''’]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM varied),
ided AS (SELECT *, CASE WHEN kind = 'legislation' AND regexp_matches(heading, '^\d+[A-Z]{0,3}\.\s') THEN 'reg-' || regexp_extract(heading, '^(\d+[A-Z]{0,3})\.', 1)
    WHEN kind = 'legislation' AND regexp_matches(heading, '(?i)^Part \d+\b') THEN 'part-' || regexp_extract(heading, '(?i)^Part (\d+)', 1)
    WHEN kind = 'legislation' AND regexp_matches(heading, '(?i)^SCHEDULE \d+\b') THEN 'schedule-' || regexp_extract(heading, '(?i)^SCHEDULE (\d+)', 1)
    WHEN kind = 'legislation' AND regexp_matches(heading, '(?i)^Schedule\b') THEN 'schedule'
    WHEN kind = 'legislation' AND regexp_matches(heading, '(?i)^Explanatory Note') THEN 'explanatory-note'
    WHEN slug = '' THEN 'section' ELSE slug END AS id FROM slugged),
anchored AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN id ELSE id || '-' || row_number() OVER w END AS anchor, '/reference/d' || doc_id || '/' AS route
    FROM ided WINDOW w AS (PARTITION BY doc_id, id ORDER BY section_no))"""

_STRIP = lambda c: rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def _plain(c: str) -> str:
    for pattern, into in ((r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]+)\]\([^)]*\)", r"\1"), (r"[*_`>#]+", ""), (r"(?m)^\s*[-*]\s+", "• "),
                          (r"\|", " "), (r"\n{2,}", "' || chr(10) || '"), (r"[ \t]+", " ")):
        c = f"regexp_replace({c}, '{pattern}', '{into}', 'g')"
    return _STRIP(c)


def _pack(c: str) -> str:
    paras = f"list_filter(list_transform(string_split({c}, chr(10)), lambda p: {_STRIP('p')}), lambda p: p <> '')"
    items = f"list_transform({paras}, lambda p: {{'o': []::VARCHAR[], 'c': p}})"
    over = "(a.c <> '' AND length(a.c) + length(x.c) > 1260)"
    cur = f"CASE WHEN {over} OR a.c = '' THEN x.c ELSE a.c || chr(10) || x.c END"
    out = f"CASE WHEN {over} THEN list_append(a.o, a.c) ELSE a.o END"
    step = f"CASE WHEN length({cur}) >= 900 THEN {{'o': list_append({out}, {cur}), 'c': ''}} ELSE {{'o': {out}, 'c': {cur}}} END"
    return f"list_reduce({items}, lambda a, x: {step}, {{'o': []::VARCHAR[], 'c': ''}})"


_CHUNKS = f"""WITH {_MD},
 packed AS (SELECT doc_id, anchor, route, CASE WHEN heading = '' THEN source ELSE heading END AS heading, {_pack(_plain('text'))} AS s FROM anchored),
 lists AS (SELECT doc_id, anchor, route, heading, CASE WHEN s.c = '' THEN s.o ELSE list_append(s.o, s.c) END AS l FROM packed),
 chunks AS (SELECT doc_id, anchor, route, heading, generate_subscripts(l, 1) - 1 AS k, unnest(l) AS text FROM lists),
 ch AS (SELECT doc_id || '#' || anchor || CASE WHEN k > 0 THEN ':' || k ELSE '' END AS id, doc_id, anchor, route, heading, text FROM chunks)"""



def level_sql(c: str) -> str:
    """A plain line's rank as a heading."""
    words, letters = rf"regexp_split_to_array({c}, '\s+')", f"regexp_replace({c}, '[^A-Za-z]', '', 'g')"
    long = f"list_filter({words}, lambda w: length(w) > 3)"
    return rf"""(CASE WHEN length({c}) > 120 OR NOT regexp_matches({c}, '[A-Za-z]') OR regexp_matches({c}, '[.,;:]$') THEN 0
        WHEN regexp_matches({c}, '(?i)^(chapter|part|appendix|annex|schedule)\s+\w') THEN 1 WHEN regexp_matches({c}, '(?i)^(strategic\s+)?policy\s+[A-Z]{{0,6}}[\s/-]?\d') THEN 3
        WHEN regexp_matches({c}, '^(\d{{1,2}}(?:\.\d{{1,2}}){{0,3}})\.?\s+[A-Z]') THEN least(4, len(string_split(regexp_extract({c}, '^(\d{{1,2}}(?:\.\d{{1,2}}){{0,3}})', 1), '.')))
        WHEN length({letters}) >= 4 AND {letters} = upper({letters}) THEN 1
        WHEN len({words}) <= 10 AND regexp_matches({c}, '^[A-Z]') AND len({long}) > 0 AND len(list_filter({long}, lambda w: regexp_matches(w, '^[A-Z]'))) / len({long}) >= 0.6 THEN 2 ELSE 0 END)::INT"""


_BARE = r"regexp_replace(l, '[*_`~<>\[\]\\]', '', 'g')"
_LINES = "(SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS l FROM documents)"

ORACLES = {
    "source_catalogue": r"""WITH f AS (SELECT source AS id, arg_min(regexp_extract(text, '^[^\n]*'), doc_id) AS title, arg_min(lang, doc_id) AS publisher, 'https://example.com/' || min(doc_id) AS url FROM documents GROUP BY ALL)
      SELECT 'src' || n_nationkey AS id, n_name AS short, 'guidance' AS kind, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE title END AS title, publisher,
        CASE WHEN n_regionkey = 1 THEN 'https://example.org/' || n_nationkey ELSE url END AS url, CASE WHEN n_nationkey % 3 = 0 THEN '2026-08-13' WHEN f.id IS NOT NULL THEN '2026-01-02' END AS updated,
        '/reference/src' || n_nationkey || '/' AS route FROM nation LEFT JOIN f ON f.id = 'src' || n_nationkey""",
    "document_scan": "SELECT doc_id, length(text) AS characters, sha256(text) AS sha256 FROM documents",
    "front_matter": """SELECT doc_id, 'source' AS key, source AS value FROM documents UNION ALL SELECT doc_id, 'lang', 'again ' || lang FROM documents
      UNION ALL SELECT doc_id, 'url', 'https://x.org/' || doc_id FROM documents""",
    "content_json": "SELECT 'k' AS key, json_extract(props, '$.k')::BIGINT AS value, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY ALL",
    "admission": """SELECT doc_id, ['docx','pptx','md','md','txt','','md'][doc_id % 7 + 1] AS type, CASE WHEN strlen(text) = 0 THEN 'empty' WHEN strlen(text) > 30000 THEN 'too big'
      WHEN doc_id % 7 = 5 THEN 'wrong type' WHEN length(text) < 300 THEN 'too short' WHEN length(text) > 20000 THEN 'too long' ELSE 'accepted' END AS verdict FROM documents""",
    "charset_decode": "SELECT doc_id, text FROM documents",
    "usage_log_source": "SELECT event_type AS feature, event_type <> 'error' AS ok, count(*) AS calls, max(value) AS slowest, sum(CASE WHEN event_type <> 'error' THEN json_extract(props, '$.k')::BIGINT END)::BIGINT AS tokens FROM events GROUP BY ALL",
    "corpus_sink": f"{_CHUNKS} SELECT lang AS kind, count(*) AS chunks FROM ch JOIN documents USING (doc_id) GROUP BY ALL",
    "snapshot_diff": """SELECT 'd' || doc_id AS id, CASE WHEN coalesce(toxic, 0) = 1 THEN 'added' WHEN quality = 0 THEN 'updated' ELSE 'same' END AS change FROM documents LEFT JOIN labels USING (doc_id)
      UNION ALL SELECT 'p' || page_id, 'removed' FROM pages""",
    "sectionise": f"WITH {_MD} SELECT doc_id, section_no, level, heading, text FROM sec",
    "section_ids": f"WITH {_MD} SELECT doc_id, section_no, id FROM ided",
    "unique_section_ids": f"WITH {_MD} SELECT doc_id, section_no, anchor FROM anchored",
    "unit_split": f"""WITH {_MD}, u AS (SELECT doc_id, heading, level, sum((level BETWEEN 1 AND 2)::INT) OVER (PARTITION BY doc_id ORDER BY section_no) AS u FROM sec)
      SELECT doc_id, (u - min(u) OVER (PARTITION BY doc_id))::INT AS unit_no, title, sections FROM
      (SELECT doc_id, u, coalesce(max(heading) FILTER (WHERE level BETWEEN 1 AND 2), 'Preamble') AS title, count(*) AS sections FROM u GROUP BY ALL)""",
    "md_to_plain": "SELECT doc_id, " + _plain("'# *Title* `x`' || chr(10) || chr(10) || '- [one](/a) ![i](p.png)' || chr(10) || '* two | three' || chr(10) || chr(10) || text") + " AS plain FROM documents",
    "chunk_pack": f"""WITH p AS (SELECT doc_id, {_pack('text')} AS s FROM documents), l AS (SELECT doc_id, CASE WHEN s.c = '' THEN s.o ELSE list_append(s.o, s.c) END AS l FROM p)
      SELECT doc_id, generate_subscripts(l, 1) - 1 AS k, unnest(l) AS chunk FROM l""",
    "corpus_chunks": f"{_CHUNKS} SELECT id, anchor, route, heading, text FROM ch",
    "anchor_map": f"WITH {_MD} SELECT doc_id, anchor, route, level <= 3 AND heading <> '' AS in_contents FROM anchored",
    "toc_titles": rf"""WITH t AS (SELECT doc_id, i, CASE WHEN i % 3 = 0 THEN (i + 1) || '. ' || l || ' (PM' || i || ' - ' || (i + 3) || ') ..... ' || (i * 3) WHEN i % 3 = 1 THEN '  Annex B: ' || l || '....... 7' ELSE l END AS line FROM {_LINES} WHERE i < 120),
      m AS (SELECT doc_id, i, line, regexp_extract(line, '^\s*(\d{{1,2}})\.\s+(.+?)\s*\.{{3,}}\s*\d+\s*$', ['n', 't']) AS c, regexp_extract(line, '^\s*Annex ([A-F]):\s+(.+?)\s*\.{{3,}}\s*\d+\s*$', ['n', 't']) AS a FROM t)
      SELECT doc_id, i AS line_no, c.n AS num, a.n AS annex, CASE WHEN c.n <> '' THEN {_STRIP(r"regexp_replace(c.t, '\s*\([A-Z]{1,2}\d+\s*-\s*\d+\)\s*$', '')")} ELSE {_STRIP('a.t')} END AS title,
        regexp_extract(c.t, '\(([A-Z]{{1,2}})\d+\s*-\s*\d+\)', 1) AS codes FROM m WHERE c.n <> '' OR a.n <> ''""",
    "footnote_sequence": f"""WITH n AS (SELECT doc_id, list(((length(l) % 40) + i)::INT ORDER BY i) AS ns FROM {_LINES} GROUP BY ALL),
      r AS (SELECT doc_id, list_reduce(list_transform(ns, lambda n: {{'o': []::INT[], 'n': n}}), lambda a, x: CASE WHEN x.n > a.n AND x.n <= a.n + 20 THEN {{'o': list_append(a.o, x.n), 'n': x.n}} ELSE a END, {{'o': []::INT[], 'n': 0}}).o AS o FROM n)
      SELECT doc_id, generate_subscripts(o, 1) - 1 AS place, unnest(o) AS n FROM r""",
    "footnote_attach": rf"""WITH b AS (SELECT doc_id, i AS block_no, regexp_replace(l, '[^a-z ]', '', 'g') || 'x' || (i % 900) || ', and y' || (i % 900 + 2) || '.' AS text FROM {_LINES}),
      n AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents),
      hit AS (SELECT doc_id, n, min(block_no) AS block_no FROM n JOIN b USING (doc_id) WHERE block_no % 900 = n OR block_no % 900 + 2 = n GROUP BY ALL)
      SELECT doc_id, n, block_no, 'PM' || block_no AS at, 'a-' || block_no AS target, CASE WHEN block_no % 900 = n THEN
        array_to_string(list_slice(regexp_split_to_array({_STRIP("regexp_replace(text, 'x[0-9]+, and y[0-9]+\\.$', 'x')")}, '\s+'), -4, -1), ' ')
        ELSE 'and y' END AS hangs_on FROM hit JOIN b USING (doc_id, block_no)""",
    "heading_paths": f"""WITH {_MD}, w AS (SELECT doc_id, section_no, level, heading,
        last_value(CASE WHEN level = 1 THEN section_no END IGNORE NULLS) OVER o AS s1, last_value(CASE WHEN level = 2 THEN section_no END IGNORE NULLS) OVER o AS s2,
        last_value(CASE WHEN level = 3 THEN section_no END IGNORE NULLS) OVER o AS s3,
        last_value(CASE WHEN level = 1 THEN heading END IGNORE NULLS) OVER o AS h1, last_value(CASE WHEN level = 2 THEN heading END IGNORE NULLS) OVER o AS h2,
        last_value(CASE WHEN level = 3 THEN heading END IGNORE NULLS) OVER o AS h3,
        count(*) FILTER (WHERE level = 1) OVER (PARTITION BY doc_id) AS ones, first_value(level) OVER o AS l1, first_value(heading) OVER o AS t1, row_number() OVER o AS rn
        FROM sec WINDOW o AS (PARTITION BY doc_id ORDER BY section_no)),
      p AS (SELECT *, list_filter([CASE WHEN level > 1 THEN h1 END, CASE WHEN level > 2 AND s2 > coalesce(s1, -1) THEN h2 END,
        CASE WHEN level > 3 AND s3 > greatest(coalesce(s1, -1), coalesce(s2, -1)) THEN h3 END, CASE WHEN level > 0 THEN heading END], lambda h: h IS NOT NULL) AS path FROM w),
      q AS (SELECT doc_id, section_no, CASE WHEN l1 = 1 AND ones = 1 AND rn > 1 AND path[1] = t1 THEN path[2:] ELSE path END AS path FROM p)
      SELECT doc_id, section_no, len(path)::INT AS depth, CASE WHEN len(path) = 0 THEN 'Opening text' ELSE array_to_string(list_slice(path, greatest(1, len(path) - 2), len(path)), ' › ') END AS locator FROM q""",
    "heading_level": rf"""WITH v AS (SELECT doc_id, i, CASE i % 5 WHEN 1 THEN 'Chapter ' || l WHEN 2 THEN i || '.2 Then ' || l WHEN 3 THEN upper(l)
        WHEN 4 THEN array_to_string(list_transform(string_split(l, ' '), lambda w: upper(left(w, 1)) || lower(substring(w, 2))), ' ') ELSE l END AS line FROM {_LINES})
      SELECT doc_id, i AS line_no, {level_sql("line")} AS level FROM v""",
    "paragraph_groups": rf"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(text, chr(10), chr(10) || ' ' || chr(10)) ELSE text END AS t FROM documents),
      l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM t),
      b AS (SELECT *, NOT regexp_matches(l, '\S') AS blank FROM l),
      c AS (SELECT *, count(*) OVER d > 20 AND (count(*) FILTER (WHERE blank) OVER d) / (count(*) OVER d) < 0.05 AS per, sum(blank::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM b WINDOW d AS (PARTITION BY doc_id)),
      g AS (SELECT doc_id, CASE WHEN per THEN i ELSE g END AS g, min(i) AS i, {_STRIP("string_agg(" + _STRIP("l") + ", ' ' ORDER BY i)")} AS para FROM c WHERE NOT blank GROUP BY ALL)
      SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS place, para FROM g WHERE para <> ''""",
    "section_select": rf"""WITH {_MD}, m AS (SELECT doc_id, i, line, regexp_extract(line, '^(#{{2,3}}) (.*?)\s*$', ['h', 't']) AS m FROM marked),
      a AS (SELECT *, last_value(CASE WHEN m.h = '##' THEN regexp_matches(lower(m.t), '^(the|le|der|un|a|e)') END IGNORE NULLS) OVER w AS on_,
        last_value(CASE WHEN m.h = '##' THEN false WHEN m.h = '###' THEN regexp_matches(m.t, '^[A-M]') END IGNORE NULLS) OVER w AS skip_ FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY i))
      SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE on_ AND NOT skip_), '') AS kept FROM a GROUP BY ALL""",
    "provision_slice": f"""WITH {_MD}, w AS (SELECT doc_id, min(id) AS f, max(id) AS t FROM ided GROUP BY ALL),
      b AS (SELECT doc_id, min(section_no) FILTER (WHERE id = f) AS a, min(section_no) FILTER (WHERE id = t) AS b FROM ided JOIN w USING (doc_id) GROUP BY ALL)
      SELECT doc_id, section_no, id FROM ided JOIN b USING (doc_id) WHERE section_no BETWEEN a AND b""",
    "prospective_mark": f"WITH {_MD} SELECT doc_id, section_no, heading || CASE WHEN toxic = 1 THEN ' (prospective: not yet in force)' ELSE '' END AS heading FROM varied LEFT JOIN labels USING (doc_id)",
    "link_absolutise": f"""SELECT doc_id, string_agg(CASE i % 4 WHEN 0 THEN '## Part ' || i || chr(10) || l || ' [here](#part-' || i || ')' WHEN 1 THEN l || ' [see](https://example.org/d/' || doc_id || '#missing)'
      WHEN 2 THEN l || ' [home](https://example.org/guide) [cdn](//cdn)' ELSE l END, chr(10) ORDER BY i) AS md FROM {_LINES} GROUP BY ALL""",
    "doc_stats": r"SELECT doc_id, length(text) AS characters, len(regexp_extract_all(text, '\S+')) AS words, len(string_split(text, chr(10))) AS sections, sha256(text) AS sha256 FROM documents",
    "heading_outline": f"""WITH {_MD}, h AS (SELECT doc_id, section_no, repeat('  ', greatest(0, least(4, level) - 1)::INT) || heading AS line FROM sec WHERE heading <> ''),
      u AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY section_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(line) > 4000 AS over_ FROM h),
      k AS (SELECT *, sum(over_::INT) OVER (PARTITION BY doc_id ORDER BY section_no) AS n FROM u)
      SELECT doc_id, string_agg(CASE WHEN n = 0 THEN line ELSE '…' END, chr(10) ORDER BY section_no) AS outline FROM (SELECT * FROM k WHERE n = 0 OR (n = 1 AND over_)) GROUP BY ALL""",
    "file_inventory": rf"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '# T' || chr(10) || chr(10) || text ELSE '// ' || replace(text, chr(10), chr(10) || '// ') || chr(10) || 'let a;' END AS t, text FROM documents),
      f AS (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat, t FROM t),
      s AS (SELECT doc_id, t, CASE WHEN doc_id % 2 = 0 THEN substring(coalesce(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '\S') AND NOT starts_with(l, '#'))[1], ''), 1, 200)
        ELSE substring(array_to_string(list_slice(string_split(regexp_replace(flat, '\.\s', '.' || chr(1), 'g'), chr(1)), 1, 2), ' '), 1, 260) END AS summary FROM f)
      SELECT doc_id, len(string_split(t, chr(10))) AS lines, summary, (SELECT sum(len(string_split(t, chr(10)))) FROM t)::BIGINT AS total_lines FROM s""",
    "table_extract": rf"""WITH r AS (SELECT doc_id, i + 1 AS row_no, '| NW/H' || i || ' | ' || replace({_BARE}, '|', '\|') || ' |  ' || length(l) || ' |' AS line FROM {_LINES}),
      c AS (SELECT doc_id, row_no, list_transform(string_split(replace(regexp_replace(regexp_replace(trim(line), '^\|', ''), '\|$', ''), '\|', chr(1)), '|'), lambda c: trim(replace(c, chr(1), '|'))) AS cells FROM r)
      SELECT doc_id, 1 AS table_no, row_no, array_to_string(cells, ' | ') AS flat FROM c UNION ALL SELECT doc_id, 1, 0, 'Ref | Site name | Area' FROM documents""",
    "strip_inline": f"SELECT doc_id, i AS line_no, 'pic link bold code gone tag * ' || {_BARE} AS text FROM {_LINES}",
}
