"""Column helpers, each as a query of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.sources.tables import documents, pages, table


def slug(spark, sf):
    name = F.concat("p_name", F.lit(" — It's "), "p_brand", F.lit("!"))
    return table(spark, sf, "part").select("p_partkey", T.slug(name).alias("slug"))


def file_slug(spark, sf):
    return pages(spark, sf).select("page_id", T.file_slug(F.col("url")).alias("slug"))


def clean_name(spark, sf):
    return pages(spark, sf).select("page_id", T.clean_name(F.concat("url", F.lit(' <a>|"b"\t'))).alias("name"))


def normalise_code(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.normalise_code(F.concat("p_brand", F.lit(" a.b-"), "p_size")).alias("code"))


def clip_text(spark, sf):
    return documents(spark, sf).select("doc_id", T.clip_text(F.concat(F.lit(" \t\n"), "text"), 700).alias("clipped"))


def clip_list(spark, sf):
    return documents(spark, sf).select("doc_id", F.array_join(T.clip_list(F.concat(F.array(F.lit(" ")), T.lines(F.col("text"))), 4, 50), "|").alias("clipped"))


def size_label(spark, sf):
    return documents(spark, sf).select("doc_id", T.size_label(F.col("n_chars") * 97).alias("label"))


def human_list(spark, sf):
    g = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("l"))
    return g.select("n_regionkey", T.human_list(F.col("l")).alias("names"), T.counted(F.size("l"), "nation").alias("counted"))


def escape_markdown(spark, sf):
    return documents(spark, sf).select("doc_id", T.escape_markdown(F.concat(F.lit("a*b_c[d] <e>|`f` \\ "), "text")).alias("escaped"))


def format_day(spark, sf):
    d = F.col("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", T.day_label(d).alias("short"), T.day_label(F.when(F.col("o_orderkey") % 9 != 0, d), long=True).alias("long"))


def rate_per_second(spark, sf):
    tokens, ms = F.get_json_object("props", "$.k").cast("bigint"), F.floor(F.col("value") * 16) * 125
    rate = F.round(tokens * F.lit(1000.0) / F.nullif(ms, F.lit(0)), 1)
    return table(spark, sf, "events").select("event_id", F.coalesce(rate.cast("string"), F.lit("?")).alias("rate"))


QUERIES = {f.__name__: f for f in (slug, file_slug, clean_name, normalise_code, clip_text, clip_list, size_label, human_list, escape_markdown, format_day, rate_per_second)}

_SQUASH = lambda c: rf"regexp_replace(regexp_replace({c}, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"

ORACLES = {
    "slug": "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' its ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part",
    "file_slug": r"""WITH s AS (SELECT page_id, left(regexp_replace(regexp_replace(lower(regexp_replace(url, '\.[A-Za-z0-9]+$', '')), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 60) AS s FROM pages) SELECT page_id, CASE WHEN s = '' THEN 'plan' ELSE s END AS slug FROM s""",
    "clean_name": r"""WITH s AS (SELECT page_id, regexp_replace(regexp_replace(string_split(url || ' <a>|"b"' || chr(9), '/')[-1], '[\x00-\x1f\x7f"<>|]', '', 'g'), '^\s+|\s+$', '', 'g') AS s FROM pages) SELECT page_id, left(CASE WHEN s = '' THEN 'document' ELSE s END, 160) AS name FROM s""",
    "normalise_code": "SELECT p_partkey, replace(replace(upper(p_brand) || 'A/B/' || p_size, '.', '/'), '-', '/') AS code FROM part",
    "clip_text": f"SELECT doc_id, left({_SQUASH('text')}, 700) AS clipped FROM documents",
    "clip_list": rf"""SELECT doc_id, array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '\S'))[:4], lambda l: left({_SQUASH('l')}, 50)), '|') AS clipped FROM documents""",
    "size_label": "SELECT doc_id, CASE WHEN n_chars * 97 >= 1048576 THEN floor(n_chars * 97 / 1048576 + 0.5)::BIGINT || 'MB' ELSE floor(n_chars * 97 / 1024 + 0.5)::BIGINT || 'KB' END AS label FROM documents",
    "human_list": """WITH g AS (SELECT n_regionkey, list_sort(list(n_name)) AS l FROM nation GROUP BY ALL) SELECT n_regionkey, CASE WHEN len(l) = 1 THEN l[1] ELSE array_to_string(l[:-2], ', ') || ' and ' || l[-1] END AS names,
      len(l) || CASE WHEN len(l) = 1 THEN ' nation' ELSE ' nations' END AS counted FROM g""",
    "escape_markdown": r"""SELECT doc_id, 'a\*b\_c\[d\] \<e\>\|\`f\` \\ ' || regexp_replace(regexp_replace(text, '\r?\n', ' ', 'g'), '([\\`*_\[\]<>|])', '\\\1', 'g') AS escaped FROM documents""",
    "format_day": "SELECT o_orderkey, strftime(o_orderdate, '%-d %b %Y') AS short, CASE WHEN o_orderkey % 9 <> 0 THEN strftime(o_orderdate, '%-d %B %Y') ELSE '' END AS long FROM orders",
    "rate_per_second": "SELECT event_id, coalesce(round(json_extract(props, '$.k')::BIGINT * 1000.0::DOUBLE / nullif(floor(value * 16)::BIGINT * 125, 0), 1)::VARCHAR, '?') AS rate FROM events",
}
