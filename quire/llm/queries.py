"""The operators of this subpackage applied to the test tables, with SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from quire.llm.curve_search import nearest
from quire.llm.html_extract import extract_text
from quire.llm.line_dedup import dedup_lines
from quire.llm.mixing import mix
from quire.llm.ngram_trie import is_training, score
from quire.llm.parity_join import similar_documents
from quire.llm.piece_lattice import decode, encode
from quire.llm.quality import judge
from quire.llm.quality_model import score_quality
from quire.llm.shared import prepare, read
from quire.llm.spelling import variants
from quire.llm.sql import ORACLES as NEWER
from quire.llm.token_counts import count_tokens
from quire.llm.turn_repair import report
from quire.llm.url_templates import judge_urls


def op1_line_dedup(spark, folder):
    out = dedup_lines(read(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_html_text(spark, folder):
    return extract_text(read(spark, folder, "pages").select("page_id", "url", "html"))


def op3_parity_join(spark, folder):
    return similar_documents(read(spark, folder, "documents"))


def op4_token_counts(spark, folder):
    return count_tokens(read(spark, folder, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json")).drop("text")


def op5_source_mix(spark, folder):
    return mix(read(spark, folder, "documents").select("doc_id", "source", "text")).drop("source")


def op6_curve_search(spark, folder):
    return nearest(read(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_ngram_trie(spark, folder):
    return score(read(spark, folder, "documents").select("doc_id", "text"), is_training(F.col("doc_id")))


def op8_quality_rules(spark, folder):
    return judge(read(spark, folder, "documents").select("doc_id", "lang", "text")).drop("q_row")


def op9_url_templates(spark, folder):
    return judge_urls(read(spark, folder, "pages").select("page_id", "url")).drop("url", "purity")


def op10_piece_lattice(spark, folder):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = decode(encode(read(spark, folder, "documents").select("doc_id", "text"), path), path)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    same = F.col("decoded") == F.replace(F.coalesce("text", F.lit("")), F.lit("▁"), F.lit(" "))  # the model knows no difference
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), digest.alias("ids_sha256"), same.alias("round_trip"))


def op11_spelling_variants(spark, folder):
    return variants(read(spark, folder, "documents").select("doc_id", "text"))


def op12_turn_repair(spark, folder):
    return report(read(spark, folder, "conversations"))


def op13_quality_model(spark, folder):
    return score_quality(read(spark, folder, "documents").select("doc_id", "text"), read(spark, folder, "labels"))


def _shipped(fn):
    def run(spark, folder):
        prepare(spark)
        return fn(spark, folder)

    return run


QUERIES = {fn.__name__: _shipped(fn) for fn in (
    op1_line_dedup, op2_html_text, op3_parity_join, op4_token_counts, op5_source_mix, op6_curve_search, op7_ngram_trie, op8_quality_rules, op9_url_templates, op10_piece_lattice,
    op11_spelling_variants, op12_turn_repair,
    op13_quality_model)}

ORACLES = {
    "op1_line_dedup": """
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) i from documents),
k as (select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from l),
s as (select k, max(doc_id) m from k where length(k) >= 40 group by k having count(distinct doc_id) >= 5),
j as (select k.*, (s.k is not null and k.doc_id <> s.m) gone from k left join s on k.k = s.k)
select doc_id, count(*) n_lines, count(*) filter (where gone) n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) kept_sha256
from j group by doc_id""",
    "op5_source_mix": """
with w as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint size from documents),
s as (select source, sum(size)::bigint source_size, [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3)::int + 1]::bigint weight from w group by source),
c as (select *, source_size * 3 cap, sum(source_size) over () total, sum(weight) over () weights from s),
b as (select *, total - coalesce(sum(cap) over o, 0) left_words, weights - coalesce(sum(weight) over o, 0) left_weight from c
  window o as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding)),
f as (select *, cap * left_weight < weight * left_words as is_full from b),
g as (select source, source_size, total, coalesce(case when is_full then cap::double else (weight * max(left_words) filter (where not is_full) over ())::double / max(left_weight) filter (where not is_full) over () end, 0) target from f),
g1 as (select *, round(total / 16.0)::bigint seats, sum(target) over () votes, count(*) over () n from g),
g2 as (select *, case when votes > 0 then target / votes else 0 end part from g1),
g3 as (select *, floor(part * seats + 0.5)::bigint base from g2),
g4 as (select *, case when votes > 0 then seats - sum(base) over () else 0 end::bigint diff from g3),
g5 as (select source, diff, unnest(range(1, ceil(part * (abs(diff) + n))::bigint + 3)) step, base, target from g4 where diff <> 0),
g6 as (select *, case when diff > 0 then base + step - 1 else base - step end held from g5),
g7 as (select source, diff, row_number() over (order by case when diff > 0 then -1 else 1 end * (target / (2 * held + 1)), source nulls last, step) r from g6 where held >= 0),
g8 as (select source, sum(sign(diff))::bigint change from g7 where r <= abs(diff) group by source),
goal as (select g4.source, source_size, target, base + coalesce(change, 0) blocks, greatest(1, ceil(source_size / 1048576.0))::bigint shards from g4 left join g8 on g4.source is not distinct from g8.source),
p as (select w.*, goal.source_size, target, blocks, ('0x' || substr(md5('17|' || coalesce(doc_id::varchar, '')), 1, 7))::bigint ord,
  ('0x' || substr(md5('18|' || coalesce(doc_id::varchar, '')), 1, 7))::bigint % shards shard from w join goal on w.source is not distinct from goal.source),
h1 as (select source, shard, sum(size)::bigint shard_size, any_value(blocks) blocks from p group by source, shard),
h2 as (select *, sum(shard_size::double) over u votes, count(*) over u n from h1 window u as (partition by source)),
h3 as (select *, case when votes > 0 then shard_size / votes else 0 end part from h2),
h4 as (select *, floor(part * blocks + 0.5)::bigint base from h3),
h5 as (select *, case when votes > 0 then blocks - sum(base) over (partition by source) else 0 end::bigint diff from h4),
h6 as (select *, unnest(range(1, ceil(part * (abs(diff) + n))::bigint + 3)) step from h5 where diff <> 0),
h7 as (select *, case when diff > 0 then base + step - 1 else base - step end held from h6),
h8 as (select source, shard, diff, row_number() over (partition by source order by case when diff > 0 then -1 else 1 end * (shard_size / (2 * held + 1)), shard, step) r from h7 where held >= 0),
h9 as (select source, shard, sum(sign(diff))::bigint change from h8 where r <= abs(diff) group by source, shard),
q as (select h5.source, h5.shard, shard_size, least((base + coalesce(change, 0)) * 16, shard_size * 3)::bigint words,
  (('0x' || substr(md5('19|' || coalesce(h5.source, '') || '|' || h5.shard::varchar), 1, 7))::bigint % greatest(1, ceil(shard_size / 16.0)::bigint)) * 16 start
  from h5 left join h9 on h5.source is not distinct from h9.source and h5.shard = h9.shard),
l as (select p.*, sum(size) over (partition by source, shard order by ord, doc_id nulls last, size rows unbounded preceding) til from p),
m as (select l.*, til - size since, q.shard_size, words, start, words % greatest(shard_size, 1) rest from l join q on l.source is not distinct from q.source and l.shard = q.shard)
select doc_id, size, source_size, target,
  (words // greatest(shard_size, 1) * size + case when rest > 0 then greatest(0, least(til, start + rest) - greatest(since, start)) + greatest(0, least(til, start + rest - shard_size) - since) else 0 end)::bigint taken
from m""",
}


ORACLES["op9_url_templates"] = rf"""
with recursive u as (select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') path from pages),
r as (select *, case when (host = 'www.example.com' or ends_with(host, '.www.example.com')) and starts_with(path, '/en/') then 'www.example.com/en/'
  when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
  when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/es/') then 'net/es/'
  when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
  when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/') then 'com/' end as rule from u),
g as (select *, case when rule in ('com/', 'www.example.com/en/') then 'allow' when rule is not null then 'block' end label from r),
a as (select *, list_transform(string_split(path, '/')[2:], lambda s: case when regexp_matches(s, '[0-9]') then '*' || regexp_extract(s, '([.][A-Za-z]+)$', 1) else s end) segments from g),
v as (select host, segments, count(*)::bigint n, count(*) filter (where label = 'allow')::bigint allowed, count(*) filter (where label = 'block')::bigint blocked from a group by all),
tree as (
  select host, segments, n, allowed, blocked, 0 as level, '' as template from v
  union all
  select host, segments, n, allowed, blocked, level + 1, template || '/' || case when s = '' or starts_with(s, '*') then s
    when not (bn >= 20 and bn * 100 >= pn) then '*'
    when ba + bb > 0 and abs(bb / (ba + bb) - pb / (pa + pb)) <= 1.96 * sqrt(pb / (pa + pb) * (1 - pb / (pa + pb)) / (ba + bb)) then '+'
    else s end
  from (select *, segments[level + 1] s, sum(n) over p pn, sum(allowed) over p pa, sum(blocked) over p pb, sum(n) over b bn, sum(allowed) over b ba, sum(blocked) over b bb
    from tree where len(segments) >= level window p as (partition by host, template), b as (partition by host, template, segments[level + 1]))
  where s is not null),
ends as (select * from tree where level = len(segments)),
z as (select host, template, sum(allowed) aa, sum(blocked) bb from ends group by all),
p as (select case when sum(allowed + blocked) > 0 then sum(blocked) / sum(allowed + blocked) else 0.5 end p0 from v),
d as (select host, segments, template, (bb + 4.0::double * p0) / (aa + bb + 4.0::double) purity from ends join z using (host, template), p)
select page_id, a.host, path, rule, coalesce(label, case when purity >= 0.8 then 'block' else 'allow' end) verdict, template
from a join d on a.host = d.host and a.segments = d.segments"""

ORACLES |= NEWER
