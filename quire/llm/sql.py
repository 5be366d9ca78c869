"""SQL twins of the newer operators."""

from __future__ import annotations

#: Columns t (crc32's table) for ``crc``; the polynomial is the reflected one of IEEE 802.3.
CRC_TABLE = """crc_table as materialized (select list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)),
  lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t)"""


def crc(text: str) -> str:
    """Unsigned crc32 of a text's UTF-8, where ``t`` of crc_table is in scope."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {octets}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::bigint)"


ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SPELLING = rf"""
with recursive {CRC_TABLE},
runs as (select doc_id, {ASCII_LOWER.format("unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+'))")} run from documents),
hashed as (select run, {crc("doc_id::varchar || ':' || run")} h from (select * from runs where length(run) >= 6), crc_table),
words as (select w as word, count(*)::bigint n from (
  select case when h % 199 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end w from hashed)
  where length(w) >= 6 group by w having count(*) >= 5),
places as (select word, n, unnest(range(1, length(word) + 1)) i from words),
holes as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) rest from places),
near_ as (
  select a.word, b.word other, b.n from holes a join holes b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select a.word, b.word, b.n from holes a join words b on a.rest = b.word
  union select b.word, a.word, a.n from holes a join words b on a.rest = b.word),
best as (select word, count(*)::bigint n_near, arg_min(other, (-n, other)) form, max(n) most from near_ group by word),
forms as (select words.word, words.n, coalesce(n_near, 0)::bigint n_near, case when most >= 5 * words.n then form end form, case when most >= 5 * words.n then most end form_n from words left join best using (word)),
chain as (select word, word last, 0 step from forms union all select chain.word, forms.form, step + 1 from chain join forms on chain.last = forms.word where form is not null),
ends as (select word, arg_max(last, step) root from chain group by word)
select word, form, root, n, n_near, form_n from forms join ends using (word)"""

ORACLES = {"op11_spelling_variants": SPELLING}


def _grown(state: str, letter: str, cost: str, line: str) -> str:
    """A state's (cost, letters, turns) after one more edit; null if the state is."""
    turns = f"{state}.turns" if line is None else f"case when {state}.turns is null then {line} else {state}.turns || chr(10) || {line} end"
    return f"case when {state} is not null then {{'cost': {state}.cost + {cost}, 'audit': {state}.audit || '{letter}', 'turns': {turns}}} end"


def _repair() -> str:
    added, none = {"0": "'user:'", "1": "'user:'", "2": "'assistant:'", "3": "'user:'"}, "null"
    inserted2 = ", ".join(_grown(f"s{q}", "I", "3", added[q]) for q in "013")
    closed = f"""select * exclude (s2, s3), c2 as s2, list_min([s3, {_grown('c2', 'I', '3', added['2'])}]) as s3 from (select *, list_min([s2, {inserted2}]) as c2 from SOURCE)"""
    line, more = "f.role || ':' || f.text", "case when f.truncated then 3 else 0 end"

    def kept(q: str, initial: str) -> str:
        return f"case when not f.must and left(f.role, 1) = '{initial}' then {_grown('s' + q, 'K', more, line)} end"

    def rerole(q: str) -> str:
        role = "assistant" if q == "2" else "user"
        return f"case when not f.must then {_grown('s' + q, 'R', more + ' + 3', repr(role + ':') + ' || f.text')} end"

    new = {"0": none, "1": kept("0", "s"), "2": ", ".join([kept(q, "u") for q in "013"] + [rerole(q) for q in "013"]), "3": kept("2", "a") + ", " + rerole("2")}
    steps = ", ".join(f"list_min([{_grown('s' + q, 'D', '4', None)}, {new[q]}]) as s{q}" for q in "0123")
    ended = "(select p.* from p join n on p.conv_id is not distinct from n.conv_id and p.i = n.n)"
    kind = "struct(cost bigint, audit varchar, turns varchar)"
    return rf"""
with recursive {CRC_TABLE},
hurt as (select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text, {crc("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 k from conversations, crc_table),
left_ as (select conv_id, turn, case when k = 4 then 'user' else role end as role, case k when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
  unnest(range(case when k = 3 then 2 else 1 end)) copy from hurt where k <> 0),
o as (select *, row_number() over w i, lag(left(role, 1)) over w || left(role, 1) pair
  from left_ window w as (partition by conv_id order by turn nulls first, role, text)),
b as (select *, row_number() over (partition by conv_id, role, text order by i) > 1 again, not regexp_matches(text, '[^\x20\x09-\x0D]') blank from o),
f as (select *, blank or again as must, not blank and again as duplicate, not blank and not again and not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') truncated from b),
n as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint gaps, count(*) filter (where blank) blank, count(*) filter (where duplicate) duplicate,
  count(*) filter (where truncated) truncated, count(*) filter (where pair not in ('su', 'ua', 'au')) illegal, count(*) n from f group by conv_id),
p as (select conv_id, 0::bigint i, {{'cost': 0::bigint, 'audit': '', 'turns': null::varchar}} s0, null::{kind} s1, null::{kind} s2, null::{kind} s3 from n
  union all select p.conv_id, f.i, {steps} from ({closed.replace('SOURCE', 'p')}) p join f on p.conv_id is not distinct from f.conv_id and f.i = p.i + 1),
e as (select p.conv_id, list_min([s0, s3]) best from ({closed.replace('SOURCE', ended)}) p)
select distinct c.conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0)::bigint blank, coalesce(duplicate, 0)::bigint duplicate, coalesce(truncated, 0)::bigint truncated,
  coalesce(illegal, 0)::bigint illegal, coalesce(best.cost, 0)::bigint as cost, coalesce(best.audit, '') audit, sha256(coalesce(best.turns, '')) repaired_sha256
from conversations c left join n on c.conv_id is not distinct from n.conv_id left join e on c.conv_id is not distinct from e.conv_id"""


ORACLES["op12_turn_repair"] = _repair()
