"""SQL counterparts of the registered queries, for DuckDB; only where SQL can express them."""

from __future__ import annotations

import string

from cratelink.llm.chat import ESCAPES, HEAD, NECK, TAIL
from cratelink.llm.queries import CONTROL

ORACLES: dict[str, str] = {}


def _lower(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


def _words(text: str) -> str:
    return rf"regexp_extract_all({_lower(text)}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


ORACLES["op1_decontamination"] = f"""
with items as (select distinct item_id, {_words('text')} as w from benchmark where item_id is not null),
windows as (
  select distinct cast(item_id as varchar) as item, least(len(w), 10) as size, array_to_string(w[i : i + 9], ' ') as win
  from (select item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as i from items where len(w) > 0)),
docs as (select row_number() over () as key, doc_id, {_words('text')} as w from documents),
places as (
  select key, w, size, unnest(range(1, len(w) - size + 2)) as i
  from docs cross join (select distinct size from windows) where len(w) >= size),
spots as (select key, i, size, array_to_string(w[i : i + size - 1], ' ') as win from places),
met as (select key, i, size, item from spots join windows using (size, win)),
hit as (select key, count(distinct j) as n from (select distinct key, i, size from met), unnest(range(i, i + size)) as u(j) group by key),
owner as (
  select key, count(*) as n, string_agg(item, ',' order by item) as ids from (select distinct key, item from met) group by key)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(hit.n, 0) as n_hit, coalesce(owner.n, 0) as n_items,
  sha256(coalesce(owner.ids, '')) as items_sha256, coalesce(hit.n, 0) > 0 as contaminated
from docs left join hit using (key) left join owner using (key)"""

def _near(size: int, percent: int, more: str = "") -> str:
    """Classes of documents whose sets of shingles of *size* words are linked."""
    return f"""
with recursive texts as (
  select doc_id, list_filter(string_split_regex({_lower('text')}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
sets as (
  select distinct doc_id,
    case when len(w) < {size} then array_to_string(w, ' ') else array_to_string(w[i : i + {size - 1}], ' ') end as s
  from (select doc_id, w, unnest(range(1, greatest(1, len(w) - {size - 1}) + 1)) as i from texts where len(w) > 0)),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as shared from sets a join sets b on a.s = b.s and a.doc_id <> b.doc_id group by all),
links as (
  select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b
  where 100 * shared >= {percent} * (x.n + y.n - shared)),
reach(doc_id, other) as (
  select doc_id, doc_id from sizes union select reach.doc_id, links.b from reach join links on links.a = reach.other)
select t.doc_id, coalesce(n, 0) as n_shingles, coalesce(least_id, t.doc_id) as component_id{more}
from texts t left join sizes using (doc_id)
left join (select doc_id, min(other) as least_id from reach group by doc_id) using (doc_id)"""


ORACLES["op7_near_copies"] = _near(5, 75)
ORACLES["op13_minhash"] = _near(4, 80, ", t.doc_id is not distinct from coalesce(least_id, t.doc_id) as kept")


def _escaped(text: str) -> str:
    for plain, sign in ESCAPES:
        text = f"replace({text}, '{plain}', '{sign}')"
    return text


_TURN = len(HEAD + NECK + TAIL)
ORACLES["op10_chat"] = f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '{CONTROL}' union all select -7, 1, 'assistant', '{CONTROL}'),
sums as (
  select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as t,
    coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '') as loss,
    sum({_TURN} + length({_escaped('role')}) + length({_escaped('text')})) as chars
  from turns group by conv_id)
select conv_id, n_turns, sha256(t) as turns_sha256, cast(length(loss) as bigint) as loss_chars, sha256(loss) as loss_sha256,
  cast(chars as bigint) as formatted_chars from sums"""


ORACLES["op12_search"] = f"""
with docs as (select row_number() over () as key, doc_id, {_words('text')} as w from documents),
used as (select key, doc_id, w, len(w) as n from docs where len(w) > 0),
stats as (select count(*) as docs_n, sum(n) as terms_n from used),
items as (
  select item_id, unnest({_words('text')}) as term from (select distinct item_id, text from benchmark)),
needed as (select item_id, term, count(*) as repeats from items group by all),
tfs as (
  select key, term, count(*) as tf from (select key, unnest(w) as term from used)
  where term in (select term from needed) group by all),
weights as (
  select term, cast(floor(1000 * ln((2 * docs_n + 2) / (2 * count(*) + 1))) as bigint) as weight from tfs, stats group by term, docs_n),
scores as (
  select item_id, doc_id, key,
    cast(sum(repeats * (weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs_n) // terms_n))))) as bigint) as score
  from needed join tfs using (term) join weights using (term) join used using (key), stats
  group by item_id, doc_id, key),
ranked as (
  select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id nulls last) as place
  from scores where score > 0)
select item_id, cast(place as int) as rank, doc_id, score from ranked where place <= 20"""

_VISIBLE = r"[^\x20\x09-\x0D]"
ORACLES["op11_repair"] = rf"""
with recursive bits as (
  select list_transform(range(256), lambda n: list_reduce(
    range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, n)) as t),
keyed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k from conversations),
dealt as (
  select keyed.*, xor(4294967295, list_reduce(list_transform(string_split(k, ''), lambda x: cast(ascii(x) as bigint)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295)) % 20 as fault from keyed, bits),
rows as (
  select conv_id, turn, case when fault = 4 then 'user' else role end as role,
    case when fault = 1 then '' when fault = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(range(case when fault = 3 then 2 else 1 end)) as copy
  from dealt where fault <> 0),
seen as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i,
    row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as times from rows),
steps as (
  select conv_id, i, turn, role, text, substr(role, 1, 1) as letter,
    case when not regexp_matches(text, '{_VISIBLE}') then 'blank' when times > 1 then 'duplicate'
      when not regexp_matches(text, '[.!?][ 	-
]*$') then 'truncated' else '' end as fault from seen),
adjacent as (
  select conv_id, lag(letter) over (partition by conv_id order by i) || letter as pair from steps),
bad as (select conv_id, count(*) as illegal from adjacent where pair is not null and pair not in ('su', 'ua', 'au') group by conv_id),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
    count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated, max(i) as n
  from steps group by conv_id),
due(state, next, name) as (values (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
inserts as (
  select state, state as upto, '' as letters, 0 as paid, cast([] as varchar[]) as made from due
  union all select state, next, 'I', 2, [name || ':'] from due
  union all select a.state, b.next, 'II', 4, [a.name || ':', b.name || ':'] from due a join due b on b.state = a.next),
kept(state, letter, next) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
paths(conv_id, i, state, best) as (
  select conv_id, cast(0 as bigint), 0, {{'cost': 0, 'audit': '', 'made': cast([] as varchar[])}} from counts
  union all
  select conv_id, i, state, min(best) from (
    select p.conv_id, s.i, a.state, {{
      'cost': p.best.cost + n.paid + a.cost, 'audit': p.best.audit || n.letters || a.edit,
      'made': list_concat(list_concat(p.best.made, n.made), a.made)}} as best
    from paths p join steps s on s.conv_id is not distinct from p.conv_id and s.i = p.i + 1
    join inserts n on n.state = p.state,
    lateral (
      select n.upto as state, 3 as cost, 'D' as edit, cast([] as varchar[]) as made
      union all select k.next, case when s.fault = 'truncated' then 1 else 0 end, 'K', [s.role || ':' || s.text]
        from kept k where k.state = n.upto and k.letter = s.letter and s.fault not in ('blank', 'duplicate')
      union all select d.next, case when s.fault = 'truncated' then 3 else 2 end, 'R', [d.name || ':' || s.text]
        from due d where d.state = n.upto and s.fault not in ('blank', 'duplicate')) a)
  group by conv_id, i, state),
ends as (
  select p.conv_id, min({{'cost': p.best.cost + n.paid, 'audit': p.best.audit || n.letters,
    'made': list_concat(p.best.made, n.made)}}) as best
  from paths p join counts c on c.conv_id is not distinct from p.conv_id and c.n = p.i
  join inserts n on n.state = p.state and n.upto in (0, 3) group by p.conv_id)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
  coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, cast(coalesce(best.cost, 0) as bigint) as cost,
  coalesce(best.audit, '') as audit, sha256(coalesce(array_to_string(best.made, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join counts c on c.conv_id is not distinct from o.conv_id
left join bad b on b.conv_id is not distinct from o.conv_id left join ends e on e.conv_id is not distinct from o.conv_id"""
