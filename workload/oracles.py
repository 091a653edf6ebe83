"""SQL counterparts of the registered queries, for DuckDB over the same tables.

The texts are independent of the Spark plans: rules are restated for an engine whose
regular expressions know no look-around, and linkage compares every pair outright.
"""

from __future__ import annotations

from cratelink.functions import quality, text
from workload.views import FX_CANDIDATES, FX_CATALOG, FX_FILES, FX_PURCHASES, FX_RUN_LOG

ORACLES: dict[str, str] = {}

_WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_AWS = r"[\t-\r\x1c-\x20]"
_GROUP = r"^([^\n]{0,120}?)" + _WS + r"*[(\[]([^)\]]{1,120})[)\]]" + _WS + r"*$"
_WEB = r"(?i)https?://|www\.|\b[\p{L}\p{N}_][\p{L}\p{N}_-]*\.(com|vip|net|org|ru|to|info|biz)\b"
_BPM = _WS + r"+\(?1\d\d\)?" + _WS + "*$"
_ENDINGS = text.MIX_ENDINGS


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def fold(x: str) -> str:
    return rf"regexp_replace(strip_accents({x}), '[^\x00-\x7F]', '', 'g')"


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_AWS}+', ' ', 'g'))"


def normalize(x: str) -> str:
    spaced = f"replace(replace(lower({fold(x)}), '-', ' '), '&', ' and ')"
    return _squeeze(rf"regexp_replace({spaced}, '[^a-z0-9_\t-\r\x1c-\x20]', '', 'g')")


def norm_artist(x: str) -> str:
    return _squeeze(rf"regexp_replace(lower({fold(x)}), '[^a-z0-9_&,\t-\r\x1c-\x20]', '', 'g')")


def clean_title(x: str) -> str:
    t = strip(x)
    for pattern in (
        rf"(?i){_WS}*[(\[][^)\]]{{0,120}}?(?:{text.MIX_WORDS}|feat\.|featuring)[^)]*[)\]]{_WS}*$",
        rf"(?i){_WS}+({_ENDINGS}){_WS}*$",
        rf"(?i){_WS}+[-–—]{_WS}+({_ENDINGS}){_WS}*$",
        rf"{_WS}*[(\[][^)\]]{{0,120}}[)\]]{_WS}*$",
        rf"(?i){_WS}+(?:feat\.|featuring|ft\.){_WS}+[^\n]+\n?$",
    ):
        t = f"regexp_replace({t}, '{pattern}', '')"
    return normalize(t)


def names(artist_key: str) -> str:
    return (
        f"list_filter(list_transform(regexp_split_to_array({artist_key}, ',|&|feat|vs| x '), lambda n: trim(n)), "
        "lambda n: n <> '')"
    )


def declared(x: str) -> str:
    return strip(f"regexp_extract({strip(x)}, '{_GROUP}', 2)")


def junk(x: str) -> str:
    v = strip(x)
    sites = " ".join(f"when contains(lower({v}), '{s}') then 'promo-domain:{s}'" for s in quality.PROMO_SITES)
    doubled = rf"(?i)\(extended mix\){_WS}*\(extended mix\)|\(original mix\){_WS}*\(original mix\)"
    return (
        f"case when {x} = '' then '' when regexp_matches({v}, '{_WEB}') then case {sites} else 'url' end "
        f"when regexp_matches({v}, '{_BPM}') then 'trailing-bpm' "
        f"when regexp_matches({v}, '{doubled}') then 'doubled-mix' else '' end"
    )


def title_agrees(asked: str, name: str, mix: str) -> str:
    q, c = clean_title(asked), clean_title(name)
    want = declared(asked)
    stem = rf"(?i)\b(instrumental|vocal|a\s?capella|stem|dub)\b"
    return (
        f"(({q} <> '' and {c} <> '' and (contains({q}, {c}) or contains({c}, {q}))) and "
        f"case when {mix} = '' then true when regexp_matches({mix}, '{stem}') and {want} = '' then false "
        f"else {want} = '' or {normalize(want)} = {normalize(mix)} end)"
    )


def length_fits(length: str, own: str, tolerance: int = 7000) -> str:
    return f"({own} = 0 or ({length} > 0 and abs({length} - {own}) <= {tolerance}))"


_AGE = "coalesce(nullif(publish_date, ''), '9999')"

_BASE = f"""
fx_catalog as ({FX_CATALOG}),
fx_purchases as ({FX_PURCHASES}),
fx_candidates as ({FX_CANDIDATES}),
fx_files as ({FX_FILES}),
fx_run_log as ({FX_RUN_LOG})
"""

# --- keys ---------------------------------------------------------------------

_KEYS = f"""
{_BASE},
p_keys as (
  select track_id, title, artists, release_title, purchased_at, {strip('isrc')} as isrc,
    {norm_artist('artists')} as artist, {normalize('release_title')} as album, {clean_title('title')} as clean
  from fx_purchases),
q as (
  select *, replace(clean, ' ', '') as condensed, {names('artist')} as names
  from (select distinct isrc, artist, album, clean from p_keys)),
r as (
  select *, replace(clean, ' ', '') as condensed, {names('artist')} as names
  from (select seq, file_path as path, {strip('isrc')} as isrc, {norm_artist('artist')} as artist,
          {normalize('album')} as album, {clean_title('title')} as clean from fx_catalog))
"""
_KEY_OUT = (
    "isrc, artist, album, clean, condensed, array_to_string(list_distinct(names), '|') as names, "
    "coalesce(names[1], '') as first_name"
)
# list_distinct keeps no order; the fixture's names are distinct already.
_KEY_OUT = _KEY_OUT.replace("list_distinct(names)", "names")

ORACLES["keys_purchase"] = f"with {_KEYS} select {_KEY_OUT} from q"
ORACLES["keys_catalog"] = f"with {_KEYS} select seq, path, {_KEY_OUT} from r"
ORACLES["keys_documents"] = f"""
select doc_id, md5({clean_title("text")}) as title_key, {norm_artist('source')} as source_key,
  md5({normalize('text')}) as text_key from documents"""
ORACLES["keys_sql_functions"] = f"""
select conv_id, turn, {clean_title("text")} as clean, md5({normalize('text')}) as text_key,
  md5({norm_artist('text')}) as artist_key from conversations"""

# --- linkage: every pair, every rule -------------------------------------------

_OVERLAP = (
    "(len(list_filter(q.names, lambda x: len(list_filter(r.names, lambda y: contains(x, y) or contains(y, x))) > 0)) > 0)"
)
_OV = f"""
ov as (select q.artist as qa, r.artist as ra, {_OVERLAP} as ov
  from (select distinct artist, names from q) q cross join (select distinct artist, names from r) r)
"""
_ALB = "(contains(q.album, r.album) or contains(r.album, q.album))"
_T = "greatest(2, length(q.clean) // 5)"
_FIRST = "coalesce(q.names[1], '')"
_FUZZY = "q.album <> '' and q.clean <> '' and q.artist <> ''"
_RULES: dict[str, list[tuple[int, str]]] = {
    "s01": [(0, "q.isrc <> '' and q.isrc = r.isrc")],
    "s02": [(0, f"{_FUZZY} and r.album = q.album and r.clean = q.clean and ov.ov")],
    "s03": [(0, "q.album <> '' and q.clean <> '' and r.album = q.album and r.clean = q.clean")],
    "s04": [
        (0, "q.artist <> '' and q.clean <> '' and r.clean = q.clean and r.artist = q.artist"),
        (1, f"q.artist <> '' and q.clean <> '' and r.clean = q.clean and r.artist <> '' and r.artist = {_FIRST}"),
    ],
    "s05": [(0, "q.clean <> '' and r.clean = q.clean")],
    "s06": [(0, "q.album <> '' and q.clean <> '' and r.album = q.album and starts_with(r.clean, q.clean || ' ')")],
    "s07": [
        (0, f"q.artist <> '' and q.clean <> '' and r.artist <> '' and r.artist in (q.artist, {_FIRST}) and starts_with(r.clean, q.clean || ' ')")
    ],
    "s08": [
        (0, "q.artist <> '' and q.condensed <> q.clean and r.condensed = q.condensed and r.album = q.album and ov.ov"),
        (1, "q.album <> '' and q.condensed <> q.clean and r.condensed = q.condensed and r.album = q.album"),
    ],
    "s09": [(0, f"{_FUZZY} and r.clean = q.clean and {_ALB} and ov.ov")],
    "s10": [(0, f"q.album <> '' and q.condensed <> q.clean and r.condensed = q.condensed and {_ALB}")],
    "s11": [(0, f"{_FUZZY} and ov.ov and {_ALB} and (starts_with(r.clean, q.clean) or starts_with(q.clean, r.clean))")],
    "s12": [
        (0, f"{_FUZZY} and ov.ov and {_ALB} and r.clean <> '' and abs(length(r.clean) - length(q.clean)) <= {_T} and levenshtein(q.clean, r.clean) <= {_T}")
    ],
    "s13": [
        (0, f"{_FUZZY} and ov.ov and {_ALB} and r.clean <> '' and (contains(q.clean, r.clean) or contains(r.clean, q.clean))")
    ],
}


def _hits(strategies: list[str]) -> str:
    cases = " ".join(
        f"when {cond} then {int(name[1:]) * 10 + sub}" for name in strategies for sub, cond in _RULES[name]
    )
    return f"""
hits as (
  select isrc, artist, album, clean, arg_min(path, (lvl, seq)) as path, min(lvl) // 10 as strategy from (
    select q.isrc, q.artist, q.album, q.clean, r.path, r.seq, case {cases} end as lvl
    from q cross join r join ov on ov.qa = q.artist and ov.ra = r.artist)
  where lvl is not null group by isrc, artist, album, clean)
"""


for _name in _RULES:
    ORACLES[f"link_{_name}"] = f"with {_KEYS}, {_OV}, {_hits([_name])} select isrc, artist, album, clean, path from hits"

_LABEL = "case when strategy is null then '' else 's' || lpad(cast(strategy as varchar), 2, '0') end"
_LINKED = f"""
linked as (select p_keys.*, coalesce(path, '') as file_path, {_LABEL} as strategy
  from p_keys left join hits using (isrc, artist, album, clean))
"""
_LINK = f"with {_KEYS}, {_OV}, {_hits(list(_RULES))}, {_LINKED}"

ORACLES["link_exact"] = (
    f"with {_KEYS}, {_OV}, {_hits(['s01', 's02', 's03', 's04', 's05'])}, {_LINKED} "
    "select track_id, file_path, strategy from linked"
)
ORACLES["link_full"] = f"{_LINK} select track_id, file_path, strategy from linked"
ORACLES["link_full_title_way"] = ORACLES["link_full_grouped_windows"] = ORACLES["link_full"]
_OWN = [n for n in _RULES if n != "s05"] + ["s14", "s15"]
_RULES |= {
    "s14": _RULES["s05"],
    "s15": [(0, f"{_FUZZY} and ov.ov and {_ALB} and length(q.clean) = length(r.clean)")],
}
ORACLES["link_custom"] = (
    f"with {_KEYS}, {_OV}, {_hits(_OWN)}, {_LINKED} select track_id, file_path, strategy from linked"
)
ORACLES["link_strategy_counts"] = f"""
{_LINK} select {_LABEL} as strategy, count(*) as n from q left join hits using (isrc, artist, album, clean) group by 1"""
ORACLES["match_counts"] = f"""
{_LINK} select count(*) filter (where file_path <> '') as matched, count(*) filter (where file_path = '') as unmatched
from linked"""
ORACLES["artist_overlap_pairs"] = f"with {_KEYS}, {_OV} select qa as q_artist, ra as r_artist from ov where ov"
ORACLES["album_pairs"] = f"""
with {_KEYS} select q.album as q_album, r.album as r_album
from (select distinct album from q where album <> '') q cross join (select distinct album from r where album <> '') r
where {_ALB}"""
ORACLES["catalog_stats"] = (
    f"with {_BASE} select count(*) as tracks, count(*) filter (where isrc <> '') as with_isrc from fx_catalog"
)

# --- quality --------------------------------------------------------------------

_TITLE = "regexp_extract(html, '(?is)<title>(.*?)</title>', 1)"
_URL_PATH = r"regexp_replace(url, '[?#].*$', '')"
ORACLES["junk_titles"] = rf"""
select page_id, {junk('t')} as title_reason, {junk('url')} as url_reason,
  lower(regexp_extract(split_part({_URL_PATH}, '/', -1), '^\.*[^.].*(\.[^.]*)$', 1)) as url_ext
from (select page_id, url, {_TITLE} as t from pages)"""

_TAGS = f"""
{_BASE},
tags as (
  select seq, artist, case when seq % 6 = 0 then title || ' 128' else title end as title, album, genre, date, duration_ms,
    seq % 23 <> 0 as readable,
    '/mnt/' || (case when seq % 3 = 0 then 'c' else 'g' end) || '/music/' || cast(seq as varchar)
      || (case when seq % 5 = 0 then '.ogg' else '.mp3' end) as path from fx_files),
profile as (
  select path, case when not readable then ['unreadable'] else list_filter([
      case when genre = '' then 'genre' end, case when date = '' then 'date' end, case when album = '' then 'album' end,
      case when {junk('title')} <> '' then 'title:junk' end, case when {junk('album')} <> '' then 'album:junk' end,
      case when {junk('genre')} <> '' then 'genre:junk' end, case when {junk('artist')} <> '' then 'artist:junk' end],
      lambda m: m is not null) end as missing
  from tags where path like '%.mp3')
"""
ORACLES["missing_profile"] = (
    f"with {_TAGS} select path, array_to_string(missing, '|') as missing from profile where len(missing) > 0"
)
ORACLES["sparse_counts"] = (
    f"with {_TAGS} select count(*) filter (where len(missing) > 0) as sparse, count(*) as total from profile"
)
ORACLES["needs_work"] = f"with {_TAGS} select path from profile where len(missing) > 0"
ORACLES["needs_work_drives"] = ORACLES["needs_work"]

# --- search texts and paths -------------------------------------------------------

_SPLIT = f"""
{_BASE},
written as (
  select id, case when mix_name = '' then name when id % 3 = 0 then name || ' (' || mix_name || ')'
    when id % 3 = 1 then name || ' - ' || mix_name else name || ' ' || mix_name end as w from fx_candidates),
parts as (
  select id, w, regexp_extract(w, '{_GROUP}', 1) as gb, regexp_extract(w, '{_GROUP}', 2) as gm,
    regexp_extract(w, '(?i){_WS}+[-–—]{_WS}+({_ENDINGS}){_WS}*$', 1) as dm,
    regexp_replace(w, '(?i){_WS}+[-–—]{_WS}+({_ENDINGS}){_WS}*$', '') as db,
    regexp_extract(w, '(?i){_WS}+({_ENDINGS}){_WS}*$', 1) as bm,
    regexp_replace(w, '(?i){_WS}+({_ENDINGS}){_WS}*$', '') as bb from written)
"""
ORACLES["split_mix"] = f"""
with {_SPLIT} select id,
  case when gm <> '' then trim(gb) when dm <> '' then db when bm <> '' then bb else w end as base,
  case when gm <> '' then gm when dm <> '' then dm else bm end as mix, gm as declared from parts"""
ORACLES["clean_query"] = f"""
with {_BASE} select seq, case when seq % 3 = 0 then title else regexp_replace(title, '{_BPM}', '') end as title, artist,
  (case when seq % 2 = 0 then artist || ' - ' else '' end) || title
    || (case seq % 3 when 0 then ' 128' when 1 then ' djsoundtop.com' else '' end) as bare from fx_files"""
ORACLES["search_artists"] = f"""
with {_BASE} select artists, array_to_string(string_split(artists, ' & '), '|') as names
from (select distinct artists from fx_purchases)"""
ORACLES["guess_identity"] = f"""
with {_BASE}, named as (
  select seq, artist, title, seq % 5 in (0, 1) as junk_folder from fx_files)
select seq,
  case when seq % 4 = 0 then artist when junk_folder then '' else artist end as artist,
  case when seq % 4 = 0 then title when junk_folder then ''
    when seq % 4 = 1 then cast(seq + 14000000 as varchar) || '_' || replace(title, ' ', '_') else title end as title,
  case when seq % 4 = 1 then seq + 14000000 else 0 end as file_id,
  case when seq % 4 = 1 then title else '' end as rest from named"""
ORACLES["drive_allow"] = f"""
with {_BASE} select upper(file_path[6]) as drive, count(*) filter (where file_path[6] = 'g') as allowed,
  count(*) filter (where file_path[6] <> 'g') as blocked from fx_catalog group by 1"""
ORACLES["path_forms"] = rf"""
with {_BASE} select seq, upper(file_path[6]) || ':' || replace(substr(file_path, 7), '/', '\') as drive_path,
  file_path as mount_path,
  'file://localhost' || replace(replace(file_path || ' a+b', '+', '%2B'), ' ', '%20') as uri from fx_catalog"""
ORACLES["ext_counts"] = f"""
with {_BASE} select regexp_extract(file_path, '\\.[a-z0-9]+$') as ext, count(*) as n,
  count(*) filter (where file_path like '%.mp3') as wanted from fx_catalog group by 1""".replace("\\\\", "\\")
ORACLES["duration_text"] = f"""
with {_BASE} select id, cast(length_ms // 60000 as varchar) || ':' || lpad(cast((length_ms // 1000) % 60 as varchar), 2, '0') as duration
from fx_candidates"""
ORACLES["duration_parse"] = f"""
with {_BASE} select id, case when id % 3 = 2 and id % 2 = 1 then -1 else (length_ms // 1000) * 1000 end as ms from fx_candidates"""

# --- candidates -------------------------------------------------------------------

_OFFERS = f"""
{_BASE},
offers as (
  select f.seq, f.artist, f.title, f.duration_ms, c.*
  from fx_files f join fx_candidates c on c.name = f.title and c.artists = f.artist),
asked as (
  select seq, title || (case seq % 3 when 0 then '' when 1 then ' (Original Mix)' else ' (Instrumental)' end) as asked
  from fx_files)
"""


def _best(gate: str) -> str:
    return f"""
best as (
  select seq, arg_min(id, ({_AGE}, id)) filter (where {gate}) as pick, count(*) as met
  from offers join asked using (seq) group by seq)
"""


_REASON = "case when pick is not null then 'match' when met is not null then 'ambiguous' else 'no-candidates' end"
_BEST_OUT = f"select seq, coalesce(pick, -1) as id, {_REASON} as reason from fx_files left join best using (seq)"
ORACLES["pick_oldest"] = f"""
with {_BASE} select name, artists, arg_min(id, ({_AGE}, id)) as id, arg_min(publish_date, ({_AGE}, id)) as publish_date
from fx_candidates group by name, artists"""
_GATE = length_fits("length_ms", "duration_ms")
ORACLES["pick_best"] = f"with {_OFFERS}, {_best(_GATE)} {_BEST_OUT}"
ORACLES["pick_best_titled"] = (
    f"with {_OFFERS}, {_best(_GATE + ' and ' + title_agrees('asked', 'name', 'mix_name'))} {_BEST_OUT}"
)
ORACLES["title_gate"] = f"""
with {_OFFERS} select seq, id, {title_agrees('asked', 'name', 'mix_name')} as agrees from offers join asked using (seq)"""
ORACLES["id_gate"] = f"""
with {_BASE} select f.seq, c.id from fx_files f join fx_candidates c on c.id = f.seq
where f.seq % 4 = 1 and f.duration_ms > 0 and c.length_ms > 0 and abs(c.length_ms - f.duration_ms) <= 10000"""


def _search(asks: str) -> str:
    """Top ten per distinct ask, by comparing every ask with every candidate."""
    return f"""
found as (
  select s_artist, s_title, s_mix, id, name, mix_name, publish_date, length_ms,
    row_number() over (partition by s_artist, s_title, s_mix order by {_AGE}, id) as place
  from (select distinct s_artist, s_title, s_mix from {asks}) a join (
    select *, lower(name) as ln, lower(artists) as la, lower(mix_name) as lm from fx_candidates) c
  on contains(ln, lower(s_title)) and contains(la, lower(s_artist)) and contains(lm, lower(s_mix))
  qualify place <= 10)
"""


ORACLES["search_top10"] = f"""
with {_BASE}, asks as (
  select lower(artist) as s_artist, upper(title) as s_title, case when seq % 4 = 0 then 'mix' else '' end as s_mix from fx_files),
{_search('asks')} select s_artist, s_title, s_mix, place, id from found"""

# Joined artists and decorated titles: the variants follow from how each was made.
_VARIANTS = f"""
{_BASE},
joint as (
  select seq, title as t, artist as a, duration_ms, seq % 7 as w, seq % 5 as d,
    case seq % 7 when 0 then artist || ' & Guest' when 1 then 'Guest feat. ' || artist else artist end as artist,
    case seq % 5 when 0 then title || ' (Extended Mix)' when 1 then title || ' (feat. Guest)' else title end as title
  from fx_files),
shaped as (
  select * exclude (title), title as raw_title, case when d in (0, 1) then t else regexp_replace(t, '{_BPM}', '') end as base,
    case when d in (0, 1) then title else regexp_replace(title, '{_BPM}', '') end as title, case d when 0 then 'Extended Mix' when 1 then 'feat. Guest' else '' end as mix,
    case w when 0 then [a, 'Guest'] when 1 then ['Guest', a] else [a] end as people
  from joint),
listed as (
  select seq, duration_ms, v, o from (
    select seq, duration_ms, unnest(vs) as v, generate_subscripts(vs, 1) - 1 as o from (
      select seq, duration_ms,
        [{{'a': artist, 't': base, 'm': mix, 'g': false}}, {{'a': artist, 't': title, 'm': '', 'g': false}},
         {{'a': base, 't': artist, 'm': mix, 'g': false}}]
        || list_transform(people, lambda p: {{'a': p, 't': base, 'm': mix, 'g': true}})
        || case when d = 1 then list_transform(people, lambda p: {{'a': p, 't': base, 'm': '', 'g': true}}) else [] end
        || case when d = 1 then list_transform([t || ' (', 'Guest)'], lambda p: {{'a': p, 't': base, 'm': '', 'g': true}}) else [] end as vs
      from shaped))),
variants as (
  select seq, any_value(duration_ms) as duration_ms, v.a as s_artist, v.t as s_title, v.m as s_mix,
    cast(min(o) as integer) as ordinal, arg_min(v.g, o) as gated
  from listed group by seq, v.a, v.t, v.m)
"""
ORACLES["search_variants"] = f"with {_VARIANTS} select seq, ordinal, s_artist, s_title, s_mix, gated from variants"
_USABLE = f"""
{_VARIANTS}, {_search('variants')},
passing as (
  select seq, ordinal, id, publish_date from variants join found using (s_artist, s_title, s_mix)
  where {length_fits('length_ms', 'duration_ms')} and (not gated or s_title = '' or {title_agrees('s_title', 'name', 'mix_name')})),
usable as (select * from passing qualify rank() over (partition by seq order by ordinal) = 1)
"""
ORACLES["variant_first_usable"] = f"with {_USABLE} select seq, ordinal, id from usable"

_PARSED = """
  id, name, artists || ', Guest' as artists, 'House' as genre, case when id % 2 = 0 then 'Deep House' else '' end as sub_genre,
  case when id % 3 = 0 then 'Own' else 'House Label' end as label, id + 7 as release_id,
  coalesce(nullif(publish_date, ''), '1999-01-01') as publish_date, cast(case when id % 4 = 0 then 0 else 120 + id % 20 end as integer) as bpm,
  case when id % 5 = 0 then 'http://i/500x500.jpg' else 'http://t/i.jpg' end as artwork_url, length_ms"""
ORACLES["candidate_parse"] = f"with {_BASE} select {_PARSED} from fx_candidates"
ORACLES["snapshot_roundtrip"] = (
    f"with {_BASE}, parsed as (select {_PARSED}, mix_name from fx_candidates) "
    "select id, name, mix_name, bpm, length_ms, artwork_url from parsed"
)
ORACLES["props_snapshot"] = """
select cast(json_extract_string(props, '$.k') as bigint) as id, arg_max(event_type, event_id) as name,
  cast(arg_max(case event_id % 6 when 0 then 1 when 2 then 7 when 5 then cast(json_extract_string(props, '$.k') as int) else 0 end, event_id) as integer) as bpm,
  max(event_id) as length_ms, max(event_id) as version from events group by 1"""
ORACLES["cache_landings"] = ORACLES["props_snapshot"]
ORACLES["snapshot_lookup"] = """
with c as (select o_orderkey as id from orders where o_orderkey % 5 <> 0)
select case when c.id is null then 'error' else 'matched' end as status, count(*) as n, count(distinct l_orderkey) as ids
from lineitem left join c on c.id = l_orderkey group by 1"""
ORACLES["wanted_ids"] = """
select distinct l_orderkey as id from lineitem
where l_orderkey not in (select o_orderkey from orders where o_orderkey % 5 <> 0)"""

# --- fallback sources ---------------------------------------------------------------

_RECORDINGS = f"""
{_OFFERS},
passing_r as (
  select *, lower((case when id % 9 = 0 then 'Nobody' else artists end) || ' Live') as credit from offers
  where 60 + id % 41 >= 80 and (duration_ms = 0 or length_ms = 0 or abs(length_ms - duration_ms) <= 10000) and id % 9 <> 0),
first_r as (select * from passing_r qualify row_number() over (partition by seq order by id) = 1),
mb as (
  select seq, case when id % 6 = 0 then title else name end as name, credit as artists,
    case when id % 10 = 0 then '' else 'Rel ' || cast(id as varchar) end as release_name,
    substr(publish_date || 'T00:00', 1, 10) as publish_date, 'Lab' as label from first_r)
"""
ORACLES["mb_gate"] = f"with {_RECORDINGS} select seq, name, artists, release_name, publish_date, label from mb"
_LISTED_MS = "(length_ms // 1000) * 1000"
_RELEASES = f"""
passing_d as (
  select * from offers where id <> 0 and id % 8 <> 0 and id % 11 <> 0 and duration_ms > 0 and length_ms > 0
    and abs({_LISTED_MS} - duration_ms) <= 10000),
first_d as (select * from passing_d qualify row_number() over (partition by seq order by id) = 1),
dg as (
  select seq, 'Album ' || cast(id as varchar) as name, artists, 'Album ' || cast(id as varchar) as release_name,
    coalesce(nullif(publish_date, ''), '1998') as publish_date, 'Lab' as label,
    case when id % 4 = 0 then 'Tech House' when id % 2 = 0 then 'Rock' else '' end as genre, 'a' as artwork_url from first_d)
"""
ORACLES["discogs_gate"] = f"with {_OFFERS}, {_RELEASES} select seq, name, artists, release_name, publish_date, label, genre, artwork_url from dg"
ORACLES["source_waterfall"] = f"""
with {_RECORDINGS}, {_RELEASES}, {_best(_GATE)}, decided as (
  select f.seq, case when b.pick is not null then 'catalog' when mb.seq is not null then 'recordings'
    when dg.seq is not null then 'releases' else '' end as source, b.pick, b.met
  from fx_files f left join best b using (seq) left join mb using (seq) left join dg using (seq))
select seq, source, case when source <> '' then 'matched' when met is not null then 'ambiguous' else 'no-candidates' end as status
from decided"""

# --- the whole flow: who a file is follows from how its path and tags were made -----

_FLOW = f"""
{_BASE},
raw as (
  select f.seq, f.artist as a, f.title as t, f.duration_ms,
    case f.seq % 7 when 0 then f.artist || ' & Guest' when 1 then 'Guest feat. ' || f.artist else f.artist end as tag_artist,
    case f.seq % 5 when 0 then f.title || ' (Extended Mix)' when 1 then f.title || ' (feat. Guest)' else f.title end as tag_title,
    f.seq % 6 = 0 as untagged,
    case when f.seq % 5 = 0 then 'UnknownArtist' when f.seq % 5 = 1 then 'www.example.com' else f.artist end as folder,
    case f.seq % 4 when 0 then '03 - ' || f.artist || ' - ' || f.title
      when 1 then cast(f.seq + 14000000 as varchar) || '_' || replace(f.title, ' ', '_')
      when 2 then f.title else '1-07. ' || f.title end as stem
  from fx_files f),
joint as (
  select seq, '/mnt/g/music/' || folder || '/' || stem || '.mp3' as path, duration_ms,
    case when not untagged then seq % 7 else 2 end as w, case when not untagged then seq % 5 else 2 end as d, a, t,
    case when not untagged then tag_artist when seq % 4 = 0 then a when seq % 5 in (0, 1) then null else a end as artist,
    case when not untagged then tag_title when seq % 4 = 0 then t when seq % 5 in (0, 1) then null else t end as title
  from raw),
known as (select * from joint where artist is not null)
"""
_FLOW_SEARCH = (
    _VARIANTS[_VARIANTS.index("shaped as (") :]
    .replace("from joint)", "from known)")
)
ORACLES["enrich_resolve"] = f"""
with {_FLOW}, {_FLOW_SEARCH}, {_search('variants')},
passing as (
  select seq, ordinal, id, publish_date, length_ms, duration_ms from variants join found using (s_artist, s_title, s_mix)
  where {length_fits('length_ms', 'duration_ms')} and (not gated or s_title = '' or {title_agrees('s_title', 'name', 'mix_name')})),
usable as (select * from passing qualify rank() over (partition by seq order by ordinal) = 1),
picks as (select seq, arg_min(id, ({_AGE}, id)) as pick from usable group by seq)
select path, coalesce(artist, '') as artist, coalesce(title, '') as title,
  case when artist is null then 'skipped' when pick is not null then 'matched' else 'no-candidates' end as status,
  case when pick is not null then 'catalog' else '' end as source, coalesce(pick, -1) as id
from joint left join picks using (seq)"""

# --- merge ------------------------------------------------------------------------

_MERGE = f"""
{_OFFERS}, {_best(_GATE)},
new as materialized (
  select b.seq, c.id, case when c.mix_name <> '' then c.name || ' (' || c.mix_name || ')' else c.name end as n_title,
    c.artists as n_artist, 'Rel' as n_album,
    case when c.id % 4 = 0 then 'Hard Techno' when c.id % 2 = 0 then 'Techno' else '' end as n_genre,
    c.publish_date as n_date, case when c.id % 3 = 0 then '' else cast(c.id % 3 as varchar) end as n_bpm,
    case when c.id % 5 = 0 then '' else 'http://i/a.jpg' end as art
  from best b join fx_candidates c on c.id = b.pick),
fields as (
  select seq, unnest(['artist', 'title', 'album', 'genre', 'date', 'bpm']) as field,
    unnest([f.artist, f.title, f.album, f.genre, f.date, '']) as old,
    unnest([n_artist, n_title, n_album, n_genre, n_date, n_bpm]) as new
  from fx_files f join new using (seq)),
judged as materialized (select *, {junk('old')} as reason from fields),
plan as materialized (
  select seq, field, old, new, reason from judged where new <> '' and (old = '' or reason <> '') and old <> new)
"""
ORACLES["merge_plan"] = f"with {_MERGE} select * from plan"
ORACLES["merge_plan_maps"] = f"""
with {_MERGE} select n.seq, coalesce(string_agg(p.field || '=' || p.new, '|' order by p.field), '') as updates,
  coalesce(string_agg(p.field || '=' || p.reason, '|' order by p.field) filter (where p.reason <> ''), '') as reasons,
  n.art <> '' and n.seq % 2 <> 0 as embed_artwork
from new n left join plan p on p.seq = n.seq and p.field in ('genre', 'date', 'bpm') group by n.seq, n.art"""
ORACLES["merge_result"] = f"""
with {_MERGE}, wide as (
  select seq, max(new) filter (where field = 'artist') as artist, max(new) filter (where field = 'title') as title,
    max(new) filter (where field = 'album') as album, max(new) filter (where field = 'genre') as genre,
    max(new) filter (where field = 'date') as date from plan group by seq)
select f.seq, coalesce(w.artist, f.artist) as artist, coalesce(w.title, f.title) as title, coalesce(w.album, f.album) as album,
  coalesce(w.genre, f.genre) as genre, coalesce(w.date, f.date) as date,
  array_to_string(list_filter([case when w.artist is not null then 'artist' end, case when w.title is not null then 'title' end,
    case when w.album is not null then 'album' end, case when w.genre is not null then 'genre' end,
    case when w.date is not null then 'date' end], lambda m: m is not null), '|') as updated,
  case when coalesce(w.artist, w.title, w.album, w.genre, w.date) is not null then 'catalog' else '' end as source
from fx_files f left join wide w using (seq)"""
ORACLES["reconcile"] = f"""
with {_MERGE}, u as (
  select n.seq, n.art, count(p.field) as n_up, coalesce(bool_or(p.field = 'artist'), false) as sets_artist,
    f.artist <> '' as had_artist
  from new n join fx_files f using (seq) left join plan p using (seq) group by n.seq, n.art, f.artist),
v as (
  select seq, (seq % 13 <> 0 or n_up = 0) and not (seq % 17 = 0 and seq % 13 <> 0 and sets_artist) as landed,
    (case when seq % 29 = 0 and not (art <> '' and seq % 2 <> 0) then '<pictures>' else '' end) as pics,
    (case when seq % 17 = 0 and seq % 13 <> 0 and had_artist then 'artist' else '' end) as gone,
    seq % 19 <> 0 as audio_ok from u)
select seq, landed, array_to_string(list_filter([pics, gone], lambda m: m <> ''), '|') as lost, audio_ok,
  case when landed and pics = '' and gone = '' and audio_ok then 'matched' else 'verify-failed' end as status from v"""

# --- runs -------------------------------------------------------------------------

ORACLES["resume_todo"] = """
select cast(o_orderkey as varchar) as path from orders
where (o_orderkey % 3 <> 0 or o_orderkey % 6 = 0)
  and o_orderkey not in (select event_id from events where event_type <> 'error')"""
ORACLES["status_counts"] = f"""
with {_BASE} select case when status = 'matched' and seq % 2 = 0 and seq % 3 <> 0 then 'updated' else status end as status,
  count(*) as n from fx_run_log group by 1"""
ORACLES["run_verdict"] = f"""
with {_BASE} select run_id, case when bool_or(status in ('error', 'verify-failed', 'stuck')) then 2 else 0 end as verdict
from fx_run_log group by run_id"""
ORACLES["run_progress"] = f"""
with {_BASE} select run_id, count(*) as done, count(*) filter (where status = 'matched') as matched,
  coalesce('item ' || cast(arg_max(seq, (ts, seq)) filter (where status = 'matched') as varchar), '') as last_matched,
  round(100.0 * count(*) / 500, 3) as pct, round(count(*) / 60.0, 3) as rate,
  round((500 - count(*)) / greatest(count(*) / 60.0, 0.01), 3) as eta from fx_run_log group by run_id"""
_BREAKER = f"""
{_BASE},
islands as (
  select *, sum(case when status = 'error' then 0 else 1 end) over (partition by run_id order by ts, seq) as island from fx_run_log),
streaks as (
  select *, cast(sum(case when status = 'error' then 1 else 0 end) over (partition by run_id, island order by ts, seq) as bigint) as streak,
    row_number() over (partition by run_id order by ts, seq) as position from islands),
trips as (select run_id, min(position) as trip from streaks where streak >= 3 group by run_id),
kept as (select s.* from streaks s left join trips using (run_id) where trip is null or position <= trip)
"""
ORACLES["breaker_prefix"] = f"with {_BREAKER} select run_id, seq, status, streak from kept"
ORACLES["breaker_prefix_dry"] = f"""
with {_BREAKER} select s.run_id, seq, position from streaks s left join trips using (run_id)
where trip is null or (position - 1) // 10 <= (trip - 1) // 10"""
ORACLES["breaker_totals"] = f"""
with {_BREAKER} select run_id, status, count(*) as n from kept group by run_id, status
union all select run_id, 'stopped-early', 1 from trips"""
ORACLES["chunks"] = f"""
with {_BASE} select seq, position, (position - 1) // 50 as chunk
from (select seq, row_number() over (order by ts, seq) as position from fx_run_log)"""
ORACLES["first_results"] = f"with {_BASE} select seq, status from fx_run_log order by ts, seq limit 100"
_DONE_AT = "ts + to_seconds(cast(floor(value * 10) as bigint))"
ORACLES["stuck_batch"] = f"""
with last as (select max(ts) as now from events)
select event_id as item from events cross join last
where (event_type = 'error' or {_DONE_AT} > now) and floor(epoch(now)) - floor(epoch(ts)) > 300"""
ORACLES["result_records"] = f"""
with {_BASE} select seq, '{{"path":"' || cast(seq as varchar) || '","status":"' || status || '","error":""}}' as record from fx_run_log"""

# --- ingest -----------------------------------------------------------------------

ORACLES["upsert_first_wins"] = """
select conv_id, turn, role, md5(text) as text_key from conversations
qualify row_number() over (partition by conv_id order by turn) = 1"""
ORACLES["catalog_landings"] = ORACLES["upsert_first_wins"]
ORACLES["purchase_flatten"] = f"""
with {_BASE} select case when id = 0 then '' else cast(id as varchar) end as track_id, name as title, artists || ', Guest' as artists,
  '' as remixers, case when id % 2 = 0 then 'House' else '' end as genre, case when id % 3 = 0 then '$1.49' else '' end as price,
  case when id % 4 = 0 then '' else cast(id % 4 as varchar) end as bpm, '9' as release_id, 'Rel' as release_title,
  publish_date as purchase_date, case when length_ms = 0 then '9:59' else
    cast(length_ms // 60000 as varchar) || ':' || lpad(cast((length_ms // 1000) % 60 as varchar), 2, '0') end as duration
from fx_candidates"""
ORACLES["page_gaps"] = """
with n as (select greatest(1, cast(ceil(count(*) / 100.0) as integer)) as last from orders)
select cast(p as integer) as page_no from (select unnest(generate_series(1, last)) as p from n)
where p - 1 not in (select distinct o_orderkey // 100 from orders where (o_orderkey // 100) % 7 <> 3)"""
ORACLES["purchases_resorted"] = """
with rows as (
  select o_orderkey, case when o_orderkey % 50 = 0 then '' else strftime(o_orderdate, '%Y-%m-%d') end as d,
    (select max(o_orderkey) // 2 from orders) as half from orders)
select cast(o_orderkey as varchar) as track_id, d as purchase_date from rows where o_orderkey <= half + 10
union all select cast(o_orderkey as varchar), d from rows where o_orderkey > half"""

ORACLES["csv_roundtrip"] = f"""
with {_BASE} select case when id = 0 then '' else cast(id as varchar) end as track_id,
  name || chr(13) || chr(10) || '"x", y' as title, case when id % 2 = 0 then 'House' else '' end as genre,
  case when id % 4 = 0 then '' else cast(id % 4 as varchar) end as bpm from fx_candidates"""
ORACLES["csv_blocks"] = ORACLES["csv_roundtrip"]
ORACLES["matched_roundtrip"] = f"""
with {_BASE} select t as track_id, '/m/' || t as path, 18 as n_columns
from (select case when id = 0 then '' else cast(id as varchar) end as t from fx_candidates)"""
ORACLES["catalog_build"] = f"""
with {_BASE} select seq, '/m/' || cast(seq as varchar) || '.mp3' as file_path, case when seq % 3 <> 0 then artist else '' end as artist,
  '' as album_artist, case when seq % 3 <> 0 then title else '' end as title, case when seq % 3 <> 0 then genre else '' end as genre,
  case when seq % 3 <> 0 then cast(duration_ms // 60000 as varchar) || ':' || lpad(cast((duration_ms // 1000) % 60 as varchar), 2, '0')
    else '0:00' end as duration, cast(seq * 10 as varchar) as file_size from fx_files"""
ORACLES["done_paths"] = f"with {_BASE} select distinct cast(seq % 500 as varchar) as path from fx_run_log"
ORACLES["plan_allowed_fields"] = f"""
with {_MERGE} select seq, field, new from plan where field in ('genre', 'date', 'bpm')"""
ORACLES["log_roundtrip"] = f"""
with {_BASE} select cast(seq as varchar) as path, status, case when seq % 2 = 0 then seq else 0 end as candidate_id,
  case when seq % 4 = 1 then '9' else '' end as snapshot_id from fx_run_log
where status = 'matched' and ((seq % 2 = 0 and seq <> 0) or seq % 4 = 1)"""
ORACLES["manifest_roundtrip"] = f"""
with {_TAGS} select path, artist, title, duration_ms, array_to_string(missing, '|') as missing
from profile join tags using (path) where len(missing) > 0"""
ORACLES["manifest_blocks"] = ORACLES["manifest_roundtrip"]
ORACLES["merge_publish"] = ORACLES["merge_result"].rsplit("select f.seq,", 1)[0] + """
select f.seq, case when f.seq % 10 = 0 then f.artist else coalesce(w.artist, f.artist) end as artist,
  case when f.seq % 10 = 0 then f.title else coalesce(w.title, f.title) end as title,
  case when f.seq % 10 = 0 then f.album else coalesce(w.album, f.album) end as album,
  case when f.seq % 10 = 0 then f.genre else coalesce(w.genre, f.genre) end as genre,
  case when f.seq % 10 = 0 then f.date else coalesce(w.date, f.date) end as date
from fx_files f left join wide w using (seq)"""
ORACLES["publish_versions"] = ORACLES["merge_publish"]

# --- playlists --------------------------------------------------------------------

_PLAY = f"""
{_LINK},
dated as (
  select track_id, title, artists, release_title, file_path,
    case when track_id % 10 in (0, 3) then null else strftime(purchased_at, '%Y-%m') end as month from linked where file_path <> ''),
entries as (
  select *, 'month' as kind, month as period from dated where month is not null
  union all select *, 'year', substr(month, 1, 4) from dated where month is not null)
"""
ORACLES["playlist_months"] = f"{_PLAY} select period, count(*) as n from entries where kind = 'month' group by period"
ORACLES["playlist_years"] = f"{_PLAY} select period, count(*) as n from entries where kind = 'year' group by period"
_UNIQUE = "uniq as (select kind, period, file_path, min(track_id) as track_id from entries group by kind, period, file_path)"
ORACLES["playlist_entries"] = f"{_PLAY}, {_UNIQUE} select kind, period, file_path, track_id from uniq"
ORACLES["m3u_lines"] = f"""
{_PLAY}, named as (select *, period || (case when kind = 'year' then '-0.m3u' else '.m3u' end) as playlist from entries)
select playlist, track_id as position, '#EXTINF:-1,' || artists || ' - ' || title || chr(10) || file_path as line from named
union all select distinct playlist, -1, '#EXTM3U' from named"""
_REFS = f"""
{_PLAY}, {_UNIQUE},
tracks as (select *, row_number() over (order by track_id) as track_no from dated),
lasts as (select file_path, max(track_no) as key from tracks group by file_path),
refs as (select kind, period, track_id as ordinal, key from uniq join lasts using (file_path))
"""
ORACLES["xml_collection"] = f"""
{_REFS} select track_no, '<TRACK TrackID="' || cast(track_no as varchar) || '" Name="' || title || '" Artist="'
  || replace(artists, '&', '&amp;') || '" Album="' || release_title || '" Location="file://localhost' || file_path
  || '" TotalTime="0" Kind="' || split_part(file_path, '.', -1) || '"/>' as xml from tracks"""
ORACLES["xml_references"] = f"{_REFS} select kind, period, ordinal, key from refs"
ORACLES["xml_tree"] = f"""
{_REFS}, rows as (select *, substr(period, 1, 4) as year, case when kind = 'year' then 0 else 1 end as rank from refs),
counts as (select year, rank, period, count(*) as n from rows group by year, rank, period)
select year, rank, period, 1 as step, ordinal, '<TRACK Key="' || cast(key as varchar) || '"/>' as line from rows
union all select year, rank, period, 0, 0, '<NODE Type="1" Name="' || period || (case when rank = 0 then ' (Full Year)' else '' end)
  || '" KeyType="0" Entries="' || cast(n as varchar) || '">' from counts
union all select year, rank, period, 2, 0, '</NODE>' from counts
union all select year, -1, '', 0, 0, '<NODE Type="0" Name="' || year || '">' from counts where rank = 0
union all select year, 2, '', 0, 0, '</NODE>' from counts where rank = 0"""

# --- streaming --------------------------------------------------------------------

ORACLES["stream_enrich"] = ORACLES["pick_best"]
ORACLES["stream_breaker"] = ORACLES["breaker_prefix"]
ORACLES["stream_stuck"] = f"""
with bounds as (select least(max(ts), max({_DONE_AT}) filter (where event_type <> 'error')) as seen from events)
select event_id as item, 'stuck' as status from events, bounds
where (event_type = 'error' or {_DONE_AT} > ts + interval 300 seconds) and ts + interval 300 seconds < seen"""
ORACLES["stream_counts"] = f"with {_BASE} select status, count(*) as n from fx_run_log group by 1"
ORACLES["stream_resume"] = ORACLES["pick_best"]
ORACLES["stream_progress"] = f"""
with {_BASE} select count(*) as done, count(*) filter (where status = 'matched') as matched,
  coalesce('item ' || cast(arg_max(seq, (ts, seq)) filter (where status = 'matched') as varchar), '') as last_matched,
  cast(100 as double) as pct from fx_run_log"""
ORACLES["stream_watchdog"] = "select event_id as item, 'stuck' as status from events where event_type = 'error'"
ORACLES["stream_breaker_batches"] = ORACLES["breaker_prefix"]
