"""The key rules as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from cratelink.functions import quality, search, text


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _translated(src: str, dst: str) -> str:
    """Folding by one translate, with the several-character cases written out first."""
    pairs = _quoted("\x02".join(f"{k}\x03{v}" for k, v in text._fold_tables()[2].items()))
    expanded = (
        f"if(v rlike {_quoted(text._longer_class())}, array_join(transform(split(v, ''), c -> "
        f"coalesce(try_element_at(str_to_map({pairs}, '\x02', '\x03'), c), c)), ''), v)"
    )
    table = f"{_quoted(src)}, {_quoted(dst)}"
    foreign = _quoted(r"[^\x00-\x7F]+")
    return (
        f"if(v rlike {foreign}, regexp_replace(translate({expanded}, {table}), {foreign}, ''), translate(v, {table}))"
    )


def _squeezed(body: str) -> str:
    return f"trim(regexp_replace({body}, '  +', ' '))"


#: The steps of the title rule, each behind a test that is true whenever its pattern can match.
_STEP_TESTS = (
    (text.MIX_GROUP, "right(v, 1) in (')', ']')"),
    (text.BARE_MIX, "lower(right(v, 1)) in ('x', 'l', 't', 'k')"),
    (text.DASH_MIX, "lower(right(v, 1)) in ('x', 'l', 't', 'k')"),
    (text.ANY_GROUP, "right(v, 1) in (')', ']')"),
    (text.FEATURING, "contains(lower(v), 'feat') or contains(lower(v), 'ft.')"),
)


def _step(pattern: str, test: str) -> str:
    return f"if({test}, regexp_replace(v, {_quoted(pattern)}, ''), v)"


def _nested(body: str) -> str:
    for i in range(len(_STEP_TESTS)):
        body = f"cl_drop_{i}({body})"
    return body


def _bodies() -> dict[str, str]:
    stripped = f"btrim(v, {_quoted(text.SPACE_CHARS)})"
    sites = " ".join(
        f"when contains(lower(v), {_quoted(s)}) then {_quoted('promo-domain:' + s)}" for s in quality.PROMO_SITES
    )
    return {
        "cl_fold": _translated(*text._fold_tables()[:2]),
        "cl_normalize": _squeezed(f"replace({_translated(*text._key_tables('&', ' '))}, '&', ' and ')"),
        "cl_norm_artist": _squeezed(_translated(*text._key_tables("&,", ""))),
        **{f"cl_drop_{i}": _step(pattern, test) for i, (pattern, test) in enumerate(_STEP_TESTS)},
        "cl_clean_title": f"cl_normalize({_nested(stripped)})",
        "cl_declared_mix": f"btrim(regexp_extract({stripped}, {_quoted(text.TITLE_AND_GROUP)}, 2), "
        f"{_quoted(text.SPACE_CHARS)})",
        "cl_junk_reason": f"case when v = '' then '' when {stripped} rlike {_quoted(search.WEB_ADDRESS)} then "
        f"case {sites} else 'url' end when {stripped} rlike {_quoted(search.TRAILING_BPM)} then 'trailing-bpm' "
        f"when {stripped} rlike {_quoted(quality.DOUBLED_MIX)} then 'doubled-mix' else '' end",
    }


def register(spark: SparkSession) -> list[str]:
    """Create one temporary SQL function per rule; they inline as plain expressions."""
    bodies = _bodies()
    for name, body in bodies.items():
        spark.sql(f"create or replace temporary function {name}(v string) returns string return {body}")
    return list(bodies)
