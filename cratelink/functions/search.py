"""Query-side text rules: what to search a candidate table with."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cratelink.functions.text import (
    BARE_MIX,
    DASH_MIX,
    GROUP_CAP,
    TITLE_AND_GROUP,
    WORD,
    WS,
    WS_SET,
    clean_title,
    declared_mix,
    normalize,
    strip,
)

# --- fixed values -----------------------------------------------------------

#: Top-level domains that turn a dotted word into a web address.
WEB_DOMAINS = "com|vip|net|org|ru|to|info|biz"
#: Folder names that say nothing about the artist.
JUNK_FOLDERS = ["unknownartist", "unknownalbum"]
#: Mixes of the same recording, which length alone cannot tell apart.
STEM_WORDS = "instrumental|vocal|a" + WS + "?capella|stem|dub"

# Leading dashes of a host run are captured so that removal can put them back.
WEB_ADDRESS = (
    rf"(?iu)https?://|www\.|(?<![\p{{L}}\p{{N}}_-])(-*){WORD}[\p{{L}}\p{{N}}_-]*"
    rf"\.(?:{WEB_DOMAINS})(?!{WORD})"
)
TRAILING_BPM = rf"(?<!{WS}){WS}+\(?1\p{{Nd}}\p{{Nd}}\)?{WS}*\z"
TRACK_NUMBER = rf"\A(?:\p{{Nd}}{{1,3}}[_.{WS_SET}-]+)+"
LEADING_ID = rf"\A(\p{{Nd}}{{6,}})[_.{WS_SET}-]+([^\n]+)\n?\z"
ARTIST_JOINER = (
    rf"(?iu)(?<!{WS}){WS}*(?:,|;|&|\+|(?<!{WORD})x|(?<!{WORD})vs"
    rf"|(?<!{WORD})(?:featuring|feat|ft)\.?){WS}+|(?<!{WS}){WS}+/{WS}+"
)
FEATURING_TAIL = (
    rf"(?iu)(?<!{WS}){WS}*[(\[]?(?<!{WS}){WS}*(?<!{WORD})(?:featuring|feat|ft)(?!{WORD})"
    rf"\.?{WS}+[^)\]]{{0,{GROUP_CAP}}}[)\]]?{WS}*\z"
)


def split_mix(c: Column) -> Column:
    """``struct(base, mix)``: bracket form first, then dash, then bare ending."""
    t = strip(c)

    def ending(pattern: str) -> Column:
        mix = F.regexp_extract(t, pattern, 1)
        return F.when(
            mix != "", F.struct(strip(F.regexp_replace(t, pattern, "")).alias("base"), mix.alias("mix"))
        )

    group = F.regexp_extract(t, TITLE_AND_GROUP, 2)
    bracketed = F.when(
        group != "",
        F.struct(
            strip(F.regexp_extract(t, TITLE_AND_GROUP, 1)).alias("base"),
            strip(group).alias("mix"),
        ),
    )
    return F.coalesce(
        bracketed,
        ending(DASH_MIX),
        ending(BARE_MIX),
        F.struct(t.alias("base"), F.lit("").alias("mix")),
    )


def drop_web(c: Column) -> Column:
    """Remove web addresses."""
    return F.regexp_replace(c, WEB_ADDRESS, "$1")


def clean_search_title(title: Column, artist: Column) -> Column:
    """Title without addresses, trailing tempo and a repeated artist prefix."""
    q = strip(F.regexp_replace(strip(drop_web(title)), TRAILING_BPM, ""))
    prefix = F.lower(strip(artist))
    low = F.lower(q)
    led = (artist != "") & (
        F.startswith(low, F.concat(prefix, F.lit(" - ")))
        | F.startswith(low, F.concat(prefix, F.lit(" – ")))
    )
    q = F.when(led, strip(F.substr(q, F.length(prefix) + 4))).otherwise(q)
    return F.when(q != "", q).otherwise(strip(title))


def clean_search_artist(artist: Column) -> Column:
    a = strip(F.regexp_replace(strip(drop_web(artist)), TRAILING_BPM, ""))
    return F.when(a != "", a).otherwise(artist)


def split_artists(artist: Column) -> Column:
    """Artist names to search one by one; names such as ``AC/DC`` stay whole."""
    parts = F.transform(F.split(artist, ARTIST_JOINER), lambda p: F.btrim(p, F.lit(" -_,")))
    return F.filter(parts, lambda p: p != "")


def drop_featuring(title: Column) -> Column:
    """Title without a trailing featuring clause."""
    return strip(F.regexp_replace(title, FEATURING_TAIL, ""))


def file_stem(path: Column) -> Column:
    """File name without folders and extension. A leading dot is not an extension."""
    base = F.substring_index(path, "/", -1)
    return F.regexp_replace(base, r"(?s)\A(\.*[^.].*)\.[^.]*\z", "$1")


def _name_body(path: Column) -> Column:
    return strip(F.regexp_replace(strip(file_stem(path)), TRACK_NUMBER, ""))


def identity_from_name(path: Column) -> Column:
    """``struct(artist, title)`` from ``Artist - Title``; artist ``''`` without a dash."""
    stem = _name_body(path)
    at = F.instr(stem, " - ")
    return F.when(
        at > 0,
        F.struct(
            strip(F.substr(stem, F.lit(1), at - 1)).alias("artist"),
            strip(F.substr(stem, at + 3)).alias("title"),
        ),
    ).otherwise(F.struct(F.lit("").alias("artist"), stem.alias("title")))


def identity_from_folder(path: Column, title: Column) -> Column:
    """``struct(artist, title)`` with the parent folder as artist, unless it is junk."""
    segments = F.split(path, "/+")
    parent = F.coalesce(F.try_element_at(segments, F.lit(-2)), F.lit(""))
    usable = (
        (parent != "")
        & ~F.lower(parent).isin(JUNK_FOLDERS)
        & ~parent.rlike(WEB_ADDRESS)
        & (title != "")
    )
    return F.struct(
        F.when(usable, strip(parent)).otherwise(F.lit("")).alias("artist"), title.alias("title")
    )


def id_from_name(path: Column) -> Column:
    """``struct(id, rest)`` for names led by a catalog id; ``(0, '')`` otherwise."""
    stem = strip(file_stem(path))
    digits = F.regexp_extract(stem, LEADING_ID, 1)
    rest = F.regexp_extract(stem, LEADING_ID, 2)
    rest = F.replace(strip(F.regexp_replace(rest, TRACK_NUMBER, "")), F.lit("_"), F.lit(" "))
    return F.when(
        digits != "",
        F.struct(F.coalesce(digits.try_cast("bigint"), F.lit(0)).alias("id"), rest.alias("rest")),
    ).otherwise(F.struct(F.lit(0).cast("bigint").alias("id"), F.lit("").alias("rest")))


def resolve_identity(path: Column, artist: Column, title: Column) -> Column:
    """Identity to search with: tags, then file name, then folder; null when none fits."""
    named = identity_from_name(path)
    guess = named["title"]
    folder = identity_from_folder(path, F.when(guess != "", guess).otherwise(title))

    def valid(s: Column) -> Column:
        return F.when((s["artist"] != "") & (s["title"] != ""), s)

    tags = F.struct(artist.alias("artist"), title.alias("title"))
    return F.coalesce(valid(tags), valid(named), valid(folder))


def title_agrees(query: Column, name: Column, mix: Column) -> Column:
    """Do a query title and a candidate name one recording, mixes considered?"""
    q = clean_title(query)
    c = clean_title(name)
    base = (q != "") & (c != "") & (F.contains(q, c) | F.contains(c, q))
    want = declared_mix(query)
    stem = mix.rlike(rf"(?iu)(?<!{WORD})(?:{STEM_WORDS})(?!{WORD})")
    mix_fits = (
        F.when(mix == "", F.lit(True))
        .when(stem & (want == ""), F.lit(False))
        .otherwise((want == "") | (normalize(want) == normalize(mix)))
    )
    return base & mix_fits


def compare_key(c: Column) -> Column:
    """Lower-cased words of any script, one blank between: no folding."""
    words = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")
    return F.trim(words)
