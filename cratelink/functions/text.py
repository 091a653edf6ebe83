"""Match-key text rules as native column expressions.

Nothing here leaves the JVM: folding is ``translate`` plus a literal map, and the
suffix rules are guarded regular expressions, so a key-building job stays one
narrow stage whatever the size of the table.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: must equal the linked tool's for equal results -----------

#: What counts as whitespace, as a trim set and as a regex class.
SPACE_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
WS_SET = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS = f"[{WS_SET}]"
#: A letter, digit or underscore in any script.
WORD = r"[\p{L}\p{N}_]"
#: Words that mark a bracket group as a mix name.
MIX_WORDS = "mix|edit|remix|version|rework|dub|vocal|instrumental|extended|radio|reprise"
#: Mix names that may also stand bare or after a dash at the end of a title.
MIX_ENDINGS = (
    "original mix|extended mix|radio edit|club mix|dub mix|vocal mix"
    "|instrumental|remix|edit|rework"
)
#: Longest bracket group that still counts as a suffix.
GROUP_CAP = 120

# ``(?<!WS)`` before each leading run keeps matching linear on long runs of
# blanks; the cap bounds the lazy inner run. Java backtracks as well.
_RUN = rf"(?<!{WS}){WS}"
MIX_GROUP = (
    rf"(?iu){_RUN}*[(\[][^)\]]{{0,{GROUP_CAP}}}?(?:{MIX_WORDS}|feat\.|featuring)"
    rf"[^)]*[)\]]{WS}*\z"
)
BARE_MIX = rf"(?iu){_RUN}+({MIX_ENDINGS}){WS}*\z"
DASH_MIX = rf"(?iu){_RUN}+[-–—]{WS}+({MIX_ENDINGS}){WS}*\z"
ANY_GROUP = rf"{_RUN}*[(\[][^)\]]{{0,{GROUP_CAP}}}[)\]]{WS}*\z"
FEATURING = rf"(?iu){_RUN}+(?:feat\.|featuring|ft\.){WS}+[^\n]+\n?\z"
#: Title, then one trailing bracket group: 1 = title, 2 = group.
TITLE_AND_GROUP = (
    rf"\A([^\n]{{0,{GROUP_CAP}}}?)(?<!{WS}){WS}*[(\[]([^)\]]{{1,{GROUP_CAP}}})[)\]]{WS}*\z"
)
#: Separators between artist names once the text is folded and lower-cased.
NAME_SEPARATORS = ",|&|feat|vs| x "

_NON_ASCII = r"[^\x00-\x7F]"


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Compatibility decompositions that leave ASCII, derived from the Unicode data.

    Decomposition followed by dropping non-ASCII is context free, so a table per
    code point is exact. One-character results go to ``translate``; longer ones
    to a map.
    """
    src, dst, longer = [], [], {}
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        ascii_text = unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode()
        if len(ascii_text) == 1:
            src.append(ch)
            dst.append(ascii_text)
        elif ascii_text:
            longer[ch] = ascii_text
    return "".join(src), "".join(dst), longer


@lru_cache(maxsize=1)
def _longer_class() -> str:
    points = sorted(ord(c) for c in _fold_tables()[2])
    parts, start = [], points[0]
    for prev, cur in zip(points, points[1:] + [None]):
        if cur != prev + 1:
            parts.append(rf"\x{{{start:x}}}-\x{{{prev:x}}}")
            start = cur
    return f"[{''.join(parts)}]"


def strip(c: Column) -> Column:
    """Trim every kind of whitespace from both ends."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def _expanded(c: Column) -> Column:
    """Code points that decompose to several ASCII characters, written out."""
    pairs = F.str_to_map(
        F.lit("\x02".join(f"{k}\x03{v}" for k, v in _fold_tables()[2].items())),
        F.lit("\x02"),
        F.lit("\x03"),
    )
    spelled = F.transform(
        F.split(c, ""), lambda ch: F.coalesce(F.try_element_at(pairs, ch), ch)
    )
    return F.when(c.rlike(_longer_class()), F.array_join(spelled, "")).otherwise(c)


def fold(c: Column) -> Column:
    """Drop accents and keep only what decomposes to ASCII."""
    src, dst, _ = _fold_tables()
    folded = F.regexp_replace(F.translate(_expanded(c), src, dst), _NON_ASCII + "+", "")
    return F.when(c.rlike(_NON_ASCII), folded).otherwise(c)


@lru_cache(maxsize=4)
def _key_tables(keep: str, dash: str) -> tuple[str, str]:
    """One ``translate`` that folds, lower-cases, blanks whitespace and drops punctuation.

    Kept are ASCII letters, digits, ``_`` and *keep*; ``-`` becomes *dash*. Characters
    to drop come last and have no counterpart.
    """
    src, dst, _ = _fold_tables()
    ascii_text = "".join(map(chr, range(0x80)))
    kept, dropped = [], []
    for ch, to in zip(src + ascii_text, dst + ascii_text):
        to = " " if to in SPACE_CHARS else dash if to == "-" else to.lower()
        if not (to and (to.isalnum() or to in "_ " or to in keep)):
            dropped.append(ch)
        elif to != ch:
            kept.append((ch, to))
    return "".join(k for k, _ in kept) + "".join(dropped), "".join(v for _, v in kept)


def _key_form(c: Column, keep: str, dash: str) -> Column:
    table = _key_tables(keep, dash)
    foreign = F.regexp_replace(F.translate(_expanded(c), *table), _NON_ASCII + "+", "")
    return F.when(c.rlike(_NON_ASCII), foreign).otherwise(F.translate(c, *table))


def _squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "  +", " "))


def normalize(c: Column) -> Column:
    """Fold, lower-case, drop punctuation, collapse blanks; ``&`` reads as ``and``."""
    return _squeezed(F.replace(_key_form(c, "&", " "), F.lit("&"), F.lit(" and ")))


def drop_suffixes(c: Column) -> Column:
    """Remove mix names, trailing bracket groups and featuring clauses, in that order."""
    t = strip(c)
    # Only closed text can end in a group; open brackets would be tried one by one.
    t = F.when(_closed(t), F.regexp_replace(t, MIX_GROUP, "")).otherwise(t)
    for pattern in (BARE_MIX, DASH_MIX, ANY_GROUP, FEATURING):
        t = F.regexp_replace(t, pattern, "")
    return t


def once(c: Column, rule) -> Column:
    """*rule* applied to *c* evaluated once, however often the rule refers to it."""
    return F.element_at(F.transform(F.array(c), lambda v: rule(v)), 1)


def clean_title(c: Column) -> Column:
    """Title key: suffixes removed, then normalised."""
    return once(drop_suffixes(c), normalize)


def _closed(t: Column) -> Column:
    return F.endswith(t, F.lit(")")) | F.endswith(t, F.lit("]"))


def _mix_like(t: Column) -> Column:
    return F.lower(F.right(t, F.lit(1))).isin("x", "l", "t", "k")


def _featuring_like(t: Column) -> Column:
    return F.contains(F.lower(t), F.lit("feat")) | F.contains(F.lower(t), F.lit("ft."))


#: Suffix steps with a cheap test that is true whenever the pattern can match. Every
#: step leaves text that does not end in whitespace, so the last character decides.
_STEPS = (
    (MIX_GROUP, _closed),
    (BARE_MIX, _mix_like),
    (DASH_MIX, _mix_like),
    (ANY_GROUP, _closed),
    (FEATURING, _featuring_like),
)


def with_title_key(df: DataFrame, source: Column, out: str) -> DataFrame:
    """*df* plus the title key of *source* as column *out*.

    The same rule as :func:`clean_title`, one projection per step, so that each step's
    cheap test can spare the pattern without evaluating earlier steps again.
    """
    df = df.withColumn(out, strip(source))
    for pattern, possible in _STEPS:
        t = F.col(out)
        df = df.withColumn(out, F.when(possible(t), F.regexp_replace(t, pattern, "")).otherwise(t))
    return df.withColumn(out, normalize(F.col(out)))


def condensed(clean: Column) -> Column:
    """Title key without blanks."""
    return F.replace(clean, F.lit(" "), F.lit(""))


def norm_artist(c: Column) -> Column:
    """Artist key: like :func:`normalize`, but ``&`` and ``,`` survive and hyphens go."""
    return _squeezed(_key_form(c, "&,", ""))


def artist_names(artist_key: Column) -> Column:
    """Distinct names in a normalised artist key, first name first."""
    parts = F.transform(F.split(artist_key, NAME_SEPARATORS), lambda n: F.trim(n))
    return F.array_distinct(F.filter(parts, lambda n: n != ""))


def first_name(names: Column) -> Column:
    return F.coalesce(F.get(names, F.lit(0)), F.lit(""))


def declared_mix(c: Column) -> Column:
    """The mix a title states in its trailing bracket group, or ``''``."""
    return strip(F.regexp_extract(strip(c), TITLE_AND_GROUP, 2))


def names_overlap(a: Column, b: Column) -> Column:
    """True when two name arrays share a name or one name holds another."""
    return F.arrays_overlap(a, b) | F.exists(
        a, lambda x: F.exists(b, lambda y: F.contains(x, y) | F.contains(y, x))
    )


def album_compatible(r_album: Column, q_album: Column) -> Column:
    """Equal albums, or one inside the other; a blank catalog album always fits."""
    return F.contains(q_album, r_album) | F.contains(r_album, q_album)


def edit_threshold(clean: Column) -> Column:
    """Edits allowed for a title key: a fifth of its length, at least two."""
    return F.greatest(F.lit(2), F.floor(F.length(clean) / 5)).cast("int")
