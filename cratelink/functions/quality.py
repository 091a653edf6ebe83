"""Which values are missing or junk."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cratelink.functions.search import TRAILING_BPM, WEB_ADDRESS
from cratelink.functions.text import WS, strip

# --- fixed values -----------------------------------------------------------

#: Promotion sites named in the reason, first listed wins.
PROMO_SITES = (
    "myfreemp3.vip",
    "electronicfresh.com",
    "djsoundtop.com",
    "myfreemp3",
    "electronicfresh",
    "djsoundtop",
)
#: Attributes whose absence makes a row sparse, in report order.
KEY_FIELDS = ("genre", "date", "album")
#: Attributes checked for junk, in report order.
JUNK_FIELDS = ("title", "album", "genre", "artist")
#: Attributes a merge may set.
MERGE_FIELDS = ("artist", "title", "album", "genre", "date", "bpm", "key", "label", "isrc")

DOUBLED_MIX = (
    rf"(?iu)\(extended mix\){WS}*\(extended mix\)|\(original mix\){WS}*\(original mix\)"
)


def junk_reason(value: Column) -> Column:
    """Why a value is junk, or ``''`` when it is not."""
    v = strip(value)
    low = F.lower(v)
    site = F.coalesce(
        *[F.when(F.contains(low, F.lit(s)), F.lit(f"promo-domain:{s}")) for s in PROMO_SITES],
        F.lit("url"),
    )
    return (
        F.when(value == "", F.lit(""))
        .when(v.rlike(WEB_ADDRESS), site)
        .when(v.rlike(TRAILING_BPM), F.lit("trailing-bpm"))
        .when(v.rlike(DOUBLED_MIX), F.lit("doubled-mix"))
        .otherwise(F.lit(""))
    )


def is_junk(value: Column) -> Column:
    return junk_reason(value) != ""


def findings(row: dict[str, Column], readable: Column | None = None) -> Column:
    """Array of findings: missing key fields, then ``field:junk``; empty when sound."""
    marks = [F.when(row[f] == "", F.lit(f)) for f in KEY_FIELDS]
    marks += [F.when(is_junk(row[f]), F.lit(f"{f}:junk")) for f in JUNK_FIELDS]
    found = F.filter(F.array(*marks), lambda m: m.isNotNull())
    if readable is None:
        return found
    return F.when(readable, found).otherwise(F.array(F.lit("unreadable")))
