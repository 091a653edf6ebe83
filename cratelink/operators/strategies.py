"""The linkage policy as data: an ordered list of strategies.

Four shapes cover the policy. A *lookup* is decided by equality alone, so each side
emits key texts and the catalog keeps its first row per key. A *grouped* strategy
adds "one text inside another" within an equality group. A *titled* one compares albums
and artists under an equal title. A *residual* strategy has no equality and is planned by
:mod:`cratelink.operators.residual`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from cratelink.functions import text

SEP = "\x1f"


def compact(k: Column) -> Column:
    """Key texts travel as their digest, whatever their length."""
    return F.md5(k)


def _key(*parts: Column) -> Column:
    return F.concat_ws(SEP, *parts)


def _one(key: Column, when: Column) -> Column:
    return F.when(when, F.array(compact(key)))


def _present(*names: str) -> Column:
    cond = F.lit(True)
    for n in names:
        cond = cond & (F.col(n) != "")
    return cond


def _openings(owner: str) -> Column:
    """Keys of *owner* with every opening of the title that ends before a blank."""
    words = F.split(F.col("clean"), " ")
    return F.when(
        (F.col(owner) != "") & (F.size(words) > 1),
        F.transform(
            F.sequence(F.lit(1), F.size(words) - 1),
            # Digested one by one, so a long title never holds all its openings as text.
            lambda n: compact(_key(F.col(owner), F.array_join(F.slice(words, F.lit(1), n), " "))),
        ),
    )


def _artist_keys() -> Column:
    """Title under the whole artist text, then under the first name."""
    return F.when(
        _present("artist", "clean"),
        F.transform(_first_names(), lambda a: compact(_key(a, F.col("clean")))),
    )


@dataclass(frozen=True)
class Strategy:
    """One rung. ``catalog`` and ``query`` give arrays of key texts (null = none).

    ``query`` keys are listed in order of preference when ``ranked``; ``values`` name
    the columns compared for containment by a grouped strategy. ``title`` is the SQL
    condition on the titles of a pair aliased (q, r) of a residual strategy. A *titled*
    strategy asks for an equal title, a fitting album and overlapping artists.
    ``any_title`` says that every row of an equal title is accepted.
    """

    name: str
    level: int
    kind: str
    catalog: Callable[[], Column] | None = None
    query: Callable[[], Column] | None = None
    ranked: bool = False
    values: Callable[[], Column] | None = None
    title: str | None = None
    any_title: bool = False


# --- predicates over a pair aliased (q, r) ----------------------------------

OVERLAP = (
    "(arrays_overlap(q.names, r.names) or exists(q.names, x -> "
    "exists(r.names, y -> contains(x, y) or contains(y, x))))"
)
ALBUM_FITS = "(contains(q.album, r.album) or contains(r.album, q.album))"
_LIMIT = "cast(greatest(2, floor(length(q.clean) / 5)) as int)"
TITLE_PREFIX = "(startswith(q.clean, r.clean) or startswith(r.clean, q.clean))"
TITLE_NEAR = (
    f"(r.clean <> '' and abs(length(q.clean) - length(r.clean)) <= {_LIMIT} "
    f"and levenshtein(q.clean, r.clean, {_LIMIT}) >= 0)"
)
TITLE_INSIDE = "(r.clean <> '' and (contains(q.clean, r.clean) or contains(r.clean, q.clean)))"


def _first_names() -> Column:
    return F.array_distinct(F.filter(F.array("artist", "first_name"), lambda a: a != ""))


_SPACED = lambda: F.col("condensed") != F.col("clean")

STRATEGIES: tuple[Strategy, ...] = (
    Strategy(
        "s01", 10, "lookup",
        lambda: _one(F.col("isrc"), _present("isrc")),
        lambda: _one(F.col("isrc"), _present("isrc")),
    ),
    Strategy(
        "s02", 20, "grouped",
        lambda: _one(_key(F.col("album"), F.col("clean")), _present("album", "clean")),
        lambda: _one(_key(F.col("album"), F.col("clean")), _present("album", "artist", "clean")),
        values=lambda: F.col("names"),
    ),
    Strategy(
        "s03", 30, "lookup",
        lambda: _one(_key(F.col("album"), F.col("clean")), _present("album", "clean")),
        lambda: _one(_key(F.col("album"), F.col("clean")), _present("album", "clean")),
    ),
    Strategy(
        "s04", 40, "lookup",
        lambda: _one(_key(F.col("artist"), F.col("clean")), _present("artist", "clean")),
        _artist_keys,
        ranked=True,
    ),
    Strategy(
        "s05", 50, "lookup",
        lambda: _one(F.col("clean"), _present("clean")),
        lambda: _one(F.col("clean"), _present("clean")),
        any_title=True,
    ),
    Strategy(
        "s06", 60, "lookup",
        lambda: _openings("album"),
        lambda: _one(_key(F.col("album"), F.col("clean")), _present("album", "clean")),
    ),
    Strategy(
        "s07", 70, "lookup",
        lambda: _openings("artist"),
        _artist_keys,
    ),
    Strategy(
        "s08", 80, "grouped",
        lambda: _one(_key(F.col("album"), F.col("condensed")), _present("condensed")),
        lambda: _one(
            _key(F.col("album"), F.col("condensed")), _present("condensed", "artist") & _SPACED()
        ),
        values=lambda: F.col("names"),
    ),
    Strategy(
        "s08", 81, "lookup",
        lambda: _one(_key(F.col("album"), F.col("condensed")), _present("album", "condensed")),
        lambda: _one(
            _key(F.col("album"), F.col("condensed")), _present("condensed", "album") & _SPACED()
        ),
    ),
    # Needs an equal title, which s05 accepts from any artist: it decides where s05 comes
    # later, or where the first row of the title has no path.
    Strategy("s09", 90, "titled"),
    Strategy(
        "s10", 100, "grouped",
        lambda: _one(F.col("condensed"), _present("condensed")),
        lambda: _one(F.col("condensed"), _present("condensed", "album") & _SPACED()),
        values=lambda: F.array("album"),
    ),
    Strategy("s11", 110, "residual", title=TITLE_PREFIX),
    Strategy("s12", 120, "residual", title=TITLE_NEAR),
    Strategy("s13", 130, "residual", title=TITLE_INSIDE),
)


def names_by_level(strategies: tuple[Strategy, ...] = STRATEGIES) -> dict[int, str]:
    return {s.level: s.name for s in strategies}
