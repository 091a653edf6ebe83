"""Period playlists from linked purchases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cratelink.functions.paths import extension, file_uri
from cratelink.functions.times import purchase_parts
from cratelink.operators.position import first_per_key, numbered
from cratelink.session import shuffled

MONTH, YEAR = "month", "year"
HEADER = "#EXTM3U"


def entries(linked: DataFrame, path: str, date: str, ordinal: str) -> DataFrame:
    """Linked rows once per period they fall in: (kind, period, ...). Undated rows drop out."""
    parts = linked.filter(F.coalesce(F.col(f"`{path}`"), F.lit("")) != "").withColumn(
        "_p", purchase_parts(F.coalesce(F.col(f"`{date}`"), F.lit("")))
    )
    periods = F.array(
        F.struct(F.lit(MONTH).alias("kind"), F.col("_p.month").alias("period")),
        F.struct(F.lit(YEAR).alias("kind"), F.col("_p.year").alias("period")),
    )
    return (
        parts.filter("_p is not null")
        .withColumn("_e", F.explode(periods))
        .select(*linked.columns, "_e.kind", "_e.period")
    )


def rollup(entry_rows: DataFrame) -> DataFrame:
    """Rows per period. The count combines before the shuffle."""
    return entry_rows.groupBy("kind", "period").agg(F.count("*").alias("n"))


def file_name(kind: str = "kind", period: str = "period"):
    """``2025-03.m3u`` for a month, ``2025-0.m3u`` for a year."""
    return F.when(F.col(kind) == YEAR, F.concat(F.col(period), F.lit("-0.m3u"))).otherwise(
        F.concat(F.col(period), F.lit(".m3u"))
    )


def m3u_lines(entry_rows: DataFrame, path: str, title: str, artists: str, ordinal: str) -> DataFrame:
    """(playlist, position, line): a header, then two text lines per track.

    The position is the row's own ordinal; the header comes first at -1.
    """
    line = F.concat(
        F.lit("#EXTINF:-1,"),
        F.coalesce(F.col(f"`{artists}`"), F.lit("")),
        F.lit(" - "),
        F.coalesce(F.col(f"`{title}`"), F.lit("")),
        F.lit("\n"),
        F.col(f"`{path}`"),
    )
    rows = entry_rows.select(
        file_name().alias("playlist"), F.col(ordinal).cast("bigint").alias("position"), line.alias("line")
    )
    heads = rows.select("playlist").distinct().select(
        "playlist", F.lit(-1).cast("bigint").alias("position"), F.lit(HEADER).alias("line")
    )
    return heads.unionByName(rows)


def unique_entries(entry_rows: DataFrame, path: str, ordinal: str) -> DataFrame:
    """Each path once per period, at its first place."""
    return first_per_key(entry_rows, ["kind", "period", path], ordinal)


def collection(linked: DataFrame, path: str, title: str, artists: str, album: str, ordinal: str) -> DataFrame:
    """All linked rows as numbered collection tracks, dated or not."""
    rows = numbered(
        linked.filter(F.coalesce(F.col(f"`{path}`"), F.lit("")) != ""), ordinal, column="track_id_no"
    )
    kind = F.regexp_replace(extension_as_written(path), r"\A\.+", "")
    return rows.select(
        F.col("track_id_no").alias("TrackID"),
        F.coalesce(F.col(f"`{title}`"), F.lit("")).alias("Name"),
        F.coalesce(F.col(f"`{artists}`"), F.lit("")).alias("Artist"),
        F.coalesce(F.col(f"`{album}`"), F.lit("")).alias("Album"),
        file_uri(F.col(f"`{path}`")).alias("Location"),
        F.lit("0").alias("TotalTime"),
        kind.alias("Kind"),
        F.col(f"`{path}`").alias("path"),
    )


def extension_as_written(path: str):
    base = F.substring_index(F.col(f"`{path}`"), "/", -1)
    return F.regexp_extract(base, r"(?s)\A\.*[^.].*(\.[^.]*)\z", 1)


def references(unique_rows: DataFrame, tracks: DataFrame, path: str, ordinal: str) -> DataFrame:
    """(kind, period, ordinal, key): playlist rows as collection numbers.

    A path listed twice in the collection is known by its last number.
    """
    last = tracks.groupBy("path").agg(F.max("TrackID").alias("key"))
    return unique_rows.join(shuffled(last), unique_rows[path] == last["path"]).select(
        "kind", "period", F.col(ordinal).alias("ordinal"), "key"
    )


__all__ = [
    "collection",
    "entries",
    "extension",
    "file_name",
    "m3u_lines",
    "references",
    "rollup",
    "unique_entries",
]
