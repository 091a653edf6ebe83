"""Ranked sources: gates of the fallback sources, and the first one that resolves."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cratelink.functions.search import compare_key, split_artists
from cratelink.functions.text import strip
from cratelink.functions.times import parse_duration
from cratelink.session import shuffled, stage

#: Fixed values.
MIN_SCORE = 80
FALLBACK_TOLERANCE = 10_000
STATUSES = ("matched", "skipped", "error", "ambiguous", "no-candidates", "stuck", "verify-failed")
ELECTRONIC = "electronic"

CANDIDATE_FIELDS = {
    "id": "bigint",
    "name": "string",
    "mix_name": "string",
    "artists": "string",
    "genre": "string",
    "sub_genre": "string",
    "label": "string",
    "release_name": "string",
    "release_id": "bigint",
    "publish_date": "string",
    "bpm": "int",
    "key_name": "string",
    "isrc": "string",
    "catalog_number": "string",
    "artwork_url": "string",
    "length_ms": "bigint",
}


def conform(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """*df* with exactly the candidate columns (blank or zero where absent) plus *keep*."""

    def column(name: str, kind: str) -> Column:
        empty = F.lit("") if kind == "string" else F.lit(0)
        present = F.coalesce(F.col(name), empty) if name in df.columns else empty
        return present.cast(kind).alias(name)

    return df.select(*keep, *[column(n, k) for n, k in CANDIDATE_FIELDS.items()])


def _first_gated(rows: DataFrame, key: str) -> DataFrame:
    """Per file the passing row of lowest rank."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), "rank").alias("_m")).select(key, "_m.*")


def credit_fits(artist: Column, credit: Column) -> Column:
    """Artist inside the credit, credit inside the artist, or the first listed artist inside."""
    low = F.lower(artist)
    first = F.lower(strip(F.substring_index(artist, ",", 1)))
    return (
        (artist != "")
        & (credit != "")
        & (F.contains(credit, low) | F.contains(low, credit) | ((first != "") & F.contains(credit, first)))
    )


def recordings_match(files: DataFrame, recordings: DataFrame, key: str, tolerance: int = FALLBACK_TOLERANCE) -> DataFrame:
    """First recording per file past score, length and artist gates, as candidate rows.

    *recordings* hold the parsed columns of :func:`cratelink.sources.remote.recordings`
    under *key*, with their rank in the answer.
    """
    f = files.select(key, "artist", "title", "duration_ms")
    r = recordings.join(f, key)
    length_ok = (
        (F.coalesce("duration_ms", F.lit(0)) == 0)
        | (F.col("rec_length") == 0)
        | (F.abs(F.col("rec_length") - F.col("duration_ms")) <= tolerance)
    )
    gate = (
        (F.col("artist") != "")
        & (F.col("title") != "")
        & (F.col("score") >= MIN_SCORE)
        & length_ok
        & credit_fits(F.col("artist"), F.col("credit"))
    )
    first = _first_gated(r.filter(gate), key)
    # Only the first passing recording counts; it must then carry something to merge.
    useful = first.filter("rec_release <> '' or rec_date <> '' or rec_label <> ''")
    named = useful.select(
        key,
        F.when(F.col("rec_title") != "", F.col("rec_title")).otherwise(F.col("title")).alias("name"),
        F.when(F.col("credit") != "", F.col("credit")).otherwise(F.col("artist")).alias("artists"),
        F.col("rec_release").alias("release_name"),
        F.col("rec_date").alias("publish_date"),
        F.col("rec_label").alias("label"),
    )
    return conform(named, [key])


def release_artist_agrees(result_title: Column, artist: Column) -> Column:
    """Is one of the file's artists among those listed before the dash?"""
    listed = compare_key(F.substring_index(result_title, " - ", 1))
    ours = F.filter(F.transform(split_artists(artist), compare_key), lambda n: n != "")
    return F.exists(ours, lambda n: F.contains(listed, n) | F.contains(n, listed))


def release_title_agrees(result_title: Column, title: Column, tracklist: Column) -> Column:
    """Title equals the result's or a listed track's; containment is not enough."""
    wanted = compare_key(title)
    at = F.instr(result_title, " - ")
    own = F.when(at > 0, F.substr(result_title, at + 3)).otherwise(result_title)
    listed = F.exists(
        tracklist, lambda t: (F.coalesce(t["title"], F.lit("")) != "") & (compare_key(t["title"]) == wanted)
    )
    return (wanted != "") & ((compare_key(own) == wanted) | F.coalesce(listed, F.lit(False)))


def release_length_fits(tracklist: Column, file_ms: Column, tolerance: int = FALLBACK_TOLERANCE) -> Column:
    """Some listed track is as long as the file; unknown lengths never fit."""
    near = F.exists(
        tracklist,
        lambda t: F.coalesce(F.abs(parse_duration(t["duration"]) - file_ms) <= tolerance, F.lit(False)),
    )
    return (F.coalesce(file_ms, F.lit(0)) > 0) & F.coalesce(near, F.lit(False))


def release_genre(genres: Column, styles: Column) -> Column:
    """First style, else first genre, and only for an electronic release."""
    def present(a: Column) -> Column:
        trimmed = F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda g: strip(F.coalesce(g, F.lit(""))))
        return F.filter(trimmed, lambda g: g != "")

    g, s = present(genres), present(styles)
    electronic = F.array_contains(F.transform(g, lambda x: F.lower(x)), ELECTRONIC)
    return F.when(electronic, F.coalesce(F.get(s, F.lit(0)), F.get(g, F.lit(0)))).otherwise(F.lit(""))


def releases_match(files: DataFrame, results: DataFrame, releases: DataFrame, key: str, tolerance: int = FALLBACK_TOLERANCE) -> DataFrame:
    """First release per file past artist, title and length gates, as candidate rows.

    *results* are search results under *key* with their rank; *releases* the landed
    details by ``release_key``. *files* carry ``base``, the title without its mix.
    """
    f = files.select(key, "artist", "base", "duration_ms")
    asked = results.filter("result_type is null or result_type = 'release'").join(f, key)
    asked = asked.filter(
        F.coalesce(F.col("result_id") != 0, F.lit(False))
        & release_artist_agrees(F.col("result_title"), F.col("artist"))
    )
    met = asked.join(releases, F.col("result_id") == F.col("release_key"))
    passing = met.filter(
        release_title_agrees(F.col("result_title"), F.col("base"), F.col("tracklist"))
        & release_length_fits(F.col("tracklist"), F.col("duration_ms"), tolerance)
    )
    first = _first_gated(passing, key)
    shaped = first.select(
        key,
        F.when(F.col("rel_title") != "", F.col("rel_title")).otherwise(F.col("base")).alias("name"),
        F.when(F.col("rel_artists") != "", F.col("rel_artists")).otherwise(F.col("artist")).alias("artists"),
        F.col("rel_title").alias("release_name"),
        F.col("rel_date").alias("publish_date"),
        F.col("rel_label").alias("label"),
        release_genre(F.col("genres"), F.col("styles")).alias("genre"),
        F.col("rel_artwork").alias("artwork_url"),
    ).filter("release_name <> '' or publish_date <> '' or genre <> ''")
    return conform(shaped, [key])


def status_or(reason: Column, default: str = "no-candidates") -> Column:
    """A known status as it is; anything else becomes *default*."""
    return F.when(reason.isin(*STATUSES), reason).otherwise(F.lit(default))


#: Conformed candidates by key, or how to find them for the files that are still open.
Source = DataFrame | Callable[[DataFrame], DataFrame] | None


def waterfall(files: DataFrame, sources: Sequence[tuple[str, Source]], key: str) -> DataFrame:
    """First source that resolves each file: (key, source, pick).

    *sources* is an ordered list of (name, source), one row per file at most; a disabled
    source is ``None``. A source is only asked for files that none before it resolved.
    """
    still_open = files
    found = None
    for name, source in sources:
        if source is None:
            continue
        rows = source(still_open) if callable(source) else source.join(shuffled(still_open.select(key)), key, "left_semi")
        part = rows.select(key, F.lit(name).alias("source"), F.struct(*CANDIDATE_FIELDS).alias("pick"))
        part = stage(part, f"source-{name}")
        still_open = stage(still_open.join(shuffled(part), key, "left_anti"), "still-open")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return files.select(key, F.lit("").alias("source")).withColumn("pick", F.lit(None))
    return files.select(key).join(shuffled(found), key, "left").select(key, F.coalesce("source", F.lit("")).alias("source"), "pick")
