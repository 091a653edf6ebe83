"""Resolve and merge: manifest rows to picks, plans and result rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cratelink.functions.paths import drive_to_mount, guard_drives, has_extension, TAGGED_EXTENSIONS
from cratelink.functions.quality import findings
from cratelink.functions.search import id_from_name, resolve_identity
from cratelink.operators.gates import by_id, pick_best
from cratelink.operators.merge import merged, offered
from cratelink.operators.search import first_usable
from cratelink.operators.waterfall import CANDIDATE_FIELDS, status_or, waterfall
from cratelink.session import shuffled, stage

PRIMARY = "catalog"
_TAGS = ("title", "album", "genre", "artist", "date")


def sparse(tags: DataFrame, extensions: str | None = None) -> DataFrame:
    """Rows with any finding, as manifest entries with their ``missing`` array."""
    row = {f: F.coalesce(F.col(f), F.lit("")) for f in _TAGS}
    readable = F.coalesce(F.col("readable"), F.lit(True)) if "readable" in tags.columns else None
    rows = tags.filter(has_extension(F.col("path"), extensions)).withColumn("missing", findings(row, readable))
    return rows.filter(F.size("missing") > 0)


def sparse_counts(tags: DataFrame, extensions: str | None = None) -> DataFrame:
    """Sparse and total rows in one pass."""
    row = {f: F.coalesce(F.col(f), F.lit("")) for f in _TAGS}
    readable = F.coalesce(F.col("readable"), F.lit(True)) if "readable" in tags.columns else None
    rows = tags.filter(has_extension(F.col("path"), extensions))
    return rows.agg(
        F.count_if(F.size(findings(row, readable)) > 0).alias("sparse"), F.count("*").alias("total")
    )


def needing_work(
    manifest: DataFrame, tags: DataFrame, allow_drives: str | None = None, force: bool = False
) -> DataFrame:
    """Manifest paths that exist, may be written, are taggable and have a finding (or *force*).

    A manifest may name a file in drive, mount or ``file://`` form; either form meets the tags.
    """
    rows = tags.filter(has_extension(F.col("path"), None, TAGGED_EXTENSIONS))
    if not force:
        rows = sparse(rows)
    wanted = guard_drives(manifest, allow_drives).select(drive_to_mount(F.col("path")).alias("_mount")).distinct()
    return rows.withColumn("_mount", drive_to_mount(F.col("path"))).join(wanted, "_mount", "left_semi").drop("_mount")


def identified(files: DataFrame) -> DataFrame:
    """Files with the identity to search by (null when none) and the id their name carries."""
    who = resolve_identity(F.col("path"), F.coalesce("artist", F.lit("")), F.coalesce("title", F.lit("")))
    return (
        files.withColumn("_who", who)
        .withColumn("file_id", id_from_name(F.col("path"))["id"])
        .withColumn("own_artist", F.coalesce("artist", F.lit("")))
        .withColumn("own_title", F.coalesce("title", F.lit("")))
        .withColumn("artist", F.col("_who.artist"))
        .withColumn("title", F.col("_who.title"))
        .drop("_who")
    )


def resolve(
    files: DataFrame,
    candidates: DataFrame,
    fallbacks: Sequence[tuple[str, DataFrame | None]] = (),
) -> DataFrame:
    """One result per file: (path, artist, title, status, source, pick).

    An id in the file name beats the search when lengths agree; otherwise the first
    usable query variant's oldest fitting candidate; otherwise the first fallback
    source with a match. *files*: path, artist, title, duration_ms.
    """
    known = stage(identified(files), "identified")
    searchable = known.filter("artist is not null")
    direct = by_id(searchable.select("path", "file_id", "duration_ms"), candidates)
    direct = direct.select("path", *CANDIDATE_FIELDS)
    asked = searchable.join(shuffled(direct.select("path")), "path", "left_anti").select("path", "artist", "title", "duration_ms")
    found = first_usable(asked, candidates, "path").select("path", "duration_ms", *CANDIDATE_FIELDS)
    best = stage(pick_best(asked, found, "path"), "best")
    searched = best.filter("pick is not null").select("path", "pick.*")
    decided = waterfall(searchable, [(PRIMARY, direct.unionByName(searched)), *fallbacks], "path")
    rows = known.select("path", "artist", "title", "own_artist", "own_title").join(
        shuffled(decided), "path", "left"
    ).join(shuffled(best.select("path", "reason")), "path", "left")
    status = (
        F.when(F.col("artist").isNull(), F.lit("skipped"))
        .when(F.col("pick").isNotNull(), F.lit("matched"))
        .otherwise(status_or(F.coalesce("reason", F.lit(""))))
    )
    return rows.select(
        "path",
        F.coalesce("artist", "own_artist").alias("artist"),
        F.coalesce("title", "own_title").alias("title"),
        status.alias("status"),
        F.coalesce("source", F.lit("")).alias("source"),
        "pick",
    )


def merge_resolved(tags: DataFrame, resolved: DataFrame, overwrite: bool = False, fields=None) -> DataFrame:
    """Tags with resolved values merged in additively and their source noted."""
    hits = resolved.filter("status = 'matched'")
    new = offered(hits, "path").join(hits.select("path", F.col("source").alias("_source")), "path")
    return merged(tags, new, "path", overwrite, fields, F.coalesce("_source", F.lit("")))
