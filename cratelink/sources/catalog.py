"""Catalog tables: file inventory, row build, first-wins upsert, stats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cratelink.functions.paths import LIBRARY_EXTENSIONS, has_extension
from cratelink.functions.times import seconds_text
from cratelink.operators.keys import CATALOG_FIELDS, catalog_keys
from cratelink.operators.position import first_per_key
from cratelink.schemas import CATALOG_COLUMNS


def inventory(spark: SparkSession, root: str, extensions: str | None = None) -> DataFrame:
    """Files below *root* with a wanted extension: (path, size). Contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", r"\Afile:/+", "/")
    listed = files.select(path.alias("path"), F.col("length").alias("size"))
    return listed.filter(has_extension(F.col("path"), extensions, LIBRARY_EXTENSIONS))


def catalog_rows(files: DataFrame, tags: DataFrame) -> DataFrame:
    """Files joined to a landed tag table, as the 11 catalog columns plus ``seq``.

    *files*: path, size, seq. *tags*: path and the tag columns used below.
    """
    rows = files.join(tags, "path", "left")

    def tag(name: str):
        return F.coalesce(F.col(name), F.lit("")) if name in tags.columns else F.lit("")

    columns = {
        "File Path": F.col("path"),
        "Artist": tag("artist"),
        "Album Artist": tag("album_artist"),
        "Title": tag("title"),
        "Album": tag("album"),
        "ISRC": tag("isrc"),
        "Track Number": tag("tracknumber"),
        "Genre": tag("genre"),
        "Date": tag("date"),
        "Duration": seconds_text(F.coalesce("seconds", F.lit(0.0))),
        "File Size": F.col("size").cast("string"),
    }
    return rows.select("seq", *[columns[c].alias(c) for c in CATALOG_COLUMNS])


def upsert(existing: DataFrame | None, new: DataFrame, key: str = "File Path", order: str = "seq") -> DataFrame:
    """Rows to append so that the first row per key stays: new, not yet known, first of its kind."""
    fresh = new if existing is None else new.join(existing.select(key), key, "left_anti")
    return first_per_key(fresh, [key], order).select(*new.columns)


def with_keys(catalog: DataFrame, fields: dict[str, str] = CATALOG_FIELDS) -> DataFrame:
    """The persisted key table of a catalog."""
    return catalog_keys(catalog, fields)


def stats(catalog: DataFrame, isrc: str = "ISRC") -> DataFrame:
    return catalog.agg(
        F.count("*").alias("tracks"),
        F.count_if(F.coalesce(F.col(isrc), F.lit("")) != "").alias("with_isrc"),
    )
