"""Key tables: a purchase or catalog row reduced to what the strategies compare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cratelink.functions import text
from cratelink.session import shuffled

QUERY_FIELDS = {"isrc": "ISRC", "artist": "Artists", "title": "Title", "album": "Release Title"}
CATALOG_FIELDS = {"isrc": "ISRC", "artist": "Artist", "title": "Title", "album": "Album", "path": "File Path"}

#: Key columns a query group is identified by.
KEY_COLUMNS = ("isrc", "artist", "album", "clean")


def _field(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`"), F.lit(""))


def _key_steps(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    return text.with_title_key(df, _field(fields["title"]), "_clean").select(
        *df.columns,
        text.strip(_field(fields["isrc"])).alias("_isrc"),
        text.norm_artist(_field(fields["artist"])).alias("_artist"),
        text.normalize(_field(fields["album"])).alias("_album"),
        "_clean",
    )


def _named(df: DataFrame) -> DataFrame:
    names = text.artist_names(F.col("artist"))
    return df.withColumns({"condensed": text.condensed(F.col("clean")), "names": names}).withColumn(
        "first_name", text.first_name(F.col("names"))
    )


def query_id(isrc: Column, artist: Column, album: Column, clean: Column) -> Column:
    """Stable id of a key tuple (128 bits, so copies group and distinct tuples stay apart)."""
    return F.md5(F.concat_ws("\x1f", isrc, artist, album, clean))


def raw_keys(purchases: DataFrame, fields: dict[str, str] = QUERY_FIELDS) -> DataFrame:
    """Distinct raw (isrc, artist, album, title) with their keys and ``qid``.

    Copies of a purchase collapse before any rule runs, with map-side combine, and the
    rules then run on the shuffled side, on all cores whatever the input's splits are.
    """
    parts = ("isrc", "artist", "album", "title")
    raw = purchases.select(*[_field(fields[p]).alias(f"raw_{p}") for p in parts]).distinct()
    keyed = _key_steps(raw, {p: f"raw_{p}" for p in parts})
    keyed = keyed.select(
        *[f"raw_{p}" for p in parts], *[F.col(f"_{k}").alias(k) for k in KEY_COLUMNS]
    )
    return keyed.withColumn("qid", query_id(*[F.col(k) for k in KEY_COLUMNS]))


def keys_of(raw: DataFrame) -> DataFrame:
    """One row per distinct key tuple of a :func:`raw_keys` table."""
    return _named(raw.select(*KEY_COLUMNS, "qid").distinct())


def query_keys(purchases: DataFrame, fields: dict[str, str] = QUERY_FIELDS) -> DataFrame:
    """One row per distinct key tuple of the purchases."""
    return keys_of(raw_keys(purchases, fields))


def join_links(purchases: DataFrame, raw: DataFrame, links: DataFrame, fields: dict[str, str] = QUERY_FIELDS) -> DataFrame:
    """Every purchase with the columns its key tuple was linked to (null when none)."""
    parts = ("isrc", "artist", "album", "title")
    found = raw.join(shuffled(links), "qid").drop("qid", *KEY_COLUMNS)
    condition = [_field(fields[p]) == F.col(f"raw_{p}") for p in parts]
    return purchases.join(shuffled(found), condition, "left").drop(*[f"raw_{p}" for p in parts])


def catalog_keys(catalog: DataFrame, fields: dict[str, str] = CATALOG_FIELDS) -> DataFrame:
    """Catalog rows as keys. ``seq`` is data: it says which row came first.

    Rows are spread first: a catalog is small in bytes, so few splits hold it, and the rules
    would run on as few cores.
    """
    keyed = _key_steps(catalog.repartition("seq"), fields).select(
        "seq",
        _field(fields["path"]).alias("path"),
        *[F.col(f"_{k}").alias(k) for k in KEY_COLUMNS],
    )
    return _named(keyed)
