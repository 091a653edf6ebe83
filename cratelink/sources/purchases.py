"""Purchase tables: CSV, landed page JSON, incremental append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cratelink.functions.times import duration_text
from cratelink.operators.position import newest_first
from cratelink.schemas import PAGE, PURCHASE_COLUMNS, TRACK, text_schema


def read_csv(spark: SparkSession, path: str, columns=PURCHASE_COLUMNS) -> DataFrame:
    """Header CSV as text columns, ``''`` for missing; embedded line breaks survive."""
    df = (
        spark.read.schema(text_schema(columns))
        .option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("enforceSchema", False)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("mode", "PERMISSIVE")
        .csv(path)
    )
    return df.na.fill("")


def _text(c: Column) -> Column:
    """Text, with the falsy forms of the source ('', null, 0, false) as ``''``."""
    t = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(t.isin("0", "0.0", "false"), F.lit("")).otherwise(t)


def _words(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _names(c: Column) -> Column:
    people = F.coalesce(c, F.array().cast("array<struct<id:string,name:string,slug:string,role:string,type:string>>"))
    return F.array_join(F.transform(people, lambda a: _words(a["name"])), ", ")


def flatten(tracks: DataFrame, track: str = "track", keep: tuple[str, ...] = ()) -> DataFrame:
    """Nested tracks to the 17 text columns, a narrow projection."""
    t = F.col(track)
    ms = F.coalesce(t["length_ms"].try_cast("double").cast("bigint"), F.lit(0))
    # Only an object-shaped price has a display text; a bare number has none.
    display = F.when(
        F.startswith(F.ltrim(t["price"]), F.lit("{")), F.get_json_object(t["price"], "$.display")
    )
    columns = {
        "Track ID": _text(t["id"]),
        "Title": _words(t["name"]),
        "Artists": _names(t["artists"]),
        "Remixers": _names(t["remixers"]),
        "Genre": _words(t["genre"]["name"]),
        "Sub Genre": _words(t["sub_genre"]["name"]),
        "Label": _words(t["label"]["name"]),
        "Catalog Number": _words(t["catalog_number"]),
        "Release Date": _words(t["publish_date"]),
        "Purchase Date": _words(t["purchase_date"]),
        "Price": _words(display),
        "BPM": _text(t["bpm"]),
        "Key": _words(t["key"]["name"]),
        "ISRC": _words(t["isrc"]),
        "Release ID": F.when(t["release"].isNotNull(), F.coalesce(t["release"]["id"], F.lit("0"))).otherwise(F.lit("")),
        "Release Title": _words(t["release"]["name"]),
        "Duration": F.when(ms != 0, duration_text(ms)).otherwise(_words(t["length"])),
    }
    return tracks.select(*keep, *[columns[c].alias(c) for c in PURCHASE_COLUMNS])


def parse_tracks(texts: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """JSON text per track to flat purchase rows."""
    return flatten(texts.withColumn("track", F.from_json(column, TRACK)), "track", keep)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed page envelopes, one JSON document per line."""
    lines = spark.read.text(path)
    return lines.select(F.from_json("value", PAGE).alias("p")).select("p.*")


def page_number(page: Column) -> Column:
    """``"3/17"`` or ``"3"`` to 3."""
    return F.coalesce(F.substring_index(page, "/", 1).try_cast("int"), F.lit(1))


def page_rows(pages: DataFrame) -> DataFrame:
    """Purchases of landed pages in page order: page, place and the 17 columns."""
    placed = pages.select(
        page_number(F.col("page")).alias("page_no"), F.posexplode("results").alias("place", "track")
    )
    return flatten(placed, "track", ("page_no", "place"))


def missing_pages(pages: DataFrame, per_page: int, start: int = 1, max_pages: int | None = None) -> DataFrame:
    """Page numbers still to land. The first page is always wanted.

    The expected range comes from the counts the pages state, one row after a global
    aggregate, and is compared by anti-join.
    """
    total = F.greatest(F.lit(1), F.ceil(F.max("count") / per_page)).cast("int")
    limit = total if not max_pages else F.least(total, F.lit(start - 1 + max_pages))
    expected = pages.agg(F.coalesce(limit, F.lit(1)).alias("last")).select(
        F.explode(F.sequence(F.lit(1), F.greatest("last", F.lit(1)))).alias("page_no")
    )
    wanted = expected.filter((F.col("page_no") == 1) | (F.col("page_no") >= start))
    landed = pages.select(page_number(F.col("page")).alias("page_no"))
    return wanted.join(landed, "page_no", "left_anti")


def resume_page(existing_rows: int, per_page: int) -> int:
    """The page a resumed download starts at; a partly filled last page is fetched again."""
    return max(1, existing_rows // per_page) + 1


def append(old: DataFrame, new: DataFrame, ordinal: str = "ordinal", distinct_ids: bool = False) -> DataFrame:
    """Old and new purchases, newest purchase date first, stable.

    Duplicates stay, as a re-fetched page brings them; *distinct_ids* keeps one per id.
    """
    both = old.withColumn("_part", F.lit(0)).unionByName(new.withColumn("_part", F.lit(1)))
    if distinct_ids:
        both = both.dropDuplicates(["Track ID"])
    return newest_first(both.withColumn("_o", F.struct("_part", ordinal)), "Purchase Date", "_o").drop("_o", "_part")
