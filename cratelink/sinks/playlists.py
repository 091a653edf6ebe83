"""Playlist files and the collection XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tracks per text file of a playlist; a longer one goes into numbered parts.
PART_ROWS = 1_000_000


def write_m3u(lines: DataFrame, root: str, mode: str = "errorifexists") -> None:
    """One folder per playlist, its lines in order.

    Rows are ranged by (playlist, position), so a playlist holding most of the rows is
    cut over many tasks; its part files, in name order, are the playlist in order.
    """
    ordered = lines.repartitionByRange("playlist", "position").sortWithinPartitions("playlist", "position")
    ordered.select("playlist", "line").write.mode(mode).option(
        "maxRecordsPerFile", PART_ROWS
    ).partitionBy("playlist").text(root)


def name_single_parts(spark: SparkSession, root: str) -> list[str]:
    """Give each one-part playlist under *root* its plain file name.

    Walks file names only. A playlist of several parts keeps its folder.
    """
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    named = []
    for folder in fs.listStatus(base):
        folder_name = folder.getPath().getName()
        if not folder_name.startswith("playlist="):
            continue
        parts = [p.getPath() for p in fs.listStatus(folder.getPath()) if p.getPath().getName().startswith("part-")]
        if len(parts) == 1:
            target = folder_name.removeprefix("playlist=")
            if fs.rename(parts[0], jvm.org.apache.hadoop.fs.Path(base, target)):
                fs.delete(folder.getPath(), True)
                named.append(target)
    return sorted(named)


def track_xml(columns=("TrackID", "Name", "Artist", "Album", "Location", "TotalTime", "Kind")) -> Column:
    """A collection track as one element with attributes."""
    attributes = F.struct(*[F.col(c).cast("string").alias(f"_{c}") for c in columns])
    return F.rtrim(F.to_xml(attributes, {"rowTag": "TRACK", "indent": ""}), F.lit("\n"))


def write_collection(tracks: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The collection as XML files with one TRACK element per row."""
    columns = ("TrackID", "Name", "Artist", "Album", "Location", "TotalTime", "Kind")
    tracks.select(*[F.col(c).cast("string").alias(f"_{c}") for c in columns]).write.format("xml").mode(mode).option(
        "rootTag", "COLLECTION"
    ).option("rowTag", "TRACK").save(path)


def tree_lines(refs: DataFrame) -> DataFrame:
    """The playlist tree as ordered XML lines: (year, kind_order, period, ordinal, line).

    Nodes are rows, not one document in memory: opening and closing lines are rows of
    their own, so sorting the table by its leading columns yields the file.
    """
    year = F.substr("period", F.lit(1), F.lit(4))
    rows = refs.withColumn("year", year).withColumn("rank", F.when(F.col("kind") == "year", 0).otherwise(1))
    track = rows.select(
        "year", "rank", "period", F.lit(1).alias("step"), F.col("ordinal").cast("bigint").alias("ordinal"),
        F.concat(F.lit('<TRACK Key="'), F.col("key").cast("string"), F.lit('"/>')).alias("line"),
    )
    counts = rows.groupBy("year", "rank", "period").agg(F.count("*").alias("n"))
    name = F.when(F.col("rank") == 0, F.concat("period", F.lit(" (Full Year)"))).otherwise(F.col("period"))
    opening = counts.select(
        "year", "rank", "period", F.lit(0).alias("step"), F.lit(0).cast("bigint").alias("ordinal"),
        F.concat(
            F.lit('<NODE Type="1" Name="'), name, F.lit('" KeyType="0" Entries="'), F.col("n").cast("string"), F.lit('">')
        ).alias("line"),
    )
    closing = counts.select(
        "year", "rank", "period", F.lit(2).alias("step"), F.lit(0).cast("bigint").alias("ordinal"), F.lit("</NODE>").alias("line")
    )
    years = counts.filter("rank = 0")
    folder = years.select(
        "year", F.lit(-1).alias("rank"), F.lit("").alias("period"), F.lit(0).alias("step"), F.lit(0).cast("bigint").alias("ordinal"),
        F.concat(F.lit('<NODE Type="0" Name="'), F.col("year"), F.lit('">')).alias("line"),
    )
    folder_end = years.select(
        "year", F.lit(2).alias("rank"), F.lit("").alias("period"), F.lit(0).alias("step"), F.lit(0).cast("bigint").alias("ordinal"),
        F.lit("</NODE>").alias("line"),
    )
    return track.unionByName(opening).unionByName(closing).unionByName(folder).unionByName(folder_end)


#: Name the document gives for its maker.
PRODUCT = "cratelink"


def document_lines(tracks: DataFrame, refs: DataFrame) -> DataFrame:
    """The whole library document as rows to be sorted by (section, year, rank, period, step, ordinal).

    Every element is a row, so no task ever holds the document.
    """
    spark = tracks.sparkSession
    place = ["section", "year", "rank", "period", "step", "ordinal"]

    def fixed(rows: list[tuple[int, str]]) -> DataFrame:
        df = spark.createDataFrame(rows, "section int, line string")
        return df.select(
            "section", F.lit("").alias("year"), F.lit(0).alias("rank"), F.lit("").alias("period"),
            F.lit(0).alias("step"), F.lit(0).cast("bigint").alias("ordinal"), "line",
        )

    head = fixed(
        [
            (0, '<?xml version="1.0" encoding="utf-8"?>'),
            (1, '<DJ_PLAYLISTS Version="1.0.0">'),
            (2, f'<PRODUCT Name="{PRODUCT}" Version="1.0" Company=""/>'),
            (5, "</COLLECTION>"),
            (6, "<PLAYLISTS>"),
            (7, '<NODE Type="0" Name="ROOT">'),
            (9, "</NODE>"),
            (10, "</PLAYLISTS>"),
            (11, "</DJ_PLAYLISTS>"),
        ]
    )
    blank = [
        F.lit("").alias("year"), F.lit(0).alias("rank"), F.lit("").alias("period"), F.lit(0).alias("step")
    ]
    opening = tracks.agg(F.count("*").alias("n")).select(
        F.lit(3).alias("section"), *blank, F.lit(0).cast("bigint").alias("ordinal"),
        F.concat(F.lit('<COLLECTION Entries="'), F.col("n").cast("string"), F.lit('">')).alias("line"),
    )
    rows = tracks.select(
        F.lit(4).alias("section"), *blank, F.col("TrackID").cast("bigint").alias("ordinal"), track_xml().alias("line")
    )
    tree = tree_lines(refs).select(F.lit(8).alias("section"), *place[1:], "line")
    return head.unionByName(opening).unionByName(rows).unionByName(tree)


def write_document(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Document lines as text parts that read in name order as one XML document."""
    place = ["section", "year", "rank", "period", "step", "ordinal"]
    ordered = lines.repartitionByRange(*place).sortWithinPartitions(*place)
    ordered.select("line").write.mode(mode).text(path)
