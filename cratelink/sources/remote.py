"""Landed answers of the two fallback sources, parsed to rows for their gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cratelink.schemas import RECORDING, RELEASE, RELEASE_RESULT


def _words(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def recordings(answers: DataFrame, key: str, column: str = "value", rank: str = "rank") -> DataFrame:
    """Recording JSON per row to (key, rank, score, credit, length and release columns).

    Release, date and label come from the first release.
    """
    r = F.from_json(F.col(column), RECORDING)
    rows = answers.select(key, rank, r.alias("r"))
    people = F.coalesce(F.col("r.artist-credit"), F.array().cast("array<struct<name:string>>"))
    release = F.get(F.col("r.releases"), F.lit(0))
    labels = F.filter(
        F.transform(release["label-info"], lambda i: _words(i["label"]["name"])), lambda n: n != ""
    )
    return rows.select(
        key,
        rank,
        F.coalesce(F.col("r.score").try_cast("int"), F.lit(0)).alias("score"),
        F.lower(F.array_join(F.transform(people, lambda a: _words(a["name"])), " ")).alias("credit"),
        F.coalesce(F.col("r.length").try_cast("bigint"), F.lit(0)).alias("rec_length"),
        _words(F.col("r.title")).alias("rec_title"),
        _words(release["title"]).alias("rec_release"),
        F.substr(_words(release["date"]), F.lit(1), F.lit(10)).alias("rec_date"),
        _words(F.get(labels, F.lit(0))).alias("rec_label"),
    )


def release_results(answers: DataFrame, key: str, column: str = "value", page: str | None = None) -> DataFrame:
    """A search answer's ``results`` array, one row per result with its rank.

    An answer landed as several pages names its page column.
    """
    results = F.from_json(F.col(column), f"struct<results:array<{RELEASE_RESULT}>>")["results"]
    number = (F.col(page) if page else F.lit(0)).cast("bigint")
    return answers.select(key, number.alias("page"), F.posexplode(results).alias("place", "r")).select(
        key,
        F.struct("page", "place").alias("rank"),
        F.col("r.id").alias("result_id"),
        F.col("r.type").alias("result_type"),
        _words(F.col("r.title")).alias("result_title"),
    )


def releases(details: DataFrame, column: str = "value") -> DataFrame:
    """Release detail JSON to one row per release."""
    r = F.from_json(F.col(column), RELEASE)
    rows = details.select(r.alias("r"))
    people = F.coalesce(F.col("r.artists"), F.array().cast("array<struct<name:string>>"))
    names = F.filter(F.transform(people, lambda a: _words(a["name"])), lambda n: n != "")
    images = F.coalesce(F.col("r.images"), F.array().cast("array<struct<type:string,uri:string>>"))
    primary = F.filter(images, lambda i: (i["type"] == "primary") & (_words(i["uri"]) != ""))
    year = F.when(F.col("r.year") != "0", F.col("r.year"))
    return rows.select(
        F.col("r.id").alias("release_key"),
        _words(F.col("r.title")).alias("rel_title"),
        F.array_join(names, ", ").alias("rel_artists"),
        _words(F.get(F.col("r.labels"), F.lit(0))["name"]).alias("rel_label"),
        F.substr(
            F.coalesce(F.nullif(F.col("r.released"), F.lit("")), year, F.lit("")), F.lit(1), F.lit(10)
        ).alias("rel_date"),
        F.col("r.genres").alias("genres"),
        F.col("r.styles").alias("styles"),
        F.coalesce(
            F.col("r.tracklist"), F.array().cast("array<struct<title:string,duration:string>>")
        ).alias("tracklist"),
        _words(F.get(primary, F.lit(0))["uri"]).alias("rel_artwork"),
    )
