"""Candidate tables: parsing, snapshots and the detail cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cratelink.operators.waterfall import CANDIDATE_FIELDS
from cratelink.schemas import API_CANDIDATE


def _words(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _number(c: Column, kind: str) -> Column:
    return F.coalesce(c.try_cast(kind), F.lit(0)).cast(kind)


def _artwork(c: Column) -> Column:
    def one(image: Column) -> Column:
        dynamic = F.replace(F.replace(image["dynamic_uri"], F.lit("{w}"), F.lit("500")), F.lit("{h}"), F.lit("500"))
        return F.coalesce(F.nullif(dynamic, F.lit("")), F.nullif(image["uri"], F.lit("")))

    return F.coalesce(one(c["release"]["image"]), one(c["image"]), F.lit(""))


def parse(texts: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Search-answer JSON to candidate rows."""
    c = F.col("_c")
    people = F.coalesce(c["artists"], F.array().cast("array<struct<name:string>>"))
    fields = {
        "id": _number(c["id"], "bigint"),
        "name": _words(c["name"]),
        "mix_name": _words(c["mix_name"]),
        "artists": F.array_join(F.transform(people, lambda a: _words(a["name"])), ", "),
        "genre": _words(c["genre"]["name"]),
        "sub_genre": _words(c["sub_genre"]["name"]),
        "label": F.when(c["label"].isNotNull(), _words(c["label"]["name"])).otherwise(
            _words(c["release"]["label"]["name"])
        ),
        "release_name": _words(c["release"]["name"]),
        "release_id": _number(c["release"]["id"], "bigint"),
        "publish_date": F.coalesce(
            F.nullif(c["publish_date"], F.lit("")), F.nullif(c["new_release_date"], F.lit("")), F.lit("")
        ),
        "bpm": _number(c["bpm"], "int"),
        "key_name": _words(c["key"]["name"]),
        "isrc": _words(c["isrc"]),
        "catalog_number": _words(c["catalog_number"]),
        "artwork_url": _artwork(c),
        "length_ms": _number(c["length_ms"], "bigint"),
    }
    parsed = texts.withColumn("_c", F.from_json(column, API_CANDIDATE))
    return parsed.select(*keep, *[fields[n].alias(n) for n in CANDIDATE_FIELDS])


def to_snapshot() -> Column:
    """A candidate row as snapshot JSON."""
    return F.to_json(F.struct(*CANDIDATE_FIELDS))


def parse_snapshots(texts: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Snapshot JSON text with loose types to candidate rows.

    Numbers lose their fraction and flags count as 0 and 1; a text is a number only if it
    is written as a whole one. Everything else is 0, or an empty text.
    """
    parsed = texts.withColumn("_s", F.try_parse_json(column))

    def field(name: str, kind: str) -> Column:
        wanted = "string" if kind == "string" else "bigint"
        blank = F.lit("") if kind == "string" else F.lit(0)
        return F.coalesce(F.try_variant_get("_s", f"$.{name}", wanted), blank).cast(kind)

    return parsed.select(*keep, *[field(n, k).alias(n) for n, k in CANDIDATE_FIELDS.items()])


def wanted_ids(ids: DataFrame, cache: DataFrame, key: str = "id") -> DataFrame:
    """Distinct ids that are not cached yet."""
    return ids.select(key).distinct().join(cache.select(key), key, "left_anti")


def merge_cache(cache: DataFrame, landed: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """Cache plus landed details; the latest version of an id wins."""
    both = cache.unionByName(landed)
    rest = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("_s")).select(key, "_s.*")


def with_snapshots(rows: DataFrame, cache: DataFrame, key: str = "id") -> DataFrame:
    """Rows joined to their snapshot; a miss is an ``error`` row."""
    known = cache.withColumn("_known", F.lit(True))
    return (
        rows.join(known, key, "left")
        .withColumn("status", F.when(F.col("_known"), F.lit("matched")).otherwise(F.lit("error")))
        .drop("_known")
    )
