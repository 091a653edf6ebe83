"""Additive merge: plan per field, apply, reconcile before publishing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cratelink.functions.quality import MERGE_FIELDS, junk_reason

#: Largest change of audio length, in seconds (exclusive), a publish may show.
LENGTH_DRIFT = 0.5


def candidate_fields(c: str = "pick") -> dict[str, Column]:
    """The nine mergeable values a candidate offers; sub-genre wins, date is cut to a day."""

    def get(name: str) -> Column:
        return F.coalesce(F.col(f"{c}.{name}"), F.lit(""))

    bpm = F.coalesce(F.col(f"{c}.bpm"), F.lit(0))
    return {
        "title": display_title(get("name"), get("mix_name")),
        "artist": get("artists"),
        "album": get("release_name"),
        "genre": F.when(get("sub_genre") != "", get("sub_genre")).otherwise(get("genre")),
        "date": F.substr(get("publish_date"), F.lit(1), F.lit(10)),
        "bpm": F.when(bpm != 0, bpm.cast("string")).otherwise(F.lit("")),
        "key": get("key_name"),
        "label": get("label"),
        "isrc": get("isrc"),
    }


def display_title(name: Column, mix: Column) -> Column:
    return F.when(mix != "", F.concat(name, F.lit(" ("), mix, F.lit(")"))).otherwise(name)


def offered(candidates: DataFrame, key: str, pick: str = "pick") -> DataFrame:
    """Candidate picks as (key, new_<field>..., artwork_url)."""
    return candidates.select(
        key,
        *[c.alias(f"new_{f}") for f, c in candidate_fields(pick).items()],
        F.coalesce(F.col(f"{pick}.artwork_url"), F.lit("")).alias("artwork_url"),
    )


def plan_fields(
    current: DataFrame,
    new: DataFrame,
    key: str,
    overwrite: bool = False,
    fields: Sequence[str] | None = None,
) -> DataFrame:
    """(key, field, old, new, reason) for every value that would change.

    A new value is taken when it is present, allowed and different, and the old one is
    blank, junk, or to be overwritten. The unpivot is a narrow explode of nine structs.
    """
    wanted = [f for f in MERGE_FIELDS if fields is None or f in fields]
    if not wanted:
        wanted, new = list(MERGE_FIELDS), new.limit(0)
    pairs = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"),
                F.coalesce(F.col(f), F.lit("")).alias("old") if f in current.columns else F.lit("").alias("old"),
                F.coalesce(F.col(f"new_{f}"), F.lit("")).alias("new"),
            )
            for f in wanted
        ]
    )
    rows = current.join(new, key).select(key, F.explode(pairs).alias("p")).select(key, "p.*")
    rows = rows.withColumn("reason", junk_reason(F.col("old")))
    replaceable = (F.col("old") == "") | (F.col("reason") != "") | F.lit(overwrite)
    return rows.filter((F.col("new") != "") & replaceable & (F.col("old") != F.col("new")))


def plans(
    current: DataFrame,
    new: DataFrame,
    key: str,
    overwrite: bool = False,
    art_overwrite: bool = False,
    fields: Sequence[str] | None = None,
) -> DataFrame:
    """One plan per row: updates map, junk reasons map, artwork flag.

    The nine fields of a row fold into maps with partial aggregation; a row's group
    never exceeds nine entries.
    """
    changes = plan_fields(current, new, key, overwrite, fields)
    folded = changes.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("field", "new"))).alias("updates"),
        F.map_from_entries(
            F.filter(
                F.collect_list(F.struct("field", "reason")), lambda r: r["reason"] != ""
            )
        ).alias("reasons"),
    )
    has_art = F.coalesce(F.col("has_artwork"), F.lit(False)) if "has_artwork" in current.columns else F.lit(False)
    flags = current.select(key, has_art.alias("has_artwork")).join(new.select(key, "artwork_url"), key)
    empty = F.create_map().cast("map<string,string>")
    return flags.join(folded, key, "left").select(
        key,
        F.coalesce("updates", empty).alias("updates"),
        F.coalesce("reasons", empty).alias("reasons"),
        "artwork_url",
        "has_artwork",
        artwork_flag(F.col("artwork_url"), F.col("has_artwork"), art_overwrite).alias("embed_artwork"),
    )


def artwork_flag(url: Column, has_art: Column, art_overwrite: bool = False) -> Column:
    return (url != "") & (F.lit(art_overwrite) | ~has_art)


def merged(
    current: DataFrame,
    new: DataFrame,
    key: str,
    overwrite: bool = False,
    fields: Sequence[str] | None = None,
    source: Column | None = None,
) -> DataFrame:
    """Current rows with the planned values in place, and where they came from.

    Wide form of :func:`plan_fields`: one join, no unpivot.
    """
    joined = current.join(new, key, "left")
    out, changed = {}, []
    for f in MERGE_FIELDS:
        if f not in current.columns:
            continue
        old, fresh = F.coalesce(F.col(f), F.lit("")), F.coalesce(F.col(f"new_{f}"), F.lit(""))
        allowed = fields is None or f in fields
        take = (
            F.lit(allowed)
            & (fresh != "")
            & (old != fresh)
            & ((old == "") | (junk_reason(old) != "") | F.lit(overwrite))
        )
        out[f] = F.when(take, fresh).otherwise(old)
        changed.append(F.when(take, F.lit(f)))
    marks = F.filter(F.array(*changed), lambda m: m.isNotNull())
    result = joined.withColumn("updated", marks).withColumns(out)
    if source is not None:
        result = result.withColumn("source", F.when(F.size("updated") > 0, source).otherwise(F.lit("")))
    return result.drop(*[c for c in new.columns if c != key])


def reconcile(
    before: DataFrame,
    after: DataFrame,
    plan: DataFrame,
    key: str,
    own_marks: Sequence[str] = (),
    art_prefix: str | None = None,
) -> DataFrame:
    """Verdict per row: did every planned value land, was nothing lost, is the audio intact?

    *before* and *after* hold (key, tags map, seconds, pictures); *plan* holds
    (key, updates map, embed_artwork). A row missing on either side fails.
    """
    b = before.select(key, F.col("tags").alias("_b"), F.col("seconds").alias("_bs"), F.col("pictures").alias("_bp"))
    a = after.select(key, F.col("tags").alias("_a"), F.col("seconds").alias("_as"), F.col("pictures").alias("_ap"))
    j = plan.select(key, "updates", "embed_artwork").join(b.join(a, key, "full_outer"), key, "left")
    empty = F.create_map().cast("map<string,string>")
    updates = F.coalesce("updates", empty)
    landed = F.coalesce(
        F.forall(
            F.map_entries(updates),
            lambda e: F.coalesce(F.try_element_at(F.col("_a"), e["key"]) == e["value"], F.lit(False)),
        ),
        F.lit(False),
    )
    keys = lambda c: F.coalesce(F.map_keys(c), F.array().cast("array<string>"))
    lost = F.array_except(
        F.array_except(keys("_b"), keys("_a")), F.array(*[F.lit(m) for m in own_marks]).cast("array<string>")
    )
    embed = F.coalesce("embed_artwork", F.lit(False))
    fewer_pictures = (
        (F.coalesce("_bp", F.lit(0)) > 0) & (F.coalesce("_ap", F.lit(0)) < F.coalesce("_bp", F.lit(0))) & ~embed
    )
    if art_prefix:
        lost = F.when(embed, F.filter(lost, lambda k: ~F.startswith(k, F.lit(art_prefix)))).otherwise(lost)
    lost = F.when(fewer_pictures, F.array_append(lost, F.lit("<pictures>"))).otherwise(lost)
    audio_ok = F.col("_bs").isNull() | F.col("_as").isNull() | (F.abs(F.col("_bs") - F.col("_as")) < LENGTH_DRIFT)
    return (
        j.withColumn("landed", landed)
        .withColumn("lost", F.array_sort(lost))
        .withColumn("audio_ok", audio_ok)
        .withColumn("ok", F.col("landed") & (F.size("lost") == 0) & F.col("audio_ok"))
        .withColumn("status", F.when(F.col("ok"), F.lit("matched")).otherwise(F.lit("verify-failed")))
        .select(key, "landed", "lost", "audio_ok", "ok", "status")
    )


def publishable(before: DataFrame, after: DataFrame, verdict: DataFrame, key: str) -> DataFrame:
    """Rows to publish: new where the verdict is ok, the previous row otherwise."""
    good = verdict.filter("ok").select(key)
    kept = before.join(good, key, "left_anti")
    return after.join(good, key, "left_semi").unionByName(kept)
