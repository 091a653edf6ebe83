"""Candidate gates and picks. A gate is a boolean column over (file, candidate) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cratelink.functions.search import title_agrees
from cratelink.session import shuffled

#: Fixed tolerances, in ms.
LENGTH_TOLERANCE = 7_000
ID_TOLERANCE = 10_000

MATCH, NO_CANDIDATES, AMBIGUOUS = "match", "no-candidates", "ambiguous"


def length_fits(length_ms: Column, file_ms: Column, tolerance: int = LENGTH_TOLERANCE) -> Column:
    """Unknown file length lets all pass; else the candidate's must be known and near."""
    known = F.coalesce(file_ms, F.lit(0))
    return (known == 0) | ((length_ms > 0) & (F.abs(length_ms - known) <= tolerance))


def age_order(publish_date: Column, cid: Column) -> Column:
    """Oldest first, undated last, then by id."""
    return F.struct(
        F.when(F.coalesce(publish_date, F.lit("")) == "", F.lit("9999"))
        .otherwise(publish_date)
        .alias("_date"),
        cid.alias("_id"),
    )


def title_and_length(title: Column, name: Column, mix: Column, length_ms: Column, file_ms: Column) -> Column:
    return title_agrees(title, name, mix) & length_fits(length_ms, file_ms)


def pick_oldest(candidates: DataFrame, by: list[str], where: Column | None = None) -> DataFrame:
    """The oldest candidate per key, as the columns of *candidates*."""
    rest = [c for c in candidates.columns if c not in by]
    rows = candidates if where is None else candidates.filter(where)
    picked = F.min_by(F.struct(*rest), age_order(F.col("publish_date"), F.col("id")))
    return rows.groupBy(*by).agg(picked.alias("_p")).select(*by, "_p.*")


def pick_best(
    files: DataFrame,
    candidates: DataFrame,
    key: str,
    title: str | None = None,
) -> DataFrame:
    """One row per file: the pick (null when none) and the reason.

    *candidates* are keyed by *key* and hold the file's ``duration_ms``. All three
    reasons come out of one aggregation. A *title* column adds the title gate;
    a blank title in it means no gate.
    """
    gate = length_fits(F.col("length_ms"), F.col("duration_ms"))
    if title:
        agrees = title_agrees(F.col(title), F.col("name"), F.col("mix_name"))
        gate = gate & ((F.col(title) == "") | agrees)
    order = age_order(F.col("publish_date"), F.col("id"))
    fields = [c for c in candidates.columns if c not in (key, title, "duration_ms")]
    best = candidates.withColumn("_ok", gate).groupBy(key).agg(
        F.min_by(F.when(F.col("_ok"), F.struct(*fields)), F.when(F.col("_ok"), order)).alias("pick")
    )
    reason = (
        F.when(F.col("pick").isNotNull(), F.lit(MATCH))
        .when(F.col("_met"), F.lit(AMBIGUOUS))
        .otherwise(F.lit(NO_CANDIDATES))
    )
    return (
        files.select(key)
        .join(shuffled(best.withColumn("_met", F.lit(True))), key, "left")
        .withColumn("_met", F.coalesce("_met", F.lit(False)))
        .withColumn("reason", reason)
        .drop("_met")
    )


def by_id(files: DataFrame, candidates: DataFrame, file_id: str = "file_id") -> DataFrame:
    """Candidates named by the file itself, trusted only when both lengths are known and near."""
    joined = files.filter(F.col(file_id) > 0).join(
        shuffled(candidates), files[file_id] == candidates["id"]
    )
    near = (
        (F.coalesce("duration_ms", F.lit(0)) > 0)
        & (F.col("length_ms") > 0)
        & (F.abs(F.col("length_ms") - F.col("duration_ms")) <= ID_TOLERANCE)
    )
    return joined.filter(near)
