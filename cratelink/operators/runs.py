"""Run bookkeeping: what is left to do, counts, verdicts and the failure breaker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cratelink.operators.position import in_blocks

FAILURES = ("error", "verify-failed", "stuck")
#: Counts that fail a run.
FAILED_COUNTS = ("error", "verify-failed", "stuck", "stopped-early")
CHUNK = 50
FAILURE_LIMIT = 15
STUCK_SECONDS = 300


def todo(manifest: DataFrame, done: DataFrame, need_match: bool = False, key: str = "path") -> DataFrame:
    """Manifest rows not logged yet; *need_match* keeps those with an id or a snapshot."""
    rows = manifest.filter(F.coalesce(F.col(key), F.lit("")) != "")
    if need_match:
        rows = rows.filter((F.coalesce("candidate_id", F.lit(0)) != 0) | F.col("snapshot").isNotNull())
    return rows.join(done.select(key).distinct(), key, "left_anti")


def count_key(status: Column, changed: Column, applied: Column) -> Column:
    """``updated`` for a match that really changed something; else the status."""
    return F.when((status == "matched") & applied & changed, F.lit("updated")).otherwise(status)


def status_counts(results: DataFrame, *by: str, key: Column | None = None) -> DataFrame:
    return results.groupBy(*by, (key if key is not None else F.col("status")).alias("status")).agg(
        F.count("*").alias("n")
    )


def verdict(counts: DataFrame, *by: str) -> DataFrame:
    """2 when any failure was counted, else 0."""
    failed = F.coalesce(F.bool_or(F.col("status").isin(*FAILED_COUNTS) & (F.col("n") > 0)), F.lit(False))
    return counts.groupBy(*by).agg(F.when(failed, F.lit(2)).otherwise(F.lit(0)).alias("verdict"))


def progress(results: DataFrame, total: Column, elapsed_s: Column, *by: str) -> DataFrame:
    """Done, share, rate, remaining seconds and the last match, in one aggregation.

    *results* hold (status, order columns ``ts`` and ``seq``, ``label``).
    """
    matched = F.col("status") == "matched"
    agg = results.groupBy(*by).agg(
        F.count("*").alias("done"),
        F.count_if(matched).alias("matched"),
        F.max_by(F.when(matched, F.col("label")), F.when(matched, F.struct("ts", "seq"))).alias("last_matched"),
        F.first(total).alias("total"),
        F.first(elapsed_s).alias("elapsed"),
    )
    rate = F.col("done") / F.greatest(F.col("elapsed"), F.lit(1))
    return agg.select(
        *by,
        "done",
        "matched",
        F.coalesce("last_matched", F.lit("")).alias("last_matched"),
        F.round(100 * F.col("done") / F.greatest(F.col("total"), F.lit(1)), 3).alias("pct"),
        F.round(rate, 3).alias("rate"),
        F.round((F.col("total") - F.col("done")) / F.greatest(rate, F.lit(0.01)), 3).alias("eta"),
    )


def streaks(log: DataFrame, run: str, *order: str, carry: DataFrame | None = None, blocks: int | None = None) -> DataFrame:
    """*log* with ``streak``: failures in a row up to and including each row of its run.

    A run may be most of the log, so it is not windowed whole. Rows are cut into
    blocks by (run, order). Inside a block the streak is counted from the last success
    or the block's start; the failures a block begins with are then raised by what the
    run's earlier blocks ended with. Only one summary row per run and block crosses
    blocks. *carry* (run, streak) continues streaks of an earlier log.
    """
    log = in_blocks(log, run, *order, blocks=blocks)
    bad = F.col("status").isin(*FAILURES)
    within = Window.partitionBy(run, "_block").orderBy("_place")
    so_far = within.rowsBetween(Window.unboundedPreceding, 0)
    rows = log.withColumn("_since", F.sum(F.when(bad, 0).otherwise(1)).over(so_far))
    island = Window.partitionBy(run, "_block", "_since").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_local", F.sum(F.when(bad, 1).otherwise(0)).over(island))

    ends = rows.groupBy(run, "_block").agg(
        F.max("_since").alias("_good"), F.max_by("_local", "_place").alias("_tail")
    )
    if carry is not None:
        start = carry.select(run, F.lit(-1).alias("_block"), F.lit(1).cast("bigint").alias("_good"), F.col("streak").alias("_tail"))
        ends = ends.unionByName(start)
    # A run's summaries: at most one per block.
    runs = Window.partitionBy(run).orderBy("_block")
    ends = ends.withColumn(
        "_isle", F.sum(F.when(F.col("_good") > 0, 1).otherwise(0)).over(runs.rowsBetween(Window.unboundedPreceding, 0))
    )
    open_streak = F.sum("_tail").over(
        Window.partitionBy(run, "_isle").orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    )
    ends = ends.withColumn("_end", open_streak).withColumn("_in", F.coalesce(F.lag("_end").over(runs), F.lit(0)))
    return (
        rows.join(ends.select(run, "_block", "_in"), [run, "_block"])
        .withColumn("streak", F.when(F.col("_since") == 0, F.col("_local") + F.col("_in")).otherwise(F.col("_local")))
        .drop("_block", "_place", "_since", "_local", "_in")
    )


def trip_points(streaked: DataFrame, run: str, *order: str, limit: int = FAILURE_LIMIT) -> DataFrame:
    """Where each tripped run reached *limit* failures in a row: (run, trip struct)."""
    tripped = F.col("streak") >= max(1, limit)
    return streaked.filter(tripped).groupBy(run).agg(F.min(F.struct(*order)).alias("trip"))


def breaker_prefix(
    log: DataFrame,
    run: str,
    *order: str,
    limit: int = FAILURE_LIMIT,
    mode: str = "write",
    chunk: int = CHUNK,
    blocks: int | None = None,
) -> DataFrame:
    """Rows a run logs before its breaker stops it.

    In ``write`` mode nothing after the tripping row is logged; in ``dry`` mode the
    chunk in which it trips is finished first, so *log* needs a ``position`` in its run.
    """
    rows = streaks(log, run, *order, blocks=blocks)
    trips = trip_points(rows, run, *order, limit=limit)
    joined = rows.join(trips, run, "left")
    here = F.struct(*order)
    if mode == "dry":
        size = max(1, chunk)
        last = rows.withColumn("_h", here).join(trips, run).filter("_h = trip").select(
            run, F.floor((F.col("position") - 1) / size).alias("_stop")
        )
        kept = rows.join(last, run, "left").filter(
            F.col("_stop").isNull() | (F.floor((F.col("position") - 1) / size) <= F.col("_stop"))
        )
        return kept.drop("_stop")
    return joined.filter(F.col("trip").isNull() | (here <= F.col("trip"))).drop("trip")


def run_totals(kept: DataFrame, trips: DataFrame, run: str) -> DataFrame:
    """Status counts per run, plus ``stopped-early`` for the tripped ones."""
    stopped = trips.select(run, F.lit("stopped-early").alias("status"), F.lit(1).cast("bigint").alias("n"))
    return status_counts(kept, run).unionByName(stopped)


def stuck(starts: DataFrame, finishes: DataFrame, item: str, now: Column, seconds: int = STUCK_SECONDS) -> DataFrame:
    """Started items without a finish whose age exceeds the budget."""
    open_items = starts.join(finishes.select(item).distinct(), item, "left_anti")
    age = F.unix_timestamp(now) - F.unix_timestamp("started_at")
    return open_items.filter(age > seconds)
