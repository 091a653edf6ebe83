"""Streaming jobs: enrichment, breaker, stuck-item watch, progress and running counts.

Every ``foreachBatch`` writer is idempotent. It writes under the batch's own folder in
overwrite mode, so a batch replayed after a failure replaces its first attempt. What is
carried from batch to batch is a state store of Spark, or a table cut into buckets of
which a batch reads only those it touches and adds only the rows it changed.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cratelink.operators.runs import FAILURE_LIMIT, FAILURES, STUCK_SECONDS, streaks, trip_points
from cratelink.session import shuffled, stage
from cratelink.sources.logs import _exists

#: Buckets of a table of keys.
BUCKETS = 32
#: Batches after which a state table is written whole, so that few batches are ever read.
COMPACT = 50
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def on_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB: on local disk and in the checkpoint, not in memory."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def _bucket(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _touched(batch: DataFrame, key: str) -> list[int]:
    """Buckets of the keys of a batch: at most BUCKETS numbers."""
    return [r[0] for r in batch.select(_bucket(key)).distinct().collect()]


def run_of(checkpoint: str) -> str:
    """A name for all batches of one checkpoint."""
    return hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]


def _write(df: DataFrame, root: str, batch_id: int, *by: str) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(f"{root}/batch={batch_id}")


def read_log(spark: SparkSession, root: str) -> DataFrame:
    """All rows the batches under *root* logged."""
    return spark.read.option("basePath", root).option("recursiveFileLookup", True).parquet(root)


def enrich_stream(
    manifest: DataFrame,
    resolve: Callable[[DataFrame], DataFrame],
    log_root: str,
    checkpoint: str,
    key: str = "path",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Resolve manifest rows as they land and log each result once.

    *resolve* turns a frame of manifest rows into one result row per *key*. Keys seen
    under this checkpoint are in its state store, so a batch looks up its own keys only
    and never reads the log. A run with a new checkpoint skips what runs before it logged
    under *log_root*; only then are their keys read.
    """
    run = run_of(checkpoint)
    spark = manifest.sparkSession
    before = None
    if _exists(spark, log_root):
        before = spark.read.option("basePath", log_root).parquet(f"{log_root}/run=*/batch=*").filter(F.col("run") != run).select(key)
        before = None if before.isEmpty() else stage(before, "logged-before")

    def step(batch: DataFrame, batch_id: int) -> None:
        fresh = batch if before is None else batch.join(shuffled(before), key, "left_anti")
        _write(resolve(fresh), f"{log_root}/run={run}", batch_id)

    with on_rocksdb(spark):
        return (
            manifest.dropDuplicates([key])
            .writeStream.foreachBatch(step)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )


def _state(spark: SparkSession, root: str, batch_id: int, schema: str, run: str, buckets: list[int] | None) -> DataFrame:
    """The last state of every run before *batch_id*, of the given buckets: one row per run.

    Every COMPACT batches the whole state was written, so older batches are not read.
    """
    first = max(0, (batch_id - 1) // COMPACT * COMPACT)
    names = [f"{root}/batch={n}" for n in range(first, batch_id)]
    known = [name for name in names if _exists(spark, name)]
    if not known:
        return spark.createDataFrame([], schema)
    rows = spark.read.option("basePath", root).schema(f"{schema}, bucket int, batch bigint").parquet(*known)
    if buckets is not None:
        rows = rows.filter(F.col("bucket").isin(buckets))
    last = F.max_by(F.struct("streak", "tripped"), "batch").alias("last")
    return rows.groupBy(run).agg(last).select(run, "last.streak", "last.tripped")


def breaker_stream(
    results: DataFrame,
    run: str,
    order: tuple[str, ...],
    log_root: str,
    state_root: str,
    checkpoint: str,
    limit: int = FAILURE_LIMIT,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Log results per run until the run's failures in a row reach *limit*.

    State is one row per run (streak so far, tripped) in buckets by run. A batch reads
    the buckets of its own runs and adds their new rows; other runs are not written
    again, but for every COMPACT-th batch. A batch is ordered and cut into blocks by
    :func:`cratelink.operators.runs.streaks`, so a run that makes up most of a batch
    is still spread over tasks, and the streak it carries in is one summary row.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        schema = f"{batch.select(run).schema[0].simpleString().replace(':', ' ', 1)}, streak bigint, tripped boolean"
        whole = batch_id > 0 and batch_id % COMPACT == 0
        state = _state(spark, state_root, batch_id, schema, run, None if whole else _touched(batch, run))
        running = batch.join(state.filter("tripped").select(run), run, "left_anti")
        rows = stage(streaks(running, run, *order, carry=state.select(run, "streak")), "streaks")
        trips = trip_points(rows, run, *order, limit=limit)
        kept = rows.join(trips, run, "left").filter(
            F.col("trip").isNull() | (F.struct(*order) <= F.col("trip"))
        )
        _write(kept.drop("trip"), log_root, batch_id)
        last = rows.groupBy(run).agg(
            F.max_by("streak", F.struct(*order)).alias("now"),
            F.bool_or(F.col("streak") >= max(1, limit)).alias("hit"),
        )
        merged = state.join(last, run, "full_outer" if whole else "right").select(
            run,
            F.coalesce("now", "streak", F.lit(0)).cast("bigint").alias("streak"),
            (F.coalesce("tripped", F.lit(False)) | F.coalesce("hit", F.lit(False))).alias("tripped"),
        )
        _write(merged.withColumn("bucket", _bucket(run)).repartition("bucket"), state_root, batch_id, "bucket")

    return (
        results.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def progress_stream(
    results: DataFrame,
    log_root: str,
    metrics_root: str,
    checkpoint: str,
    order: tuple[str, ...] = ("ts", "seq"),
    trigger: dict | None = None,
) -> StreamingQuery:
    """Log results, and for each batch how many rows came, how many matched, and the last match.

    The numbers are observed while the log is written, so rows are read once. *results*
    hold status, label and the order columns.
    """
    matched = F.col("status") == "matched"

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = Observation(f"batch {batch_id}")
        last = F.max(F.when(matched, F.struct(*order, "label"))).alias("last")
        watched = batch.observe(seen, F.count(F.lit(1)).alias("done"), F.count_if(matched).alias("matched"), last)
        _write(watched, log_root, batch_id)
        got = seen.get
        kind = batch.select(F.struct(*order, "label").alias("last")).schema["last"].dataType.simpleString()
        rows = spark.createDataFrame(
            [(got["done"], got["matched"], got["last"])], f"done bigint, matched bigint, last {kind}"
        )
        _write(rows.withColumn("at", F.current_timestamp()), metrics_root, batch_id)

    return (
        results.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def batch_progress(metrics: DataFrame, total: Column, started: Column) -> DataFrame:
    """Running progress after each batch, from the rows of :func:`progress_stream` (one per batch).

    Done and matched so far, the last match, share done, rows per second since *started*
    and seconds left.
    """
    so_far = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    done, seconds = F.sum("done").over(so_far), F.unix_timestamp("at") - F.unix_timestamp(started)
    rate = F.col("done") / F.greatest("seconds", F.lit(1))
    return metrics.select(
        "batch",
        done.alias("done"),
        F.sum("matched").over(so_far).alias("matched"),
        F.coalesce(F.max("last").over(so_far)["label"], F.lit("")).alias("last_matched"),
        seconds.alias("seconds"),
        total.alias("total"),
    ).select(
        "batch", "done", "matched", "last_matched",
        F.round(100 * F.col("done") / F.greatest("total", F.lit(1)), 3).alias("pct"),
        F.round(rate, 3).alias("rate"),
        F.round((F.col("total") - F.col("done")) / F.greatest(rate, F.lit(0.01)), 3).alias("eta"),
    )


class _Watch(StatefulProcessor):
    """Per item: when it started, in microseconds, and a timer for the end of its budget."""

    def __init__(self, item: str, seconds: int):
        self.item, self.budget = item, 1000 * seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "started_at bigint, finished boolean, due bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.open.get() if self.open.exists() else None
        started, finished, due = known or (None, False, None)
        for row in rows:
            if row["event"] == "start" and row["at"] is not None:
                started = row["at"] if started is None else min(started, row["at"])
            finished = finished or row["event"] == "finish"
        if due is not None:
            self.handle.deleteTimer(due)
        if started is not None and finished:
            if known is not None:
                self.open.clear()
            return iter(())
        now = timerValues.getCurrentProcessingTimeInMs()
        # A finish without a start waits as long as an item may take, then is forgotten.
        due = now + self.budget if started is None else max(now, started // 1000 + self.budget)
        self.handle.registerTimer(due)
        self.open.update((started, finished, due))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        started, _, _ = self.open.get() if self.open.exists() else (None, False, None)
        self.open.clear()
        if started is not None:
            yield Row(**{self.item: key[0], "started_at": started, "status": "stuck"})

    def close(self) -> None:
        pass


def watchdog_stream(events: DataFrame, item: str, seconds: int = STUCK_SECONDS) -> DataFrame:
    """Started items that did not finish within their budget, told by the clock.

    *events* hold (item, event ``start`` or ``finish``, at). Each open item has a timer on
    processing time, so the last item of a stream that has fallen silent is reported too.
    Items are unique, so state spreads evenly. An item is reported once; a finish
    after that is a finish without a start. Start the query inside :func:`on_rocksdb`.
    """
    kind = events.schema[item].dataType.simpleString()
    rows = events.select(item, "event", F.unix_micros(F.col("at").cast("timestamp")).alias("at"))
    stuck = rows.groupBy(item).transformWithState(
        _Watch(item, int(seconds)),
        outputStructType=f"{item} {kind}, started_at bigint, status string",
        outputMode="Append",
        timeMode="ProcessingTime",
    )
    return stuck.withColumn("started_at", F.timestamp_micros("started_at"))


def stuck_stream(
    starts: DataFrame,
    finishes: DataFrame,
    item: str,
    seconds: int = STUCK_SECONDS,
    delay: str = "0 seconds",
) -> DataFrame:
    """Started items that did not finish within the budget, as ``stuck`` rows.

    An outer join of two watermarked streams on the item within a time bound: Spark
    keeps a start only until its budget has passed, then emits it unmatched. Items are
    unique, so state spreads evenly over partitions. *starts* hold (item, started_at),
    *finishes* (item, finished_at).
    """
    begun = F.col("started_at").cast("timestamp").alias("started_at")
    ended = F.col("finished_at").cast("timestamp").alias("finished_at")
    s = starts.select(item, begun).withWatermark("started_at", delay).alias("s")
    f = finishes.select(F.col(item).alias("f_item"), ended).withWatermark("finished_at", delay).alias("f")
    bound = F.expr(
        f"s.{item} = f_item and finished_at >= started_at "
        f"and finished_at <= started_at + interval {int(seconds)} seconds"
    )
    joined = s.join(f, bound, "left_outer")
    return joined.filter("f_item is null").select(item, "started_at", F.lit("stuck").alias("status"))


def stop_when_quiet(query: StreamingQuery, seconds: int = 120) -> None:
    """Stop a query on processing time once a batch without input has run, so due timers have fired.

    Such a query never ends by itself, since timers may always fall due. However long its
    batches take, they are waited for; *seconds* is how long a query may wait for its first
    input. A query that failed raises its error.
    """
    fed, deadline = False, time.monotonic() + seconds
    try:
        while query.isActive:
            seen = [p["numInputRows"] for p in query.recentProgress]
            fed = fed or any(seen)
            if fed and seen[-1] == 0:
                return
            if fed or query.status["isDataAvailable"]:
                deadline = time.monotonic() + seconds
            if time.monotonic() > deadline:
                return
            time.sleep(0.2)
        if query.exception() is not None:
            raise query.exception()
    finally:
        query.stop()


def counts_stream(results: DataFrame) -> DataFrame:
    """Running count per status (for complete or update mode)."""
    return results.groupBy("status").agg(F.count("*").alias("n"))


def counts_sink(
    results: DataFrame, root: str, checkpoint: str, trigger: dict | None = None, key: Column | None = None
) -> StreamingQuery:
    """Running counts per status, kept as one small table for each batch that changed them.

    Each batch adds its own counts to those of the batch before, so nothing is collected
    and a replayed batch replaces itself. :func:`last_counts` reads the newest.
    """
    status = (key if key is not None else F.col("status")).alias("status")

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        now = batch.groupBy(status).agg(F.count("*").alias("n"))
        if batch_id and _exists(spark, f"{root}/batch={batch_id - 1}"):
            now = now.unionByName(spark.read.parquet(f"{root}/batch={batch_id - 1}"))
            now = now.groupBy("status").agg(F.sum("n").alias("n"))
        _write(now.coalesce(1), root, batch_id)

    return (
        results.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def last_counts(spark: SparkSession, root: str) -> DataFrame:
    """The counts after the last batch of :func:`counts_sink`."""
    rows = spark.read.option("basePath", root).parquet(f"{root}/batch=*")
    last = rows.agg(F.max("batch").alias("last"))
    return rows.join(F.broadcast(last), F.col("batch") == F.col("last")).select("status", "n")
