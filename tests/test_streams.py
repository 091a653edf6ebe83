"""Streams over several batches: resumed, broken off, silent and compacted."""

import time
from collections import Counter

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from tests.test_tables import breaker_rows, brute_breaker

from cratelink.operators import runs
from cratelink.streaming import jobs

LOG = "run int, pos int, status string"


def landing(spark, scratch, schema):
    """Lands rows as one more file; gives the stream of all files, one a batch."""

    def land(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{scratch}/in")
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{scratch}/in")

    return land


def test_enrichment_resumes_after_a_failed_batch(spark, scratch):
    land = landing(spark, scratch, "path string")
    parts = [["a", "b"], ["b", "c"], ["d", "a"], ["e"]]
    for part in parts:
        stream = land([(p,) for p in part])
    asked = Counter()

    def resolver(fail):
        def resolve(batch):
            paths = [r.path for r in batch.collect()]
            if fail & set(paths):
                raise ValueError("worker lost")
            asked.update(paths)
            return batch.withColumn("status", F.lit("matched"))

        return resolve

    def go(checkpoint, fail=frozenset()):
        jobs.enrich_stream(stream, resolver(set(fail)), f"{scratch}/log", f"{scratch}/{checkpoint}").awaitTermination()

    with pytest.raises(StreamingQueryException):
        go("ck", {"d"})
    assert set(asked) == {"a", "b", "c"}
    go("ck")
    stream = land([("f",), ("a",)])
    go("ck")
    assert asked == Counter("abcdef")
    stream = land([("g",), ("b",)])
    go("another")  # a new checkpoint sees all files again, but not what was logged
    assert asked == Counter("abcdefg")
    assert sorted(r.path for r in jobs.read_log(spark, f"{scratch}/log").collect()) == list("abcdefg")


def test_logged_keys_are_not_broadcast(spark, scratch):
    land = landing(spark, scratch, "path string")
    plans = []

    def resolve(batch):
        plans.append(batch._jdf.queryExecution().executedPlan().toString())
        return batch

    stream = land([("a",)])
    for checkpoint in ("one", "two"):
        jobs.enrich_stream(stream, resolve, f"{scratch}/log", f"{scratch}/{checkpoint}").awaitTermination()
    assert "SortMergeJoin" in plans[1] and not any("Broadcast" in plan for plan in plans)


@pytest.mark.parametrize("compact", [50, 2])
def test_breaker_state_holds_touched_runs_only(spark, scratch, monkeypatch, compact):
    monkeypatch.setattr(jobs, "COMPACT", compact)
    land = landing(spark, scratch, LOG)
    early = 0  # half of the log, and silent after two of four batches
    rows = [(r, p if r == early else 4 * (p - 400), s) for r, p, s in breaker_rows()]
    parts = [[x for x in rows if x[1] // 100 == n and (n < 2 or x[0] != early)] for n in range(4)]
    for part in parts:
        stream = land(part)
        jobs.breaker_stream(
            stream, "run", ("pos",), f"{scratch}/log", f"{scratch}/state", f"{scratch}/ck", limit=7
        ).awaitTermination()
    got = sorted((r.run, r.pos, r.streak) for r in jobs.read_log(spark, f"{scratch}/log").collect())
    assert got == brute_breaker([x for part in parts for x in part], 7)
    state = spark.read.option("basePath", f"{scratch}/state").parquet(f"{scratch}/state/batch=*")
    written = {(r.batch, r.run) for r in state.collect()}
    assert (1, early) in written
    assert ((2, early) in written) == (compact == 2)  # a whole write holds every run
    assert (3, early) not in written


def test_watchdog_needs_no_later_event(spark, scratch):
    """The last item of a silent stream is reported by the clock; finished ones are not."""
    now = time.time()
    rows = [("hung", "start", now), ("done", "start", now), ("done", "finish", now), ("early", "finish", now)]
    rows = [(i, e, None if t is None else time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime(t))) for i, e, t in rows]
    spark.createDataFrame(rows, "item string, event string, at string").coalesce(1).write.parquet(f"{scratch}/in")
    events = spark.readStream.schema("item string, event string, at string").parquet(f"{scratch}/in")
    with jobs.on_rocksdb(spark):
        job = (
            jobs.watchdog_stream(events, "item", seconds=3)
            .writeStream.format("parquet")
            .option("path", f"{scratch}/out")
            .option("checkpointLocation", f"{scratch}/ck")
            .start()
        )
    try:
        deadline, found = time.monotonic() + 60, []
        while not found and time.monotonic() < deadline:
            time.sleep(1)
            found = spark.read.schema("item string, status string").parquet(f"{scratch}/out").collect()
    finally:
        job.stop()
    assert [tuple(r) for r in found] == [("hung", "stuck")]


class SlowQuery:
    """A query whose first batch takes longer than the wait for input."""

    isActive, stopped, error = True, None, None

    def __init__(self):
        self.began = time.monotonic()

    @property
    def recentProgress(self):
        took = time.monotonic() - self.began
        return [{"numInputRows": 5}] * (took > 1.5) + [{"numInputRows": 0}] * (took > 2)

    @property
    def status(self):
        return {"isDataAvailable": not self.recentProgress}

    def exception(self):
        return self.error

    def stop(self):
        self.stopped = time.monotonic() - self.began


def test_quiet_comes_after_the_last_batch_however_long():
    query = SlowQuery()
    jobs.stop_when_quiet(query, seconds=1)
    assert query.stopped > 2
    query.isActive, query.error = False, ValueError("batch failed")
    with pytest.raises(ValueError, match="batch failed"):
        jobs.stop_when_quiet(query)


def test_progress_of_every_batch(spark, scratch):
    schema = "run int, ts timestamp, seq int, status string, label string"
    land = landing(spark, scratch, schema)
    log = spark.range(40).select(
        F.lit(1).alias("run"),
        F.timestamp_seconds(1_700_000_000 + F.col("id")).alias("ts"),
        F.col("id").cast("int").alias("seq"),
        F.when((F.col("id") % 3 == 0) & (F.col("id") < 30), "matched").otherwise("error").alias("status"),
        F.concat(F.lit("item "), F.col("id").cast("string")).alias("label"),
    )
    rows = [tuple(r) for r in log.collect()]
    for n in range(4):
        stream = land(rows[10 * n : 10 * n + 10])
    jobs.progress_stream(stream, f"{scratch}/log", f"{scratch}/metrics", f"{scratch}/ck").awaitTermination()
    seen = spark.read.option("basePath", f"{scratch}/metrics").parquet(f"{scratch}/metrics/batch=*")
    started = F.timestamp_seconds(F.unix_timestamp(F.lit(seen.agg(F.min("at")).first()[0])) - 100)
    got = jobs.batch_progress(seen, F.lit(80), started).orderBy("batch").collect()
    for n, row in enumerate(got, 1):
        want = runs.progress(log.filter(F.col("seq") < 10 * n), F.lit(80), F.lit(100), "run").first()
        assert (row.done, row.matched, row.last_matched, row.pct) == (want.done, want.matched, want.last_matched, want.pct)
        assert 0 < row.rate <= want.rate
    assert len(got) == 4


def test_counts_survive_a_rerun(spark, scratch):
    land = landing(spark, scratch, "status string")
    for part in (["a", "b", "a"], ["b"], ["c", "a"]):
        stream = land([(s,) for s in part])
        jobs.counts_sink(stream, f"{scratch}/counts", f"{scratch}/ck").awaitTermination()
    jobs.counts_sink(stream, f"{scratch}/counts", f"{scratch}/ck").awaitTermination()
    assert {r.status: r.n for r in jobs.last_counts(spark, f"{scratch}/counts").collect()} == {"a": 3, "b": 2, "c": 1}
