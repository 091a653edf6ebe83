"""Session helpers: staging of intermediate tables in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Whether Spark deletes the shuffle files of a query when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths staged in the open ``scratch`` blocks, innermost last.
_scratch: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Where the setting is absent, a session whose master is local may use a private
    folder, remembered as its checkpoint folder. On a cluster that is an error: executors
    would write to disks of their own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        check_private(spark.sparkContext.master)
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def check_private(master: str) -> None:
    """Fail unless driver and executors are one process."""
    if not re.match(r"local($|\[)", master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; nothing is created yet."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/{app}/{label}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the tables staged inside the block when it ends.

    What is read after the block must be staged with ``keep``, and so depends on none of
    the deleted ones: a lost executor never needs them again.
    """
    paths: list[str] = []
    _scratch.append(paths)
    try:
        yield
    finally:
        _scratch.pop()
        _delete(spark, paths)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in map(hadoop, paths):
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def staged() -> int:
    """How many tables the open ``scratch`` block has staged: a mark for ``release``."""
    return len(_scratch[-1])


def release(spark: SparkSession, start: int, stop: int) -> None:
    """Delete, before the ``scratch`` block ends, what it staged between two marks.

    For rounds whose tables replace those of the round before.
    """
    _delete(spark, _scratch[-1][start:stop])


def stage(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write *df* once and read it back.

    Cuts the lineage (a lost executor re-reads files instead of recomputing the
    upstream joins), lets several consumers share one computation, and gives the
    optimizer true sizes, so broadcast decisions rest on measured bytes. The shuffle
    files of the write go when it ends, since nothing reads them again. In a ``scratch``
    block the table goes at the end of the block, with *keep* of the block around it.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    if len(_scratch) > keep:
        _scratch[-1 - keep].append(path)
    return spark.read.schema(df.schema).parquet(path)


def collected(df: DataFrame) -> pa.Table:
    """The rows of a small result; the shuffle files that made it go at once, as in ``stage``."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.select("*").toArrow()  # the setting holds for frames made after it
    finally:
        spark.conf.set(_CLEANUP, before)


def shuffled(df: DataFrame) -> DataFrame:
    """*df* as a join side that is sorted and merged, never broadcast.

    The optimizer judges a side before it runs: it takes exploded rows for as few as
    they came from and compressed files for what they hold, and the driver would build
    the whole of a side it thinks small.
    """
    return df.hint("merge")


def local_session(cores: str = "8", app: str = "cratelink", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
