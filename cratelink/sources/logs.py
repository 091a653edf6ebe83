"""Manifests and result logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cratelink.schemas import MANIFEST, RESULT_LOG

_CORRUPT = "_corrupt"


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(hadoop_path)


def read_manifest(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """Entries of JSON manifests that name a path; other elements are skipped.

    A manifest is one entry per line, which splits over tasks. *array* reads the form of
    one JSON array per file, each file in one task.
    """
    df = spark.read.schema(MANIFEST).option("multiLine", array).option("mode", "PERMISSIVE").json(path)
    return df.filter(F.coalesce("path", F.lit("")) != "")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Result log lines. Corrupt and non-object lines drop out; no file, no rows."""
    if not _exists(spark, path):
        return spark.createDataFrame([], RESULT_LOG)
    schema = T.StructType([*RESULT_LOG.fields, T.StructField(_CORRUPT, T.StringType())])
    lines = spark.read.text(path)
    is_object = F.startswith(F.ltrim("value"), F.lit("{"))
    rows = lines.filter(is_object).select(
        F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}).alias("r")
    )
    return rows.filter("r is not null and r._corrupt is null").select(*[f"r.{f.name}" for f in RESULT_LOG.fields])


def matched_rows(log: DataFrame) -> DataFrame:
    """Logged matches that carry an id or a snapshot."""
    has_snapshot = F.col("snapshot").isNotNull() & (F.size("snapshot") > 0)
    return log.filter((F.col("status") == "matched") & ((F.coalesce("candidate_id", F.lit(0)) != 0) | has_snapshot))


def done_paths(log: DataFrame) -> DataFrame:
    return log.select(F.coalesce("path", F.lit("")).alias("path")).distinct()


def append_log(results: DataFrame, path: str) -> None:
    """One JSON line per finished item."""
    results.select(*[f.name for f in RESULT_LOG.fields]).write.mode("append").json(path)


def result_record(columns: dict[str, Column]) -> Column:
    """A machine-readable record of one result."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in columns.items()]), {"ignoreNullFields": "false"})
