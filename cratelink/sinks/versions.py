"""Tables that are written, audited and then published, bucket by bucket.

A version of a table is one small file that names, for each bucket, the folder that holds
its rows. Publishing writes the changed buckets to a new folder, audits them there, and
adds the next version by a rename that fails if it exists. A job that is refused, fails or
is lost before that leaves the old version as it was, and a rerun starts anew; of two jobs
that publish at once, one fails. A change touches the buckets of its keys only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cratelink.session import stage

BUCKETS = 64
_BUCKET = "_bucket"

#: Rows that must not be published, given the new rows and those of the same buckets before.
Audit = Callable[[DataFrame, DataFrame], DataFrame]
Merge = Callable[[DataFrame, DataFrame], DataFrame]


class Refused(Exception):
    """The audit found rows; nothing was published."""


@dataclass(frozen=True)
class Version:
    number: int
    key: str
    buckets: int
    schema: str
    #: Folder of each bucket that has rows.
    parts: dict[str, str]


def _hadoop(spark: SparkSession, path: str):
    """The file system of *path*, and the path for it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _versions(spark: SparkSession, root: str) -> list[int]:
    fs, at = _hadoop(spark, f"{root}/_versions")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n) for n in names if n.isdigit())


def version(spark: SparkSession, root: str, number: int | None = None) -> Version | None:
    """The version *number*, or the newest; None if nothing was published."""
    known = _versions(spark, root)
    if not known or (number is not None and number not in known):
        return None
    number = known[-1] if number is None else number
    text = spark.read.text(f"{root}/_versions/{number:010d}", wholetext=True).first()[0]
    return Version(number, **json.loads(text))


def read(spark: SparkSession, root: str, buckets: Sequence[int] | None = None, number: int | None = None) -> DataFrame:
    """Rows of a version, all or those of some *buckets*; other folders are never listed."""
    of = version(spark, root, number)
    if of is None:
        raise FileNotFoundError(f"no such version of {root}")
    schema = StructType.fromJson(json.loads(of.schema))
    wanted = of.parts if buckets is None else {str(b) for b in buckets} & set(of.parts)
    paths = [f"{root}/{of.parts[b]}/{_BUCKET}={b}" for b in sorted(wanted, key=int)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _commit(spark: SparkSession, root: str, new: Version) -> None:
    """Add the version file in one step; an existing one is an error."""
    fs, draft = _hadoop(spark, f"{root}/_versions/draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    body = {"key": new.key, "buckets": new.buckets, "schema": new.schema, "parts": new.parts}
    out.write(json.dumps(body).encode())
    out.close()
    jvm = spark._jvm
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark._jsc.hadoopConfiguration())
    never = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    files.rename(draft, jvm.org.apache.hadoop.fs.Path(f"{root}/_versions/{new.number:010d}"), never)


def publish(
    rows: DataFrame,
    root: str,
    key: str,
    buckets: int = BUCKETS,
    only: Sequence[int] | None = None,
    audit: Audit | None = None,
) -> int:
    """Write *rows*, audit what was written, and make it the next version; its number.

    *only*: the buckets that *rows* replace, the others stay; None replaces all. A table
    keeps the number of buckets it began with. Null keys share one bucket.
    """
    spark = rows.sparkSession
    old = version(spark, root)
    buckets = old.buckets if old else buckets
    folder = f"data-{uuid.uuid4().hex}"
    placed = rows.withColumn(_BUCKET, bucket_of(key, buckets)).repartition(_BUCKET)
    placed.write.partitionBy(_BUCKET).parquet(f"{root}/{folder}")
    fs, at = _hadoop(spark, f"{root}/{folder}")
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    fresh = {n.split("=")[1]: folder for n in names if n.startswith(f"{_BUCKET}=")}
    gone = {str(b) for b in only} if only is not None else set(old.parts if old else ())
    if only is not None and not set(fresh) <= gone:
        fs.delete(at, True)
        raise ValueError("rows outside the buckets to replace")
    if audit is not None:
        written = spark.read.schema(rows.schema).parquet(*[f"{root}/{folder}/{_BUCKET}={b}" for b in fresh]) if fresh else rows.limit(0)
        before = read(spark, root, only) if old else spark.createDataFrame([], rows.schema)
        found = audit(written, before).limit(1).collect()
        if found:
            fs.delete(at, True)
            raise Refused(f"{root}: {found[0]}")
    kept = {b: f for b, f in (old.parts if old else {}).items() if b not in gone}
    new = Version(old.number + 1 if old else 1, key, buckets, rows.schema.json(), kept | fresh)
    _commit(spark, root, new)
    return new.number


def update(landed: DataFrame, root: str, key: str, merge: Merge, buckets: int = BUCKETS, audit: Audit | None = None) -> int:
    """Merge landed rows into the table, reading and writing the buckets of their keys only.

    *merge* takes the rows of those buckets and the landed rows. Nothing landed, nothing
    published. The landed rows are staged, so they are computed once.
    """
    spark = landed.sparkSession
    old = version(spark, root)
    landed = stage(landed, "landed")
    own = bucket_of(key, old.buckets if old else buckets)
    touched = [r[0] for r in landed.select(own.alias("b")).distinct().collect()]  # at most one a bucket
    if not touched:
        return old.number if old else 0
    before = read(spark, root, touched) if old else landed.limit(0)
    return publish(merge(before, landed), root, key, buckets, touched, audit)


def same_keys(key: str) -> Audit:
    """An audit: keys that repeat, came in or went missing."""

    def audit(written: DataFrame, before: DataFrame) -> DataFrame:
        marked = written.select(key, F.lit(1).alias("n"), F.lit(0).alias("o")).unionByName(
            before.select(key, F.lit(0).alias("n"), F.lit(1).alias("o"))
        )
        counts = marked.groupBy(key).agg(F.sum("n").alias("written"), F.sum("o").alias("before"))
        return counts.where("written <> 1 or before <> 1")

    return audit


def prune(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Delete versions but for the newest *keep*, and folders none of those names.

    To be run while no job publishes: the folder of a running one has no name yet.
    """
    known = _versions(spark, root)
    for number in known[:-keep]:
        fs, at = _hadoop(spark, f"{root}/_versions/{number:010d}")
        fs.delete(at, False)
    used = {f for n in known[-keep:] for f in version(spark, root, n).parts.values()}
    fs, at = _hadoop(spark, root)
    for status in fs.listStatus(at):
        name = status.getPath().getName()
        if name.startswith("data-") and name not in used:
            fs.delete(status.getPath(), True)
