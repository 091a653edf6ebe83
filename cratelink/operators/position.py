"""Global positions without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cratelink.session import stage

_LOCAL_BITS = 33


def in_blocks(df: DataFrame, *order: Column | str, blocks: int | None = None) -> DataFrame:
    """*df* range-partitioned and sorted, each row with its block and place in it.

    Written once, because blocks must not be drawn anew when a later stage is retried.
    Ranges are cut on the full order, so a popular leading value spans many blocks.
    """
    spark = df.sparkSession
    n = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    row = F.monotonically_increasing_id()
    placed = (
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("_row", row)
        .withColumn("_block", F.shiftright("_row", _LOCAL_BITS).cast("int"))
        .withColumn("_place", F.expr(f"_row & {(1 << _LOCAL_BITS) - 1}"))
        .drop("_row")
    )
    return stage(placed, "blocks")


def numbered(df: DataFrame, *order: Column | str, column: str = "position", blocks: int | None = None) -> DataFrame:
    """*df* with 1..n in the given order.

    Only one count per block passes through the running sum.
    """
    placed = in_blocks(df, *order, blocks=blocks)
    counts = placed.groupBy("_block").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        placed.join(offsets, "_block")
        .withColumn(column, F.col("_before") + F.col("_place") + 1)
        .drop("_block", "_place", "_before")
    )


def chunks(df: DataFrame, *order: Column | str, size: int = 50) -> DataFrame:
    """*df* with its position and the number of its chunk of *size* rows, from 0."""
    size = max(1, size)
    out = numbered(df, *order)
    return out.withColumn("chunk", F.floor((F.col("position") - 1) / size))


def first_n(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first *n* rows in order (a top-n, not a sort of everything)."""
    return df.orderBy(*order).limit(n)


def newest_first(df: DataFrame, column: str, ordinal: str) -> DataFrame:
    """Descending text order of a date column, blanks last, input order among equals."""
    return df.orderBy(F.desc(F.coalesce(F.col(f"`{column}`"), F.lit(""))), F.asc(ordinal))


def first_per_key(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row per key. A combining aggregate, so a popular key stays cheap."""
    rest = [c for c in df.columns if c not in keys]
    picked = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(picked.alias("_f")).select(*keys, "_f.*")
