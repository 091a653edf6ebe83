"""Table sinks with fixed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cratelink.schemas import MATCHED_COLUMNS, PURCHASE_COLUMNS


def _csv(df: DataFrame, columns, path: str, mode: str) -> None:
    (
        df.select(*[F.col(f"`{c}`") for c in columns])
        .write.mode(mode)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
        .option("nullValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_purchases(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The 17 purchase columns, in order, with a header per file."""
    _csv(df, PURCHASE_COLUMNS, path, mode)


def write_matched(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The 18 matched columns."""
    _csv(df, MATCHED_COLUMNS, path, mode)


def write_manifest(entries: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Sparse entries as JSON; an unreadable file keeps only its path and finding."""
    entries.write.mode(mode).json(path)
