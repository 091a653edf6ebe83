"""Durations and purchase dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cratelink.functions.text import strip

#: The three accepted date forms: with offset, without, date only. Fixed value.
PURCHASE_DATE = (
    r"\A(\d{4})-(1[0-2]|0?[1-9])-(3[01]|[12]\d|0?[1-9])"
    r"(?:T(?:2[0-3]|[01]?\d):[0-5]?\d:[0-5]?\d"
    r"(?:Z|[+-]\d\d:?[0-5]\d(?::?[0-5]\d(?:\.\d{1,6})?)?)?)?\z"
)


def duration_text(ms: Column) -> Column:
    """``m:ss``; minutes may pass 59."""
    seconds = F.floor(ms / 1000)
    return F.concat(
        F.floor(seconds / 60).cast("string"),
        F.lit(":"),
        F.lpad((seconds % 60).cast("string"), 2, "0"),
    )


def seconds_text(seconds: Column) -> Column:
    """``m:ss`` from a length in seconds."""
    return duration_text(F.floor(seconds).cast("bigint") * 1000)


def parse_duration(text: Column) -> Column:
    """``h:m:s``, ``m:s`` or ``s`` in ms; null when any part is not a number."""
    total = F.aggregate(
        F.split(text, ":"),
        F.lit(0).cast("bigint"),
        lambda acc, part: acc * 60 + F.coalesce(part.try_cast("bigint"), F.lit(0)),
    )
    return F.when(text.rlike(r"\A\d+(?::\d+)*\z"), total * 1000)


def purchase_parts(raw: Column) -> Column:
    """``struct(month, year)`` as written, or null when the text is no date.

    The period comes from the text, not from a timestamp, so a row keeps the
    month it shows whatever the session zone is.
    """
    t = strip(raw)
    year = F.regexp_extract(t, PURCHASE_DATE, 1)
    month = F.lpad(F.regexp_extract(t, PURCHASE_DATE, 2), 2, "0")
    day = F.lpad(F.regexp_extract(t, PURCHASE_DATE, 3), 2, "0")
    real = F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-MM-dd").isNotNull()
    return F.when(
        (year != "") & (year != "0000") & real,
        F.struct(F.concat_ws("-", year, month).alias("month"), year.alias("year")),
    )
