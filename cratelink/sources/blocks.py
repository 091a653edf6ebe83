"""Big single files read by many tasks: quoted CSV, and one JSON array per file.

A file is cut at one character (line ends, or closing braces), so its blocks are read by
different tasks. Whether a piece lies inside quotes, or how deep, depends on all before it.
So each piece is described by what it does to either state; that is summed up per block,
one row per block crosses blocks, and every piece then knows where it starts. Pieces that
are whole records stay as they are, and only the pieces of longer records are gathered,
never more than one record at a time.

The pieces are written once, as one shuffle by block has put them in order. A quote that
is never closed swallows the rest of its file, but for a last line end; that is one record.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from cratelink.schemas import MANIFEST, PURCHASE_COLUMNS
from cratelink.session import stage

_SPLIT = "spark.sql.files.maxPartitionBytes"
_BLOCK = ("file", "block")

#: A quoted field up to its closing quote; doubled quotes belong to it.
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+'
#: A line that starts outside quotes ends inside them. Quotes within a bare field are text.
_OPENS = rf'\A(?:[^",][^,]*+,|,|{_QUOTED}"[^,]*+,)*+{_QUOTED}\z'
#: A line that starts inside quotes holds no closing one; and what comes with the closing one.
_STAYS = r'\A[^"]*+(?:""[^"]*+)*+\z'
_CLOSES = r'\A[^"]*+(?:""[^"]*+)*+"[^,]*+(?:,|\z)'
#: What may stand before an object of an array: anything but braces, and texts.
_BETWEEN = r'\A(?:[^"{]|"(?:[^"\\]|\\.)*+")*+'


def _in_block() -> WindowSpec:
    return Window.partitionBy(*_BLOCK).orderBy("at")


def _earlier() -> WindowSpec:
    """The blocks of the file before this one."""
    return Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


@contextmanager
def _split_at(spark: SparkSession, size: int | None) -> Iterator[None]:
    """Blocks of at most *size* bytes for what is read inside."""
    before = spark.conf.get(_SPLIT)
    if size:
        spark.conf.set(_SPLIT, str(size))
    try:
        yield
    finally:
        spark.conf.set(_SPLIT, before)


def _pieces(spark: SparkSession, path: str, end: str) -> DataFrame:
    """Pieces of files with their place: file, start of the block, number in reading order."""
    return spark.read.option("lineSep", end).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        "value",
    )


def _carried(rows: DataFrame, group: tuple[str, ...], order: str) -> DataFrame:
    """``fixed`` and ``odd`` of each row become those of all rows up to it.

    A row sets the state (``fixed``), turns it round (``odd``) or leaves it. The last row
    that sets it and the turns since then decide; without one, all turns do.
    """
    w = Window.partitionBy(*group).orderBy(order)
    rows = rows.withColumn("turns", F.sum(F.col("odd").cast("int")).over(w))
    setting = F.when(F.col("fixed").isNotNull(), F.struct("fixed", "turns"))
    rows = rows.withColumn("last", F.last(setting, ignorenulls=True).over(w))
    since = (F.col("turns") - F.col("last.turns")) % 2 == 1
    return rows.withColumn("fixed", F.col("last.fixed") != since).withColumn("odd", F.col("turns") % 2 == 1).drop("turns", "last")


def _records(lines: DataFrame, glue: str) -> DataFrame:
    """Whole records (``file``, ``value``) of pieces that say whether they start and end one."""
    whole = lines.where("starts and ends").select("file", "value")
    parts = lines.where("not (starts and ends)")
    start = F.last(F.when(F.col("starts"), F.struct("block", "at")), ignorenulls=True).over(_in_block())
    parts = parts.withColumn("start", start)
    blocks = parts.groupBy(*_BLOCK).agg(F.max("start").alias("latest"))
    blocks = blocks.select(*_BLOCK, F.max("latest").over(_earlier()).alias("earlier"))
    parts = parts.join(blocks, [*_BLOCK]).withColumn("start", F.coalesce("start", "earlier"))
    sewn = parts.groupBy("file", "start").agg(F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("all"))
    value = F.array_join(F.transform("all", lambda p: p["value"]), glue)
    return whole.unionByName(sewn.select("file", value.alias("value")))


def csv_records(spark: SparkSession, path: str, block_bytes: int | None = None) -> DataFrame:
    """Records of quoted CSV files, headers included: ``file``, ``value``, ``head``.

    Lines end in LF or CRLF, as the first line of a file shows; in a CRLF file the breaks
    inside fields become LF. ``head`` marks the first line of a file.
    """
    with _split_at(spark, block_bytes):
        lines = _pieces(spark, path, "\n")
        opens = F.col("value").rlike(_OPENS)
        stays = F.col("value").rlike(_STAYS) | F.regexp_replace("value", _CLOSES, "").rlike(_OPENS)
        lines = lines.withColumn("opens", opens).withColumn("stays", stays)
        lines = lines.withColumn("fixed", F.when(F.col("opens") == F.col("stays"), F.col("opens")))
        lines = lines.withColumn("odd", F.col("opens") & ~F.col("stays")).drop("opens", "stays")
        lines = _carried(lines, _BLOCK, "at")
        blocks = lines.groupBy(*_BLOCK).agg(F.max_by(F.struct("fixed", "odd"), "at").alias("of")).select(*_BLOCK, "of.*")
        of_file = Window.partitionBy("file").orderBy("block")
        enters = F.coalesce(F.lag("fixed").over(of_file), F.lag("odd").over(of_file), F.lit(False))
        blocks = _carried(blocks, ("file",), "block").select(*_BLOCK, enters.alias("enters"))
        lines = lines.join(blocks, [*_BLOCK])
        after = F.coalesce("fixed", F.col("enters") != F.col("odd"))
        inside = F.coalesce(F.lag("after").over(_in_block()), "enters")
        lines = lines.withColumn("after", after).withColumn("inside", inside)
        head = (F.col("block") == 0) & (F.row_number().over(_in_block()) == 1)
        flags = {"starts": ~F.col("inside"), "ends": ~F.col("after"), "head": head}
        lines = stage(lines.select(*_BLOCK, "at", "value", *[c.alias(n) for n, c in flags.items()]), "csv-lines")
    heads = lines.where("head").select("file", F.endswith("value", F.lit("\r")).alias("crlf"), F.col("value").alias("first"))
    lines = lines.join(heads.select("file", "crlf"), "file")
    lines = lines.withColumn("value", F.when(F.col("crlf"), F.regexp_replace("value", r"\r\z", "")).otherwise(F.col("value")))
    body = _records(lines.where("not head"), "\n").withColumn("head", F.lit(False))
    return body.unionByName(heads.select("file", F.regexp_replace("first", r"\r\z", "").alias("value"), F.lit(True).alias("head")))


def read_csv(spark: SparkSession, path: str, columns=PURCHASE_COLUMNS, block_bytes: int | None = None) -> DataFrame:
    """Like ``purchases.read_csv``, with many tasks per file.

    Text columns, ``''`` for missing. A file whose header is not *columns* is an error, an
    empty file or one of a header only has no rows, and empty lines are skipped.
    """
    records = csv_records(spark, path, block_bytes)
    names = F.regexp_replace("value", '^\ufeff|"', "")
    checked = F.when(names != ",".join(columns), F.raise_error(F.concat(F.lit("other columns in "), "file")))
    records = records.withColumn("value", F.when(F.col("head"), F.coalesce(checked.cast("string"), F.lit(""))).otherwise(F.col("value")))
    options = {
        "quote": '"',
        "escape": '"',
        "lineSep": "\n",
        "ignoreLeadingWhiteSpace": "false",
        "ignoreTrailingWhiteSpace": "false",
        "mode": "PERMISSIVE",
    }
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = records.where(F.col("value") != "").select(F.from_csv("value", schema, options).alias("r"))
    return rows.select("r.*").na.fill("")


def _braces(segments: Column, side: int) -> Column:
    own = F.array_join(F.filter(segments, lambda s, i: i % 2 == side), "")
    return F.length(F.regexp_replace(own, r"[^{]", ""))


def json_objects(spark: SparkSession, path: str, block_bytes: int | None = None) -> DataFrame:
    """The objects of files that hold JSON arrays, one or several: ``file``, ``value``.

    The files are cut at closing braces, so an array on one line splits as well. Elements
    that are no objects are skipped; an array inside the array gives its objects.
    """
    with _split_at(spark, block_bytes):
        rows = _pieces(spark, path, "}")
        segments = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"')
        rows = rows.withColumn("segments", segments).withColumn("odd", F.size("segments") % 2 == 0)
        rows = rows.withColumn("up_outside", _braces(F.col("segments"), 0)).withColumn("up_inside", _braces(F.col("segments"), 1))
        rows = rows.drop("segments").withColumn("turned", F.sum(F.col("odd").cast("int")).over(_in_block()) % 2 == 1)
        # What the piece does to the depth if its block starts outside texts, and inside.
        starts_turned = F.col("turned") != F.col("odd")
        change = lambda entered: (
            F.when(starts_turned != entered, F.col("up_inside")).otherwise(F.col("up_outside"))
            - F.when(F.col("turned") != entered, 0).otherwise(1)
        )
        rows = rows.withColumn("outside", change(F.lit(False))).withColumn("inside", change(F.lit(True)))
        sums = rows.groupBy(*_BLOCK).agg(
            F.sum("outside").alias("outside"), F.sum("inside").alias("inside"), F.sum(F.col("odd").cast("int")).alias("quotes")
        )
        sums = sums.withColumn("entered", F.coalesce(F.sum("quotes").over(_earlier()), F.lit(0)) % 2 == 1)
        sums = sums.withColumn("deeper", F.when(F.col("entered"), F.col("inside")).otherwise(F.col("outside")))
        sums = sums.select(*_BLOCK, "entered", F.coalesce(F.sum("deeper").over(_earlier()), F.lit(0)).alias("depth"))
        rows = rows.join(sums, [*_BLOCK])
        own = F.when(F.col("entered"), F.col("inside")).otherwise(F.col("outside"))
        rows = rows.withColumn("own", own).withColumn("after", F.col("depth") + F.sum("own").over(_in_block()))
        rows = rows.withColumn("before", F.col("after") - F.col("own"))
        # A piece on the ground without an opening brace is the end of the array.
        rows = rows.where((F.col("before") > 0) | (F.col("after") >= 0))
        # On the ground and outside texts; a brace within a text ends a piece, but no object.
        starts = (F.col("before") == 0) & (starts_turned == F.col("entered"))
        ends = (F.col("after") == 0) & (F.col("turned") == F.col("entered"))
        value = F.concat("value", F.lit("}")).alias("value")
        rows = stage(rows.select(*_BLOCK, "at", value, starts.alias("starts"), ends.alias("ends")), "json-pieces")
    return _records(rows, "").select("file", F.regexp_replace("value", _BETWEEN, "").alias("value"))


def read_manifest(spark: SparkSession, path: str, block_bytes: int | None = None) -> DataFrame:
    """Like ``logs.read_manifest`` of the array form, with many tasks per file."""
    found = json_objects(spark, path, block_bytes).select(F.from_json("value", MANIFEST).alias("r")).select("r.*")
    return found.filter(F.coalesce("path", F.lit("")) != "")
