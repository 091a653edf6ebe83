"""Helpers shared by the text operators: batches, words, hashes, bounded counters."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

#: Text bytes handled at once by vectorised code; a longer text is one batch of its own.
SLICE_BYTES = 1 << 20
#: Rows of an Arrow batch, at most.
BATCH_ROWS = 1000
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Distinct keys a task counts before it hands its counts on.
COUNTER_KEYS = 200_000

_UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Lower-cases A-Z and blanks every ASCII character that is neither a letter nor a digit.
WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
#: Lower-cases A-Z only; words then are what white space separates.
LOWER_TABLE = _UPPER


def prepare(spark: SparkSession) -> None:
    """Let Python workers find this package where they share the driver's code path.

    Arrow batches are made of fewer rows than usual: texts are long, and a batch is held
    by the executor and by its worker at once.
    """
    if int(spark.conf.get(_BATCH_ROWS)) > BATCH_ROWS:
        spark.conf.set(_BATCH_ROWS, BATCH_ROWS)
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{known}" if known else root


def map_text(
    df: DataFrame, fn: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType
) -> DataFrame:
    """``mapInArrow`` whose input batches are cut to about SLICE_BYTES of text."""
    prepare(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fn(sliced(batches))

    return df.mapInArrow(run, schema)


def sliced(batches: Iterable[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about *limit* bytes; rows are never cut."""
    for batch in batches:
        rows = batch.num_rows
        if rows == 0:
            continue
        sizes = np.zeros(rows, dtype=np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                sizes += np.diff(_offsets(column))
        ends = np.cumsum(sizes)
        start = 0
        while start < rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def _offsets(column: pa.Array) -> np.ndarray:
    raw = np.frombuffer(column.buffers()[1], dtype=np.int32)
    return raw[column.offset : column.offset + len(column) + 1]


def texts(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null is empty."""
    return column.cast(pa.binary()).fill_null(b"").to_pylist()


def strings(column: pa.Array) -> list[str]:
    return column.fill_null("").to_pylist()


def words_of(text: bytes) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters, A-Z lower-cased."""
    return text.translate(WORD_TABLE).split()


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    arrays = [
        c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, SLICE_BYTES + (SLICE_BYTES >> 3))
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.empty(size, dtype=np.uint64)
            table[0] = 1
            table[1:] = np.uint64(base)
            _powers[key] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


_BYTE_CODE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def word_hashes(data: np.ndarray, breaks: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a batch at once, and the number of words of each text.

    *data*: the bytes of all texts, one after the other; *breaks*: where texts start,
    and the end; *separator*: for each byte value, whether it parts words.
    """
    n = len(data)
    texts_n = len(breaks) - 1
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(texts_n, np.int64)
    inside = ~separator[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = breaks[:-1][breaks[:-1] < n]
    first[at] = inside[at]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = breaks[1:-1]
    before = before[(before > 0) & (before < n)] - 1
    last[before] = inside[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODE[data] * up[:n], out=total[1:])
    hashes = mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.diff(np.searchsorted(starts, breaks))


def bucket_of(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id as text, modulo *parts*; a null id counts as an empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % parts


def row_of(keep: Sequence[str]) -> Column:
    """The named columns as one struct ``row``, so that they cannot clash with results."""
    quoted = ((c, "`" + c.replace("`", "``") + "`") for c in keep)
    return F.struct(*[F.col(q).alias(c) for c, q in quoted]).alias("row")


def schema_of(**fields: DataType | str) -> StructType:
    """A schema of named types; a text is a type as SQL writes it."""
    out = StructType()
    for name, kind in fields.items():
        out.add(name, StructType.fromDDL(f"x {kind}").fields[0].dataType if isinstance(kind, str) else kind)
    return out
