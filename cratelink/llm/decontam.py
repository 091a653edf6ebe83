"""Benchmark decontamination by a prefix-filtered join of item windows with documents.

A window is *width* consecutive item words; a shorter item is one window. A document
holds a window when the window's words stand in it one after the other. All shingles of
a held window are in the document, so by the prefix filter for full containment one
shingle of the window suffices to find it: its rarest, by the count over all documents.
A met shingle fixes where the window would lie; that place must be inside the document
(length and position bounds), and then the words are compared one by one.

The items may be many: their (window, item) pairs are dealt into blocks of about
*block_pairs* pairs, and each block is broadcast and scanned in turn, so what is
broadcast never grows with the benchmark. Rows stay where they are; nothing is shuffled
but the shingle counts.

Null and empty texts have no words and hold nothing. Items without words have no window.
Repeated items count once, repeated documents each get their row. Null item ids are left
out. An empty benchmark leaves every document clean.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from cratelink.llm.common import WORD_TABLE, batch_of, map_text, row_of, schema_of, texts, words_of

#: Words of a shingle, or all words of a shorter window.
SHINGLE = 3
#: (window, item) pairs of a block, on average; a pair is some hundred bytes.
BLOCK_PAIRS = 100_000
#: Candidates compared at once.
COMPARED = 1 << 17

_FILTER_BITS = 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: No UTF-8 text holds this byte, so it can stand between texts as a word of its own.
_GAP = b"\xff"


def item_windows(items: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Distinct (window, item): the window's words joined by spaces, the id as text."""
    source = items.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")
    )
    schema = pa.schema([("window", pa.binary()), ("item", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                words = words_of(text)
                for at in range(0, max(0, len(words) - width) + (len(words) > 0), 10_000):
                    last = min(at + 10_000, max(1, len(words) - width + 1))
                    rows = [b" ".join(words[i : i + width]) for i in range(at, last)]
                    yield batch_of(schema, rows, [item] * len(rows))

    return map_text(source, run, "window binary, item string").distinct()


class Block:
    """The windows of one block as word ids, with the shingles that find them."""

    def __init__(self, pairs: list[tuple[bytes, str]], width: int):
        self.width = width
        owners: dict[bytes, list[str]] = {}
        for window, item in sorted(pairs):
            owners.setdefault(window, []).append(item)
        self.items = list(owners.values())
        split = [w.split(b" ") for w in owners]
        self.words: dict[bytes, int] = {_GAP: 0}
        for words in split:
            for word in words:
                self.words.setdefault(word, len(self.words) + 1)
        self.base = len(self.words) + 2
        self.lengths = np.array([len(w) for w in split], dtype=np.int64)
        self.rows = np.zeros((len(split), width), dtype=np.int32)
        for row, words in zip(self.rows, split, strict=True):
            row[: len(words)] = [self.words[w] for w in words]
        self.sizes = sorted({min(SHINGLE, n) for n in self.lengths.tolist()})
        self.codes = {k: np.unique(self._own(k)[0]) for k in self.sizes}
        self.counts = {k: np.zeros(len(c), dtype=np.int64) for k, c in self.codes.items()}

    def _own(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code, window and offset of each shingle of the windows whose shingles have k words."""
        which = np.flatnonzero(np.minimum(self.lengths, SHINGLE) == k)
        codes = self.coded(self.rows[which].ravel(), k)
        window, offset = np.divmod(np.arange(len(codes)), self.width)
        inside = offset + k <= self.lengths[which[window]] if len(which) else np.zeros(0, bool)
        return codes[inside], which[window[inside]], offset[inside]

    def coded(self, ids: np.ndarray, k: int) -> np.ndarray:
        """One number per shingle start, different for different words; short at the end."""
        out = ids.astype(np.int64)
        for step in range(1, k):
            out = out[: len(ids) - step] * self.base + ids[step:]
        return out

    def index(self) -> None:
        """Keep, for each window, its rarest shingle; equal counts go to the smaller code."""
        self.prefix = {}
        for k in self.sizes:
            codes, window, offset = self._own(k)
            count = self.counts[k][np.searchsorted(self.codes[k], codes)]
            order = np.lexsort((offset, codes, count, window))
            keep = order[np.flatnonzero(np.diff(window[order], prepend=-1))]
            keep = keep[np.argsort(codes[keep], kind="stable")]
            known, first = np.unique(codes[keep], return_index=True)
            self.prefix[k] = (known, np.append(first, len(keep)), window[keep], offset[keep], _filter(known))

    def read(self, batch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Word ids of all texts and the place where each text starts; a gap parts them."""
        words = (b" \xff ".join(batch) + b" \xff").translate(WORD_TABLE).split()
        ids = np.fromiter(map(self.words.get, words, repeat(1)), dtype=np.int32, count=len(words))
        gaps = np.flatnonzero(ids == 0)
        return ids, np.concatenate([[0], gaps + 1])

    def count(self, ids: np.ndarray) -> None:
        for k in self.sizes:
            places, _ = _met(self.coded(ids, k), self.codes[k], _filter(self.codes[k]))
            np.add.at(self.counts[k], places[1], 1)

    def held(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, window and start of every window held by a text of the batch."""
        found = []
        for k in self.sizes:
            known, first, window, offset, seen = self.prefix[k]
            (at, which), _ = _met(self.coded(ids, k), known, seen)
            n = first[which + 1] - first[which]
            row = np.repeat(first[which], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            begin, w = np.repeat(at, n) - offset[row], window[row]
            text = np.searchsorted(starts, np.repeat(at, n), side="right") - 1
            fits = (begin >= starts[text]) & (begin + self.lengths[w] < starts[text + 1])
            found.append((text[fits], w[fits], begin[fits]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        text, w, begin = (np.concatenate(x) for x in zip(*found, strict=True))
        same = np.zeros(len(w), dtype=bool)
        step = np.arange(self.width)
        for a in range(0, len(w), COMPARED):
            part = slice(a, a + COMPARED)
            place = np.minimum(begin[part, None] + step, len(ids) - 1)
            same[part] = ((ids[place] == self.rows[w[part]]) | (step >= self.lengths[w[part], None])).all(axis=1)
        return text[same], w[same], begin[same]


def _filter(codes: np.ndarray) -> np.ndarray:
    seen = np.zeros(1 << _FILTER_BITS, dtype=bool)
    seen[(codes.astype(np.uint64) * _MIX) >> np.uint64(64 - _FILTER_BITS)] = True
    return seen


def _met(codes: np.ndarray, known: np.ndarray, seen: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], int]:
    """Places whose code is known, and which it is."""
    at = np.flatnonzero(seen[(codes.astype(np.uint64) * _MIX) >> np.uint64(64 - _FILTER_BITS)])
    if not len(at) or not len(known):
        return (np.zeros(0, np.int64), np.zeros(0, np.int64)), 0
    which = np.minimum(np.searchsorted(known, codes[at]), len(known) - 1)
    good = known[which] == codes[at]
    return (at[good], which[good]), len(at)


def _joined(old: list[tuple[int, int]], new: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(old + new):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _counted(source: DataFrame, block: Block) -> None:
    """Count the block's shingles over all documents; the counts are as many as the shingles."""
    shared = source.sparkSession.sparkContext.broadcast(block)
    schema = pa.schema([("k", pa.int32()), ("at", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for k in own.sizes:
            own.counts[k][:] = 0
        for batch in batches:
            own.count(own.read(texts(batch.column(0)))[0])
        for k in own.sizes:
            at = np.flatnonzero(own.counts[k])
            yield batch_of(schema, np.full(len(at), k, np.int32), at, own.counts[k][at])

    rows = map_text(source.select("text"), run, "k int, at long, n long").groupBy("k", "at").agg(F.sum("n").alias("n"))
    got = rows.toArrow()
    sizes, at, n = (got.column(c).to_numpy() for c in ("k", "at", "n"))
    for k in block.sizes:
        block.counts[k][:] = 0
        block.counts[k][at[sizes == k]] = n[sizes == k]
    shared.unpersist()


_SPANS = "array<struct<start:int,end:int>>"
_SPANS_PA = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def scan(
    docs: DataFrame,
    items: DataFrame,
    keep: Sequence[str] = ("doc_id",),
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = 10,
    block_pairs: int = BLOCK_PAIRS,
) -> DataFrame:
    """Words of each document that lie in a benchmark window, and the items they come from.

    Returns ``row`` (the kept columns), ``n_words``, ``spans`` (ranges of words that are
    hit, in order, end exclusive, not touching) and ``items`` (ids as sorted texts).
    """
    windows = item_windows(items, item_id, item_text, width)
    blocks = max(1, -(-windows.count() // block_pairs))
    windows = windows.withColumn("block", F.pmod(F.xxhash64("window", "item"), F.lit(blocks)))
    source = docs.select(row_of(keep), F.col(text_col).alias("text"))
    row_type = source.schema["row"].dataType
    plain = source.select("text")
    df = source.select(
        "row",
        "text",
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast(_SPANS).alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    for number in range(blocks):
        got = windows.where(F.col("block") == number).select("window", "item").toArrow()
        block = Block(list(zip(*(got.column(c).to_pylist() for c in ("window", "item")), strict=True)), width)
        _counted(plain, block)
        block.index()
        df = _scanned(df, block, row_type, with_text=number + 1 < blocks)
    return df


def _scanned(df: DataFrame, block: Block, row_type: DataType, with_text: bool) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            ids, starts = own.read(texts(batch.column(1)))
            text, window, begin = own.held(ids, starts)
            spans: dict[int, list[tuple[int, int]]] = {}
            items: dict[int, set[str]] = {}
            place = begin - starts[text]
            order = np.lexsort((place, text))
            for t, w, a in zip(text[order].tolist(), window[order].tolist(), place[order].tolist(), strict=True):
                b = a + int(own.lengths[w])
                mine = spans.setdefault(t, [])
                if mine and a <= mine[-1][1]:
                    mine[-1] = (mine[-1][0], max(b, mine[-1][1]))
                else:
                    mine.append((a, b))
                items.setdefault(t, set()).update(own.items[w])
            old_spans, old_items = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for t, mine in spans.items():
                joined = _joined([(s["start"], s["end"]) for s in old_spans[t]], mine)
                old_spans[t] = [{"start": a, "end": b} for a, b in joined]
                old_items[t] = sorted(items[t].union(old_items[t]))
            n_words = np.diff(starts) - 1
            columns = [batch.column(0), n_words, pa.array(old_spans, _SPANS_PA), pa.array(old_items, pa.list_(pa.string()))]
            fields = [("row", batch.schema.field(0).type), ("n_words", pa.int64()), ("spans", _SPANS_PA), ("items", pa.list_(pa.string()))]
            if with_text:
                columns.insert(1, batch.column(1))
                fields.insert(1, ("text", pa.string()))
            yield batch_of(pa.schema(fields), *columns)

    text = {"text": "string"} if with_text else {}
    schema = schema_of(row=row_type, **text, n_words="long", spans=_SPANS, items="array<string>")
    return map_text(df, run, schema)
