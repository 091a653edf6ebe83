"""Ranked lexical search: the best documents for each item, counted by a scan of the texts.

No index of the documents is kept. The terms of all items go into one Aho-Corasick
automaton, each guarded by a blank on both sides, and every text, its separators turned
into blanks, runs through it: what comes out are whole terms with their counts, and each
term leads to the items that hold it. A first scan counts documents, terms and document
frequencies; a second one scores, keeping in each task only the best of every item.

Items are taken in blocks of at most BLOCK_TERMS distinct terms and BLOCK_ITEMS items (an
item of more terms is a block of its own), each scanned by jobs of its own whose results
are written down, so what is broadcast does not grow with the number of items.

* Null and empty texts hold no term: such a document is not counted and never found, such
  an item finds nothing. A very long text is one row, read whole.
* Rows of one item id are one item: its distinct texts one after the other, so repeated
  rows count once. A null item id is an id like any other.
* Every document row ranks on its own, repeated ones too. Equal scores go by document id,
  null ids last.
* Empty tables give an empty result. Extra columns are never read, so their names may clash.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cratelink.llm.common import WORD_TABLE, batch_of, map_text, texts, words_of
from cratelink.session import stage

#: Documents reported for each item.
TOP = 20
#: Distinct terms, and items, of one automaton.
BLOCK_TERMS, BLOCK_ITEMS = 200_000, 4096
#: Cells of documents times items that are scored at once.
CELLS = 1 << 18
#: A null document id among ids: after all others.
_NO_ID = np.iinfo(np.int64).max


class Automaton:
    """The terms of a block of items, and for each term its items with its repeats in them."""

    def __init__(self, items: list[list[bytes]]):
        held = [Counter(terms) for terms in items]
        self.terms = sorted(set().union(*held)) if held else []
        self.n_items = len(items)
        place = {t: i for i, t in enumerate(self.terms)}
        pairs = sorted((place[t], i, n) for i, own in enumerate(held) for t, n in own.items())
        term, self.item, self.repeats = (np.array(c, dtype=np.int64) for c in zip(*pairs, strict=True)) if pairs else ([], None, None)
        self.starts = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self._machine = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_machine": None}

    def build(self) -> ahocorasick.Automaton:
        if self._machine is None:
            self._machine = ahocorasick.Automaton()
            for i, term in enumerate(self.terms):
                self._machine.add_word(f" {term.decode('latin-1')} ", i)
            self._machine.make_automaton()
        return self._machine

    def counts(self, text: bytes) -> tuple[int, np.ndarray, np.ndarray]:
        """Number of terms of a text, the automaton's terms in it and how often each occurs."""
        line = text.translate(WORD_TABLE)
        found = Counter(i for _, i in self.build().iter(f" {line.decode('latin-1')} "))
        size = len(found)
        return len(line.split()), np.fromiter(found.keys(), np.int64, size), np.fromiter(found.values(), np.int64, size)


def blocks_of(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Item ids and terms, in blocks of bounded size; rows reach the driver one by one."""
    one = items.where(F.col(text_col).isNotNull()).groupBy(F.col(id_col).alias("item"))
    one = one.agg(F.array_sort(F.collect_set(text_col)).alias("texts")).orderBy("item")
    ids, terms, seen = [], [], set()
    for row in one.toLocalIterator():
        own = [t for text in row["texts"] for t in words_of(text.encode())]
        if not own:
            continue
        if ids and (len(seen.union(own)) > BLOCK_TERMS or len(ids) == BLOCK_ITEMS):
            yield ids, terms
            ids, terms, seen = [], [], set()
        ids.append(row["item"])
        terms.append(own)
        seen.update(own)
    if ids:
        yield ids, terms


def statistics(source: DataFrame, automaton: Automaton) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all documents, and the document frequency of each term."""
    shared = source.sparkSession.sparkContext.broadcast(automaton)
    schema = pa.schema([("term", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        sums = np.zeros(len(own.terms) + 2, dtype=np.int64)
        for batch in batches:
            for text in texts(batch.column(1)):
                n, found, _ = own.counts(text)
                sums[0] += n > 0
                sums[1] += n
                sums[found + 2] += 1
        held = np.flatnonzero(sums)
        yield batch_of(schema, held - 2, sums[held])

    rows = map_text(source, run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros(len(automaton.terms) + 2, dtype=np.int64)
    sums[rows.column("term").to_numpy() + 2] = rows.column("n").to_numpy()
    return int(sums[0]), int(sums[1]), sums[2:]


class Best:
    """The best documents of every item so far."""

    def __init__(self, n_items: int, top: int):
        self.top = top
        self.rows: list[list[tuple[int, int]]] = [[] for _ in range(n_items)]  # (-score, id), best first
        self.least = np.zeros(n_items, dtype=np.int64)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        for item in np.flatnonzero((scores >= np.maximum(self.least, 1)).any(axis=0)):
            column = scores[:, item]
            at = np.flatnonzero(column >= max(self.least[item], 1))
            rows = sorted(self.rows[item] + list(zip((-column[at]).tolist(), ids[at].tolist(), strict=True)))
            self.rows[item] = rows[: self.top]
            if len(rows) >= self.top:
                self.least[item] = -rows[self.top - 1][0]


def _scored(source: DataFrame, automaton: Automaton, stats: tuple[int, int, np.ndarray], top: int) -> DataFrame:
    """``place`` of the item in its block, ``doc_id`` and ``score``: the best of every task."""
    n_docs, n_terms, df = stats
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)
    shared = source.sparkSession.sparkContext.broadcast((automaton, weights))
    schema = pa.schema([("place", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weight = shared.value
        best = Best(own.n_items, top)
        step = max(1, CELLS // max(1, own.n_items))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                ids = part.column(0).fill_null(_NO_ID).to_numpy()
                scores = np.zeros((part.num_rows, own.n_items), dtype=np.int64)
                for row, text in enumerate(texts(part.column(1))):
                    n, term, tf = own.counts(text)
                    if len(term):
                        m = 100 - 25 + (25 * n * n_docs) // n_terms
                        value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))
                        size = own.starts[term + 1] - own.starts[term]
                        at = np.repeat(own.starts[term] - np.cumsum(size) + size, size) + np.arange(size.sum())
                        np.add.at(scores[row], own.item[at], own.repeats[at] * np.repeat(value, size))
                best.add(ids, scores)
        for place, rows in enumerate(best.rows):
            if rows:
                score, doc = zip(*rows, strict=True)
                known = [None if d == _NO_ID else d for d in doc]
                yield batch_of(schema, [place] * len(rows), known, [-s for s in score])

    return map_text(source, run, "place long, doc_id long, score long")


def search(
    docs: DataFrame,
    items: DataFrame,
    doc_col: str = "doc_id",
    item_col: str = "item_id",
    text_col: str = "text",
    top: int = TOP,
) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id`` and ``score`` of the *top* documents of each item."""
    spark = docs.sparkSession
    kind = items.select(F.col(item_col).alias("item_id")).schema["item_id"].dataType.simpleString()
    source = docs.select(F.col(doc_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    order = Window.partitionBy("place").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    for ids, terms in blocks_of(items, item_col, text_col):
        automaton = Automaton(terms)
        stats = statistics(source, automaton)
        found = _scored(source, automaton, stats, top).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        names = spark.createDataFrame(list(enumerate(ids)), f"place long, item_id {kind}")
        found = found.join(names, "place").select("item_id", "rank", "doc_id", "score")
        out = out.unionByName(stage(found, "search-block"))
    return out
