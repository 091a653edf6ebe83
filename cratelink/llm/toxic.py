"""Toxicity: a weighted lexicon matched by an Aho-Corasick automaton over folded text.

Folding lower-cases, turns look-alike letters of other scripts into Latin ones and undoes
digit substitutions inside words, then parts words by single blanks. The lexicon is
learned, words and beginnings of words: a weight is the log odds of a term between toxic
and other labelled documents, less one standard error. Exception phrases take back the
hits they cover. Weight per document and per hundred words go through a logistic function
fitted on the labelled documents.

Null and empty texts have no hits and score as such. Documents without a label, or with
a null one, teach nothing; of repeated labels each counts. Without any labels all scores
are 0. Rows are independent; repeated rows repeat their result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cratelink.llm.common import COUNTER_KEYS, WORD_TABLE, batch_of, map_text, row_of, schema_of, strings

#: Labelled documents that are learned from; of more, a sample of this expected size.
SAMPLE = 200_000
#: Least toxic documents of a word of the lexicon, and its least weight.
LEAST_DOCS = 3
LEAST_WEIGHT = 1.5
#: Harmless phrases around words that are often meant badly.
EXCEPTIONS = (
    "trash can",
    "trash bag",
    "trash bin",
    "clown fish",
    "circus clown",
    "pond scum",
    "not stupid",
    "not worthless",
)
#: Letters of the beginnings that can be terms.
STEMS = (4, 5, 6)
#: Longest word that can be a term.
_LONGEST = 40

#: Look-alikes of Latin letters (fixed values).
_LOOKS_LIKE = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t",
    "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ɡ": "g", "һ": "h", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
_FOLDS = str.maketrans(
    _LOOKS_LIKE
    | {chr(0xFF41 + i): chr(97 + i) for i in range(26)}
    | {chr(0xFF10 + i): chr(48 + i) for i in range(10)}
    | {"​": "", "‌": "", "‍": "", "­": "", "﻿": ""}
)
_FOLDED = re.compile("[" + "".join(map(chr, _FOLDS)) + "]")
#: Digits and signs written for letters (fixed values).
_SUBSTITUTES = str.maketrans("01345789@$!|+", "oieastbga" + "silt")
_SUBSTITUTED = re.compile(r"[0-9@$!|+]")
_EDGE = "!|+@$"


def folded(text: str) -> list[bytes]:
    """Words of the folded text."""
    text = text.lower()
    if not text.isascii() and _FOLDED.search(text):
        text = text.translate(_FOLDS)
    if _SUBSTITUTED.search(text):
        text = _letters_back(text)
    return text.encode("utf-8", "replace").translate(WORD_TABLE).split()


def _letters_back(text: str) -> str:
    """Undo substitutions in words that hold a letter, between two of their characters."""
    out, done = [], 0
    for m in _SUBSTITUTED.finditer(text):
        if m.start() < done:
            continue
        start, end = m.start(), m.end()
        while start > done and not text[start - 1].isspace():
            start -= 1
        while end < len(text) and not text[end].isspace():
            end += 1
        word = text[start:end]
        tail = len(word) - len(word.rstrip(_EDGE))
        body = word[: len(word) - tail]
        if any(c.isalpha() for c in body):
            body = body.translate(_SUBSTITUTES)
        out += [text[done:start], body, word[len(word) - tail :]]
        done = end
    return "".join(out) + text[done:]


def terms_of(words: list[bytes]) -> set[str]:
    """The words, and their beginnings with a star: inflected and compound words share them."""
    out: set[str] = set()
    for word in set(words):
        if len(word) <= _LONGEST:
            text = word.decode("utf-8", "replace")
            out.add(text)
            out.update([text[:n] + "*" for n in STEMS if n < len(text)])
    return out


class Lexicon:
    """Terms with weights (a star ends a beginning), exception phrases, and the fitted logistic function."""

    def __init__(self, weights: dict[str, float], exceptions: Sequence[str]):
        self.weights = weights
        self.exceptions = [" ".join(w.decode() for w in folded(e)) for e in exceptions]
        self.fit = np.array([-50.0, 0.0, 0.0])
        self.automaton = None

    def build(self) -> None:
        """The automaton; every worker makes its own."""
        self.automaton = ahocorasick.Automaton()
        for phrase in self.exceptions:
            self.automaton.add_word(f" {phrase} ", (len(phrase) + 2, None))
        for term, weight in self.weights.items():
            pattern = f" {term[:-1]}" if term.endswith("*") else f" {term} "
            self.automaton.add_word(pattern, (len(pattern), weight))
        if len(self.automaton):
            self.automaton.make_automaton()

    def features(self, text: str) -> tuple[int, float, list[tuple[int, int]]]:
        """Number of words, summed weight, and the hits as ranges of the folded text."""
        words = folded(text)
        if not words or not len(self.automaton):
            return len(words), 0.0, []
        line = f" {b' '.join(words).decode('utf-8', 'replace')} "
        hits, excepted = [], []
        for end, (size, weight) in self.automaton.iter(line):
            if weight is None:
                excepted.append((end + 1 - size, end + 1))
            else:
                hits.append((end + 1 - size, end + 1, weight))
        if excepted:
            excepted.sort()
            starts = [a for a, _ in excepted]
            reach = list(accumulate((b for _, b in excepted), max))
            hits = [h for h in hits if (i := bisect_right(starts, h[0])) == 0 or reach[i - 1] < h[1]]
        return len(words), sum(h[2] for h in hits), [(a + 1, b - (line[b - 1] == " ")) for a, b, _ in hits]

    def score(self, n_words: int, weight: float) -> float:
        x = shaped(np.array([n_words]), np.array([weight]))
        return float(1 / (1 + np.exp(-np.clip(x @ self.fit, -50, 50)))[0])


def shaped(n_words: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """What the logistic function sees: a constant, weight, and weight per hundred words."""
    density = 100 * weight / np.maximum(n_words, 20)
    return np.stack([np.ones(len(weight)), np.log1p(weight), np.log1p(density)], axis=1)


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> DataFrame:
    """Texts with their labels. The labels are a hashed sample of bounded size, so they are broadcast."""
    taught = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")
    )
    share = min(1.0, sample / max(1, taught.count()))
    taught = taught.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(taught), "id").select("text", "toxic")


def learn(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    exceptions: Sequence[str] = EXCEPTIONS,
    sample: int = SAMPLE,
) -> Lexicon:
    """The lexicon and its calibration, from the labelled documents among *docs*.

    At most about *sample* of them are used, chosen by a hash of the id.

    To the driver come all terms that pass the floors, bounded by the sample, and a table of rounded weights.
    """
    taught = _labelled(docs, labels, id_col, text_col, label_col, sample)
    schema = pa.schema([("word", pa.string()), ("bad", pa.int64()), ("good", pa.int64())])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(strings(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                seen[toxic].update(terms_of(folded(text)))
                seen[toxic][""] += 1  # the number of documents
            if len(seen[0]) + len(seen[1]) > COUNTER_KEYS:
                yield _counts(schema, seen)
        yield _counts(schema, seen)

    words = map_text(taught, count, "word string, bad long, good long").groupBy("word")
    words = words.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    words = words.where(F.col("bad") >= LEAST_DOCS)
    totals = words.where("word = ''").first()
    bad, good = (totals["bad"], totals["good"]) if totals else (0, 0)
    if not bad or not good:
        return Lexicon({}, exceptions)
    a, b = F.col("bad") + 0.5, F.col("good") + 0.5
    odds = F.log(a / (bad + 1 - a)) - F.log(b / (good + 1 - b))
    lower = odds - F.sqrt(1 / a + 1 / b)
    top = (
        words.where("word <> ''")
        .select("word", lower.alias("weight"))
        .where(F.col("weight") >= LEAST_WEIGHT)
        .toArrow()
    )
    lexicon = Lexicon(dict(sorted(zip(*(c.to_pylist() for c in top.columns), strict=True))), exceptions)
    lexicon.fit = _fitted(taught, lexicon)
    return lexicon


def _counts(schema: pa.Schema, seen: tuple[Counter, Counter]) -> pa.RecordBatch:
    good, bad = seen
    words = list(good.keys() | bad.keys())
    out = batch_of(schema, words, [bad[w] for w in words], [good[w] for w in words])
    good.clear()
    bad.clear()
    return out


def _fitted(taught: DataFrame, lexicon: Lexicon) -> np.ndarray:
    """Logistic regression by Newton steps on counts of rounded features."""
    shared = taught.sparkSession.sparkContext.broadcast(lexicon)
    schema = pa.schema([("x", pa.int32()), ("y", pa.int32()), ("toxic", pa.int32())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        own.build()
        for batch in batches:
            found = [own.features(t)[:2] for t in strings(batch.column(0))]
            x = shaped(*(np.array(c, dtype=float) for c in zip(*found, strict=True)))
            steps = np.rint(np.minimum(x[:, 1:], 12) * 10).astype(np.int32)
            yield batch_of(schema, steps[:, 0], steps[:, 1], batch.column(1))

    rows = map_text(taught, run, "x int, y int, toxic int").groupBy("x", "y", "toxic").count().collect()
    data = np.array([[r["x"] / 10, r["y"] / 10, r["toxic"], r["count"]] for r in rows], dtype=float)
    x = np.concatenate([np.ones((len(data), 1)), data[:, :2]], axis=1)
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        weight = data[:, 3] * p * (1 - p)
        step = np.linalg.solve((x * weight[:, None]).T @ x + 0.1 * np.eye(3), x.T @ (data[:, 3] * (data[:, 2] - p)) - 0.1 * w)
        w += np.clip(step, -5, 5)
    return w


_HITS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def score(docs: DataFrame, lexicon: Lexicon, keep: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Toxicity of every whole text.

    Returns ``row`` (the kept columns), ``score`` (0 to 1), ``weight``, ``n_words`` and
    ``hits`` (ranges of the folded text).
    """
    source = docs.select(row_of(keep), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    schema = schema_of(
        row=source.schema["row"].dataType,
        score="double",
        weight="double",
        n_words="long",
        hits="array<struct<start:int,end:int>>",
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        own.build()
        for batch in batches:
            found = [own.features(t) for t in strings(batch.column(1))]
            n, weight = (np.array([f[i] for f in found], dtype=float) for i in (0, 1))
            p = 1 / (1 + np.exp(-np.clip(shaped(n, weight) @ own.fit, -50, 50)))
            hits = [[{"start": a, "end": b} for a, b in f[2]] for f in found]
            fields = [("row", batch.schema.field(0).type), ("score", pa.float64()), ("weight", pa.float64()), ("n_words", pa.int64()), ("hits", _HITS)]
            yield batch_of(pa.schema(fields), batch.column(0), p, weight, n.astype(np.int64), hits)

    return map_text(source, run, schema)
