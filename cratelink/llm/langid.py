"""Language identification of whole texts and of the spans of mixed ones.

The script of a word narrows the languages that can have written it. Each language's
score of a word is the log probability of the word's byte 3-grams. A Viterbi pass over
the words, with a penalty for each switch of language, labels every word. Where no run of
words gains more than half a penalty in any other language, the constant path is the best
one, and the pass is not needed: m runs take at least m - 1 switches, and one run over the
whole text gains nothing.

A text without letters, or null, is ``und`` with score 0 and no spans; so is every text
if nothing was learned. Equal scores go to the language named first. Rows are
independent; repeated rows repeat their result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cratelink.llm.common import batch_of, map_text, mixed, row_of, schema_of, texts

#: Hashed 3-grams per language: the model's size, whatever the text.
BUCKETS = 1 << 16
#: Natural-log cost of one switch of language.
PENALTY = 12.0
#: A language is a candidate for a script that holds at least this share of its letters.
SCRIPT_SHARE = 0.01
UNKNOWN = "und"
#: Word scores a worker remembers before it starts anew.
CACHE = 150_000

#: First code points of the scripts told apart (fixed values of the Unicode blocks).
_SCRIPTS = (
    (0x0000, "latin"),
    (0x0370, "greek"),
    (0x0400, "cyrillic"),
    (0x0530, "other"),
    (0x0590, "hebrew"),
    (0x0600, "arabic"),
    (0x0780, "other"),
    (0x0900, "devanagari"),
    (0x0980, "other"),
    (0x0E00, "thai"),
    (0x0E80, "other"),
    (0x1E00, "latin"),
    (0x1F00, "greek"),
    (0x2000, "other"),
    (0x3040, "kana"),
    (0x3100, "other"),
    (0x3400, "han"),
    (0xA000, "other"),
    (0xAC00, "hangul"),
    (0xD7B0, "other"),
    (0xF900, "han"),
    (0xFB00, "other"),
    (0x20000, "han"),
    (0x32000, "other"),
)
_STARTS = [start for start, _ in _SCRIPTS]
SCRIPTS = sorted({name for _, name in _SCRIPTS})
#: Blanks what cannot be part of a word; capitals and non-ASCII bytes stay for str.lower.
_LETTERS = bytes(c if c >= 128 or 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(256))


def script_of(word: str) -> int:
    """Script of the first letter, as a place in SCRIPTS."""
    letter = next((c for c in word if c.isalpha()), " ")
    at = int(np.searchsorted(_STARTS, ord(letter), side="right")) - 1
    return SCRIPTS.index(_SCRIPTS[at][1])


def lowered(text: bytes) -> list[bytes]:
    """Runs of letters and non-ASCII characters, in lower case."""
    text = text.translate(_LETTERS)
    return (text.lower() if text.isascii() else text.decode().lower().encode()).split()


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 3-grams of all words, each word between blanks, and where each word starts."""
    data = np.frombuffer(b" " + b" ".join(words) + b" ", dtype=np.uint8).astype(np.uint64)
    codes = data[:-2] << np.uint64(16) | data[1:-1] << np.uint64(8) | data[2:]
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    hashed = (mixed(codes + np.uint64(1)) & np.uint64(BUCKETS - 1)).astype(np.int64)
    return hashed, np.cumsum(sizes) - sizes


class Model:
    """Log probabilities of 3-grams by language, and the languages of each script."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        total = counts.sum(axis=1, keepdims=True)
        self.table = np.log((counts + 0.5) / (total + 0.5 * BUCKETS)).T.astype(np.float32).copy()
        share = scripts / np.maximum(1, scripts.sum(axis=1, keepdims=True))
        self.allowed = (share >= SCRIPT_SHARE).T
        self.allowed[~self.allowed.any(axis=1)] = True

    def start(self) -> None:
        self.places: dict[bytes, int] = {}
        self.scores = np.zeros((1 << 12, len(self.langs)), dtype=np.float32)
        self.sizes = np.zeros(1 << 12, dtype=np.int64)

    def look_up(self, words: list[bytes]) -> np.ndarray:
        """Places of the words in the score table; new words are scored together."""
        if len(self.places) > CACHE:
            self.start()
        new = list({w: None for w in words if w not in self.places})
        if new:
            at = len(self.places)
            while at + len(new) > len(self.sizes):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
                self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
            hashed, begins = grams(new)
            self.scores[at : at + len(new)] = np.add.reduceat(self.table[hashed], begins, axis=0)
            letters = np.array([len(w) if w.isascii() else _letters(w) for w in new], dtype=np.int64)
            self.sizes[at : at + len(new)] = letters
            for i, w in enumerate(new):
                if letters[i] == 0:
                    self.scores[at + i] = 0
                elif not w.isascii():
                    self.scores[at + i][~self.allowed[script_of(w.decode())]] -= 1e4
                self.places[w] = at + i
            plain = [at + i for i, w in enumerate(new) if w.isascii()]
            self.scores[plain] -= 1e4 * ~self.allowed[SCRIPTS.index("latin")]
        return np.fromiter(map(self.places.__getitem__, words), dtype=np.int64, count=len(words))

    def label(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language of each word by the best path, and its log scores."""
        scores = self.scores[places].astype(np.float64)
        best = int(np.argmax(scores.sum(axis=0)))
        gain = np.zeros((len(places) + 1, scores.shape[1]))
        np.cumsum(scores - scores[:, best : best + 1], axis=0, out=gain[1:])
        if (gain - np.minimum.accumulate(gain, axis=0)).max() <= PENALTY / 2:
            return np.full(len(places), best), scores
        return viterbi(scores, PENALTY), scores


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The labels of the highest sum of scores, less *penalty* for each switch.

    Rows hold one number per language, so plain lists are quicker than arrays.
    """
    rows = scores.tolist()
    value = rows[0]
    values = [value]
    for row in rows[1:]:
        moved = max(value) - penalty
        value = [(v if v > moved else moved) + s for v, s in zip(value, row)]  # noqa: B905
        values.append(value)
    out = np.empty(len(rows), dtype=np.int64)
    out[-1] = at = value.index(max(value))
    for t in range(len(rows) - 2, -1, -1):
        value = values[t]
        high = max(value)
        if value[at] < high - penalty:
            at = value.index(high)
        out[t] = at
    return out


def _letters(word: bytes) -> int:
    text = word.decode()
    return len(word) if any(c.isalpha() for c in text) else 0


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts of 3-grams and scripts by language over all given texts.

    At most BUCKETS counts per language come to the driver.
    """
    source = docs.where(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")
    )
    schema = pa.schema([("lang", pa.string()), ("at", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            split: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                split.setdefault(lang, []).append(text)
            for lang, group in split.items():
                mine = counts.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS), dtype=np.int64))
                words = lowered(b" ".join(group))
                if words:
                    mine[:BUCKETS] += np.bincount(grams(words)[0], minlength=BUCKETS)
                    wide = [w for w in words if not w.isascii()]
                    mine[BUCKETS + SCRIPTS.index("latin")] += len(words) - len(wide)
                    for w in wide:
                        mine[BUCKETS + _script(w)] += 1
        for lang, mine in counts.items():
            at = np.flatnonzero(mine)
            yield batch_of(schema, [lang] * len(at), at.astype(np.int32), mine[at])

    known: dict[bytes, int] = {}

    def _script(word: bytes) -> int:
        if word not in known:
            if len(known) > CACHE:
                known.clear()
            known[word] = script_of(word.decode())
        return known[word]

    got = map_text(source, run, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    counts = np.zeros((len(langs), BUCKETS + len(SCRIPTS)))
    row = np.searchsorted(langs, got.column("lang").to_pylist()) if langs else []
    counts[row, got.column("at").to_numpy()] = got.column("n").to_numpy()
    return Model(langs, counts[:, :BUCKETS], counts[:, BUCKETS:])


_SPANS = "array<struct<start:int,end:int,lang:string>>"
_SPANS_PA = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))


def identify(docs: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Language of every whole text.

    Returns ``row`` (the kept columns), ``lang`` (that of most letters), ``score`` (its
    share of the letters, times its probability against any other one language),
    ``spans`` (ranges of words, with their language, end exclusive) and ``letters``
    (bytes of words that hold letters).
    """
    source = docs.select(row_of(keep), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = schema_of(row=source.schema["row"].dataType, lang="string", score="double", spans=_SPANS, letters="long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        own.start()
        for batch in batches:
            out = [_one(own, lowered(text)) for text in texts(batch.column(1))]
            fields = [("row", batch.schema.field(0).type), ("lang", pa.string()), ("score", pa.float64()), ("spans", _SPANS_PA), ("letters", pa.int64())]
            yield batch_of(pa.schema(fields), batch.column(0), *map(list, zip(*out, strict=True)))

    return map_text(source, run, schema)


def _one(model: Model, words: list[bytes]) -> tuple[str, float, list[dict], int]:
    if not words or not model.langs:
        return UNKNOWN, 0.0, [], sum(map(_letters, words))
    places = model.look_up(words)
    sizes = model.sizes[places]
    letters = int(sizes.sum())
    if not letters:
        return UNKNOWN, 0.0, [], 0
    labels, scores = model.label(places)
    weight = np.bincount(labels, weights=sizes, minlength=len(model.langs))
    lang = int(weight.argmax())
    mine = scores[labels == lang].sum(axis=0)
    odds = np.exp(np.minimum(0, mine - mine[lang])).sum()
    cuts = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(labels)]
    spans = [
        {"start": a, "end": b, "lang": model.langs[labels[a]]} for a, b in zip(cuts, cuts[1:], strict=False)
    ]
    return model.langs[lang], float(weight[lang] / letters / odds), spans, letters
