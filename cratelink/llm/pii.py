"""Personal data: pattern rules give seeds, and contexts learned from them find more.

Seeds are the spans that the four base rules accept. Every seed, and everything else that
looks like an identifier, is an instance: tokens of four characters or more that hold a
digit, ``@`` or ``_``, and runs of neighbouring numbers, such as ``(555) 123-4567``. A
token over LONG characters is an instance, and so is each such part of it that punctuation
cuts off. The words around an instance (of the NEAR characters on either side) make its
lexical patterns. The graph of patterns and instances is scored
in rounds: a pattern is as good for a kind as its instances are, an instance as good as
the good patterns it stands in make it. Tokens met by patterns of high confidence are
spans of that kind too. Base spans always stay; an added span never overlaps one. Where a long
token and parts of it are found, all are spans.

Nulls and empty texts have no spans. Rows are independent but for the learned patterns:
repeated rows repeat their result and count once per distinct instance. Ties between kinds
go to the kind named first. An empty table gives an empty result. Kept columns may have any
names, as they travel in ``row``. A text of any length is one row of one task; instances over
LONG characters are told apart by their SHA-256. Only texts with added spans, and those few
that a bit filter takes for such, are exchanged to meet them.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cratelink.llm.common import batch_of, map_text, row_of, schema_of, strings
from cratelink.llm.jaccard import DOC_BITS, _bits, _held
from cratelink.session import scratch, stage

KINDS = ("email", "ip", "card", "phone")
#: Distinct instances, seeds among them, that a pattern must stand around.
SUPPORT = 5
#: Least confidence of a pattern that may add spans.
CONFIDENCE = 0.9
ROUNDS = 3

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits is tried from its first digit only: its rest fails where the whole does.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@_]")
_EDGE = "\"'()[]{}<>.,;:!?"
#: Characters on either side of an instance in which its neighbours are looked for.
NEAR = 80
#: Tokens longer than this are also looked into at their punctuation.
LONG = 128
_PART = re.compile(r"[^\s\"'()\[\]{}<>,;:|=&!?]+")
#: Neighbouring numbers, each of them a whole token.
_NUMBER = r"\(?\+?[0-9][0-9().+/-]*+(?=[\s,;:!?\"'\]}>]|\Z)"
_NUMBERS = re.compile(rf"(?<![^\s\"'\[{{<:;,]){_NUMBER}(?:[\x20\t]{{1,2}}{_NUMBER})+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    at, free = text.find("@"), 0
    while at >= 0:
        domain = _DOMAIN.match(text, at)
        if domain:
            start = at
            while start > free and _LOCAL.match(text, start - 1):
                start -= 1
            if start < at:
                free = domain.end()
                yield start, free
        at = text.find("@", max(at + 1, free))


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in m.groups()):
            yield m.span()


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = ord(digit) - 48
        if place % 2:
            value = value * 2 - 9 * (value > 4)
        total += value
    return total % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(48 <= ord(c) <= 57 for c in m[0]) <= 15:
                yield m.span()


RULES = dict(zip(KINDS, (emails, ips, cards, phones), strict=True))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; code points, end exclusive."""
    return [(k, a, b) for k, rule in enumerate(RULES.values()) for a, b in rule(text)]


def _words(text: str, inside: bool = False) -> list[str]:
    words = _PART.findall(text) if inside else text.split()
    return [w for w in (x.strip(_EDGE).lower() for x in words) if w]


def patterns(text: str, start: int, end: int, inside: bool = False) -> list[str]:
    """The lexical contexts of a span: words before, after, and on both sides.

    *inside* a long token, punctuation parts words as white space does.
    """
    before = _words(text[max(0, start - NEAR) : start], inside)[-2:]
    after = _words(text[end : end + NEAR], inside)[:1]
    out = []
    if before:
        out.append(f"{before[-1]} *")
    if len(before) == 2:
        out.append(f"{before[0]} {before[1]} *")
    if before and after:
        out.append(f"{before[-1]} * {after[0]}")
    return out


class Taken:
    """Parts of a text that are spoken for."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted(spans):
            if self.ends and start <= self.ends[-1]:
                self.ends[-1] = max(end, self.ends[-1])
            else:
                self.starts.append(start)
                self.ends.append(end)

    def free(self, start: int, end: int) -> bool:
        at = bisect_right(self.ends, start)
        return at == len(self.ends) or end <= self.starts[at]


def _numbers(text: str, base: Taken) -> Iterator[tuple[int, int]]:
    """Runs of two or more neighbouring numbers outside *base*, without brackets and points that do not belong."""
    for m in _NUMBERS.finditer(text):
        tokens = (t.span() for t in re.finditer(r"\S+", m[0]))
        tokens = ((m.start() + a, m.start() + b) for a, b in tokens)
        for free, group in groupby(tokens, lambda t: base.free(*t)):
            run = list(group)
            if not free or len(run) < 2:
                continue
            start, end = run[0][0], run[-1][1]
            while text[end - 1] in ".(+/-":
                end -= 1
            if text[end - 1] == ")" and text.rfind("(", start, end) < 0:
                end -= 1
            if text[start] == "(" and text.find(")", start, end) < 0:
                start += 1
            yield start, end


def _tokens(text: str) -> Iterator[tuple[int, int]]:
    """Tokens between white space that hold a mark."""
    done = 0
    for m in _MARK.finditer(text):
        if m.start() < done:
            continue
        start = m.start()
        while start > done and not text[start - 1].isspace():
            start -= 1
        end = m.end()
        while end < len(text) and not text[end].isspace():
            end += 1
        done = end
        yield start, end


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and text[start] in _EDGE:
        start += 1
    while end > start and text[end - 1] in _EDGE:
        end -= 1
    return start, end


def others(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, bool]]:
    """What looks like an identifier outside *spans*: start, end, and whether it is inside a token."""
    base = Taken((a, b) for _, a, b in spans)
    runs = list(_numbers(text, base))
    yield from ((a, b, False) for a, b in runs)
    in_runs = Taken(runs)
    for start, end in _tokens(text):
        a, b = _trimmed(text, start, end)
        if b - a >= 4 and base.free(a, b) and in_runs.free(a, b):
            yield a, b, False
        if b - a > LONG:
            for part in _PART.finditer(text, a, b):
                c, d = _trimmed(text, *part.span())
                if 4 <= d - c < b - a and _MARK.search(text, c, d) and base.free(c, d):
                    yield c, d, True


def _instance(text: str) -> str:
    return text if len(text) <= LONG else hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


_SPAN = "struct<kind:int,start:int,end:int>"
_FOUND = "struct<kind:int,start:int,end:int,instance:string,patterns:array<string>>"
_SPAN_PA = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
_FOUND_PA = pa.list_(
    pa.struct(
        [
            ("kind", pa.int32()),
            ("start", pa.int32()),
            ("end", pa.int32()),
            ("instance", pa.string()),
            ("patterns", pa.list_(pa.string())),
        ]
    )
)


def extracted(docs: DataFrame, keep: Sequence[str], text_col: str) -> DataFrame:
    """One row per document: ``key``, ``row``, its base spans, and all instances with patterns.

    ``key`` numbers the rows; the caller writes the table once, so that keys stay.
    """
    source = docs.select(
        row_of(keep), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("key")
    )
    schema = schema_of(
        key="long", row=source.schema["row"].dataType, base=f"array<{_SPAN}>", found=f"array<{_FOUND}>"
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, found = [], []
            for text in strings(batch.column(1)):
                spans = base_spans(text)
                base.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
                every = [(*s, False) for s in spans] + [(-1, *s) for s in others(text, spans)]
                found.append(
                    [
                        {"kind": k, "start": a, "end": b, "instance": _instance(text[a:b]), "patterns": patterns(text, a, b, inside)}
                        for k, a, b, inside in every
                    ]
                )
            fields = [("key", pa.int64()), ("row", batch.schema.field(0).type), ("base", _SPAN_PA), ("found", _FOUND_PA)]
            yield batch_of(pa.schema(fields), batch.column(2), batch.column(0), base, found)

    return map_text(source, run, schema)


def scored(edges: DataFrame, rounds: int, support: int, confidence: float) -> DataFrame:
    """Good patterns: ``pattern``, ``kind``, ``weight``.

    *edges* has one row per pattern and instance, with the instance's seed kind or -1.
    """
    size = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= support)
    edges = stage(edges.join(size, "pattern"), "pii-edges")
    seeds = edges.where("seed >= 0").groupBy("instance", F.col("seed").alias("kind")).agg(F.lit(1.0).alias("score"))
    scores = seeds
    for turn in range(rounds):
        good = (
            edges.join(scores, "instance")
            .groupBy("pattern", "kind")
            .agg(
                (F.sum("score") / F.max("n")).alias("weight"),
                F.sum("score").alias("mass"),
            )
            .where((F.col("weight") >= confidence) & (F.col("mass") >= support * confidence))
            .select("pattern", "kind", "weight")
        )
        good = stage(good, "pii-patterns")
        if turn == rounds - 1:
            break
        learned = (
            edges.where("seed < 0")
            .join(good, "pattern")
            .groupBy("instance", "kind")
            .agg((1 - F.exp(F.sum(F.log(F.lit(1.0001) - F.col("weight"))))).alias("score"))
        )
        scores = stage(seeds.unionByName(learned), "pii-scores")
    return good


def find(
    docs: DataFrame,
    keep: Sequence[str] = ("doc_id",),
    text_col: str = "text",
    rounds: int = ROUNDS,
    support: int = SUPPORT,
    confidence: float = CONFIDENCE,
) -> DataFrame:
    """Personal data of every whole text.

    Returns ``row`` (the kept columns), ``base`` and ``spans``: arrays of (kind, start,
    end), kinds numbered as in KINDS, sorted, code points, end exclusive. ``spans`` holds
    the base spans and what the learned patterns add.
    """
    table = stage(extracted(docs, keep, text_col), "pii-found")
    with scratch(docs.sparkSession):
        met = table.select("key", F.explode("found").alias("f")).select("key", "f.*")
        met = met.select("key", "kind", "start", "end", "instance", F.explode("patterns").alias("pattern"))
        edges = met.groupBy("pattern", "instance").agg(F.max("kind").alias("seed"))
        good = scored(edges, rounds, support, confidence)
        best = (
            met.where("kind < 0")
            .select("key", "start", "end", "pattern")
            .join(good, "pattern")
            .groupBy("key", "start", "end")
            .agg(F.min(F.struct(-F.col("weight"), "kind")).alias("best"))
        )
        added = best.groupBy("key").agg(F.collect_list(F.struct(F.col("best.kind").alias("kind"), "start", "end")).alias("added"))
        added = stage(added, "pii-added", keep=True)
    rows, maybe = table.drop("found"), _among(added)
    spans = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(f"array<{_SPAN}>"))))
    with_added = rows.where(maybe("key")).join(added, "key", "left").select("row", "base", spans.alias("spans"))
    return with_added.unionByName(rows.where(~maybe("key")).select("row", "base", F.array_sort("base").alias("spans")))


def _among(added: DataFrame) -> Callable[[str], Column]:
    """Whether a key may be one of *added*: a bit filter of fixed size, which errs towards yes."""
    bits = added.sparkSession.sparkContext.broadcast(_bits(added, "key", DOC_BITS))

    @F.pandas_udf("boolean")
    def among(keys: pd.Series) -> pd.Series:
        return pd.Series(_held(bits.value, keys.to_numpy().astype(np.int64), DOC_BITS))

    return among


def span_texts(spans: str) -> F.Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])
    return F.array_join(F.transform(spans, one), ",")


def masked(found: DataFrame, text: str = "row.text") -> DataFrame:
    """*found* with ``masked``: the text whose spans are replaced by ``<kind>``.

    Spans that overlap are masked as one, under the kind that starts first.
    """
    source = found.select("*", F.col(text).alias("_text"))
    at = {name: i for i, name in enumerate(source.columns)}
    schema = schema_of(**{f.name: f.dataType for f in found.schema}, masked="string")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(at["spans"]).to_pylist()
            texts_in = batch.column(at["_text"])
            out = texts_in.to_pylist()
            for i, mine in enumerate(spans):
                if mine:
                    out[i] = mask(out[i], [(s["kind"], s["start"], s["end"]) for s in mine])
            columns = [c for j, c in enumerate(batch.columns) if j != at["_text"]]
            fields = [f for j, f in enumerate(batch.schema) if j != at["_text"]] + [pa.field("masked", pa.string())]
            yield batch_of(pa.schema(fields), *columns, pa.array(out, pa.string()))

    return map_text(source, run, schema)


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, done = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], s[0], s[2])):
        if start >= done:
            out += [text[done:start], f"<{KINDS[kind]}>"]
        done = max(done, end)
    return "".join(out) + text[done:]
