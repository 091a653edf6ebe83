"""Byte-level BPE: pair merges taken from a rank queue over a hierarchical bitmap.

Each merge rank has a bucket of linked-list positions; two levels of bitmaps tell which
buckets hold anything, so the lowest rank is found by two find-first-set steps whatever
the length of the pre-token. Entries whose pair has changed since are skipped when they
come up. A pre-token of n bytes takes O(n log n) steps, also one of many megabytes.

Nulls and empty texts give no ids. Rows are independent: repeated rows repeat their
result, further columns are not looked at, and an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cratelink.llm.common import batch_of, map_text, strings

#: White space as Unicode defines it, which the library's own class is not.
_SPACE = r"\p{White_Space}"
#: A space between two characters that are none: no pre-token reaches over its left side.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: A space beside other white space, where plain splitting would cut wrongly; it also does at an end.
_ODD = re.compile(r"\s(?:(?<= )\s| )")
#: Chunks and pre-tokens of one generation; a worker remembers the last two. 16 MB of prose fit in two.
CACHE = 250_000
#: Bytes of pre-tokens merged through one queue; a longer one is merged alone.
BLOCK = 1 << 18
#: Longer texts of either kind are not remembered.
SHORT = 64


def read_ranks(path: str) -> bytes:
    """The rank file's content; its size is the size of the vocabulary, not of the data."""
    with open(path, "rb") as f:
        return f.read()


class Memory:
    """Ids of texts met before: those of this generation and of the one before it."""

    def __init__(self) -> None:
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.long: list[str] = []

    def recall(self, texts: set[str], make: Callable[[list[str]], list[bytes]]) -> dict[str, bytes]:
        """A table that holds at least *texts*, until ``forget``; *make* gives what is not known."""
        now, before = self.now, self.before
        open_ = texts - now.keys()
        old = open_ & before.keys()
        now.update((x, before[x]) for x in old)
        new = list(open_ - old)
        now.update(zip(new, make(new), strict=True))
        self.long += [x for x in new if len(x) >= SHORT]
        return now

    def forget(self) -> None:
        """Drop long texts, and what was not met for a generation."""
        for x in self.long:
            del self.now[x]
        self.long = []
        if len(self.now) > CACHE:
            self.before, self.now = self.now, {}


class Coder:
    """Encodes and decodes texts by one rank file."""

    def __init__(self, ranks: bytes, pattern: str):
        self.ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, ranks.splitlines()) if t}
        size = max(self.ranks.values(), default=-1) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        own = pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]")
        self.pieces = regex.compile(own).findall
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.pairs = np.full(1 << 16, -1, dtype=np.int32)
        for token, rank in self.ranks.items():
            if len(token) == 2:
                self.pairs[token[0] << 8 | token[1]] = rank
        self.low = [0] * ((size >> 8) + 1)
        self.buckets: list[list[int]] = [[] for _ in range(size)]
        self.clear()

    def clear(self) -> None:
        """Forget the texts met so far."""
        self.chunks, self.known = Memory(), Memory()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, little-endian, four bytes each.

        Texts are cut at single spaces, which start a pre-token of their own, and each
        distinct chunk of the batch is encoded once.
        """
        cut = []
        distinct: set[str] = set()
        for text in texts:
            odd = text[:1] == " " or text[-1:] == " " or _ODD.search(text)
            first, *rest = _CUT.split(text) if odd else text.split(" ")
            rest = [" " + x for x in rest]
            rest.insert(0, first)
            cut.append(rest)
            distinct.update(rest)
        found = self.chunks.recall(distinct, self._chunks)
        out = [b"".join([found[x] for x in rest]) for rest in cut]
        self.chunks.forget()
        return out

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        parts = [self.pieces(x) for x in chunks]
        found = self.known.recall(set(chain.from_iterable(parts)), self._merged)
        out = [found[part[0]] if len(part) == 1 else b"".join([found[p] for p in part]) for part in parts]
        self.known.forget()
        return out

    def _merged(self, pieces: list[str]) -> list[bytes]:
        out: list[bytes] = []
        block: list[bytes] = []
        held = 0
        for piece in map(str.encode, pieces):
            if block and held + len(piece) > BLOCK:
                out += self.merge_all(block)
                block, held = [], 0
            block.append(piece)
            held += len(piece)
        return out + self.merge_all(block)

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of many pre-tokens, merged through one queue.

        Within a pre-token merges go by rank, leftmost first; between pre-tokens the
        order has no effect, so all positions of a bucket are taken in one go. Only if
        a merge makes a pair of lower rank does the rest of the bucket wait.
        """
        get, low, buckets = self.ranks.get, self.low, self.buckets
        out: list[bytes] = [b""] * len(pieces)
        todo = []
        for at, piece in enumerate(pieces):
            whole = get(piece)
            if whole is None:
                todo.append(at)
            else:
                out[at] = whole.to_bytes(4, "little")
        data = b"".join([pieces[at] for at in todo])
        n = len(data)
        if not n:
            return out
        ends = np.cumsum([len(pieces[at]) for at in todo])
        raw = np.frombuffer(data, dtype=np.uint8)
        fences = np.zeros(n + 1, dtype=np.uint8)
        fences[0] = 1
        fences[ends] = 1
        ranks = np.full(n, -1, dtype=np.int32)
        ranks[:-1] = self.pairs[raw[:-1].astype(np.int32) << 8 | raw[1:]]
        ranks[ends - 1] = -1
        following, previous = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        columns = (fences, ranks, self.bytes[raw], following, previous)
        # Lists are quicker; an array holds the places of one very long pre-token in little memory.
        fence, pair, token, following, previous = (x.tolist() if n <= BLOCK else array(x.dtype.char, x.tobytes()) for x in columns)
        high = 0
        order = np.flatnonzero(ranks >= 0)
        order = order[np.argsort(ranks[order], kind="stable")]
        firsts = np.flatnonzero(np.diff(ranks[order], prepend=-1)).tolist() if len(order) else []
        for a, b in zip(firsts, [*firsts[1:], len(order)], strict=False):
            r = int(ranks[order[a]])
            buckets[r] = order[a:b].tolist()
            low[r >> 8] |= 1 << (r & 255)
            high |= 1 << (r >> 8)
        while high:
            w = (high & -high).bit_length() - 1
            word = low[w]
            r = (w << 8) + (word & -word).bit_length() - 1
            low[w] = word & (word - 1)
            if not low[w]:
                high &= high - 1
            bucket = buckets[r]
            buckets[r] = []
            bucket.sort()
            for at, i in enumerate(bucket):
                if pair[i] != r:
                    continue  # stale: one of the two was merged otherwise
                j = following[i]
                k = following[j]
                following[i] = k
                token[i] = r
                token[j] = pair[j] = pair[i] = -1
                least = r
                if not fence[k]:
                    previous[k] = i
                    q = get(data[i : following[k]])
                    if q is not None:
                        pair[i] = q
                        if buckets[q]:
                            buckets[q].append(i)
                        else:
                            buckets[q].append(i)
                            low[q >> 8] |= 1 << (q & 255)
                            high |= 1 << (q >> 8)
                        if q < least:
                            least = q
                if not fence[i]:
                    p = previous[i]
                    q = get(data[p:k])
                    if q is None:
                        pair[p] = -1
                    else:
                        pair[p] = q
                        if buckets[q]:
                            buckets[q].append(p)
                        else:
                            buckets[q].append(p)
                            low[q >> 8] |= 1 << (q & 255)
                            high |= 1 << (q >> 8)
                        if q < least:
                            least = q
                if least < r and at + 1 < len(bucket):
                    buckets[r] = bucket[at + 1 :]
                    low[r >> 8] |= 1 << (r & 255)
                    high |= 1 << (r >> 8)
                    break
        tokens = np.array(token, dtype="<i4")
        left = np.concatenate([[0], np.cumsum(tokens >= 0)]) * 4
        ids = tokens[tokens >= 0].tobytes()
        cuts = left[ends].tolist()
        for at, a, b in zip(todo, [0, *cuts], cuts, strict=False):
            out[at] = ids[a:b]
        return out

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


_coders: dict[tuple[str, str], Coder] = {}


def coder(key: str, pattern: str, ranks: bytes) -> Coder:
    """One coder per worker process and vocabulary: its tables are made once, not once a task."""
    if (key, pattern) not in _coders:
        _coders.clear()
        _coders[key, pattern] = Coder(ranks, pattern)
    return _coders[key, pattern]


def encode_decode(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Ids of every whole text, and the bytes they decode to.

    Returns the id column, ``n_tokens``, ``ids`` (binary, little-endian unsigned 32-bit
    integers) and ``decoded`` (binary). Special tokens are ordinary text.
    """
    ranks = read_ranks(ranks_path)
    key = hashlib.sha256(ranks).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(key, pattern, shared.value)
        try:
            for batch in batches:
                ids = code.encode_all(strings(batch.column(1)))
                schema = pa.schema(
                    [("id", batch.schema.field(0).type), ("n", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())]
                )
                yield batch_of(schema, batch.column(0), [len(x) // 4 for x in ids], ids, [code.decode(x) for x in ids])
        finally:
            code.clear()  # other stages of the job use the same worker

    out = map_text(source, run, f"id {id_type}, n_tokens long, ids binary, decoded binary")
    return out.withColumnRenamed("id", id_col)
