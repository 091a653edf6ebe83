"""N-gram Jaccard join with adaptive multi-match prefixes, and the classes of linked documents.

Every text becomes the set of its hashed shingles; texts of equal sets are one node. All
sets are ordered by one order: frequent shingles last, others by hash. Two sets of
Jaccard similarity t share at least m shingles among the first n - ceil(t n) + m of
either. Each set picks its own m: a longer prefix meets more, but asks for more common
shingles before anything is verified; the estimated cost, from the frequencies of the
prefix, decides. A pair is a candidate if it shares as many prefix shingles as the smaller
m of both, and if lengths, places, and what comes after the prefix that ends first leave
room for the overlap needed.

Groups of thousands of near copies are not expanded into pairs. Before the join, nodes
that share a min-hash with many others are compared with one member of the largest class of
each such group, another one each time, until that finds no more links; the links make
classes, and the join then only looks at pairs across classes. This
loses no link between classes, so the classes are exact: prefixes only skip pairs that
cannot reach the threshold or are in one class already. Where many nodes share a prefix
shingle, sketches bound from below how much two sets differ, so a family whose members are
just too far apart makes no pairs; its members still meet inside the join.

The order, the frequencies and the bit filters have fixed sizes; they decide how much is
met, never what is found. Shingles are 64-bit hashes, nodes 64-bit sums of them.

Documents without words have no shingles and link with nothing. A text shorter than a
shingle is one shingle. Null ids have sets, but no class; rows that share an id and differ
in text are told apart. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cratelink.llm.common import LOWER_TABLE, SLICE_BYTES, batch_of, map_text, mixed, prepare, word_hashes
from cratelink.session import collected, scratch, stage

SHINGLE = 5
#: Similarity, in hundredths.
PERCENT = 75
#: Largest number of common prefix shingles that a set may ask for.
MATCHES = 4
#: Cost of verifying a candidate, in met prefix shingles.
VERIFY = 20
#: Min-hashes of a set, how many two sets must agree in to be compared early, and rounds of that.
KEYS, AGREE, TURNS = 6, 3, 4
#: Nodes of one min-hash above which they are compared early; fewer are left to the join.
CROWD = 16
#: Frequent shingles that the order knows; shingles counted together before counts of one are dropped.
FREQUENT = 1 << 18
COUNTED = 1 << 21
#: Bits of the filters on shingles and on documents.
SHINGLE_BITS, DOC_BITS = 26, 24
#: Words of 64 bits in the sketch of a set.
SKETCH = 8

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.frombuffer(LOWER_TABLE, dtype=np.uint8)
_ODD = mixed(np.arange(101, 101 + SHINGLE, dtype=np.uint64)) | np.uint64(1)
_SALTS = mixed(np.arange(201, 203 + KEYS, dtype=np.uint64))


def _words(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts; one very long text goes by pieces cut at white space."""
    if len(data) <= 4 * SLICE_BYTES:
        return word_hashes(_LOWER[data], breaks, _SPACE)
    out, counts = [], []
    for a, b in zip(breaks[:-1].tolist(), breaks[1:].tolist(), strict=True):
        start, count = a, 0
        while start < b:
            stop = min(b, start + SLICE_BYTES)
            while stop < b and not _SPACE[data[stop]]:
                stop += 1
            part = word_hashes(_LOWER[data[start:stop]], np.array([0, stop - start]), _SPACE)[0]
            out.append(part)
            count += len(part)
            start = stop
        counts.append(count)
    return np.concatenate([np.zeros(0, np.uint64), *out]), np.array(counts, dtype=np.int64)


def sets_of(column: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingles of each text, as signed 64-bit numbers."""
    column = column.cast(pa.binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    words, counts = _words(data, offsets.astype(np.int64) - offsets[0])
    every = np.zeros(0, np.uint64)
    if len(words) >= SHINGLE:
        last = len(words) - SHINGLE + 1
        every = mixed(reduce(np.add, [words[i : last + i] * _ODD[i] for i in range(SHINGLE)]))
    out, start = [], 0
    for n in counts.tolist():
        if n >= SHINGLE:
            own = np.unique(every[start : start + n - SHINGLE + 1])
        elif n:
            own = mixed(np.array([(words[start : start + n] * _ODD[:n]).sum() + np.uint64(n)]))
        else:
            own = np.zeros(0, np.uint64)
        out.append(own.view(np.int64))
        start += n
    return out


def node_of(own: np.ndarray, salt: int = 0) -> int:
    """A number for the whole set."""
    return int(mixed(own.view(np.uint64) ^ _SALTS[salt]).sum().view(np.int64)) if len(own) else 0


def least_hashes(own: np.ndarray) -> list[int]:
    return [int(mixed(own.view(np.uint64) ^ _SALTS[2 + j]).min().view(np.int64)) for j in range(KEYS)]


def sketch_of(own: np.ndarray) -> list[int]:
    """Bits that each shingle of a set turns over: sets differ in as many shingles as their sketches in bits, or in more."""
    odd = np.bincount(_bit(own, 6 + SKETCH.bit_length() - 1), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


class Order:
    """Frequent shingles with their counts; all others count as one."""

    def __init__(self, shingles: np.ndarray, counts: np.ndarray):
        order = np.argsort(shingles)
        self.shingles, self.counts = shingles[order], counts[order].astype(np.int64)

    def frequency(self, own: np.ndarray) -> np.ndarray:
        out = np.ones(len(own), dtype=np.int64)
        if len(self.shingles):
            at = np.minimum(np.searchsorted(self.shingles, own), len(self.shingles) - 1)
            met = self.shingles[at] == own
            out[met] = self.counts[at[met]]
        return out

    def prefix(self, own: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
        """The set's prefix, in order, and how many of it a similar set must share."""
        n = len(own)
        need = -(-percent * n // 100)
        count = self.frequency(own)
        order = np.lexsort((own, count)) if count.max() > 1 else np.argsort(own)
        count = count[order]
        best, matches = None, 1
        for m in range(1, min(MATCHES, need) + 1):
            part = count[: n - need + m]
            # Who shares m of these is on a list besides the m - 1 longest.
            met = part.sum()
            cost = met + VERIFY * (met - part[len(part) - m + 1 :].sum())
            if best is None or cost < best:
                best, matches = cost, m
        return own[order[: n - need + matches]], matches


def _bits(df: DataFrame, column: str, log2: int) -> np.ndarray:
    """A bit filter over a column of longs; 2^log2 bits, whatever the rows."""
    schema = pa.schema([("word", pa.int64()), ("bits", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _bit(batch.column(0).to_numpy(), log2)
            word, row = np.unique(at >> 6, return_inverse=True)
            bits = np.zeros(len(word), dtype=np.uint64)
            np.bitwise_or.at(bits, row, np.uint64(1) << (at & 63).astype(np.uint64))
            yield batch_of(schema, word, bits.view(np.int64))

    prepare(df.sparkSession)
    rows = df.select(column).mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    got = collected(rows)
    out = np.zeros(1 << (log2 - 6), dtype=np.uint64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def _bit(values: np.ndarray, log2: int) -> np.ndarray:
    return (mixed(values.view(np.uint64)) >> np.uint64(64 - log2)).astype(np.int64)


def _held(bits: np.ndarray, values: np.ndarray, log2: int) -> np.ndarray:
    at = _bit(values, log2)
    return (bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def described(docs: DataFrame) -> DataFrame:
    """Per document its set's size, node and min-hashes (kind 0); frequent shingles (kind 1)."""
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    schema = pa.schema(list(zip(("kind", "id", "n", "node", "keys"), kinds, strict=True)))

    def frequent(seen: list[np.ndarray]) -> pa.RecordBatch:
        known, n = np.unique(np.concatenate([np.zeros(0, np.int64), *seen]), return_counts=True)
        known, n = known[n > 1], n[n > 1]
        return batch_of(schema, np.ones(len(n), np.int32), known, n, np.zeros(len(n), np.int64), [None] * len(n))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] = []
        size = 0
        for batch in batches:
            sets = sets_of(batch.column(1))
            keys = [least_hashes(own) if len(own) else None for own in sets]
            n = [len(own) for own in sets]
            yield batch_of(schema, np.zeros(len(n), np.int32), batch.column(0), n, [node_of(own) for own in sets], keys)
            seen += sets
            size += sum(n)
            if size > COUNTED:
                yield frequent(seen)
                seen, size = [], 0
        yield frequent(seen)

    return map_text(docs, run, "kind int, id long, n long, node long, keys array<long>")


def _order(described_docs: DataFrame) -> Order:
    counts = described_docs.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n"))
    top = collected(counts.orderBy(F.col("n").desc(), "id").limit(FREQUENT))
    return Order(top.column("id").to_numpy(), top.column("n").to_numpy())


def gathered(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node`` and ``items`` (the set) of the wanted nodes, from the text of their document."""
    bits = docs.sparkSession.sparkContext.broadcast(_bits(wanted, "rep", DOC_BITS))
    schema = pa.schema([("rep", pa.int64()), ("found", pa.int64()), ("items", pa.list_(pa.int64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.flatnonzero(_held(bits.value, batch.column(0).to_numpy(), DOC_BITS))
            if len(keep):
                part = batch.take(pa.array(keep))
                sets = sets_of(part.column(1))
                offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                items = pa.ListArray.from_arrays(offsets, np.concatenate([np.zeros(0, np.int64), *sets]))
                yield batch_of(schema, part.column(0), [node_of(own) for own in sets], items)

    found = map_text(docs.where("id is not null"), run, "rep long, found long, items array<long>")
    once = found.dropDuplicates(["rep", "found"])  # repeated rows; the join needs no other exchange of the sets
    same = (F.col("rep") == F.col("w_rep")) & (F.col("found") == F.col("node"))
    return once.join(wanted.select("node", F.col("rep").alias("w_rep")), same).select("node", "items")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    a = sets.select(F.col("node").alias("a"), F.col("items").alias("items_a"))
    b = sets.select(F.col("node").alias("b"), F.col("items").alias("items_b"))
    # Only the wanted sets are exchanged.
    both = pairs.join(a, "a").join(b.join(pairs.select("b").distinct(), "b"), "b")
    shared = F.size(F.array_intersect("items_a", "items_b"))
    union = F.size("items_a") + F.size("items_b") - shared
    return both.where(100 * shared >= percent * union).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``comp``, the least node that links reach, for every node on an edge."""
    both = stage(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "join-edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp"))
    labels = stage(labels, "join-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node"))
        near = near.agg(F.min("comp").alias("near"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        new = labels.join(near, "node").join(jump, "comp")
        new = stage(new.select("node", F.col("comp").alias("old"), F.least("near", "far", "comp").alias("comp")), "join-labels")
        labels = new.select("node", "comp")
        if new.where("comp <> old").isEmpty():
            return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (a class for every node) after *links*: only classes are linked, not their members."""
    of = lambda end: labels.select(F.col("node").alias(end), F.col("comp").alias(f"comp_{end}"))
    between = links.join(of("a"), "a").join(of("b"), "b").where("comp_a <> comp_b")
    between = between.select(F.least("comp_a", "comp_b").alias("a"), F.greatest("comp_a", "comp_b").alias("b"))
    new = components(between).select(F.col("node").alias("comp"), F.col("comp").alias("new"))
    out = labels.join(new, "comp", "left").select("node", F.coalesce("new", "comp").alias("comp"))
    return stage(out, "join-labels")


def _early_classes(nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Classes of the nodes that agree in min-hashes with many others (``node``, ``comp``).

    In every group of a min-hash a member of the largest class, another one each time, is
    compared with all nodes outside that class, until no comparison finds a link. So the
    few that a member is too far from are met by the next ones, and what is left over is
    far from most of the class. The work of a round is linear in the nodes of the groups.
    """
    own = nodes.select("node", F.posexplode("keys").alias("j", "key"))
    sizes = own.groupBy("j", "key").agg(F.count("*").alias("size")).where(F.col("size") > CROWD)
    live = own.join(stage(sizes, "join-groups"), ["j", "key"])
    # Two nodes that agree in so many keys share so many groups.
    full = live.groupBy("node").agg(F.count("*").alias("keys"), F.sum("size").alias("degree")).where(F.col("keys") >= AGREE)
    live = stage(live.join(full.select("node", "degree"), "node").select("j", "key", "node", "degree"), "join-crowds")
    known = stage(live.select("node").distinct().join(nodes, "node").select("node", "rep", "n", "keys"), "join-early")
    sets = stage(gathered(docs, known), "join-sets")
    labels = stage(known.select("node", F.col("node").alias("comp")), "join-labels")
    other = known.select(F.col("node").alias("pivot"), F.col("n").alias("m"), F.col("keys").alias("pivot_keys"))
    agree = F.size(F.filter(F.arrays_zip("keys", "pivot_keys"), lambda z: z["keys"] == z["pivot_keys"]))
    for turn in range(TURNS):
        rows = live.join(labels, "node")
        # The middle of a group has the fullest groups; later on any member will do.
        seat = F.col("degree") if turn == 0 else F.xxhash64("node", F.lit(turn))
        parts = rows.groupBy("j", "key", "comp").agg(F.count("*").alias("c"), F.max(F.struct(seat.alias("seat"), "node")).alias("of"))
        best = F.struct("c", "of.seat", F.col("of.node").alias("node"), "comp")
        tops = parts.groupBy("j", "key").agg(F.max(best).alias("top"), F.count("*").alias("classes")).where("classes > 1")
        met = rows.join(tops.select("j", "key", "top"), ["j", "key"]).where("comp <> top.comp")
        met = met.select("node", F.col("top.node").alias("pivot")).distinct().join(known.drop("rep"), "node").join(other, "pivot")
        met = met.where(_fits("n", "m", percent) & (agree >= AGREE))
        met = stage(met.select(F.col("node").alias("a"), F.col("pivot").alias("b")), "join-pairs")
        links = stage(verified(met, sets, percent), "join-links")
        if links.isEmpty():
            break
        labels = merged(labels, links)
    return labels


def _fits(n: str, m: str, percent: int) -> Column:
    return (100 * F.least(n, m)) >= (percent * F.greatest(n, m))


def _candidates(docs: DataFrame, nodes: DataFrame, order: Order, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) across classes that share enough of their prefixes."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(order)
    pairs_schema = pa.schema([("shingle", pa.int64()), ("node", pa.int64())])

    def prefixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(known.value.prefix(own, percent)[0], node_of(own)) for own in sets_of(batch.column(1)) if len(own)]
            if found:
                sizes = [len(p) for p, _ in found]
                node = np.repeat(np.array([x for _, x in found], dtype=np.int64), sizes)
                yield batch_of(pairs_schema, np.concatenate([p for p, _ in found]), node)

    # A shingle in the prefixes of one node only cannot make a pair: one small sum for each finds the others.
    met = map_text(docs.where("id is not null"), prefixes, "shingle long, node long").groupBy("shingle")
    met = met.agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    bits = spark.sparkContext.broadcast(_bits(met, "shingle", SHINGLE_BITS))
    long = pa.int64()
    kinds = [long, long, long, pa.int32(), long, long, long, pa.list_(long), pa.list_(long), pa.list_(pa.int32())]
    names = ("rep", "node", "n", "matches", "size", "end_count", "end_shingle", "sketch", "shingles", "places")
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for rep, own in zip(batch.column(0).to_pylist(), sets_of(batch.column(1)), strict=True):
                if len(own):
                    prefix, matches = known.value.prefix(own, percent)
                    at = np.flatnonzero(_held(bits.value, prefix, SHINGLE_BITS))
                    if len(at):
                        end = (int(known.value.frequency(prefix[-1:])[0]), int(prefix[-1]))
                        rows.append(
                            (rep, node_of(own), len(own), matches, len(prefix), *end, sketch_of(own), prefix[at], at.astype(np.int32))
                        )
            if rows:
                yield batch_of(schema, *map(list, zip(*rows, strict=True)))

    sql = (
        "rep long, node long, n long, matches int, size long, end_count long, end_shingle long, "
        "sketch array<long>, shingles array<long>, places array<int>"
    )
    rows = map_text(docs.where("id is not null"), shared, sql)
    comp = nodes.join(labels, "node", "left").select("node", "rep", F.coalesce("comp", "node").alias("comp"))
    rows = rows.join(stage(comp, "join-comps"), ["node", "rep"])
    # Where a prefix ends in the order, and how much of the set comes after it.
    end = F.struct("end_count", "end_shingle", (F.col("n") - F.col("size")).alias("rest")).alias("end")
    rows = stage(rows.select("node", "n", "matches", end, "comp", "sketch", "shingles", "places"), "join-entries")
    entries = rows.select("node", "n", "matches", "end", "comp", F.explode(F.arrays_zip("shingles", "places")).alias("z"))
    entries = entries.select("*", F.col("z.shingles").alias("shingle"), F.col("z.places").alias("place")).drop("z")
    sizes = entries.groupBy("shingle", "comp").agg(F.count("*").alias("c"))
    tops = sizes.groupBy("shingle").agg(
        F.max(F.struct("c", "comp")).alias("top"), F.count("*").alias("classes"), F.sum("c").alias("met")
    )
    tops = stage(tops.where("classes > 1").select("shingle", F.col("top.comp").alias("top"), "met"), "join-shared")
    # What two classes share before a place is contested in both prefixes, so the contested before it bound that.
    order_of = Window.partitionBy("node").orderBy("place")
    entries = entries.join(tops, "shingle").withColumn("before", F.dense_rank().over(order_of) - 1)
    # No partner asks for less than this.
    entries = entries.where(100 * (F.col("before") + F.col("n") - F.col("place")) >= percent * F.col("n"))
    entries = stage(entries, "join-contested")
    # Only where many meet, their sketches are worth the bytes.
    crowd = entries.where(F.col("met") > CROWD).join(rows.select("node", "sketch"), "node")
    calm = entries.where(F.col("met") <= CROWD).withColumn("sketch", F.lit(None).cast("array<long>"))
    entries = calm.unionByName(crowd).drop("met")
    # The largest class of a shingle meets all others, but never itself.
    rest = entries.where("comp <> top")
    left = entries.alias("x")
    right = rest.alias("y")
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    need = F.ceil(percent * (x("n") + y("n")) / (100 + percent))
    room = F.least(x("before"), y("before")) + F.least(x("n") - x("place"), y("n") - y("place"))
    once = (x("comp") == x("top")) | (x("node") < y("node"))
    differ = reduce(add, [F.bit_count(F.get(x("sketch"), F.lit(i)).bitwiseXOR(F.get(y("sketch"), F.lit(i)))) for i in range(SKETCH)])
    alike = F.coalesce(differ, F.lit(0)) <= x("n") + y("n") - 2 * need
    on = (x("shingle") == y("shingle")) & (x("comp") != y("comp")) & once & _fits("x.n", "y.n", percent) & (room >= need) & alike
    pairs = left.join(right, on).select(
        F.least(x("node"), y("node")).alias("a"),
        F.greatest(x("node"), y("node")).alias("b"),
        F.least(x("matches"), y("matches")).alias("matches"),
        need.alias("need"),
        F.least(x("end"), y("end")).alias("end"),
    )
    sums = pairs.groupBy("a", "b").agg(
        F.count("*").alias("shared"), F.max("matches").alias("matches"), F.max("need").alias("need"), F.max("end").alias("end")
    )
    # Up to where the first of the two prefixes ends, both sets were looked at whole.
    enough = (F.col("shared") >= F.col("matches")) & (F.col("shared") + F.col("end.rest") >= F.col("need"))
    return stage(sums.where(enough).select("a", "b"), "join-candidates", keep=True)


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Classes of documents linked by shingle-set similarity.

    Returns ``id``, ``n_shingles``, ``component`` (the least id of the class; the own id
    if it has no links) and ``same_set`` (the least id of the documents of an equal set).
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    with scratch(docs.sparkSession):
        own, classes = _classes(source, percent)
    out = own.select("id", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("node")).alias("node"))
    lone = out.where("node is null").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component"), F.col("id").alias("same_set"))
    return (
        out.where("node is not null")
        .join(classes, "node")
        .select("id", F.col("n").alias("n_shingles"), "component", F.col("rep").alias("same_set"))
        .unionByName(lone)
    )


def _classes(source: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Size and node of every row, and of every node its least id (``rep``) and that of its class."""
    found = stage(described(source), "join-described")
    own = stage(found.where("kind = 0").select("id", "n", "node"), "join-own", keep=True)
    nodes = found.where("kind = 0 and n > 0 and id is not null").groupBy("node")
    nodes = stage(nodes.agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.max("keys").alias("keys")), "join-nodes")
    with scratch(source.sparkSession):
        labels = stage(_early_classes(nodes, source, percent), "join-early-classes", keep=True)
    nodes = nodes.drop("keys")
    with scratch(source.sparkSession):
        pairs = _candidates(source, nodes, _order(found), labels, percent)
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = stage(gathered(source, ends.join(nodes.select("node", "rep"), "node")), "join-sets")
    every = nodes.join(labels, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))
    labels = merged(stage(every, "join-labels"), stage(verified(pairs, sets, percent), "join-links"))
    classes = stage(nodes.join(labels, "node").select("node", "rep", "comp"), "join-classes")
    least = classes.groupBy("comp").agg(F.min("rep").alias("component"))
    return own, stage(classes.join(least, "comp").select("node", "rep", "component"), "join-classes", keep=True)
