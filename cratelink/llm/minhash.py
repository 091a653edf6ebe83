"""Near copies by MinHash with tensored banding.

A set of shingles is described by COLLECTIONS small collections of WIDTH min-hashes each.
The key of a table is made of two of the collections, so COLLECTIONS * WIDTH hashes serve
COLLECTIONS * (COLLECTIONS - 1) / 2 tables of 2 * WIDTH hashes. Two sets of similarity s
agree in a collection with probability p = s^WIDTH, and meet in a table unless they agree
in fewer than two: at s = 0.8 and with the settings here a pair is missed with probability
2.3e-6, at 0.9 with 1e-10. Every link is confirmed on the full sets.

Groups are never expanded into pairs. Texts of equal sets are one node. In every bucket
that holds several nodes one pivot is compared with all others: the node whose buckets
are the fullest, so the middle of a group of near copies, and then the fullest one outside
the first pivot's class. What is left are buckets of several classes. Their nodes are
joined by prefixes: shingles that one class alone has cannot be shared, the others are
ordered by rarity, and a shingle at place p can only be the first one that is shared with a
set whose size leaves room for the overlap in what follows. Pairs meet where both sizes fit
at the shingle. Copies with many changes have too few shingles that others have, so they
meet nothing, while copies with few changes are in the class of the pivot by then. That
join is exact, so no link that any table shows is lost.

* Null and empty texts have no shingles and link with nothing; a text of fewer words than
  a shingle is one shingle. Very long texts are hashed by pieces.
* Null ids have sets but no class. Rows that share an id and differ in text are nodes of
  their own, equal rows are one; all carry the least id of their class, so ties need no rule.
* An empty table gives an empty one. Extra columns are never read, so their names may clash.
* Shingles are 64-bit hashes, nodes 64-bit sums of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cratelink.llm.common import LOWER_TABLE, SLICE_BYTES, batch_of, map_text, mixed, word_hashes
from cratelink.llm.jaccard import DOC_BITS, _bits, _held, components, verified
from cratelink.session import stage

SHINGLE = 4
#: Similarity, in hundredths.
PERCENT = 80
#: Collections of min-hashes, and min-hashes of each.
COLLECTIONS, WIDTH = 16, 2
#: Shingles hashed at once.
PIECE = 1 << 13

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.frombuffer(LOWER_TABLE, dtype=np.uint8)
_SALTS = mixed(np.arange(501, 501 + COLLECTIONS * WIDTH, dtype=np.uint64))
_NODE_SALT = mixed(np.array([499], dtype=np.uint64))[0]


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in pieces that end between words."""
    start = 0
    while start < len(data):
        stop = min(len(data), start + SLICE_BYTES)
        while stop < len(data) and not _SPACE[data[stop]]:
            stop += 1
        yield data[start:stop]
        start = stop


def shingles_of(text: bytes) -> np.ndarray:
    """Sorted distinct shingles of a text, as signed 64-bit numbers."""
    data = np.frombuffer(text, dtype=np.uint8)
    parts = [word_hashes(_LOWER[p], np.array([0, len(p)]), _SPACE)[0] for p in _pieces(data)]
    words = np.concatenate([np.zeros(0, np.uint64), *parts])
    size = min(SHINGLE, len(words))
    if not size:
        return np.zeros(0, np.int64)
    odd = mixed(np.arange(601, 601 + size, dtype=np.uint64)) | np.uint64(1)
    last = len(words) - size + 1
    return np.unique(mixed(reduce(np.add, [words[i : last + i] * odd[i] for i in range(size)]) + np.uint64(size))).view(np.int64)


def node_of(own: np.ndarray) -> int:
    """A number for the whole set."""
    return int(mixed(own.view(np.uint64) ^ _NODE_SALT).sum().view(np.int64)) if len(own) else 0


def collections_of(own: np.ndarray) -> np.ndarray:
    """One number for each collection of min-hashes."""
    least = np.full(len(_SALTS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(own), PIECE):
        part = own[start : start + PIECE].view(np.uint64)
        least = np.minimum(least, mixed(part[None, :] ^ _SALTS[:, None]).min(axis=1))
    turned = least.reshape(COLLECTIONS, WIDTH) * (2 * np.arange(WIDTH, dtype=np.uint64) + np.uint64(1))
    return mixed(turned.sum(axis=1)).view(np.int64)


def described(docs: DataFrame) -> DataFrame:
    """``id``, size, node and collections of every text."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles_of(t) for t in batch.column(1).cast(pa.binary()).fill_null(b"").to_pylist()]
            keys = [collections_of(own) if len(own) else None for own in sets]
            yield batch_of(schema, batch.column(0), [len(own) for own in sets], [node_of(own) for own in sets], keys)

    return map_text(docs, run, "id long, n long, node long, keys array<long>")


def gathered(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node`` and ``items`` (the set) of the wanted nodes, from the text of their document ``rep``."""
    bits = docs.sparkSession.sparkContext.broadcast(_bits(wanted, "rep", DOC_BITS))
    schema = pa.schema([("rep", pa.int64()), ("found", pa.int64()), ("items", pa.list_(pa.int64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.flatnonzero(_held(bits.value, batch.column(0).to_numpy(), DOC_BITS))
            if len(keep):
                part = batch.take(pa.array(keep))
                sets = [shingles_of(t) for t in part.column(1).cast(pa.binary()).fill_null(b"").to_pylist()]
                yield batch_of(schema, part.column(0), [node_of(own) for own in sets], sets)

    found = map_text(docs.where("id is not null"), run, "rep long, found long, items array<long>")
    once = found.dropDuplicates(["rep", "found"])
    same = (F.col("rep") == F.col("w_rep")) & (F.col("found") == F.col("node"))
    return once.join(wanted.select("node", F.col("rep").alias("w_rep")), same).select("node", "items")


def buckets(nodes: DataFrame) -> DataFrame:
    """``key`` and ``node`` of all buckets that hold several nodes, and how many those are."""
    pairs = [(i, j) for i in range(COLLECTIONS) for j in range(i + 1, COLLECTIONS)]
    keys = F.array(*[F.xxhash64(F.lit(t), F.col("keys")[i], F.col("keys")[j]) for t, (i, j) in enumerate(pairs)])
    entries = nodes.select("node", F.explode(keys).alias("key"))
    # A combining aggregate: a bucket that holds a third of all nodes is one row for each task.
    many = entries.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    return stage(entries.join(stage(many, "minhash-keys"), "key"), "minhash-buckets")


def _open(live: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Bucket rows with their class; buckets of one class are dropped."""
    if labels is None:
        return live.withColumn("comp", F.col("node"))
    rows = live.drop("comp").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    spread = rows.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b")
    return rows.join(spread.select("key"), "key")


def _pivot_pairs(live: DataFrame, nodes: DataFrame, column: str, percent: int) -> DataFrame:
    """Every node of a bucket beside the bucket's pivot, where classes differ and sizes fit."""
    met = live.where(f"node <> {column}.node and comp <> {column}.comp").select("node", F.col(f"{column}.node").alias("pivot")).distinct()
    met = met.join(nodes.select("node", "n"), "node").join(nodes.select(F.col("node").alias("pivot"), F.col("n").alias("m")), "pivot")
    met = met.where(100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
    return stage(met.select(F.col("node").alias("a"), F.col("pivot").alias("b")), "minhash-pairs")


def _confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = stage(gathered(docs, ends.join(nodes.select("node", "rep"), "node")), "minhash-sets")
    return stage(verified(pairs, sets, percent), "minhash-links")


def _rest(live: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links between classes that still share a bucket, by prefixes of rare shingles."""
    own = live.select("node", "comp").distinct()
    sets = gathered(docs, own.join(nodes, "node").select("node", "rep"))
    sets = stage(sets.join(own, "node"), "minhash-contested")
    items = sets.select("node", "comp", F.size("items").alias("n"), F.explode("items").alias("item"))
    counts = items.groupBy("item").agg(F.count("*").alias("df"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    # Shingles of one class only can neither be met nor decide: in the order they come first, by themselves.
    shared = stage(counts.where("low <> high").select("item", "df"), "minhash-shared")
    known = items.join(shared, "item").groupBy("node", "comp", "n").agg(F.array_sort(F.collect_list(F.struct("df", "item"))).alias("items"))
    # Where only the shingles from place p on can still be shared, a partner may have so many shingles at most.
    cap = F.expr(f"cast(floor((size(items) - pos) * {100 + percent} / {percent}) as long) - n")
    places = known.select("node", "comp", "n", "items", F.posexplode("items").alias("pos", "z")).withColumn("cap", cap)
    rows = places.where(100 * F.col("cap") >= percent * F.col("n")).select("node", "comp", "n", "cap", F.col("z.item").alias("item"))
    rows = stage(rows, "minhash-prefixes")
    # Who is too long or too short for everyone else with the shingle meets nobody.
    fits = rows.groupBy("item").agg(F.min("n").alias("least_n"), F.max("cap").alias("most_n"))
    rows = rows.join(fits, "item").where("cap >= least_n and n <= most_n").drop("least_n", "most_n")
    # The largest class of a shingle meets all others, but never itself.
    sizes = rows.groupBy("item", "comp").agg(F.count("*").alias("c"))
    tops = sizes.groupBy("item").agg(F.max(F.struct("c", "comp")).alias("top"), F.count("*").alias("classes"))
    tops = stage(tops.where("classes > 1").select("item", F.col("top.comp").alias("top")), "minhash-tops")
    rows = rows.join(tops, "item")
    x, y = rows.alias("x"), rows.where("comp <> top").alias("y")
    once = "(x.comp = x.top or x.node < y.node)"
    met = x.join(y, F.expr(f"x.item = y.item and x.comp <> y.comp and {once} and x.n <= y.cap and y.n <= x.cap"))
    pairs = met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    return stage(verified(stage(pairs, "minhash-pairs"), sets.select("node", "items"), percent), "minhash-links")


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``id``, ``n_shingles`` and ``component`` (the least id that links reach) of every document."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    own = stage(described(source), "minhash-described")
    nodes = own.where("n > 0 and id is not null").groupBy("node")
    nodes = stage(nodes.agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.max("keys").alias("keys")), "minhash-nodes")
    live = buckets(nodes)
    nodes = nodes.drop("keys")
    degree = live.groupBy("node").agg(F.sum("size").alias("degree"))
    live = stage(live.join(degree, "node").select("key", "node", "degree"), "minhash-live")
    edges = labels = None
    for _ in range(2):
        live = _open(live, labels)
        seat = F.struct("degree", "node", "comp")
        first = live.groupBy("key").agg(F.max(seat).alias("pivot"))
        live = live.drop("pivot").join(first, "key")
        if edges is not None:  # the first pivot was compared already: now the fullest outside its class
            second = live.where("comp <> pivot.comp").groupBy("key").agg(F.max(seat).alias("second"))
            live = live.drop("pivot").join(second.withColumnRenamed("second", "pivot"), "key")
        live = stage(live, "minhash-live")
        found = _confirmed(_pivot_pairs(live, nodes, "pivot", percent), nodes, source, percent)
        edges = found if edges is None else edges.unionByName(found)
        labels = components(edges)
    live = stage(_open(live.drop("pivot"), labels), "minhash-live")
    labels = components(edges.unionByName(_rest(live, nodes, source, percent)))
    classes = stage(nodes.join(labels, "node", "left").select("node", "rep", F.coalesce("comp", "node").alias("comp")), "minhash-classes")
    least = classes.groupBy("comp").agg(F.min("rep").alias("component"))
    classes = classes.join(least, "comp").select("node", "component")
    named = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("node"))
    out = own.select("id", F.col("n").alias("n_shingles"), named.alias("node"))
    lone = out.where("node is null").select("id", "n_shingles", F.col("id").alias("component"))
    return out.where("node is not null").join(classes, "node").select("id", "n_shingles", "component").unionByName(lone)
