"""Nearest neighbours by cosine: stable projections, kd-trees, and a chi-square stopping test.

Unit vectors are projected on *m* Gaussian directions, a 2-stable distribution: for two
points at distance d, the squared projected distance over d^2 follows chi-square with m
degrees of freedom. Projected neighbours are met in the order of a kd-tree's leaves and
verified on the original vectors, until the next leaf is so far in the projection that,
with probability *confidence*, nothing nearer than the k-th best is left.

The upper levels of the tree cut all rows into cells; they are laid over a sample of
bounded size, but every row is indexed. A cell of many rows is dealt into blocks, and
each block gets a tree of its own. A query searches its own cell first, and then, with
the distance reached there, the cells that the stopping test does not rule out.

Equal vectors are indexed once, with their k + 1 smallest ids: no query can need more.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do
those of another length than most have (of equal counts, the shorter), or null ids. A
query's own row never answers it, nor a repeated row of the same id; repeated ids count
once per vector. Equal scores go to the smaller id. Fewer candidates give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import exp

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cratelink.llm.common import batch_of, prepare
from cratelink.session import stage

DIRECTIONS = 8
CONFIDENCE = 0.97
#: Rows of a cell, on average, until there are MAX_CELLS of them; and of a block of a cell.
CELL_ROWS = 2048
MAX_CELLS = 1024
BLOCK_ROWS = 8192
#: Queries that a block answers at once.
QUERY_BLOCK = 4096
#: Rows that the cells are laid over, at most (expected size of a hashed sample).
SAMPLE = 20_000
LEAF = 32
SEED = 20240229


def chi_square_quantile(p: float, m: int) -> float:
    """Quantile for an even number of degrees of freedom, by bisection."""
    def below(x: float) -> float:
        term, total = 1.0, 0.0
        for i in range(m // 2):
            total += term
            term *= x / 2 / (i + 1)
        return 1 - exp(-x / 2) * total

    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def _units(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def cosine(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosines in double precision, each row on its own."""
    return (query * vectors).sum(axis=1) / (np.sqrt((query * query).sum()) * np.sqrt((vectors * vectors).sum(axis=1)))


class Cells:
    """The upper levels of the kd-tree: numbered cells, with the box of each."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth = depth
        self.dims: list[int] = []
        self.cuts: list[float] = []
        parts = [points]
        for _ in range(depth):
            halves = []
            for part in parts:
                spread = part.max(axis=0) - part.min(axis=0) if len(part) else np.zeros(points.shape[1])
                dim = int(spread.argmax())
                cut = float(np.median(part[:, dim])) if len(part) else 0.0
                self.dims.append(dim)
                self.cuts.append(cut)
                halves += [part[part[:, dim] <= cut], part[part[:, dim] > cut]]
            parts = halves
        self.low = np.zeros((0, points.shape[1]))
        self.high = self.low

    def of(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), dtype=np.int64)
        dims, cuts = np.array([*self.dims, 0]), np.array([*self.cuts, 0.0])
        rows = np.arange(len(points))
        for _ in range(self.depth):
            at = 2 * at + 1 + (points[rows, dims[at]] > cuts[at])
        return at - ((1 << self.depth) - 1)

    def nearest(self, point: np.ndarray) -> np.ndarray:
        """Squared distance from a projected point to the box of each cell."""
        gap = np.maximum(0, np.maximum(self.low - point, point - self.high))
        return (gap * gap).sum(axis=1)


class Tree:
    """A kd-tree over one block: rows ordered by leaf, and the boxes of the leaves."""

    def __init__(self, points: np.ndarray):
        leaves, todo = [], [np.arange(len(points))]
        while todo:
            rows = todo.pop()
            if len(rows) <= LEAF:
                leaves.append(rows)
                continue
            own = points[rows]
            dim = int((own.max(axis=0) - own.min(axis=0)).argmax())
            half = len(rows) // 2
            order = np.argpartition(own[:, dim], half)
            todo += [rows[order[:half]], rows[order[half:]]]
        self.rows = np.concatenate(leaves)
        self.first = np.cumsum([0, *map(len, leaves)])
        self.points = points[self.rows]
        self.low = np.minimum.reduceat(self.points, self.first[:-1], axis=0)
        self.high = np.maximum.reduceat(self.points, self.first[:-1], axis=0)

    def search(
        self, point: np.ndarray, query: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, reach: float, factor: float
    ) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the k best and their scores; *reach*: squared distance already attained."""
        gap = np.maximum(0, np.maximum(self.low - point, point - self.high))
        bound = (gap * gap).sum(axis=1)
        order = np.argsort(bound, kind="stable")
        bound = bound[order]
        best, scores = np.zeros(0, np.int64), np.zeros(0)
        at, step = 0, 4
        while at < len(order) and bound[at] < factor * reach:
            stop = min(len(order), at + step)
            rows = np.concatenate([np.arange(self.first[i], self.first[i + 1]) for i in order[at:stop].tolist()])
            away = ((self.points[rows] - point) ** 2).sum(axis=1)
            rows = self.rows[rows[away < factor * reach]]
            if len(rows):
                best = np.concatenate([best, rows])
                scores = np.concatenate([scores, cosine(query, vectors[rows])])
                top = np.lexsort((ids[best], -scores))[:k]
                best, scores = best[top], scores[top]
                if len(best) == k:
                    reach = min(reach, max(1e-12, 2 - 2 * float(scores[-1])))
            at, step = stop, min(64, step * 2)
        return best, scores


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``v`` (array of double) of the vectors that take part."""
    v = F.col("v")
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    out = out.where(F.col("id").isNotNull() & good).where(F.exists("v", lambda x: x != 0))
    sizes = out.groupBy(F.size("v").alias("n")).count().orderBy(F.col("count").desc(), "n").first()
    return out.where(F.size("v") == (sizes["n"] if sizes else 0))


def _blob(column: pa.Array, size: int) -> np.ndarray:
    """Rows of a list column of equally long rows as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def neighbours(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    directions: int = DIRECTIONS,
    confidence: float = CONFIDENCE,
) -> DataFrame:
    """The *k* nearest rows of each row for which *is_query* (over ``id``) holds.

    Returns ``query_id``, ``rank`` from 1, ``id`` and ``score`` (the cosine).
    """
    spark = vectors.sparkSession
    prepare(spark)
    everyone = stage(valid(vectors, id_col, vector_col).distinct(), "ann-valid")
    by_id = Window.partitionBy("v").orderBy("id")
    kept = everyone.withColumn("n", F.row_number().over(by_id)).where(F.col("n") <= k + 1)
    reps = stage(kept.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")), "ann-vectors")
    queries = everyone.where(is_query).select("v").distinct()
    queries = stage(queries.withColumn("query", F.monotonically_increasing_id()), "ann-queries")

    total = reps.count()
    shape = reps.select(F.size("v").alias("n")).first()
    size = shape["n"] if shape else 1
    matrix = np.random.default_rng(SEED).standard_normal((size, directions))
    share = min(1.0, SAMPLE / max(1, total))
    sample = reps.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").toArrow()
    points = _units(_blob(sample.column("v").combine_chunks(), size)) @ matrix if sample.num_rows else np.zeros((0, directions))
    depth = max(0, min(MAX_CELLS, -(-total // CELL_ROWS)) - 1).bit_length()
    cells = Cells(points, depth)
    _measured(reps, cells, matrix, directions)
    counts = cells.counts
    blocks = np.maximum(1, -(-counts // BLOCK_ROWS))
    shared = spark.sparkContext.broadcast((matrix, cells, blocks))

    dealt = pa.schema([("cell", pa.int32()), ("block", pa.int32()), ("ids", pa.list_(pa.int64())), ("vector", pa.binary())])

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions_of, own, parts = shared.value
        for batch in batches:
            if batch.num_rows:
                v = _blob(batch.column(0), size)
                cell = own.of(_units(v) @ directions_of)
                block = batch.column(2).to_numpy().astype(np.int64) % parts[cell]
                rows = [x.tobytes() for x in v]
                yield batch_of(dealt, cell.astype(np.int32), block.astype(np.int32), batch.column(1), rows)

    index = reps.select("v", "ids", F.pmod(F.xxhash64("v", F.lit(7)), F.lit(1 << 30)).alias("h")).mapInArrow(
        deal, "cell int, block int, ids array<long>, vector binary"
    )
    index = stage(index, "ann-index")
    factor = chi_square_quantile(confidence, directions)
    asked = pa.schema(
        [("query", pa.int64()), ("cell", pa.int32()), ("block", pa.int32()), ("reach", pa.float64()), ("vector", pa.binary())]
    )

    def ask(first: bool):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            directions_of, own, parts = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = _blob(batch.column(1), size)
                at = _units(v) @ directions_of
                reach = batch.column(2).to_numpy(zero_copy_only=False)
                out = []
                for query, x, point, home, far in zip(
                    batch.column(0).to_pylist(), v, at, own.of(at).tolist(), reach.tolist(), strict=True
                ):
                    near = [home] if first else np.flatnonzero(own.nearest(point) < factor * far).tolist()
                    out += [
                        (query, cell, block, far, x.tobytes())
                        for cell in near
                        if (first or cell != home) and own.counts[cell]
                        for block in range(parts[cell])
                    ]
                if out:
                    yield batch_of(asked, *map(list, zip(*out, strict=True)))

        return run

    asked_sql = "query long, cell int, block int, reach double, vector binary"
    everywhere = F.lit(float("inf")).alias("reach")
    found = _answered(index, queries.select("query", "v", everywhere).mapInArrow(ask(True), asked_sql), matrix, k + 1, factor)
    found = stage(found, "ann-home")
    reached = found.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("worst"))
    far = F.when(F.col("n") > k, F.greatest(F.lit(1e-12), 2 - 2 * F.col("worst"))).otherwise(F.lit(float("inf")))
    onward = queries.join(reached, "query", "left").select("query", "v", F.coalesce(far, F.lit(float("inf"))).alias("reach"))
    more = _answered(index, onward.mapInArrow(ask(False), asked_sql), matrix, k + 1, factor)
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.get("ids", F.lit(0)))
    top = found.unionByName(more).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    top = top.groupBy("query").agg(F.collect_list(F.struct((-F.col("score")).alias("less"), "ids")).alias("top"))
    top = stage(queries.join(top, "query").select("v", "top"), "ann-top")

    answers = F.flatten(F.transform("top", lambda t: F.transform(t["ids"], lambda i: F.struct(t["less"].alias("less"), i.alias("id")))))
    own = F.slice(F.array_sort(F.filter("answers", lambda a: a["id"] != F.col("query_id"))), 1, k)
    asking = everyone.where(is_query).select(F.col("id").alias("query_id"), "v")
    return (
        asking.join(top, "v")
        .select("query_id", answers.alias("answers"))
        .select("query_id", F.posexplode(own).alias("rank", "a"))
        .select("query_id", (F.col("rank") + 1).alias("rank"), F.col("a.id").alias("id"), (-F.col("a.less")).alias("score"))
    )


def _measured(reps: DataFrame, cells: Cells, matrix: np.ndarray, m: int) -> None:
    """Rows and box of each cell, over all rows; as many numbers as there are cells."""
    shared = reps.sparkSession.sparkContext.broadcast((matrix, cells))
    size = len(matrix)
    names = [f"{side}{i}" for side in ("low", "high") for i in range(m)]
    schema = pa.schema([("cell", pa.int32()), ("n", pa.int64()), *[(x, pa.float64()) for x in names]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions_of, own = shared.value
        for batch in batches:
            if batch.num_rows:
                points = _units(_blob(batch.column(0), size)) @ directions_of
                cell = own.of(points)
                order = np.argsort(cell, kind="stable")
                known, first, n = np.unique(cell[order], return_index=True, return_counts=True)
                low = np.minimum.reduceat(points[order], first, axis=0)
                high = np.maximum.reduceat(points[order], first, axis=0)
                yield batch_of(schema, known.astype(np.int32), n, *low.T.copy(), *high.T.copy())

    rows = reps.select("v").mapInArrow(run, "cell int, n long, " + ", ".join(f"{x} double" for x in names))
    rows = rows.groupBy("cell").agg(
        F.sum("n").alias("n"), *[(F.min if x.startswith("low") else F.max)(x).alias(x) for x in names]
    )
    n = 1 << cells.depth
    cells.counts = np.zeros(n, dtype=np.int64)
    cells.low, cells.high = np.full((n, m), np.inf), np.full((n, m), -np.inf)
    for r in rows.collect():
        cells.counts[r["cell"]] = r["n"]
        cells.low[r["cell"]] = [r[f"low{i}"] for i in range(m)]
        cells.high[r["cell"]] = [r[f"high{i}"] for i in range(m)]


def _answered(index: DataFrame, asked: DataFrame, matrix: np.ndarray, k: int, factor: float) -> DataFrame:
    """The k best rows of each asked block, for each query."""
    asked = stage(asked, "ann-asked")
    crowd = asked.groupBy("cell", "block").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("parts"))
    crowd = stage(crowd, "ann-crowd")
    keys = ["cell", "block", "part"]
    rows = index.join(crowd, ["cell", "block"]).select(
        "cell", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "ids", "vector"
    )
    wants = asked.join(crowd, ["cell", "block"]).select(
        "cell", "block", F.pmod(F.xxhash64("query"), F.col("parts")).cast("int").alias("part"), "query", "reach", "vector"
    )

    def answer(rows: pd.DataFrame, wants: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or wants.empty:
            return pd.DataFrame([], columns=["query", "score", "ids"], dtype=object)
        vectors = np.frombuffer(b"".join(rows["vector"]), dtype=np.float64).reshape(len(rows), -1)
        asking = np.frombuffer(b"".join(wants["vector"]), dtype=np.float64).reshape(len(wants), -1)
        ids = rows["ids"].to_list()
        least = np.array([x[0] for x in ids], dtype=np.int64)
        tree = Tree(_units(vectors) @ matrix)
        points = _units(asking) @ matrix
        out = []
        for query, reach, point, v in zip(wants["query"], wants["reach"], points, asking, strict=True):
            best, scores = tree.search(point, v, vectors, least, k, reach, factor)
            out += [(query, score, ids[b]) for b, score in zip(best.tolist(), scores.tolist(), strict=True)]
        return pd.DataFrame(out, columns=["query", "score", "ids"])

    return (
        rows.groupBy(*keys)
        .cogroup(wants.groupBy(*keys))
        .applyInPandas(answer, "query long, score double, ids array<long>")
    )
