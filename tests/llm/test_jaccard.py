"""The Jaccard join against all pairs of plain sets."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cratelink.llm import jaccard
from cratelink.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(
        dict.fromkeys([9, 10, 11, 12, 13], " ")
    )
    words = [w for w in words.split(" ") if w]
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def classes(docs):
    sets = {}
    for doc, text in docs:
        sets.setdefault(frozenset(shingles(text)), []).append(doc)
    keys = [k for k in sets if k]
    parent = {k: k for k in keys}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if 100 * len(a & b) >= 75 * len(a | b):
                parent[root(a)] = root(b)
    least = {}
    for k in keys:
        least[root(k)] = min(sets[k] + [least.get(root(k), 1 << 60)])
    out = []
    for k, ids in sets.items():
        out += [(i, len(k), least[root(k)] if k else i) for i in ids]
    return sorted(out)


def found(docs):
    return sorted((r.id, r.n_shingles, r.component) for r in jaccard.linked(docs).collect())


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in QUERIES["op7_near_copies"](spark, SF).collect())
    assert got == classes([(r.doc_id, r.text) for r in rows])


def edited(rng, words, rate):
    out = []
    for w in words:
        if rng.random() < rate:
            out.append(f"e{rng.randrange(10**6)}")
            if rng.random() < 0.5:
                out.append(w)
        else:
            out.append(w)
    return out


@pytest.mark.parametrize(("seed", "crowd"), [(1, 16), (2, 1)])
def test_planted_groups(spark, monkeypatch, seed, crowd):
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(60)]
    docs = []
    for _ in range(25):  # groups of near copies around the threshold
        base = [word() for _ in range(rng.randrange(5, 200))]
        for _ in range(rng.randrange(2, 12)):
            docs.append(edited(rng, base, rng.choice([0.005, 0.02, 0.05])))
    base = [word() for _ in range(120)]
    for _ in range(60):  # one large group
        docs.append(edited(rng, base, 0.02))
    for _ in range(60):  # a common passage in short and long texts
        docs.append(passage + [word() for _ in range(rng.choice([5, 15, 25, 100]))])
    chain = [word() for _ in range(80)]
    for i in range(12):  # neighbours are similar, ends are not
        docs.append([f"c{j}" if j < 6 * i else w for j, w in enumerate(chain)])
    docs += docs[:40]
    pairs = [(i, " ".join(d)) for i, d in enumerate(docs)]
    pairs += [(1001, None), (1002, ""), (1003, "one two"), (1004, "ONE  two"), (1005, "one two three four five"), (1006, " \n")]
    rng.shuffle(pairs)
    d = spark.createDataFrame(pairs, "doc_id long, text string").withColumn("node", F.lit(1)).repartition(5)
    assert found(d) == classes(pairs)


def test_join_alone_loses_nothing(spark, monkeypatch):
    """Without early links, every pair must come from the prefixes."""
    monkeypatch.setattr(jaccard, "AGREE", 99)
    rng = random.Random(5)
    docs = []
    for _ in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(3, 90))]
        docs += [edited(rng, base, 0.03) for _ in range(6)]
    common = [f"p{i}" for i in range(40)]
    docs += [common + [f"q{rng.randrange(900)}" for _ in range(rng.randrange(3, 14))] for _ in range(40)]
    pairs = [(i, " ".join(d)) for i, d in enumerate(docs)]
    assert found(spark.createDataFrame(pairs, "doc_id long, text string")) == classes(pairs)


def test_family_too_far_apart_makes_few_pairs(spark):
    """Texts that each change three words of their own are alike, but hardly two of them enough."""
    rng = random.Random(4)
    texts = []
    for d in range(40):
        own = rng.sample(range(150), 3)
        texts.append([f"x{d}" if i in own else f"w{i}" for i in range(150)])
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "id long, text string")
    described = jaccard.described(docs)
    nodes = described.where("kind = 0").select("node", F.col("id").alias("rep"), "n")
    none = nodes.select("node", F.col("node").alias("comp")).limit(0)
    order = jaccard.Order(*(c.to_numpy() for c in described.where("kind = 1").select("id", "n").toArrow().columns))
    assert jaccard._candidates(docs, nodes, order, none, 75).count() < 2 * len(texts)
    assert found(docs.toDF("doc_id", "text")) == classes(list(enumerate(" ".join(t) for t in texts)))


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(5)
    pool = rng.integers(-(1 << 62), 1 << 62, 400)
    bits = lambda own: np.unpackbits(np.array(jaccard.sketch_of(own)).view(np.uint8))
    for size in (0, 1, 30, 200, 399):
        a, b = (np.unique(rng.choice(pool, size, replace=False)) for _ in range(2))
        apart = int((bits(a) != bits(b)).sum())
        assert apart <= len(np.setxor1d(a, b))
        assert size == 0 or len(np.setxor1d(a, b)) == 0 or apart > 0


def test_edges(spark):
    d = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "x")], "doc_id long, text string")
    rows = sorted(((r.id, r.n_shingles, r.component) for r in jaccard.linked(d).collect()), key=str)
    assert rows == [(1, 2, 1), (1, 2, 1), (2, 1, 2), (None, 2, None)]
    assert jaccard.linked(d.limit(0)).count() == 0
    long = " ".join(f"v{i}" for i in range(900_000))
    two = spark.createDataFrame([(5, long), (4, long + " end")], "doc_id long, text string")
    assert sorted((r.id, r.component) for r in jaccard.linked(two).collect()) == [(4, 4), (5, 4)]


def test_prefix_bound():
    """A similar pair shares as many prefix shingles as the smaller demand."""
    import numpy as np

    rng = np.random.default_rng(3)
    common = rng.integers(0, 1 << 60, 50)
    order = jaccard.Order(common, rng.integers(2, 5000, 50))
    for _ in range(300):
        n = int(rng.integers(1, 80))
        base = np.unique(np.concatenate([rng.choice(common, min(n, 30), replace=False), rng.integers(0, 1 << 60, n)]))
        keep = base[rng.random(len(base)) > 0.08]
        other = np.unique(np.concatenate([keep, rng.integers(0, 1 << 60, int(rng.integers(0, 5)))]))
        if len(other) and 100 * len(np.intersect1d(base, other)) >= 75 * len(np.union1d(base, other)):
            (p, m), (q, k) = order.prefix(base, 75), order.prefix(other, 75)
            assert len(np.intersect1d(p, q)) >= min(m, k)


def test_filters_leave_no_shuffle_files(spark):
    def files():
        return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()

    before = files()
    jaccard._bits(spark.range(10000).groupBy(F.xxhash64("id").alias("x")).count(), "x", 12)
    for _ in range(50):  # they are deleted in the background
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before
