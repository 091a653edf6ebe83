"""MinHash classes against all pairs of plain sets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cratelink.llm import minhash


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(dict.fromkeys([9, 10, 11, 12, 13], " "))
    words = [w for w in words.split(" ") if w]
    if len(words) < 4:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 4]) for i in range(len(words) - 3)}


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
            if 100 * len(a & b) >= 80 * len(a | b):
                parent[root(a)] = root(b)
    least = {}
    for k in keys:
        least[root(k)] = min(sets[k] + [least.get(root(k), 1 << 60)])
    return sorted((i, len(k), least[root(k)] if k else i) for k, ids in sets.items() for i in ids)


def found(docs):
    return sorted((r.id, r.n_shingles, r.component) for r in minhash.linked(docs).collect())


def edited(rng, words, rate):
    out = []
    for w in words:
        if rng.random() < rate:
            out.append(f"e{rng.randrange(10**6)}")
        else:
            out.append(w)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_groups(spark, seed):
    """Groups of copies around the threshold, chains, common passages and edge texts."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(60)]
    docs = []
    for _ in range(25):
        base = [word() for _ in range(rng.randrange(4, 200))]
        docs += [edited(rng, base, rng.choice([0.005, 0.02, 0.05])) for _ in range(rng.randrange(2, 12))]
    base = [word() for _ in range(150)]
    for _ in range(150):  # one large group: middle, rim and outsiders
        docs.append(edited(rng, base, rng.choice([0.0, 0.01, 0.03, 0.06, 0.1])))
    for _ in range(60):
        docs.append(passage + [word() for _ in range(rng.choice([3, 10, 25, 100]))])
    chain = [word() for _ in range(80)]
    docs += [[f"c{j}" if j < 4 * i else w for j, w in enumerate(chain)] for i in range(12)]
    docs += docs[:40]
    pairs = [(i, " ".join(d)) for i, d in enumerate(docs)]
    pairs += [(1001, None), (1002, ""), (1003, "one two"), (1004, "ONE  two"), (1005, "one two three four"), (1006, " \n")]
    rng.shuffle(pairs)
    d = spark.createDataFrame(pairs, "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("key", F.lit(2))
    assert found(d.repartition(5)) == classes(pairs)


def test_last_step_alone_loses_nothing(spark, monkeypatch):
    """Links that the pivots do not show must come from the prefixes."""
    monkeypatch.setattr(minhash, "_pivot_pairs", lambda live, *_: live.selectExpr("node as a", "node as b").limit(0))
    rng = random.Random(5)
    docs = []
    for _ in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(3, 90))]
        docs += [edited(rng, base, 0.03) for _ in range(8)]
    pairs = [(i, " ".join(d)) for i, d in enumerate(docs)]
    assert found(spark.createDataFrame(pairs, "doc_id long, text string")) == classes(pairs)


def test_edges(spark):
    d = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, "x")], "doc_id long, text string")
    rows = sorted(((r.id, r.n_shingles, r.component) for r in minhash.linked(d).collect()), key=str)
    assert rows == [(1, 2, 1), (1, 2, 1), (2, 1, 2), (None, 2, None)]
    assert minhash.linked(d.limit(0)).count() == 0
    long = " ".join(f"v{i}" for i in range(900_000))
    two = spark.createDataFrame([(5, long), (4, long + " end")], "doc_id long, text string")
    assert sorted((r.id, r.component) for r in minhash.linked(two).collect()) == [(4, 4), (5, 4)]


def test_agreement_of_collections():
    """Collections of sets of similarity s agree with probability s to the power of their width."""
    rng = np.random.default_rng(3)
    agree = []
    for _ in range(200):
        both, a, b = np.split(rng.integers(1, 1 << 60, 120), [80, 100])
        agree.append((minhash.collections_of(np.append(both, a)) == minhash.collections_of(np.append(both, b))).mean())
    assert abs(np.mean(agree) - (80 / 120) ** minhash.WIDTH) < 0.03
