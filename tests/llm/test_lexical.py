"""Ranked search against plain counting."""

import math
import random
import re
from collections import Counter

import pytest

from cratelink.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=lexical.TOP):
    own = [(i, Counter(t), len(t)) for i, t in ((i, terms(x)) for i, x in docs) if t]
    n_docs, n_terms = len(own), sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item in sorted({i for i, _ in items}, key=str):
        asked = [t for x in sorted({x for i, x in items if i == item and x is not None}) for t in terms(x)]
        scores = []
        for doc, tf, n in own:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            score = 0
            for t in asked:
                if tf[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((10**9 * tf[t]) // (1000 * tf[t] + 12 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        for rank, (score, _, _, doc) in enumerate(sorted(scores)[:top], 1):
            out.append((item, rank, doc, -score))
    return sorted(out, key=str)


def found(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as term", "2 as place", "3 as id").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "7 as item")
    rows = lexical.search(d, q, **more).collect()
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in rows), key=str)


@pytest.mark.parametrize("block", [lexical.BLOCK_TERMS, 40])
def test_all_documents(spark, monkeypatch, block):
    """Small blocks give what one automaton gives; ties, repeats and nulls are ranked as defined."""
    monkeypatch.setattr(lexical, "BLOCK_TERMS", block)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)] + ["Ünder", "straße", "ÉTÉ", "été", "x", "xx", "42"]
    line = lambda n: rng.choice([" ", "-", "_", "\n"]).join(rng.choice(words) for _ in range(n))
    docs = [(i, line(rng.randrange(1, 40))) for i in range(120)]
    docs += docs[:6] + [(None, docs[3][1]), (None, docs[3][1]), (500, None), (501, ""), (502, "..."), (503, line(30_000))]
    items = [(i, line(rng.randrange(1, 25))) for i in range(14)]
    items += [items[0], (1, "w1 w2 w2"), (50, None), (51, "?!"), (52, "unseen"), (None, "w3 w3")]
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, docs, items, top=3) == brute(docs, items, 3)


def test_whole_terms_only(spark):
    docs = [(1, "cat concatenate cat,cat"), (2, "concat scat"), (3, "CAT cats")]
    assert found(spark, docs, [(9, "cat")]) == brute(docs, [(9, "cat")])
    assert {r[2] for r in found(spark, docs, [(9, "cat")])} == {1, 3}


def test_empty(spark):
    assert found(spark, [], [(1, "a")]) == []
    assert found(spark, [(1, "a")], []) == []
    assert found(spark, [(1, None)], [(1, "a")]) == []
