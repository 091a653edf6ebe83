"""Toxicity, language, neighbours, language model: held-out results and small brute forces."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cratelink.llm import ann, langid, lm, toxic
from cratelink.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def bucket(doc, parts):
    return zlib.crc32(str(doc).encode()) % parts


# --- toxicity -------------------------------------------------------------------


def test_folding():
    words = lambda t: b" ".join(toxic.folded(t)).decode()
    assert words("You 1D10T, m0r0n!") == "you idiot moron"
    assert words("іdіot $tupid tr@sh 100 3,5") == "idiot stupid trash 100 3 5"
    assert words("ＩＤＩＯＴ wor​thless") == "idiot worthless"
    assert words("") == "" and toxic.folded("É É") == ["é".encode()] * 2


def test_matching_and_exceptions():
    lexicon = toxic.Lexicon({"trash": 2.0, "clown": 1.0}, ["trash can"])
    lexicon.build()
    n, weight, hits = lexicon.features("Trash! the trash-can, a CL0WN clownish")
    assert (n, weight, len(hits)) == (7, 3.0, 2)
    assert lexicon.features("trash can " * 20_000)[1] == 0.0
    assert lexicon.features("") == (0, 0.0, [])


def test_toxicity_query(spark):
    rows = {r.doc_id: r for r in QUERIES["op4_toxicity"](spark, SF).collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    assert all(r.held_out == (bucket(i, 5) == 0) and r.predicted == (r.score >= 0.5) for i, r in rows.items())
    held = [(rows[i].score, y) for i, y in labels if rows[i].held_out]
    good, bad = ([s for s, y in held if y == k] for k in (0, 1))
    assert np.mean([b >= 0.5 for b in bad]) >= 0.5 and np.mean([g < 0.5 for g in good]) > 0.98


def test_toxicity_edges(spark):
    docs = spark.createDataFrame(
        [(i, ("you moron go away " if i % 2 else "a good day to you ") * 3, 1) for i in range(60)]
        + [(100, None, 1), (101, "", 1), (None, "moron", 1)]
        + [(102, "you m0ron go away " * 3, 1)] * 2,
        "doc_id long, text string, score int",
    )
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (100, None), (101, 0)], "doc_id long, toxic int")
    got = [(r.row.doc_id, r.score) for r in toxic.score(docs, toxic.learn(docs, labels)).collect()]
    assert len(got) == docs.count()
    best = dict(got)
    assert best[1] > 0.5 > best[2] and best[102] > 0.5 > best[100] == best[101]
    nothing = toxic.learn(docs, labels.limit(0))
    assert all(r.score < 1e-9 for r in toxic.score(docs, nothing).collect())
    assert toxic.score(docs.limit(0), nothing).count() == 0


# --- language -------------------------------------------------------------------


def test_language_query(spark):
    rows = {r.doc_id: r for r in QUERIES["op5_language"](spark, SF).collect()}
    truth = [(r.doc_id, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()]
    assert len(rows) == len(truth)
    assert all(r.held_out == (bucket(i, 3) == 1) for i, r in rows.items())
    held = [rows[i].lang_pred == lang for i, lang in truth if lang and rows[i].held_out]
    assert np.mean(held) > 0.98


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(4)
    for _ in range(30):
        n, langs = int(rng.integers(1, 7)), int(rng.integers(1, 4))
        scores = rng.normal(0, 4, (n, langs))
        paths = [[int(x) for x in np.base_repr(i, max(2, langs)).zfill(n)] for i in range(max(2, langs) ** n)]
        paths = [p for p in paths if max(p) < langs]
        value = lambda p: scores[np.arange(n), p].sum() - 3.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))
        assert value(langid.viterbi(scores, 3.0).tolist()) == pytest.approx(max(map(value, paths)))


def test_labels_are_those_of_the_best_path():
    """Two languages may share one switch, so the shortcut needs less than half of it."""
    model = langid.Model(["a", "b", "c"], np.ones((3, langid.BUCKETS)), np.ones((3, len(langid.SCRIPTS))))
    model.scores = np.array([[0, 10, -10.1], [0, -10.1, 10]])
    assert model.label(np.arange(2))[0].tolist() == [1, 2]
    rng = np.random.default_rng(5)
    for _ in range(300):
        model.scores = rng.normal(0, 5, (int(rng.integers(1, 9)), 3))
        places = np.arange(len(model.scores))
        value = lambda p: model.scores[places, p].sum() - langid.PENALTY * np.count_nonzero(np.diff(p))  # noqa: E731, B023
        assert value(model.label(places)[0]) == pytest.approx(value(langid.viterbi(model.scores, langid.PENALTY)))


def test_spans_scripts_and_edges(spark):
    en, de = "the house of the man with this thing and that", "das haus und der mann mit diesem ding nicht auch"
    ru = "этот дом и человек"
    rows = [(i, t, lang) for i in range(20) for t, lang in ((en, "en"), (de, "de"), (ru, "ru"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs)
    asked = [(1, f"{en} {en}. {de} {de}"), (2, ru.upper()), (3, None), (4, ""), (5, "12 — 34 !"), (6, en), (6, en), (None, de)]
    asked += [(7, (en + " ") * 20_000 + ru)]
    q = spark.createDataFrame(asked, "doc_id long, text string").withColumn("lang", F.lit("xx"))
    got = sorted(((r.row.doc_id, r) for r in langid.identify(q, model).collect()), key=lambda x: str(x[0]))
    named = [(i, r.lang) for i, r in got]
    assert named[0] in ((1, "en"), (1, "de"))  # half of each
    assert named[1:] == [(2, "ru"), (3, "und"), (4, "und"), (5, "und"), (6, "en"), (6, "en"), (7, "en"), (None, "de")]
    by = dict(got)
    assert [(s.lang, s.end - s.start) for s in by[1].spans] == [("en", 20), ("de", 20)]
    assert [s.lang for s in by[7].spans] == ["en", "ru"] and by[3].score == 0 and by[6].letters > 0
    assert all(r.lang == "und" for r in langid.identify(q, langid.learn(docs.limit(0))).collect())
    assert langid.identify(q.limit(0), model).count() == 0


# --- neighbours -----------------------------------------------------------------


def nearest(vectors, k):
    ids = np.array([i for i, _ in vectors])
    m = np.array([v for _, v in vectors], dtype=float)
    out = {}
    for i, v in vectors:
        if i % 50 == 0:
            score = (m * v).sum(axis=1) / np.sqrt((m * m).sum(axis=1)) / math.sqrt((np.array(v) ** 2).sum())
            order = [j for j in np.lexsort((ids, -np.round(score, 12))) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), score[j]) for j in order]
    return out


def test_neighbour_query(spark):
    rows = QUERIES["op6_neighbours"](spark, SF).collect()
    table = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    truth = nearest([(r.vec_id, r.embedding) for r in table], 5)
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(truth) and all(len(g) == 5 for g in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in truth[q]}) for q in truth)
    assert hits / (5 * len(truth)) >= 0.9
    for q in got:
        known = dict(truth[q])
        assert [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True)
        assert all(known.get(i, s) == pytest.approx(s, abs=1e-12) for i, s in got[q])


def test_neighbours_over_many_cells(spark, monkeypatch):
    """Small cells, blocks and query blocks; groups of equal vectors; tied scores."""
    for name, value in (("CELL_ROWS", 64), ("BLOCK_ROWS", 20), ("QUERY_BLOCK", 3)):
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 12))
    vectors = [(i, (centres[i % 8] + rng.normal(0, 0.6, 12)).tolist()) for i in range(1500)]
    vectors += [(i, [1.0] * 12) for i in range(1500, 1700)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(7)
    got = {}
    for r in ann.neighbours(df, F.col("id") % 50 == 0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.id
    truth = nearest(vectors, 5)
    assert set(got) == set(truth) and all(sorted(g) == [1, 2, 3, 4, 5] for g in got.values())
    assert [got[1600][i] for i in range(1, 6)] == [1500, 1501, 1502, 1503, 1504]
    assert [got[1500][i] for i in range(1, 6)] == [1501, 1502, 1503, 1504, 1505]
    hits = sum(len(set(got[q].values()) & {i for i, _ in truth[q]}) for q in truth)
    assert hits / (5 * len(truth)) >= 0.9


def test_neighbour_edges(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [2.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [None, 1.0])]
    rows += [(7, [float("inf"), 1.0]), (None, [1.0, 0.0]), (8, [1.0]), (50, [-1.0, 0.0]), (0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1))
    got = sorted((r.query_id, r["rank"], r.id) for r in ann.neighbours(df, F.col("id") % 50 == 0).collect())
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 50), (50, 1, 1), (50, 2, 2), (50, 3, 0)]
    assert ann.neighbours(df.limit(0), F.col("id") % 50 == 0).count() == 0


def test_common_terms_stay_in_a_long_lexicon(spark):
    """5,000 words of few toxic documents outweigh a common term; all are kept."""
    rare = " ".join(f"{chr(97 + i % 26)}{i}x" for i in range(5000))
    rows = [(i, f"{rare if i < 4 else 'quite'} {'zog' if i < 30 else 'day'}", 1) for i in range(40)]
    rows += [(i, "a good day " + ("zog" if i < 100 else "to you"), 0) for i in range(40, 440)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxic.learn(table.select("doc_id", "text"), table.select("doc_id", "toxic"))
    assert len(lexicon.weights) > 5000 and lexicon.weights["zog"] < min(w for t, w in lexicon.weights.items() if t[0] == "c")


# --- language model -------------------------------------------------------------


def plain_tokens(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in text.translate(dict.fromkeys([9, 10, 11, 12, 13], " ")).split(" ") if w] + [None]


@pytest.mark.parametrize("hot", [1 << 18, 50])
def test_language_model(spark, hot):
    table = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300").select("doc_id", "text")
    docs = [(r.doc_id, r.text) for r in table.collect()]
    words, model = lm.learn(table.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1))
    rows = {r.row.doc_id: r for r in lm.score(table, words, model, hot=hot).collect()}
    count = Counter(w for i, t in docs if bucket(i, 5) != 1 for w in plain_tokens(t))
    total, floor = count.total(), count.total() + 0.5 * (len(count) + 1)
    assert model.total == total and len(rows) == len(docs)
    for i, text in docs:
        own = plain_tokens(text)
        assert (rows[i].n_tokens, rows[i].n_known) == (len(own), sum(count[w] > 0 for w in own))
        assert rows[i].base_score == pytest.approx(sum(math.log10((count[w] + 0.5) / floor) for w in own), abs=1e-6)
        assert rows[i].score < 0
    seen = [i for i, _ in docs if bucket(i, 5) == 1 and rows[i].n_tokens == rows[i].n_known]
    assert sum(rows[i].score for i in seen) == pytest.approx(sum(rows[i].base_score for i in seen), rel=0.1)
    by_letter = -sum(math.log10(64) * (len((w or "").encode()) + 1) for _, t in docs for w in plain_tokens(t))
    assert sum(r.score for r in rows.values()) > 0.6 * by_letter


def test_probabilities_sum_to_one(spark):
    texts = [("ab ab ba a",), ("ab b 1 é",), ("ab. b a",), (None,)]
    words, model = lm.learn(spark.createDataFrame(texts, "text string"))
    known = sum(10**r.log10_p for r in words.collect())
    spelling = model.samples[0]
    assert np.allclose(np.exp(spelling.rows).sum(axis=1), 1)
    new = np.mean([(lm.WORD_STRENGTH + model.discount * s.tables) / (lm.WORD_STRENGTH + model.total) for s in model.samples])
    seen = [bytes(r.word) for r in words.collect()]
    reserved = sum(10**x for x in model.new_log10(seen))
    assert known + new - reserved == pytest.approx(1, abs=1e-6)


def test_seating_follows_the_restaurant():
    """Mean number of tables against one-by-one seating."""
    rng, plain = np.random.default_rng(2), random.Random(3)
    for customers, parent, discount, strength in ((30, 0.3, 0.5, 1.0), (200, 0.05, 0.7, 2.0), (6000, 0.2, 0.6, 1.0)):
        many = lm.reseat(np.full(4000, customers), np.full(4000, parent), np.zeros(4000), discount, strength, rng)
        runs = []
        for _ in range(2000 if customers < 1000 else 250):
            tables = 1
            for seated in range(1, customers):
                new = (strength + discount * tables) * parent
                tables += plain.random() < new / (new + seated - discount * tables)
            runs.append(tables)
        assert many.mean() == pytest.approx(np.mean(runs), rel=0.05)


def test_language_model_edges(spark):
    docs = spark.createDataFrame(
        [(1, None), (2, ""), (3, "Aa aa\tAA"), (3, "Aa aa\tAA"), (None, "zz " * 50_000), (4, "Überzz ” x" * 3)],
        "doc_id long, text string",
    ).withColumn("word", F.lit("clash"))
    words, model = lm.learn(docs.where("doc_id = 3"))
    rows = sorted(((r.row.doc_id, r.n_tokens, r.n_known) for r in lm.score(docs, words, model).collect()), key=str)
    assert rows == [(1, 1, 1), (2, 1, 1), (3, 4, 4), (3, 4, 4), (4, 8, 1), (None, 50_001, 1)]
    words, model = lm.learn(docs.limit(0))
    none = lm.score(docs, words, model).collect()
    assert len(none) == 6 and all(r.n_known == 0 and r.score < 0 for r in none)
    assert lm.perplexity(lm.score(docs, words, model)).first().perplexity > 1
    assert lm.score(docs.limit(0), words, model).count() == 0
