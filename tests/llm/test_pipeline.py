"""The pipeline against plain Python stage by stage, and edge rows through all stages."""

import hashlib

import corpus_pipeline
from tests.llm.test_jaccard import classes
from tests.llm.test_spans import documents, hits_by_hand

SF = "/root/testdata/sf0.001"


def test_stages_on_the_table(spark, scratch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = dict(documents(spark))
    kept = dict(texts)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{scratch}/{name}"
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        rows = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == corpus_pipeline.COLUMNS and len(rows) == docs.count()
        if name == "language":
            kept = {i: t for i, t in kept.items() if t and any(c.isalpha() for c in t)}
        elif name == "near_copies":
            kept = {i: kept[i] for i, _, least in classes(list(kept.items())) if i == least}
        elif name == "benchmark_free":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            kept = {i: kept[i] for i, _, hit, *_ in hits_by_hand(list(kept.items()), items) if not hit}
        else:
            assert all(r.n_chars == len(r.text) for r in rows.values())
            assert not any("@mail" in r.text for r in rows.values())
        assert set(rows) == set(kept), name
    out = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    assert set(out) == set(kept)
    for i, r in rows.items():
        assert out[i].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_run_gives_the_same(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and len({r.doc_id for r in rows}) == len(rows)


def test_edge_rows(spark, scratch):
    schema = "doc_id long, text string, lang string, source string, n_chars long, spans string, node long"
    text = "the quick brown fox jumps over the lazy dog near the river bank today " * 3
    rows = [(1, text, "en", "s", 5), (1, text, "en", "s", 5), (2, text, None, None, None), (None, text + "x y", "en", None, 1)]
    rows += [(3, None, "en", "s", 0), (4, "", "de", "s", 0), (5, "123 456", "en", "s", 7), (6, "mail a@b.cd now please", "en", "s", 1)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], schema)
    for frame, expected in ((docs, [1, 6]), (docs.limit(0), [])):
        step = frame
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = f"{scratch}/{len(expected)}-{i}"
            stage(spark, step, SF).write.parquet(path)
            step = spark.read.parquet(path)
            if name == "private" and expected:
                assert "mail <email> now please" in [r.text for r in step.collect()]
        assert sorted((r.doc_id for r in step.collect()), key=str) == sorted(expected, key=str)


def test_near_copies_of_null_and_repeated_ids(spark):
    body = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcd"]
    rows = [(7, body[0]), (7, body[0] + " more"), (9, body[0] + " other words")]
    rows += [(None, body[1]), (None, body[1] + " more"), (None, body[2]), (8, body[2] + " x"), (8, body[3]), (5, ""), (5, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, docs, SF).collect()]
    ids = sorted((i for i, _ in kept), key=str)
    assert ids == [5, 5, 7, 8, 8, None]
    assert (8, body[2] + " x") in kept and (8, body[3]) in kept
    assert sum(t in (body[1], body[1] + " more") for _, t in kept) == 1
