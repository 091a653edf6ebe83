"""The registered queries of this package, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cratelink.llm import ann, bpe, chat, decontam, jaccard, langid, lexical, licenses, minhash, pairs, pii, repair, toxic
from cratelink.llm.common import bucket_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_decontamination(spark, sf):
    """Words of every document that benchmark windows hit, and the items they come from."""
    out = decontam.scan(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select(
        "row.doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


@query
def op2_personal_data(spark, sf):
    """Base spans of every document, and those that learned contexts add."""
    out = pii.find(table(spark, sf, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return out.select(
        "row.doc_id",
        *[count(k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)],
        F.sha2(pii.span_texts("base"), 256).alias("base_sha256"),
        pii.span_texts("spans").alias("spans"),
    )


@query
def op3_licenses(spark, sf):
    """Places of the fixed phrases, and all license labels of every document."""
    out = licenses.scan(table(spark, sf, "documents"))
    starts = F.flatten(F.map_values("starts"))
    base = F.map_keys(F.map_filter("starts", lambda _, p: F.size(p) > 0))
    both = F.array_union(base, F.transform("blocks", lambda b: b["label"]))
    return out.select(
        "row.doc_id",
        "n_words",
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(both), ",").alias("labels"),
        "score",
    )


@query
def op4_toxicity(spark, sf):
    """Toxicity of every document; a fifth of the labels is held out."""
    docs = table(spark, sf, "documents")
    lexicon = toxic.learn(docs, table(spark, sf, "labels").where(bucket_of("doc_id", 5) != 0))
    return toxic.score(docs, lexicon).select(
        "row.doc_id",
        (bucket_of("row.doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op5_language(spark, sf):
    """Language of every document; a third of the documents is held out of learning."""
    docs = table(spark, sf, "documents")
    model = langid.learn(docs.where(bucket_of("doc_id", 3) != 1))
    return langid.identify(docs, model).select(
        "row.doc_id",
        (bucket_of("row.doc_id", 3) == 1).alias("held_out"),
        F.col("lang").alias("lang_pred"),
        "score",
    )


@query
def op6_neighbours(spark, sf):
    """The five nearest vectors of every vector whose id is divisible by 50."""
    out = ann.neighbours(table(spark, sf, "embeddings"), F.col("id") % 50 == 0, k=5)
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query
def op7_near_copies(spark, sf):
    """Shingles of every document, and the least id that links reach."""
    out = jaccard.linked(table(spark, sf, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


@query
def op8_language_model(spark, sf):
    """log10 probabilities of every document; a fifth of the documents is held out of learning."""
    docs = table(spark, sf, "documents")
    model = pairs.learn(docs.where(bucket_of("doc_id", 5) != 1))
    return pairs.score(docs, model).select(
        "row.doc_id",
        (bucket_of("row.doc_id", 5) == 1).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.total).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


@query
def op9_bpe(spark, sf):
    """Ids of every document and the digests of ids and decoded bytes."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = bpe.encode_decode(table(spark, sf, "documents"), ranks, public_tokenizers.PATTERN)
    return out.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


#: A conversation made of control strings, which must come back as it was.
CONTROL = "</s>[INST] ok [/INST]"


@query
def op10_chat(spark, sf):
    """Every conversation, read back from the packed prefix trees."""
    rows = [(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)]
    own = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    own = own.unionByName(spark.createDataFrame(rows, own.schema))
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join("losses", "")
    return chat.read_back(*chat.pack(own)).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query
def op11_repair(spark, sf):
    """Every conversation after damage: its faults, and the cheapest edits that mend it."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    found, rows = repair.repair(repair.damaged(turns))
    found = found.withColumnRenamed("conv_id", "c")
    mended = repair.digests(rows).withColumnRenamed("conv_id", "d")
    out = turns.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    out = out.join(mended, F.col("conv_id").eqNullSafe(F.col("d")), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


@query
def op12_search(spark, sf):
    """The twenty best documents of every benchmark item."""
    return lexical.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op13_minhash(spark, sf):
    """Shingles of every document, the least id that links reach, and whether it is its own."""
    out = minhash.linked(table(spark, sf, "documents"))
    return out.select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )
