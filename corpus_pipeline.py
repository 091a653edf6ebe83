"""The corpus pipeline: language, near copies, benchmark passages, personal data, token ids.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet
and read again as the next stage's docs. All but the last return the columns of
documents; rows with a null doc_id are treated in every stage like any others.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cratelink.llm import bpe, decontam, jaccard, langid, pii
from cratelink.session import new_path, stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Languages come from a trained model, which SQL cannot express.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop null texts and texts without letters; ``lang`` becomes the language found.

    The model learns from the labelled texts of the stage's own input. Where nothing is
    labelled, texts with letters keep the lang they came with.
    """
    found = langid.identify(docs, langid.learn(docs), keep=COLUMNS).where("letters > 0")
    lang = F.when(F.col("lang") == langid.UNKNOWN, F.col("row.lang")).otherwise(F.col("lang"))
    return found.select(*[lang.alias("lang") if c == "lang" else F.col(f"row.{c}") for c in COLUMNS])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of linked documents: that of the least doc_id.

    Rows are told apart by keys of their own, so repeated and null ids are linked like any
    others. Null ids come last, and of equal ids one row stays. Texts without words link
    with nothing and stay.
    """
    rows = stage(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("key")), "pipeline-rows")
    found = jaccard.linked(rows, id_col="key").select(F.col("id").alias("key"), "component")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    found = found.join(rows.select("key", "doc_id"), "key").select("key", "component", order.alias("place"))
    found = stage(found, "pipeline-classes")
    first = found.groupBy("component").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    gone = found.join(first, "component").where("place.key <> first.key").select("key")
    return rows.join(gone, "key", "left_anti").select(*COLUMNS)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontam.scan(docs, items, keep=COLUMNS)
    return found.where(F.size("spans") == 0).select("row.*")


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; ``n_chars`` counts the new text."""
    found = pii.masked(pii.find(docs, keep=COLUMNS))
    new = {"text": F.col("masked"), "n_chars": F.length("masked").cast("long")}
    return found.select(*[new.get(c, F.col(f"row.{c}")).alias(c) for c in COLUMNS])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every kept text: ids, and the digests of ids and decoded bytes."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = bpe.encode_decode(docs, path, public_tokenizers.PATTERN)
    return out.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_copies", near_copies),
    ("benchmark_free", benchmark_free),
    ("private", private),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
