"""License notices: an exact set-similarity join of text blocks with notice templates.

Blocks are windows of words, each reaching one longest template over the next, so every
run of words as long as a template lies wholly in some block. A block meets a template
if it holds at least *threshold* of the template's distinct words. The template words are
ordered by the number of documents that hold them, rarest first. If a block and a
template share the needed number of words, the first one they share is in the prefix of
both; the join is on that word, after a length filter on the block, and a position filter
drops pairs whose remaining words are too few. What is left is counted exactly.

Everything is DataFrame functions. Fixed phrases are found on their own, as runs of words.

Null and empty texts have no words and no labels. Repeated rows repeat their result, an
empty table gives an empty one. A block may meet several templates; all count.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cratelink.llm.common import row_of
from cratelink.session import stage

#: label -> phrase whose words stand one after the other (fixed values of the contract).
PHRASES = {
    "cc-by": "cc by",
    "gpl": "general public license",
    "reserved": "all rights reserved",
}
#: label -> opening words of a notice.
TEMPLATES = {
    "apache": "licensed under the apache license version 2 0 you may not use this file except in compliance",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-by-text": "this work is licensed under a creative commons attribution international license",
    "cc0": "the author has dedicated the work to the public domain by waiving all rights worldwide",
    "copyright": "copyright all rights reserved no part may be reproduced without written permission",
    "gpl-text": "this work is licensed under the gnu general public license version",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "mpl": "this source code form is subject to the terms of the mozilla public license",
}
THRESHOLD = 0.8

#: What parts words once A-Z are lower-cased.
_APART = r"[^0-9a-z\x{80}-\x{10FFFF}]+"


def words(text: Column) -> Column:
    """Lower-cased words; a Kelvin sign would become an ASCII letter, so it is set aside first."""
    plain = F.lower(F.translate(F.coalesce(text, F.lit("")), "K", "ª"))
    return F.array_remove(F.split(plain, _APART), "")


def _literal(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def places(tokens: Column, phrase: Sequence[str]) -> Column:
    """Where the phrase starts; texts without its last word are not walked through."""
    def at(i: Column) -> Column:
        same = [F.get(tokens, i + k) == word for k, word in enumerate(phrase)]
        out = same[0]
        for one in same[1:]:
            out = out & one
        return out

    found = F.filter(F.sequence(F.lit(0), F.size(tokens) - 1), at)
    return F.when(F.array_contains(tokens, phrase[-1]), found).otherwise(F.array().cast("array<int>"))


def scan(
    docs: DataFrame,
    keep: Sequence[str] = ("doc_id",),
    text_col: str = "text",
    phrases: Mapping[str, str] = PHRASES,
    templates: Mapping[str, str] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Labels of every whole text.

    Returns ``row`` (the kept columns), ``n_words``, ``starts`` (map from phrase label to
    the words where it starts), ``blocks`` (first word, label and containment of each
    block that meets a template) and ``score`` (the best containment; 1 with a phrase).
    """
    sets = {label: sorted(set(text.split())) for label, text in templates.items()}
    vocabulary = sorted(set().union(*sets.values()))
    longest = max((len(t.split()) for t in templates.values()), default=1)
    tokens = F.col("tokens")
    found = (
        docs.select(row_of(keep), words(F.col(text_col)).alias("tokens"), F.monotonically_increasing_id().alias("key"))
        .withColumn("held", F.array_intersect(_literal(vocabulary), tokens))
        .withColumns({f"at_{i}": places(tokens, p.split()) for i, p in enumerate(phrases.values())})
    )
    needs = {label: ceil(threshold * len(t)) for label, t in sets.items()}
    whole = F.lit(False)
    for label, own in sets.items():
        whole = whole | (F.size(F.array_intersect(_literal(own), F.col("held"))) >= needs[label])
    found = found.select(
        "key",
        "row",
        "held",
        F.size("tokens").cast("long").alias("n_words"),
        F.map_from_arrays(_literal(list(phrases)), F.array(*[F.col(f"at_{i}") for i in range(len(phrases))])).alias("starts"),
        F.when(whole, tokens).alias("tokens"),
    )
    found = stage(found, "license-words")

    counted = found.select(F.explode("held").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    frequency = {r["word"]: r["n"] for r in counted.collect()}  # at most the template words
    order = sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    spark = docs.sparkSession
    index = [
        (word, place, label, len(own), needs[label])
        for label, own in sets.items()
        for place, word in enumerate(sorted(own, key=rank.__getitem__)[: len(own) - needs[label] + 1])
    ]
    prefix = spark.createDataFrame(index, "word string, place int, label string, size int, need int")
    ordered = spark.createDataFrame(
        [(label, sorted(own, key=rank.__getitem__)) for label, own in sets.items()], "label string, own array<string>"
    )

    starts = F.sequence(F.lit(0), F.greatest(F.size("tokens") - longest - 1, F.lit(0)), F.lit(longest))
    blocks = (
        found.where(F.col("tokens").isNotNull())
        .select("key", "tokens", F.explode(starts).alias("first"))
        .select(
            "key",
            "first",
            F.array_intersect(_literal(order), F.slice("tokens", F.col("first") + 1, 2 * longest)).alias("block"),
        )
        .where(F.size("block") >= min(needs.values(), default=0))
        .withColumn("n", F.size("block"))
    )
    met = (
        blocks.select("key", "first", "block", "n", F.posexplode("block").alias("at", "word"))
        .join(prefix, "word")
        .where(
            (F.col("n") >= F.col("need"))
            & (F.col("at") <= F.col("n") - F.col("need"))
            & (F.least(F.col("size") - F.col("place"), F.col("n") - F.col("at")) >= F.col("need"))
        )
        .select("key", "first", "block", "label", "need")
        .dropDuplicates(["key", "first", "label"])
        .join(ordered, "label")
        .withColumn("shared", F.size(F.array_intersect("own", "block")))
        .where(F.col("shared") >= F.col("need"))
        .groupBy("key")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("first", "label", (F.col("shared") / F.size("own")).alias("containment")))
            ).alias("blocks")
        )
    )
    none = F.array().cast("array<struct<first:int,label:string,containment:double>>")
    blocks_of = F.coalesce(F.col("blocks"), none)
    best = F.coalesce(F.array_max(F.transform(blocks_of, lambda b: b["containment"])), F.lit(0.0))
    phrase = F.exists(F.map_values("starts"), lambda p: F.size(p) > 0)
    return found.join(met, "key", "left").select(
        "row",
        "n_words",
        "starts",
        blocks_of.alias("blocks"),
        F.when(phrase, 1.0).otherwise(best).alias("score"),
    )
