"""Chat formatting as prefix trees: turns that conversations share are written once.

A node is a turn with all turns before it, named by a chained hash; conversations that
begin alike share nodes. A tree holds all conversations with the same first turn. Its
nodes are laid out depth-first in one sequence of characters. Every node carries its
place there, its position ids (which run on from its parent's, whatever lies between) and
the intervals of the sequence that it may attend to: its ancestors and itself. Turns that
follow one another without a fork are one interval, so a long conversation has few.

A tree may hold a third of all conversations, so no tree is ever gathered in one task:
the order is a range-partitioned sort on paths, and places are running sums over blocks.

Rows of a conversation go by turn, then role and text; repeated rows are turns of their
own. Null turns come first. A null text or role is empty, a null conv_id is an id of its
own. An empty table gives empty ones.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cratelink.llm.common import batch_of, map_text, strings
from cratelink.operators.position import in_blocks
from cratelink.session import stage

#: What marks a turn. Neither can come from a role or a text, whose brackets are escaped.
HEAD, NECK, TAIL = "<|", "|>\n", "<|end|>\n"
#: Characters that begin or end control strings, here or in other templates, and what stands for them.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("[", "&#91;"), ("]", "&#93;"))
TRAINED = "assistant"


def escaped(text: Column) -> Column:
    for plain, sign in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(sign))
    return text


def unescape(text: str) -> str:
    for plain, sign in reversed(ESCAPES):
        text = text.replace(sign, plain)
    return text


def paths(conversations: DataFrame) -> DataFrame:
    """One row per turn: ``conv_id``, ``place``, ``node``, ``parent``, ``tree``, ``role``, ``text``."""
    turn = F.struct(
        F.col("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    turns = F.array_sort(F.collect_list(turn))
    own = lambda t: F.sha2(F.concat(F.sha2(t["role"], 256), t["text"]), 256)
    chain = F.aggregate(
        "turns",
        F.array().cast("array<string>"),
        lambda seen, t: F.concat(
            seen,
            F.array(
                F.substring(F.sha2(F.concat(F.coalesce(F.element_at(F.when(F.size(seen) > 0, seen), -1), F.lit("")), own(t)), 256), 1, 32)
            ),
        ),
    )
    return (
        conversations.groupBy("conv_id")
        .agg(turns.alias("turns"))
        .select("conv_id", "turns", chain.alias("nodes"))
        .select("conv_id", "nodes", F.posexplode("turns").alias("place", "t"))
        .select(
            "conv_id",
            "place",
            F.get("nodes", F.col("place")).alias("node"),
            F.get("nodes", F.col("place") - 1).alias("parent"),
            F.get("nodes", F.lit(0)).alias("tree"),
            F.col("t.role").alias("role"),
            F.col("t.text").alias("text"),
        )
    )


def with_runs(turns: DataFrame) -> DataFrame:
    """Turns with ``path``: the first nodes of the unbranched runs from the root to the turn's own.

    A run ends where turns part, so a path is as long as there are forks above a turn,
    however many turns a conversation has.
    """
    known = turns.select("node", "parent").where("parent is not null").dropDuplicates(["node"])
    forks = known.groupBy("parent").agg(F.count("*").alias("n")).where("n > 1").select(F.col("parent").alias("fork"))
    forks = stage(forks, "chat-forks")
    first = turns.join(forks, turns["parent"] == forks["fork"], "left").where("parent is null or fork is not null")
    # A null conv_id is an id of its own, which a plain join would lose.
    heads = first.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "node"))).alias("heads"))
    heads = heads.withColumnRenamed("conv_id", "head_id")
    own = turns.join(heads, turns["conv_id"].eqNullSafe(heads["head_id"])).drop("head_id")
    path = F.transform(F.filter("heads", lambda h: h["place"] <= F.col("place")), lambda h: h["node"])
    return own.withColumn("path", path).drop("heads")


def pack(conversations: DataFrame, trained: str = TRAINED) -> tuple[DataFrame, DataFrame]:
    """The packed trees, and the nodes of each conversation.

    Nodes: ``tree``, ``node``, ``parent``, ``start`` and ``length`` (in the tree's
    sequence), ``position`` (of the first character), ``attends`` (intervals of the
    sequence, root first: the runs above, then the own run up to the node's end),
    ``piece`` (the characters) and ``loss_start``, ``loss_end`` (in the piece; null
    unless the role is *trained*). Conversations: ``conv_id``, ``place``, ``node``.
    """
    turns = stage(paths(conversations), "chat-turns")
    head = F.concat(F.lit(HEAD), escaped(F.col("role")), F.lit(NECK))
    body = escaped(F.col("text"))
    nodes = (
        with_runs(turns)
        .dropDuplicates(["node"])
        .withColumn("head", F.length(head))
        .withColumn("piece", F.concat(head, body, F.lit(TAIL)))
        .withColumn("length", F.length("piece").cast("long"))
        .withColumn("loss_start", F.when(F.col("role") == trained, F.col("head")))
        .withColumn("loss_end", F.when(F.col("role") == trained, F.col("head") + F.length(body)))
        .select("tree", "node", "parent", "path", "place", "piece", "length", "loss_start", "loss_end")
    )
    placed = in_blocks(nodes, "path", "place")
    before = Window.partitionBy("_block").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("_block").agg(F.sum("length").alias("_size"))
    offset = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_block", F.coalesce(F.sum("_size").over(offset), F.lit(0)).alias("_base"))
    at = F.col("_base") + F.coalesce(F.sum("length").over(before), F.lit(0))
    placed = placed.join(F.broadcast(sums), "_block").withColumn("at", at).drop("_block", "_place", "_base")
    placed = stage(placed.withColumn("run", F.element_at("path", -1)), "chat-placed")

    runs = placed.groupBy("run").agg(
        F.max("path").alias("path"), F.min("at").alias("a"), F.max(F.col("at") + F.col("length")).alias("b")
    )
    runs = stage(runs.withColumn("depth", F.size("path")), "chat-runs")
    spans = runs.select(F.col("run").alias("above"), "depth", "a", "b")
    above = (
        runs.select("run", F.explode("path").alias("above"))
        .join(spans, "above")
        .groupBy("run")
        .agg(F.array_sort(F.collect_list(F.struct("depth", "a", "b"))).alias("runs"))
    )
    above = stage(above, "chat-above")
    base = F.get("runs", F.lit(0))["a"]
    others = F.slice("runs", 1, F.size("runs") - 1)
    mine = F.element_at("runs", -1)["a"]
    interval = lambda a, b: F.struct((a - base).alias("start"), (b - base).alias("end"))
    end = F.col("at") + F.col("length")
    packed = placed.join(above, "run").select(
        "tree",
        "node",
        "parent",
        (F.col("at") - base).alias("start"),
        "length",
        (F.aggregate(others, F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"]) + F.col("at") - mine).alias("position"),
        F.concat(F.transform(others, lambda x: interval(x["a"], x["b"])), F.array(interval(mine, end))).alias("attends"),
        "piece",
        "loss_start",
        "loss_end",
    )
    return stage(packed, "chat-packed"), turns.select("conv_id", "place", "node")


def read_back(packed: DataFrame, ends: DataFrame) -> DataFrame:
    """Each conversation as it stands in the packed trees.

    ``conv_id``, ``formatted`` (what a model reads from root to leaf), ``losses`` (texts
    under the loss mask, unescaped) and ``turns`` (role and text, unescaped).
    """
    own = packed.select("node", "piece", "loss_start", "loss_end")
    gathered = (
        ends.join(own, "node")
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("place", "piece", "loss_start", "loss_end"))).alias("pieces"))
    )
    masked = F.filter("pieces", lambda p: p["loss_start"].isNotNull())
    ready = gathered.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"),
        F.transform(
            masked, lambda p: F.substring(p["piece"], p["loss_start"] + 1, p["loss_end"] - p["loss_start"])
        ).alias("losses"),
    )
    turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            formatted = strings(batch.column(1))
            losses = [[unescape(x) for x in mine] for mine in batch.column(2).to_pylist()]
            fields = [("conv_id", batch.schema.field(0).type), ("formatted", pa.string()), ("losses", pa.list_(pa.string())), ("turns", turn)]
            yield batch_of(pa.schema(fields), batch.column(0), formatted, losses, [parse(x) for x in formatted])

    kind = ends.schema["conv_id"].dataType.simpleString()
    return map_text(
        ready,
        run,
        f"conv_id {kind}, formatted string, losses array<string>, turns array<struct<role:string,text:string>>",
    )


def parse(formatted: str) -> list[dict[str, str]]:
    """Turns of a formatted conversation."""
    out = []
    for part in formatted.split(TAIL)[:-1]:
        role, _, text = part.removeprefix(HEAD).partition(NECK)
        out.append({"role": unescape(role), "text": unescape(text)})
    return out
