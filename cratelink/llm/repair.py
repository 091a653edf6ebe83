"""Repair of conversation structure by an auction for shortest paths.

The rows of a conversation, in order of turn, are the steps of a lattice whose nodes say
how many rows were read and what was put out last: nothing, system, user or assistant.
Arcs delete a row (3), keep it (0), give it the role that is due (2) or insert an empty
turn (2); a truncated row that stays costs 1 more, a blank or repeated one must go. A
cheapest path to the end gives roles ``(s?(ua)+)?``.

Paths are found by the auction algorithm: every node has a price, at most the cost of an
arc plus the price of its end. A path starts at an origin and is extended along an arc
that is tight, or contracted after its last node's price was raised to the least bid. It
stops at a node whose price has converged; the prices along it then are distances. Origins
are taken from the last row to the first, so converged nodes are always near. All prices
converge, so every tight arc lies on a cheapest path, and following the least letter of
the tight arcs from the start gives the least of the cheapest edit texts.

No conversation is held by one task. Rows are sorted in ranges of the full order and cut
into blocks of at most BLOCK rows, each one code per row. A conversation of several blocks
is solved block by block: the auction gives each block's costs between all of its entries
and exits, one narrow pass over blocks turns them into the prices at the block ends and
the state each block is entered in, and then all blocks are traced at once. Texts travel
only when rows are sorted and when they are joined to their edits.

* A null role, or null text, is one space. Rows of null conv_id are one conversation; null
  turns come first. Rows of the same turn are in order of role and text.
* Empty texts are blank, repeated rows are duplicates, very long texts are one row each.
* Roles are told by their first letter; one that is not s, u or a can only be replaced.
* Conversations without rows have zeros, an empty audit and no repaired rows; an empty
  table gives empty tables. Extra columns are never read, so their names may clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cratelink.llm.common import batch_of, prepare
from cratelink.session import stage

#: Rows of a block.
BLOCK = 512
#: Costs of edits, and what a truncated row that stays costs more.
DELETE, CHANGE, INSERT, CUT = 3, 2, 2, 1
#: What was put out last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an inserted or changed turn, by state.
DUE = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: What a kept row leads to, by state and initial.
KEPT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FAR = 1 << 40
#: Adjacent roles that may stand.
LEGAL = ("su", "ua", "au")
#: A row's code is the first letter of its role (o for others), upper case where truncated; a row that must go has ``-``.
_VISIBLE = r"[^\x20\x09-\x0D]"


class Lattice:
    """The rows of a block, with the prices of its nodes: distances to the end of the conversation."""

    def __init__(self, codes: str, ends: tuple[int, ...], last: bool):
        self.codes, self.ends, self.last = codes, ends, last
        self.price = [[0] * 4 for _ in range(len(codes) + 1)]
        self.done = [[False] * 4 for _ in range(len(codes) + 1)]
        self._auction()

    def arcs(self, i: int, state: int) -> list[tuple[str, int, int, int]]:
        """Letter, cost, and the node it leads to: (-1, 0) is the end. In order of letters."""
        if i == len(self.codes):
            out = [("", self.ends[state], -1, 0)] if self.ends[state] < FAR else []
            return out + [("I", INSERT, i, DUE[state])] if self.last else out
        code = self.codes[i]
        out = [("D", DELETE, i + 1, state), ("I", INSERT, i, DUE[state])]
        if code != "-":
            more = CUT if code.isupper() else 0
            kept = KEPT.get((state, code.lower()))
            if kept is not None:
                out.append(("K", more, i + 1, kept))
            out.append(("R", CHANGE + more, i + 1, DUE[state]))
        return [arc for arc in out if not (arc[2] == len(self.codes) and not self._open(arc[3]))]

    def _open(self, state: int) -> bool:
        return self.last or self.ends[state] < FAR

    def _reach(self, i: int) -> list[bool]:
        """States of row *i* from which the end can be reached; rows after it are known."""
        out = [any(j == -1 or (j > i and self.live[j][s]) for _, _, j, s in self.arcs(i, state)) for state in range(4)]
        for state in (ASSISTANT, USER, SYSTEM, NOTHING, ASSISTANT):
            out[state] = out[state] or any(j == i and out[s] for _, _, j, s in self.arcs(i, state))
        return out

    def _auction(self) -> None:
        m = len(self.codes)
        self.live = [[False] * 4 for _ in range(m + 1)]
        for i in range(m, -1, -1):
            self.live[i] = self._reach(i)
            arcs = [[a for a in self.arcs(i, s) if a[2] == -1 or self.live[a[2]][a[3]]] for s in range(4)]
            # A start below every bid: the least price ahead, and what any arc to it costs.
            ahead = [c + (0 if j == -1 else self.price[j][s]) for own in arcs for _, c, j, s in own if j != i]
            self.price[i] = [min(ahead, default=0)] * 4
            for origin in range(4):
                if self.live[i][origin]:
                    self._path(i, origin, arcs)

    def _path(self, i: int, origin: int, arcs: list[list[tuple[str, int, int, int]]]) -> None:
        """Auction from one origin until its path meets a converged node."""
        price, done = self.price[i], self.done[i]
        path = [origin]
        while path and not done[origin]:
            at = path[-1]
            bid, letter, j, s = min((c + (0 if j == -1 else self.price[j][s]), letter, j, s) for letter, c, j, s in arcs[at])
            if price[at] < bid:
                price[at] = bid
                if at != origin:
                    path.pop()
            elif j != i or done[s]:
                for node in path:  # all its arcs are tight and its end has converged
                    done[node] = True
            else:
                path.append(s)

    def trace(self, state: int) -> tuple[list[str], int]:
        """The edits of each row, trailing ones in one more, and the state at the end."""
        m, i, out = len(self.codes), 0, [""]
        while True:
            here = self.price[i][state]
            for letter, cost, j, s in self.arcs(i, state):
                if (j == -1 or self.live[j][s]) and here == cost + (0 if j == -1 else self.price[j][s]):
                    break
            if j == -1:
                return out, state
            out[-1] += letter
            if j > i:
                out.append("")
            i, state = j, s
            if i == m and not self.last:
                return out, state


_short = lru_cache(maxsize=1 << 12)(Lattice)


def solved(codes: str, ends: tuple[int, ...], last: bool) -> Lattice:
    """The lattice of a block; those of short conversations are kept, as many are alike."""
    return _short(codes, ends, last) if len(codes) <= 32 else Lattice(codes, ends, last)


#: Prices where a conversation ends: it may end with nothing or with an assistant's turn.
FINAL = (0, FAR, FAR, 0)


def crossing(codes: str, last: bool) -> list[int]:
    """Costs from each entry to each exit of a block; for a last block, to the end."""
    if last:
        lattice = solved(codes, FINAL, True)
        return [lattice.price[0][e] if lattice.live[0][e] else FAR for e in range(4)]
    out = []
    for x in range(4):
        lattice = solved(codes, tuple(0 if s == x else FAR for s in range(4)), False)
        out += [lattice.price[0][e] if lattice.live[0][e] else FAR for e in range(4)]
    return out


def damaged(turns: DataFrame) -> DataFrame:
    """The rows of a conversations table after deterministic damage.

    crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 takes its
    ``.!?`` away, 3 repeats it, 4 makes its role user. Nulls count as one space.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), fault.alias("fault"))
    changed = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", ""))
    rows = rows.where("fault <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        changed.otherwise(F.col("text")).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy"),
    )
    return rows.drop("copy")


def _identity() -> Column:
    """A number of 128 bits, as text, that equal roles and texts share."""
    return F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))


def _marked(turns: DataFrame) -> DataFrame:
    """Rows with what the sorted pass needs: identity, and where it was met first if it is met again."""
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    ).withColumn("same", _identity())
    met = rows.groupBy("conv_id", "same").agg(
        F.count("*").alias("times"), F.min(F.struct(F.col("turn").isNotNull().alias("set"), "turn")).alias("first")
    )
    met = stage(met.where("times > 1").select(F.col("conv_id").alias("c"), F.col("same").alias("s"), "first"), "repair-repeats")
    again = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    rows = rows.join(met, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("same") == F.col("s")), "left")
    return rows.select("conv_id", "turn", "role", "text", "same", F.coalesce(again, F.lit(False)).alias("again"))


def _coded(turns: DataFrame) -> DataFrame:
    """Every row with its fault and code, in range blocks of the full order."""
    visible = F.col("text").rlike(_VISIBLE)
    ended = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    rows = _marked(turns).select(
        "conv_id", "turn", "role", "text", "same", "again", (~visible).alias("blank"), (~ended).alias("cut")
    )
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Cut where prefixes differ, so equal rows stay together and the sample of the cuts stays small.
    cuts = [*order[:2], F.substring("role", 1, 32), F.substring("text", 1, 32)]
    placed = rows.repartitionByRange(n, *cuts).sortWithinPartitions(*order)
    placed = placed.withColumn("row", F.monotonically_increasing_id())
    fields = [("conv_id", placed.schema["conv_id"].dataType.simpleString()), ("turn", placed.schema["turn"].dataType.simpleString())]
    sql = ", ".join(f"{n} {k}" for n, k in fields) + ", role string, text string, row long, block long, fault string, code string"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, before, block, size = object(), None, 0, 0
        for batch in batches:
            convs, turn, same, again, blank, cut, role, row = (
                batch.column(c).to_pylist() for c in ("conv_id", "turn", "same", "again", "blank", "cut", "role", "row")
            )
            blocks, faults, codes = [], [], []
            for k in range(batch.num_rows):
                if convs[k] != conv or size == BLOCK:
                    block, size = row[k], 0
                here = (convs[k], turn[k], same[k])
                size += 1
                fault = "blank" if blank[k] else "duplicate" if again[k] or here == before else "truncated" if cut[k] else None
                letter = role[k][:1] if role[k][:1] in ("s", "u", "a") else "o"
                conv, before = convs[k], here
                blocks.append(block)
                faults.append(fault)
                codes.append(letter + ("-" if fault in ("blank", "duplicate") else letter.upper() if fault else letter))
            own = [batch.column(c) for c in ("conv_id", "turn", "role", "text", "row")]
            schema = pa.schema(
                [(f, a.type) for f, a in zip(("conv_id", "turn", "role", "text", "row"), own, strict=True)]
                + [("block", pa.int64()), ("fault", pa.string()), ("code", pa.string())]
            )
            yield batch_of(schema, *own, blocks, faults, codes)

    prepare(turns.sparkSession)
    return stage(placed.mapInArrow(run, sql), "repair-rows")


def _blocks(rows: DataFrame) -> DataFrame:
    """One row for each block: codes, faults, adjacent roles and turns."""
    count = lambda kind: F.count_if(F.col("fault") == kind).alias(kind)
    codes = F.array_sort(F.collect_list(F.struct("row", "code")))  # at most BLOCK
    out = rows.groupBy("conv_id", "block").agg(
        codes.alias("codes"), count("blank"), count("duplicate"), count("truncated"),
        F.min("turn").alias("low"), F.max("turn").alias("high"), F.count_distinct("turn").alias("turns"),
    )
    roles = F.transform("codes", lambda c: F.substring(c["code"], 1, 1))
    pairs = F.zip_with(F.slice(roles, 1, F.size(roles) - 1), F.slice(roles, 2, F.size(roles)), lambda a, b: F.concat(a, b))
    return out.select(
        "conv_id", "block", "blank", "duplicate", "truncated", "low", "high", "turns",
        F.array_join(F.transform("codes", lambda c: F.substring(c["code"], 2, 1)), "").alias("codes"),
        F.element_at(roles, 1).alias("first_role"), F.element_at(roles, -1).alias("last_role"),
        F.size(F.filter(pairs, lambda p: ~p.isin(*LEGAL))).cast("long").alias("illegal"),
    )


def _scan(df: DataFrame, order: list, fn, sql: str) -> DataFrame:
    """*fn* over the rows of each conversation in order; it keeps what it needs of rows before."""
    prepare(df.sparkSession)
    return df.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *order).mapInArrow(fn, sql)


def _joined_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks with the prices at their ends and the state they are entered in.

    A block of a conversation that has no other needs no crossing. Otherwise two narrow
    passes over the blocks (sixteen costs for up to BLOCK rows) join them.
    """
    crossed = pa.schema([("block", pa.int64()), ("last", pa.bool_()), ("costs", pa.list_(pa.int64()))])

    def cross(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            last = b.column(2).to_pylist()
            costs = [crossing(c, e) for c, e in zip(b.column(1).to_pylist(), last, strict=True)]
            yield batch_of(crossed, b.column(0), last, costs)

    kind = blocks.schema["conv_id"].dataType.simpleString()
    ends = blocks.groupBy("conv_id").agg(F.max("block").alias("end"), F.count("*").alias("n"))
    ends = ends.where("n > 1").withColumnRenamed("conv_id", "c")
    own = blocks.join(ends, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "block", "codes", (F.col("block") == F.col("end")).alias("last"))
    own = stage(own, "repair-split")
    costs = own.select("block", "codes", "last").mapInArrow(cross, "block long, last boolean, costs array<long>")
    rows = own.select("conv_id", "block").join(costs, "block").select("conv_id", "block", "last", "costs")

    def prices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entry: list[int] = []
        for b in batches:
            out = []
            for last, cost in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                ends = [] if last else entry
                entry = cost if last else [min(FAR, min(cost[4 * x + e] + ends[x] for x in range(4))) for e in range(4)]
                out.append(ends)
            schema = pa.schema([("conv_id", b.column(0).type), ("block", pa.int64()), ("ends", pa.list_(pa.int64()))])
            yield batch_of(schema, b.column(0), b.column(1), out)

    ended = _scan(rows, [F.col("block").desc()], prices, f"conv_id {kind}, block long, ends array<long>")
    ended = stage(ended.join(own.select(F.col("block").alias("b"), "codes", "last"), F.col("block") == F.col("b")).drop("b"), "repair-ends")

    # What each entry would lead to is found for all blocks at once; only four states then pass along a conversation.
    moves = pa.schema([("block", pa.int64()), ("moves", pa.list_(pa.int32()))])

    def move(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for codes, ends, last in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                own = solved(codes, FINAL if last else tuple(ends), last)
                out.append([own.trace(e)[1] if own.live[0][e] else -1 for e in range(4)])
            yield batch_of(moves, b.column(0), out)

    moved = ended.select("block", "codes", "ends", "last").mapInArrow(move, "block long, moves array<int>")
    steps = ended.select("conv_id", F.col("block").alias("b")).join(moved, F.col("b") == F.col("block")).select("conv_id", "block", "moves")

    def entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = object(), NOTHING
        for b in batches:
            out = []
            for own, step in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                state = NOTHING if own != conv else state
                out.append(state)
                conv, state = own, step[state]
            yield batch_of(pa.schema([("block", pa.int64()), ("entry", pa.int32())]), b.column(1), out)

    entered = _scan(steps, ["block"], entries, "block long, entry int")
    return ended.select(F.col("block").alias("b"), "ends", "last").join(entered.withColumnRenamed("block", "e"), F.col("b") == F.col("e")).drop("e")


def _traced(blocks: DataFrame) -> DataFrame:
    """``block``, ``cost`` and, for each row, its edits and the roles it leads to."""
    joined = _joined_blocks(blocks)
    todo = blocks.join(joined, F.col("block") == F.col("b"), "left").select("block", "codes", "ends", "last", "entry")
    edits = pa.list_(pa.struct([("edits", pa.string()), ("state", pa.int32())]))
    schema = pa.schema([("block", pa.int64()), ("cost", pa.int64()), ("rows", edits)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, cost = [], []
            for codes, ends, last, entry in zip(*(b.column(i).to_pylist() for i in range(1, 5)), strict=True):
                last = last is not False
                entry = entry or NOTHING
                own = solved(codes, FINAL if last else tuple(ends), last)
                found, exit_state = own.trace(entry)
                state, rows = entry, []
                for k, code in enumerate(codes):
                    mine = found[k] if k < len(codes) - 1 or not last else found[k] + found[k + 1]
                    rows.append({"edits": mine, "state": state})
                    state = after(mine, state, code)
                out.append(rows)
                cost.append(own.price[0][entry] - (0 if last else ends[exit_state]))
            yield batch_of(schema, b.column(0), cost, out)

    prepare(blocks.sparkSession)
    return stage(todo.mapInArrow(run, "block long, cost long, rows array<struct<edits:string,state:int>>"), "repair-traces")


def after(edits: str, state: int, code: str) -> int:
    """The state after the edits of a row."""
    for letter in edits:
        if letter == "K":
            state = KEPT[state, code.lower()]
        elif letter != "D":
            state = DUE[state]
    return state


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cheapest edits of every conversation.

    Returns conversations (``conv_id``, ``gaps``, ``blank``, ``duplicate``, ``truncated``,
    ``illegal``, ``cost``, ``audit``) and repaired rows (``conv_id``, ``row``, ``part``,
    ``role``, ``text``), in order of ``row`` and ``part``.
    """
    rows = _coded(turns)
    blocks = stage(_blocks(rows), "repair-blocks")
    traced = _traced(blocks)
    letters = F.array_join(F.transform("rows", lambda r: r["edits"]), "")
    short = traced.select("block", "cost", letters.alias("audit"))
    before = F.lag(F.struct("last_role", "high")).over(Window.partitionBy("conv_id").orderBy("block"))
    whole = blocks.join(short, "block").select("*", before.alias("before"))
    seam = F.when(F.col("before").isNotNull() & ~F.concat("before.last_role", "first_role").isin(*LEGAL), 1).otherwise(0)
    shared = F.when(F.col("before.high") == F.col("low"), 1).otherwise(0)
    whole = whole.withColumn("illegal", F.col("illegal") + seam).withColumn("turns", F.col("turns") - shared)
    total = lambda c: F.sum(c).cast("long").alias(c)
    pieces = F.array_sort(F.collect_list(F.struct("block", "audit")))
    gaps = F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("turns"), F.lit(0))
    conversations = whole.groupBy("conv_id").agg(
        gaps.cast("long").alias("gaps"), *[total(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.array_join(F.transform(pieces, lambda p: p["audit"]), "").alias("audit"),
    )
    # A block is at most BLOCK rows, so this join has no popular key; it is named by its first row.
    place = (F.col("row") - F.col("block")).cast("int")
    known = rows.join(traced.select("block", "rows"), "block").withColumn("own", F.get("rows", place))
    return conversations, known.select("conv_id", "row", F.explode(_output()).alias("o"), "role", "text").select(
        "conv_id", "row", "o.part",
        F.coalesce("o.role", "role").alias("role"), F.when(F.col("o.own"), F.col("text")).otherwise("").alias("text"),
    )


def _output() -> Column:
    """The turns that a row's edits put out: kept (null role), changed or inserted."""
    names = F.array(F.lit("user"), F.lit("user"), F.lit("assistant"), F.lit("user"))
    due = F.array(*[F.lit(d) for d in DUE])
    letters = F.filter(F.split("own.edits", ""), lambda c: c != "")
    empty = F.array().cast("array<struct<part:int,role:string,own:boolean>>")
    start = F.struct(F.col("own.state").alias("state"), empty.alias("out"))
    kept = (
        F.when(F.substring("code", 1, 1) == "s", SYSTEM).when(F.substring("code", 1, 1) == "u", USER).otherwise(ASSISTANT)
    )

    def step(acc: Column, letter: Column) -> Column:
        role = F.when(letter != "K", F.get(names, acc["state"]))
        turn = F.struct(F.size(acc["out"]).cast("int").alias("part"), role.alias("role"), (letter != "I").alias("own"))
        out = F.when(letter == "D", acc["out"]).otherwise(F.array_append(acc["out"], turn))
        state = F.when(letter == "D", acc["state"]).when(letter == "K", kept).otherwise(F.get(due, acc["state"]))
        return F.struct(state.cast("int").alias("state"), out.alias("out"))

    return F.aggregate(letters, start, step, lambda acc: acc["out"])


def digests(rows: DataFrame) -> DataFrame:
    """``conv_id`` and the SHA-256 of its ``role:text`` lines, newline-joined.

    A digest is one chain, so the rows of a conversation pass one task in order; none are held.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, chain, schema = None, None, None
        for b in batches:
            schema = pa.schema([("conv_id", b.column(0).type), ("sha256", pa.string())])
            ids, out = [], []
            for own, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if chain is None or own != conv:
                    if chain is not None:
                        ids.append(conv)
                        out.append(chain.hexdigest())
                    conv, chain = own, hashlib.sha256()
                else:
                    chain.update(b"\n")
                chain.update(f"{role}:{text}".encode())
            yield batch_of(schema, ids, out)
        if chain is not None:
            yield batch_of(schema, [conv], [chain.hexdigest()])

    return _scan(rows, ["row", "part"], run, f"conv_id {kind}, sha256 string")
