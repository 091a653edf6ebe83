"""Conversation repair against every cheapest edit, and its edge cases."""

import hashlib
import random
from collections import defaultdict

import pytest

from cratelink.llm import repair
from cratelink.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        shown = text.strip(SPACE)
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(fault)
    return out


def best_edits(rows):
    """Forward search over all edits, keeping the least (cost, audit) of each state."""
    now = {0: (0, "", ())}

    def put(states, state, cost, audit, made):
        if state not in states or (cost, audit) < states[state][:2]:
            states[state] = (cost, audit, made)

    def inserted(states):
        for _ in range(3):
            for state, (cost, audit, made) in list(states.items()):
                due = repair.DUE[state]
                put(states, due, cost + 2, audit + "I", (*made, (repair.ROLES[due], "")))

    for (role, text), fault in zip(rows, faults_of(rows), strict=True):
        inserted(now)
        new = {}
        for state, (cost, audit, made) in now.items():
            put(new, state, cost + 3, audit + "D", made)
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                kept = repair.KEPT.get((state, role[:1]))
                if kept is not None:
                    put(new, kept, cost + more, audit + "K", (*made, (role, text)))
                due = repair.DUE[state]
                put(new, due, cost + 2 + more, audit + "R", (*made, (repair.ROLES[due], text)))
        now = new
    inserted(now)
    return min(now[s] for s in (0, 3) if s in now)


def brute(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, own in convs.items():
        own.sort()
        turns = [t for known, t, _, _ in own if known]
        pairs = [(r, x) for _, _, r, x in own]
        initials = [r[:1] for r, _ in pairs]
        faults = faults_of(pairs)
        cost, audit, made = best_edits(pairs)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(faults.count(k) for k in ("blank", "duplicate", "truncated")),
            sum(a + b not in repair.LEGAL for a, b in zip(initials, initials[1:], strict=False)),
            cost,
            audit,
            hashlib.sha256("\n".join(f"{r}:{x}" for r, x in made).encode()).hexdigest(),
        )
    return out


EMPTY = hashlib.sha256(b"").hexdigest()


def found(df):
    conversations, rows = repair.repair(df)
    hashes = {r.conv_id: r.sha256 for r in repair.digests(rows).collect()}
    return {r[0]: (*r[1:], hashes.get(r[0], EMPTY)) for r in conversations.collect()}


def random_rows(rng, convs, longest):
    texts = ["Yes.", "no", "", " \n", "Why?", "so be it", "Well!", None]
    roles = ["user", "assistant", "system", "tool", "user", "assistant", None]
    rows = []
    for conv in range(convs):
        turn = 0
        for _ in range(rng.randrange(1, longest)):
            turn += rng.choice([0, 1, 1, 1, 2])
            role = rng.choice(roles) if rng.random() < 0.5 else ("user", "assistant")[turn % 2]
            text = rng.choice(texts) if rng.random() < 0.4 else f"text {turn}."
            rows.append((conv or None, None if rng.random() < 0.05 else turn, role, text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("block", "longest"), [(512, 12), (3, 20), (1, 9)])
def test_all_edits(spark, monkeypatch, block, longest):
    """Blocks of any length give what one lattice over the whole conversation gives."""
    monkeypatch.setattr(repair, "BLOCK", block)
    rows = random_rows(random.Random(block), 60, longest)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute(rows)


def test_lattice_prices_are_distances():
    rng = random.Random(9)
    for _ in range(200):
        codes = "".join(rng.choice("suaoSUAO-") for _ in range(rng.randrange(0, 14)))
        own = repair.Lattice(codes, repair.FINAL, True)
        for i in range(len(codes) + 1):
            for state in range(4):
                for _, cost, j, s in own.arcs(i, state):
                    assert own.price[i][state] <= cost + (0 if j == -1 else own.price[j][s])
            assert all(own.done[i])


def test_hot_conversation(spark):
    """One conversation spans many blocks and range partitions."""
    rng = random.Random(4)
    rows = [(5, t, rng.choice(["user", "assistant", "assistant", "tool"]), f"t{t}" + rng.choice(["", ".", "!"])) for t in range(4000)]
    rows += [(6, 0, "user", "a."), (6, 1, "assistant", "b.")]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_edges(spark):
    long = "w" * 2_000_000 + "."
    rows = [(1, None, "user", "a."), (1, None, "user", "a."), (1, 3, None, None), (2, 0, "", "x"), (3, 1, "user", long), (3, 2, "assistant", "ok.")]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    assert found(df) == want
    assert want[3][5:7] == (0, "KK")
    clash = df.selectExpr("*", "1 as row", "2 as block", "3 as fault", "4 as code", "5 as same")
    assert found(clash) == want
    assert found(df.limit(0)) == {}


def test_query(spark):
    """Conversations that lose every row are still there."""
    sf = "/root/testdata/sf0.001"
    rows = QUERIES["op11_repair"](spark, sf).collect()
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    damaged = [tuple(r) for r in repair.damaged(turns).collect()]
    want = brute(damaged)
    ids = {r.conv_id for r in turns.select("conv_id").distinct().collect()}
    assert {r[0]: tuple(r[1:]) for r in rows} == {c: want.get(c, (0, 0, 0, 0, 0, 0, "", EMPTY)) for c in ids}
