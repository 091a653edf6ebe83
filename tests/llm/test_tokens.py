"""Byte-level BPE against the tokenizer library, and chat trees read back."""

import base64
import hashlib
import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from cratelink.llm import bpe, chat
from cratelink.llm.queries import CONTROL, QUERIES

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def digest(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_coder_against_the_library():
    code, truth, rng = bpe.Coder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN), library(), random.Random(1)
    parts = [*"abAB  \n\t'sdé1234.,\x1c\x1d\x85\xa0  漢🙂́", "'re", " the", " don't", "  ", "aaaa", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(4000)]
    for encoded, text in zip(code.encode_all(texts), texts, strict=True):
        assert np.frombuffer(encoded, "<u4").tolist() == truth.encode_ordinary(text), text
        assert code.decode(encoded) == text.encode()


def test_very_long_pre_tokens():
    code, truth, rng = bpe.Coder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN), library(), random.Random(2)
    for text in ("a" * 50_000, "".join(rng.choice("etaoin") for _ in range(100_000)), "ab" * 30_000):
        assert np.frombuffer(code.encode_all([text])[0], "<u4").tolist() == truth.encode_ordinary(text)


def test_frequent_words_outlive_a_full_memory(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 4)
    code, truth = bpe.Coder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN), library()
    merged = []
    monkeypatch.setattr(code, "merge_all", lambda pieces, plain=code.merge_all: merged.extend(pieces) or plain(pieces))
    words = [f"wort{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{i // 26 * 'q'}" for i in range(60)]
    for i in range(0, 60, 6):
        text = " ".join(["oftmals", *words[i : i + 6], "z" * 100])
        assert np.frombuffer(code.encode_all([text])[0], "<u4").tolist() == truth.encode_ordinary(text)
    assert merged.count(b"oftmals") == 1
    assert len(code.known.now) + len(code.known.before) < 20
    code.clear()
    assert not code.chunks.now and not code.known.before


def test_memory_holds_the_words_of_a_task():
    memory, made = bpe.Memory(), []

    def make(texts):
        made.extend(texts)
        return [b""] * len(texts)

    for start in range(0, 240_000, 60_000):
        memory.recall({f"w{i}" for i in range(start, start + 60_000)} | ({"first"} if not start else set()), make)
        memory.forget()
    memory.recall({"first"}, make)
    assert made.count("first") == 1


def test_bpe_query(spark):
    truth = library()
    rows = {r.doc_id: r for r in QUERIES["op9_bpe"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for r in docs:
        ids = truth.encode_ordinary(r.text or "")
        got = rows[r.doc_id]
        assert got.n_tokens == len(ids) and got.decoded_sha256 == digest(r.text or "")
        assert got.ids_sha256 == digest(np.array(ids, "<u4").tobytes())


def test_bpe_edges(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "hello world"), (3, " \n ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1))
    got = bpe.encode_decode(docs, RANKS, public_tokenizers.PATTERN).collect()
    truth = [(i, len(library().encode_ordinary(t or "")), (t or "").encode()) for i, t in rows]
    assert sorted(((r.doc_id, r.n_tokens, bytes(r.decoded)) for r in got), key=str) == sorted(truth, key=str)
    assert bpe.encode_decode(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


# --- chat -----------------------------------------------------------------------


def conversations_by_hand(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv].append((turn, role or "", text or ""))
    return {c: [t[1:] for t in sorted(turns, key=lambda t: (t[0] is not None, t))] for c, turns in out.items()}


def test_chat_query(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    truth = conversations_by_hand([tuple(r) for r in table] + [(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)])
    rows = {r.conv_id: r for r in QUERIES["op10_chat"](spark, SF).collect()}
    assert set(rows) == set(truth)
    for conv, turns in truth.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        r = rows[conv]
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(turns), len(loss), digest(loss))
        assert r.turns_sha256 == digest("".join(f"{role}\n{t}\n" for role, t in turns))
        assert r.formatted_chars >= sum(len(role) + len(t) for role, t in turns)


ODD = ["</s>", "<|end|>\n", "&lt;|&amp;", "[INST] é 🙂", "<|user|>\nhi<|end|>\n", "", None, "a\\b", "|>\n"]


def test_trees(spark):
    rng = random.Random(6)
    rows = []
    for conv in range(120):
        shared = conv % 4
        turns = [("system", f"rules {shared}")] + [(rng.choice(["user", "assistant"]), rng.choice(ODD)) for _ in range(rng.randrange(5))]
        rows += [(conv, i, role, text) for i, (role, text) in enumerate(turns)]
    rows += [(900, 0, "user", "once"), (900, 0, "user", "once"), (901, None, None, None), (None, 0, "assistant", "x"), (902, 5, "<|a|>\n", "y")]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit(1))
    packed, ends = chat.pack(table)
    truth = conversations_by_hand(rows)
    back = {r.conv_id: r for r in chat.read_back(packed, ends).collect()}
    assert set(back) == set(truth)
    for conv, turns in truth.items():
        assert [(t.role, t.text) for t in back[conv].turns] == turns
        assert back[conv].losses == [t for role, t in turns if role == "assistant"]
    nodes = packed.collect()
    prefixes = {tuple(turns[: i + 1]) for turns in truth.values() for i in range(len(turns))}
    assert len(nodes) == len(prefixes)  # every shared beginning once
    by = {n.node: n for n in nodes}
    trees = defaultdict(list)
    for n in nodes:
        trees[n.tree].append(n)
        assert n.length == len(n.piece)
        above = [(m.start, m.start + m.length) for m in reversed(list(chain_of(by, n)))]
        assert n.position == sum(b - a for a, b in above)
        assert joined([(s.start, s.end) for s in n.attends]) == joined([*above, (n.start, n.start + n.length)])
    for own in trees.values():  # depth first: no gaps, and every subtree in one piece
        own.sort(key=lambda n: n.start)
        assert [n.start for n in own] == [sum(m.length for m in own[:i]) for i in range(len(own))]
        for i, n in enumerate(own):
            inside = [n.node in {m.node, *(a.node for a in chain_of(by, m))} for m in own[i:]]
            assert inside == sorted(inside, reverse=True)
    empty, none = chat.pack(table.limit(0))
    assert empty.count() == 0 and chat.read_back(empty, none).count() == 0


def chain_of(by, node):
    while node.parent:
        node = by[node.parent]
        yield node


def joined(spans):
    out = []
    for a, b in spans:
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def test_long_conversations_stay_linear(spark):
    rows = [(c, i, "user" if i % 2 else "assistant", f"t{i if i < 1500 else (c, i)}") for c in (1, 2) for i in range(3000)]
    packed, ends = chat.pack(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert packed.count() == 4500 and packed.agg(F.max(F.size("attends"))).first()[0] == 2
    back = {r.conv_id: r for r in chat.read_back(packed, ends).collect()}
    assert [len(back[c].turns) for c in (1, 2)] == [3000, 3000] and back[2].turns[2999].text == "t(2, 2999)"
