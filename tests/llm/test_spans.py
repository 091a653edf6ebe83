"""Decontamination, personal data, licenses: against plain Python over whole small tables."""

import hashlib
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cratelink.llm import decontam, licenses, pii
from cratelink.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORDS.findall(lower(text))


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


# --- decontamination ------------------------------------------------------------


def hits_by_hand(docs, items):
    owners = {}
    for item, text in items:
        own = words(text)
        for at in range(max(1, len(own) - 9) if own and item is not None else 0):
            owners.setdefault(tuple(own[at : at + 10]), set()).add(str(item))
    out = []
    for doc, text in docs:
        own, hit, found = words(text), set(), set()
        for size in {len(w) for w in owners}:
            for at in range(len(own) - size + 1):
                if (window := tuple(own[at : at + size])) in owners:
                    hit.update(range(at, at + size))
                    found |= owners[window]
        out.append((doc, len(own), len(hit), len(found), digest(",".join(sorted(found)))))
    return sorted(out, key=str)


def hits_of(docs, items, **options):
    rows = decontam.scan(docs, items, **options).collect()
    return sorted(
        (
            (r.row.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), len(r["items"]), digest(",".join(r["items"])))
            for r in rows
        ),
        key=str,
    )


def test_decontamination_query(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    expected = hits_by_hand(documents(spark), items)
    got = QUERIES["op1_decontamination"](spark, SF)
    rows = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got.collect()]
    assert sorted(rows, key=str) == expected
    assert any(r[2] for r in expected)
    assert got.where("contaminated <> (n_hit > 0)").count() == 0


@pytest.mark.parametrize("block_pairs", [3, 100_000])
def test_decontamination_edges(spark, block_pairs):
    many = " ".join(f"w{i % 50}" for i in range(20_000))
    docs = [(1, "A b C. d"), (2, None), (3, ""), (4, many + " x y " + "is " * 40), (4, many), (None, "x y z")]
    docs += [(5, "É é A é b c d e f g h i j k l"), (6, "b"), (6, "b")]
    items = [(1, "a B"), (2, "is " * 20), (2, "is " * 20), (3, None), (4, ""), (None, "zz"), (7, "y"), (8, "b")]
    items += [(5, " ".join(f"w{i}" for i in range(1, 13))), (6, "é b c d e f g h i j k")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("spans", F.lit("clash"))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit(1))
    assert hits_of(d, b, block_pairs=block_pairs) == hits_by_hand(docs, items)
    assert hits_of(d, b.limit(0), block_pairs=block_pairs) == hits_by_hand(docs, [])
    assert hits_of(d.limit(0), b, block_pairs=block_pairs) == []


# --- personal data --------------------------------------------------------------

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def accepted(kind, found):
    digits = [int(c) for c in found if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        doubled = [d * 2 - 9 * (d > 4) if i % 2 else d for i, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def base_by_hand(text):
    return [
        (kind, m.start(), m.end())
        for kind, rule in RULES.items()
        for m in re.finditer(rule, text or "")
        if accepted(kind, m[0])
    ]


def test_personal_data_query(spark):
    rows = {r.doc_id: r for r in QUERIES["op2_personal_data"](spark, SF).collect()}
    docs = documents(spark)
    assert len(rows) == len(docs)
    for doc, text in docs:
        base = base_by_hand(text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        r = rows[doc]
        assert r.base_sha256 == digest(joined)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in RULES]
        assert set(joined.split(",")) <= set(r.spans.split(",")) or not base


ODD = [
    "a@b@c.d.e x@y.z@q.w .@a.b a@b a@.b @a.b",
    "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111111",
    "+1 (755) 555-9729 +1 +12345678 +1234567890123456 ++49 30 1234567.",
    "é 漢 a@b.cd 🙂 10.0.0.1 " * 3,
    "1" * 5000 + "@" * 50 + "a" * 5000,
    "",
]


def test_base_rules_on_odd_texts():
    for text in ODD:
        assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(text)] == base_by_hand(text)


def test_contexts_find_unseen_identifiers(spark):
    docs = [(i, f"noise word{i} and my account mail is user{i}@site{i}.org thanks") for i in range(40)]
    docs += [(100, "so my account mail is jo_at_site9 thanks"), (101, "the server jo_at_site9 went down"), (102, None)]
    docs += [(103, "a plain text without any")] * 2
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("base", F.lit(1))
    got = pii.find(d, keep=["doc_id", "text"])
    rows = [(r.row.doc_id, [(s.kind, r.row.text[s.start : s.end]) for s in r.spans]) for r in got.collect()]
    assert len(rows) == len(docs)
    assert (100, [(0, "jo_at_site9")]) in rows
    assert [r for r in rows if r[0] in (101, 102, 103)] == [(101, []), (102, []), (103, []), (103, [])]
    masks = {r.row.doc_id: r.masked for r in pii.masked(got).collect()}
    assert masks[3] == "noise word3 and my account mail is <email> thanks" and masks[102] is None
    assert pii.find(d.limit(0)).count() == 0


def learned(spark, docs):
    """Added spans of each document, as texts."""
    got = pii.find(spark.createDataFrame(docs, "doc_id long, text string"), keep=["doc_id", "text"]).collect()
    out = {}
    for r in got:
        base = {(s.start, s.end) for s in r.base}
        out[r.row.doc_id] = [r.row.text[s.start : s.end] for s in r.spans if (s.start, s.end) not in base]
    return out


def test_contexts_find_numbers_with_blanks(spark):
    docs = [(i, f"noise word{i}x my phone number is +1 555 {1000 + i} {2000 + i} today") for i in range(40)]
    forms = ["555 123 4567", "(555) 123-4567", "555-123-4567", "4111 1111 1111 1112"]
    docs += [(100 + i, f"so my phone number is {form} today, or 12 or 13") for i, form in enumerate(forms)]
    docs += [(200, "in the year 555 123 4567 nothing"), (201, "my phone number is 555 123 4567.")]
    got = learned(spark, docs)
    assert [got[100 + i] for i in range(len(forms))] == [[f] for f in forms]
    assert got[200] == [] and got[201] == ["555 123 4567"] and not any(got[i] for i in range(40))


def test_contexts_reach_into_long_tokens(spark):
    docs = [(i, f"noise word{i}x sent account mail is user{i}@site{i}.org thanks") for i in range(40)]
    glued = ",".join(f"k{i}=v{i}" for i in range(40))
    docs += [(100, f"so {glued};sent;account;mail;is;jo_at_site9;{glued} end")]
    docs += [(101, "so sent account mail is " + "ab_9" * 100 + " thanks")]
    got = learned(spark, docs)
    assert got[100] == ["jo_at_site9"] and got[101] == ["ab_9" * 100]


def others_by_hand(text, spans):
    """Single tokens and runs of numbers outside *spans*, token by token."""
    free = lambda a, b: not any(a < y and x < b for _, x, y in spans)
    number = re.compile(r"\(?\+?[0-9][0-9().+/-]*")
    tokens = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    out, i = set(), 0
    while i < len(tokens):
        j = i
        while j < len(tokens) and free(*tokens[j]) and number.fullmatch(text[slice(*tokens[j])]) and (
            j == i or re.fullmatch("[ ]{1,2}", text[tokens[j - 1][1] : tokens[j][0]])
        ):
            j += 1
        if j > i + 1:
            out.add((tokens[i][0], tokens[j - 1][1]))
            i = j
            continue
        a, b = tokens[i]
        if b - a >= 4 and re.search("[0-9@_]", text[a:b]) and free(a, b):
            out.add((a, b))
        i += 1
    return out


def test_other_instances_against_a_plain_scan():
    rng = random.Random(3)
    parts = ["12", "5551", "123-45", "(555) 12", "word", "a_b1", "x@y", "é9é9", "10.0.0.1", "1/2/33", "4x44"]
    for _ in range(300):
        text = "".join(p + rng.choice([" ", "  ", "   ", "\n"]) for p in rng.choices(parts, k=rng.randint(0, 12)))
        spans = pii.base_spans(text)
        assert {(a, b) for a, b, _ in pii.others(text, spans)} == others_by_hand(text, spans), text
    assert list(pii.others("9" * 200_000, [])) == [(0, 200_000, False)]
    assert len(list(pii.others("12 " * 100_000, []))) == 1


# --- licenses -------------------------------------------------------------------


def base_labels_by_hand(text):
    own = words(text)
    found = {
        label: [i for i in range(len(own)) if own[i : i + len(p.split())] == p.split()]
        for label, p in licenses.PHRASES.items()
    }
    return own, {label: at for label, at in found.items() if at}


def templates_by_hand(text):
    own = words(text)
    longest = max(len(t.split()) for t in licenses.TEMPLATES.values())
    best = {}
    for at in range(0, max(len(own) - longest - 1, 0) + 1, longest):
        block = set(own[at : at + 2 * longest])
        for label, template in licenses.TEMPLATES.items():
            share = len(block & set(template.split())) / len(set(template.split()))
            if share >= licenses.THRESHOLD:
                best[label] = max(share, best.get(label, 0))
    return best


def check_licenses(got, docs):
    rows = sorted(got.collect(), key=lambda r: str(r.row))
    assert len(rows) == len(docs)
    for r, (doc, text) in zip(rows, sorted(docs, key=lambda d: str(d[0])), strict=False):
        own, base = base_labels_by_hand(text)
        best = templates_by_hand(text)
        assert r.n_words == len(own), doc
        assert {k: v for k, v in r.starts.items() if v} == base
        assert {b.label for b in r.blocks} == set(best)
        assert r.score == pytest.approx(1.0 if base else max(best.values(), default=0.0))


def test_licenses_against_all_blocks(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    pairs = [(str(r.doc_id), r.text) for r in docs.collect()]
    rows = {r.row.doc_id: r for r in licenses.scan(docs).collect()}
    assert len(rows) == len(pairs)
    for doc, text in pairs:
        own, base = base_labels_by_hand(text)
        best = templates_by_hand(text)
        assert rows[doc].n_words == len(own)
        assert {k: v for k, v in rows[doc].starts.items() if v} == base
        assert {b.label for b in rows[doc].blocks} == set(best)
        assert rows[doc].score == pytest.approx(1.0 if base else max(best.values(), default=0.0))


def test_license_edges(spark):
    filler = " ".join(f"x{i}" for i in range(3000))
    notice = licenses.TEMPLATES["mit"]
    texts = [None, "", "CC-BY", "cc, by cc by", "İ K general public\nlicense Kall", f"{filler} {notice} {filler}"]
    texts += [notice.upper(), " ".join(notice.split()[:12]), "All rights RESERVED. é all rights reserved", notice.upper()]
    docs = [(i, t) for i, t in enumerate(texts)] + [(6, notice.upper())]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit("clash"))
    got = licenses.scan(d)
    rows = sorted(((r.row.doc_id, r) for r in got.collect()), key=lambda x: x[0])
    assert len(rows) == len(docs)
    for doc, r in rows:
        own, base = base_labels_by_hand(texts[doc])
        best = templates_by_hand(texts[doc])
        assert (r.n_words, {k: v for k, v in r.starts.items() if v}) == (len(own), base)
        assert {b.label for b in r.blocks} == set(best)
    assert licenses.scan(d.limit(0)).count() == 0


def test_license_query_columns(spark):
    rows = {r.doc_id: r for r in QUERIES["op3_licenses"](spark, SF).collect()}
    for doc, text in documents(spark):
        own, base = base_labels_by_hand(text)
        places = sorted(p for at in base.values() for p in at)
        r = rows[doc]
        assert (r.n_words, r.n_base) == (len(own), len(places))
        assert (r.first_word, r.last_word) == ((places[0], places[-1]) if places else (None, None))
        assert r.base_labels == ",".join(sorted(base))
        assert set(filter(None, r.labels.split(","))) == set(base) | set(templates_by_hand(text))


def test_native_plan(spark):
    plan = licenses.scan(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert not re.search("Python|Pandas|pyarrow", Path(licenses.__file__).read_text().replace("Python UDF", ""))
