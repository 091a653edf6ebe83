"""Linkage against a brute force that compares every pair."""

import random
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from cratelink.operators import cascade, residual
from cratelink.operators.containment import contained_pairs, edit_candidates, edit_pairs
from cratelink.operators.keys import catalog_keys, query_keys
from cratelink.schemas import CATALOG_COLUMNS
from cratelink.session import stage


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def levels_of(q, r):
    """Every (level, sub) a pair satisfies."""
    inside = lambda a, b: a in b or b in a
    overlap = any(inside(a, b) for a in q.names for b in r.names)
    album = inside(q.album, r.album)
    spaced = q.condensed != q.clean
    full = q.album and q.clean and q.artist
    out = []
    if q.isrc and q.isrc == r.isrc:
        out.append((10, 0))
    if full and q.album == r.album and q.clean == r.clean and overlap:
        out.append((20, 0))
    if q.album and q.clean and q.album == r.album and q.clean == r.clean:
        out.append((30, 0))
    if q.artist and q.clean == r.clean != "":
        if r.artist == q.artist:
            out.append((40, 0))
        elif r.artist and r.artist == q.first_name:
            out.append((40, 1))
    if q.clean and q.clean == r.clean:
        out.append((50, 0))
    if q.clean and r.clean.startswith(q.clean + " "):
        if q.album and q.album == r.album:
            out.append((60, 0))
        if r.artist and q.artist and r.artist in (q.artist, q.first_name):
            out.append((70, 0))
    if spaced and q.condensed == r.condensed:
        if q.artist and q.album == r.album and overlap:
            out.append((80, 0))
        if q.album and q.album == r.album:
            out.append((81, 0))
        if q.album and album:
            out.append((100, 0))
    if full and album and overlap:
        limit = max(2, len(q.clean) // 5)
        if q.clean.startswith(r.clean) or r.clean.startswith(q.clean):
            out.append((110, 0))
        if r.clean and abs(len(q.clean) - len(r.clean)) <= limit and distance(q.clean, r.clean) <= limit:
            out.append((120, 0))
        if r.clean and inside(q.clean, r.clean):
            out.append((130, 0))
    return out


def brute(queries, rows):
    result = {}
    for q in queries:
        best = {}
        for r in rows:
            for level, sub in levels_of(q, r):
                best[level] = min(best.get(level, (9, 0, "")), (sub, r.seq, r.path))
        for level in sorted(best):
            if best[level][2]:
                result[q.qid] = (level, best[level][1])
                break
    return result


def fixture(spark, seed, n_q=60, n_r=80):
    rng = random.Random(seed)
    words = ["love", "night", "city lights", "a", "love a", "Mover", "_x", "intro", "sensation", "sensasion", ""]
    artists = ["Bicep", "Meera (NO)", "A & B", "dj", "dj x y", "Jori Hulkkonen, Tiga", "Tiga", "", "&", "Bicep feat. Dj"]
    albums = ["", "Apricots", "Sundial", "Sundial Deluxe Edition", "ep", "deeper", "Various Artists Compilation Volume 12"]
    mixes = ["", "", " (Original Mix)", " (Extended Mix)", " Remix", " live at home"]

    def title():
        parts = rng.sample(words, rng.choice([1, 1, 2]))
        joined = rng.choice([" ", "", " "]).join(parts)
        return joined + rng.choice(mixes)

    isrc = lambda: rng.choice(["", "", "", "ABC123", "GB7NR2431602", " X9 "])
    # A third of the catalog shares one title and a third has no title at all.
    purchases = [(str(i), title(), rng.choice(artists), rng.choice(albums), isrc()) for i in range(n_q)]
    catalog = []
    for i in range(n_r):
        t = rng.choice(["intro", "", title()])
        path = "" if rng.random() < 0.1 else f"/p/{i}.mp3"
        catalog.append((i, path, rng.choice(artists), t, rng.choice(albums), isrc()))
    p = spark.createDataFrame(purchases, "`Track ID` string, Title string, Artists string, `Release Title` string, ISRC string")
    c = spark.createDataFrame(catalog, "seq bigint, `File Path` string, Artist string, Title string, Album string, ISRC string")
    return stage(query_keys(p), "q"), stage(catalog_keys(c), "r")


@pytest.mark.parametrize(
    ("seed", "limits"),
    [(1, {}), (2, {"group_limit": 0, "fan_limit": 0}), (3, {"group_limit": 2, "fan_limit": 5}), (4, {"group_limit": 0, "fan_limit": 0})],
)
def test_cascade_equals_brute_force(spark, seed, limits):
    q, r = fixture(spark, seed)
    got = {x.qid: (x.level, x.seq) for x in cascade.link_keys(q, r, **limits).collect()}
    assert got == brute(q.collect(), r.collect())
    assert len({level for level, _ in got.values()}) > 4


@pytest.mark.parametrize("fan_limit", [2000, 0])
def test_titled_rule_decides(spark, fan_limit):
    """s09 decides where the rule that takes any row of a title comes later, or misses for want of a path."""
    buy = _purchase(spark, "B1 & A1", "Song", "Album")
    rows = [("/any", "C1", "Other", "Song"), ("/mine", "A1", "Album Deluxe", "Song")]
    s05 = next(s for s in cascade.STRATEGIES if s.name == "s05")
    own = tuple(s for s in cascade.STRATEGIES if s is not s05) + (replace(s05, name="s14", level=140),)

    def linked(tracks, **options):
        out = cascade.link(buy, _tracks(spark, *tracks), level_column="level", fan_limit=fan_limit, **options)
        return [(r["Local File Path"], r["level"]) for r in out.collect()]

    assert linked(rows) == [("/any", 50)]
    assert linked(rows, strategies=own) == [("/mine", 90)]
    assert linked([("", "C1", "Other", "Song"), rows[1]]) == [("/mine", 90)]


def test_residual_ways_agree(spark):
    """Titles compared outright, by form, or by windows and parts in a block; own rules looked up or tested."""
    q, r = fixture(spark, 11)
    known = [(s.level, s.title) for s in cascade.STRATEGIES if s.kind == "residual"]
    looked_up = known + [(150, "length(q.clean) = length(r.clean)")]
    tested = known + [(150, "length(r.clean) = length(q.clean)")]

    def hits(rules, **limits):
        return sorted(map(tuple, residual.residual_hits(q, r, rules, **limits).collect()))

    plain = hits(looked_up)
    assert {level for _, level, _ in plain} == {110, 120, 130, 150}
    assert hits(looked_up, fan_limit=0) == plain
    assert hits(tested, fan_limit=0, form_limit=0) == plain


@pytest.mark.parametrize(
    ("rule", "value"),
    [
        ("length(q.clean) = length(r.clean)", "length(clean)"),
        ("substring(q.clean, 1, 3) = substring(r.clean, 1, 3)", "substring(clean, 1, 3)"),
        ("length(q.clean) = length(q.clean)", None),
        ("length(q.album) = length(r.album)", None),
        ("not length(q.clean) = length(r.clean)", None),
        ("length(q.clean) + length(q.clean) = length(r.clean) + length(r.clean)", None),
        ("length(q.clean) <= length(r.clean)", None),
    ],
)
def test_only_plain_equalities_are_looked_up(rule, value):
    assert residual._same(rule) == value


@pytest.mark.parametrize("limits", [{}, {"fan_limit": 0}])
def test_titles_meet_inside_their_blocks_only(spark, monkeypatch, limits):
    """20 names on each of 2 albums, 10 titles each: a title meets those of its album and name, not all of the album."""
    names, albums, titles = [f"n{chr(97 + i)}x" for i in range(20)], ["first album", "second album"], [f"t {i}" for i in range(10)]
    cross = [(a, n, t) for a in albums for n in names for t in titles]
    p = spark.createDataFrame([(n, f"{t} more", a) for a, n, t in cross], "Artists string, Title string, `Release Title` string")
    c = spark.createDataFrame([(i, f"/{i}", n, t, a) for i, (a, n, t) in enumerate(cross)], "seq bigint, `File Path` string, Artist string, Title string, Album string")
    q, r = query_keys(p.withColumn("ISRC", F.lit(""))), catalog_keys(c.withColumn("ISRC", F.lit("")))
    met, test = [], residual._tested
    monkeypatch.setattr(residual, "_tested", lambda rows, *rest: met.append(rows.count()) or test(rows, *rest))
    rules = [(s.level, s.title) for s in cascade.STRATEGIES if s.kind == "residual"] + [(150, "length(q.clean) = length(r.clean)")]
    hits = residual.residual_hits(q, r, rules, **limits)
    assert hits.filter("level = 110").count() == len(cross)
    assert sum(met) <= len(cross) * len(titles)


def test_single_strategies_do_not_depend_on_limits(spark):
    q, r = fixture(spark, 7)
    for name in ("s02", "s08", "s09", "s10", "s11", "s12", "s13"):
        key = "fan_limit" if name in ("s09", "s11", "s12", "s13") else "group_limit"
        plain = cascade.strategy_hits(q, r, name)
        tight = cascade.strategy_hits(q, r, name, **{key: 0})
        assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, tight.collect())), name


def _tracks(spark, *rows):
    full = [(i, p, a, "", t, al, "", "", "", "", "", "1000") for i, (p, a, al, t) in enumerate(rows)]
    return spark.createDataFrame(full, "seq bigint, " + ", ".join(f"`{c}` string" for c in CATALOG_COLUMNS))


def _purchase(spark, artists, title, release):
    return spark.createDataFrame([("1", title, artists, release, "")], "`Track ID` string, Title string, Artists string, `Release Title` string, ISRC string")


@pytest.mark.parametrize(
    ("purchase", "tracks", "path"),
    [
        (("A1", "Bbc 1", "Album"), [("/a", "A1", "Album", "Bbc1")], "/a"),
        (("A1", "Song", "Album"), [("/a", "B1", "Album", "Song Extended")], "/a"),
        (("A1", "Song", ""), [("/a", "A1", "Other Album", "Song Extended")], "/a"),
        (("A1", "Song Extended", "Album"), [("/a", "A1", "Album", "Song")], "/a"),
        (("A1", "Sensation", "Album"), [("/a", "A1", "Album", "Sensasion")], "/a"),
        (("A1", "Midnight City Lights", "Album"), [("/a", "A1", "Album", "City")], "/a"),
        (("A1", "Other Song", "Totally Different"), [("/a", "A1", "Album", "Song")], ""),
        (("A1", "Bbc 1", "Album"), [("/deluxe", "B1", "Album Deluxe", "Bbc1"), ("/other", "B1", "Album", "Bbc1"), ("/mine", "A1", "Album", "Bbc1")], "/mine"),
        (("A1", "Bbc 1", "Album"), [("/deluxe", "B1", "Album Deluxe", "Bbc1"), ("/exact", "B1", "Album", "Bbc1")], "/exact"),
        (("A1", "Bbc 1", "Album"), [("/deluxe", "B1", "Album Deluxe Edition", "Bbc1")], "/deluxe"),
        (("A1", "Any Song", "Album"), [("/blank", "A1", "", "")], "/blank"),
    ],
)
def test_golden_links(spark, purchase, tracks, path):
    out = cascade.link(_purchase(spark, *purchase), _tracks(spark, *tracks))
    assert [r["Local File Path"] for r in out.collect()] == [path]
    counts = cascade.match_counts(out).collect()[0]
    assert (counts.matched, counts.unmatched) == ((1, 0) if path else (0, 1))


def test_strict_skips_untitled_rows(spark):
    out = cascade.link(_purchase(spark, "A1", "Any Song", "Album"), _tracks(spark, ("/blank", "A1", "", "")), strict=True)
    assert out.collect()[0]["Local File Path"] == ""


def test_containment_finds_long_and_short_needles(spark):
    rng = random.Random(5)
    pool = ["".join(rng.choice("ab ") for _ in range(rng.choice([1, 2, 5, 17, 33, 70, 600]))).strip() or "a" for _ in range(60)]
    pool += [p[3:-2] for p in pool if len(p) > 6] + ["x" * 700, "x" * 650]
    left = sorted(set(pool[::2]))
    right = sorted(set(pool[1::2]))
    frame = lambda v: spark.createDataFrame([("", x) for x in v], "grp string, v string")
    got = {(r.l, r.r) for r in contained_pairs(frame(left), frame(right)).collect()}
    assert got == {(a, b) for a in left for b in right if a in b or b in a}


def test_edit_pairs_are_complete(spark):
    rng = random.Random(6)
    base = ["".join(rng.choice("abcd ") for _ in range(n)).strip() or "ab" for n in (1, 2, 2, 3, 4, 5, 8, 12, 20, 31, 50)]

    def mutate(t):
        t = list(t)
        for _ in range(rng.randint(0, max(2, len(t) // 5) + 1)):
            i = rng.randrange(len(t) + 1)
            t[i : i + rng.choice([0, 1])] = rng.choice(["", "a", "z"])
        return "".join(t)

    left = sorted(set(base))
    right = sorted({mutate(b) for b in base for _ in range(12)} - {""})
    frame = lambda v: spark.createDataFrame([(x,) for x in v], "v string")
    got = {(r.l, r.r) for r in edit_pairs(frame(left), frame(right)).collect()}
    assert got == {(a, b) for a in left for b in right if distance(a, b) <= max(2, len(a) // 5)}


@pytest.mark.parametrize("limit", [2000, 5, 0])
def test_edit_pairs_by_form_and_by_part(spark, limit):
    """Titles told apart by numbers meet by their form, or by parts where a form is crowded."""
    rng = random.Random(limit)
    base = [f"{a} {b} {rng.randrange(10**k)}" for a in ("red", "small", "cold") for b in ("ring", "plate") for k in (1, 3, 5)]
    left = sorted({*base, "1", "22", "7" * 30, "room 101 " * 5})
    right = {t.replace("1", "", 1) for t in base} | {t + "x" for t in base} | {"z" + t.replace("e", "3") for t in base}
    right |= {t[:-1] for t in base} | {f"{t[:-2]}{rng.randrange(100)}" for t in base} | {"2", "12", "7" * 27, "room 1o1 " * 5}
    right = sorted(right)
    frame = lambda v: spark.createDataFrame([(x,) for x in v], "v string")
    got = {(r.l, r.r) for r in edit_pairs(frame(left), frame(right), limit).collect()}
    assert got == {(a, b) for a in left for b in right if distance(a, b) <= max(2, len(a) // 5)}


def test_plans_hold_no_python_and_no_pair_comparison(spark):
    q, r = fixture(spark, 9)
    plan = cascade.lookup_hits(q, r, cascade.STRATEGIES)._jdf.queryExecution().toString()
    keys = query_keys(_purchase(spark, "a", "b", "c"))._jdf.queryExecution().toString()
    for text in (plan, keys):
        assert "Python" not in text
        assert "NestedLoop" not in text and "CartesianProduct" not in text
    assert "SortAggregate" not in plan


def test_copies_collapse_before_linking(spark):
    row = ("1", "Song", "A1", "Album", "")
    p = spark.createDataFrame([row] * 500, "`Track ID` string, Title string, Artists string, `Release Title` string, ISRC string")
    assert query_keys(p).count() == 1
    out = cascade.link(p, _tracks(spark, ("/a", "A1", "Album", "Song")))
    assert out.filter(F.col("`Local File Path`") == "/a").count() == 500


def test_exploded_texts_are_never_broadcast(spark):
    # Staged, since only files have a size that the optimizer can judge.
    texts = stage(spark.createDataFrame([("", f"some title {n}") for n in range(20)], "grp string, v string"), "texts")
    titles = texts.select("v")
    for pairs in (contained_pairs(texts, texts), edit_candidates(titles, titles)):
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan
        assert not re.search(r"BroadcastHashJoin \[(grp|piece|part|bucket)", plan)
