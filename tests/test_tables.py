"""Sources, sinks, merge, run bookkeeping, playlists and streams on small tables."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cratelink.operators import gates, merge, playlists, position, runs, search, waterfall
from cratelink.schemas import MATCHED_COLUMNS, PURCHASE_COLUMNS
from cratelink.session import scratch, shared_dir, stage
from cratelink.sinks import playlists as playlist_sink
from cratelink.sinks import tables
from cratelink.sources import candidates, catalog, logs, purchases, remote
from cratelink.streaming import jobs

TRACK = {
    "id": 7, "name": "Mover", "artists": [{"id": 1, "name": "A"}, {"name": None}], "genre": {"name": "House"},
    "label": {"name": "L"}, "release": {"id": 3, "name": "R"}, "key": {"name": "Am"}, "price": {"display": "$1.49"},
    "bpm": 128, "isrc": "X", "purchase_date": "2025-03-25", "length_ms": 246500, "extra": {"ignored": 1},
}


def values(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def test_flatten(spark):
    bare = {"id": 8, "price": 1.49, "length": "4:00"}
    rows = purchases.parse_tracks(values(spark, json.dumps(TRACK), json.dumps(bare), "{}")).collect()
    got = rows[0].asDict()
    assert got["Artists"] == "A, " and got["Price"] == "$1.49" and got["Duration"] == "4:06" and got["Release ID"] == "3"
    assert rows[1]["Price"] == "" and rows[1]["Duration"] == "4:00" and rows[1]["BPM"] == ""
    assert all(v == "" for v in rows[2])


def test_pages(spark, scratch):
    page = lambda n: json.dumps({"count": 450, "page": f"{n}/5", "per_page": 100, "results": [TRACK]})
    Path(scratch, "p.json").write_text("\n".join(map(page, (1, 2, 4))))
    pages = purchases.read_pages(spark, scratch)
    assert [r.page_no for r in purchases.missing_pages(pages, 100).orderBy("page_no").collect()] == [3, 5]
    assert [r.page_no for r in purchases.missing_pages(pages, 100, start=3, max_pages=1).collect()] == [3]
    assert purchases.page_rows(pages).count() == 3
    assert purchases.resume_page(250, 100) == 3 and purchases.resume_page(0, 100) == 2


def test_csv_round_trip(spark, scratch):
    rows = purchases.parse_tracks(values(spark, json.dumps(TRACK)))
    rows = rows.withColumn("Title", F.lit('a\r"b", c\nd '))
    tables.write_purchases(rows, f"{scratch}/csv")
    back = purchases.read_csv(spark, f"{scratch}/csv").collect()
    assert [tuple(r) for r in back] == [tuple(rows.collect()[0])]
    tables.write_matched(rows.withColumn("Local File Path", F.lit("/a")), f"{scratch}/matched")
    header = next(Path(scratch, "matched").glob("part-*")).read_text().splitlines()[0]
    assert header == ",".join(MATCHED_COLUMNS) and len(PURCHASE_COLUMNS) == 17


def test_inventory_and_upsert(spark, scratch):
    for name in ("a.MP3", "b.flac", "c.txt", "sub/d.ogg"):
        Path(scratch, name).parent.mkdir(exist_ok=True)
        Path(scratch, name).write_text("xx")
    files = catalog.inventory(spark, scratch)
    assert sorted(Path(r.path).name for r in files.collect()) == ["a.MP3", "b.flac", "d.ogg"]
    plan = files._jdf.queryExecution().toString()
    assert "content" not in plan.split("== Physical Plan ==")[1]
    seq = files.withColumn("seq", F.lit(1).cast("bigint"))
    tags = seq.select("path", F.lit("T").alias("title"), F.lit(125.9).alias("seconds"))
    row = catalog.catalog_rows(seq, tags).filter("`File Path` like '%a.MP3'").collect()[0]
    assert (row["Title"], row["Duration"], row["File Size"], row["Artist"]) == ("T", "2:05", "2", "")
    old = spark.createDataFrame([("p", 1, "old")], "path string, seq bigint, v string")
    new = spark.createDataFrame([("p", 5, "x"), ("q", 9, "late"), ("q", 7, "first")], "path string, seq bigint, v string")
    assert [tuple(r) for r in catalog.upsert(old, new, "path").collect()] == [("q", 7, "first")]


def test_logs(spark, scratch):
    assert logs.read_log(spark, f"{scratch}/none").count() == 0
    lines = [
        {"path": "a", "status": "matched", "candidate_id": 5}, {"path": "b", "status": "matched"},
        {"path": "c", "status": "error", "candidate_id": 1}, {"path": "d", "status": "matched", "snapshot": {"id": 3}},
    ]
    Path(scratch, "log.jsonl").write_text("\n".join(map(json.dumps, lines)) + '\n{broken\n["list"]\n"text"\n')
    log = logs.read_log(spark, f"{scratch}/log.jsonl")
    assert sorted(r.path for r in log.collect()) == ["a", "b", "c", "d"]
    assert sorted(r.path for r in logs.matched_rows(log).collect()) == ["a", "d"]
    Path(scratch, "m.json").write_text(json.dumps([{"path": "a", "missing": ["genre"]}, {"path": ""}, {"x": 1}]))
    manifest = logs.read_manifest(spark, f"{scratch}/m.json", array=True)
    assert [r.path for r in manifest.collect()] == ["a"]
    assert runs.todo(manifest, logs.done_paths(log)).count() == 0
    logs.append_log(log, f"{scratch}/out")
    logs.append_log(log, f"{scratch}/out")
    assert logs.read_log(spark, f"{scratch}/out").count() == 8


def test_snapshots_take_loose_types(spark):
    loose = {"id": "9", "name": 7, "bpm": "128", "release_id": True, "length_ms": "bad", "publish_date": None, "artwork_url": 5}
    row = candidates.parse_snapshots(values(spark, json.dumps(loose), "{}")).collect()
    assert (row[0].id, row[0].name, row[0].bpm, row[0].release_id, row[0].length_ms) == (9, "7", 128, 1, 0)
    assert (row[0].publish_date, row[0].artwork_url, row[1].id) == ("", "5", 0)
    odd = ['{"bpm": 7.9, "id": "7.9", "length_ms": "true"}', '{"bpm": -7.9, "id": " 5 ", "length_ms": 1e3}', "no json"]
    rows = [(r.bpm, r.id, r.length_ms) for r in candidates.parse_snapshots(values(spark, *odd)).collect()]
    assert rows == [(7, 0, 0), (-7, 5, 1000), (0, 0, 0)]


def test_pick_reasons(spark):
    files = spark.createDataFrame([(1, 200000), (2, 200000), (3, 200000), (4, None)], "f int, duration_ms bigint")
    c = spark.createDataFrame(
        [(1, 200000, 2, "2020-10-08", 207000), (1, 200000, 3, "2019-01-01", 207001), (1, 200000, 1, "", 200000),
         (2, 200000, 4, "2020", 400000), (4, None, 6, "2021-01-01", 0), (4, None, 5, "2020-01-01", 9)],
        "f int, duration_ms bigint, id bigint, publish_date string, length_ms bigint",
    )
    got = {r.f: (r.pick.id if r.pick else None, r.reason) for r in gates.pick_best(files, c, "f").collect()}
    assert got == {1: (2, "match"), 2: (None, "ambiguous"), 3: (None, "no-candidates"), 4: (5, "match")}


def test_search_equals_brute_force(spark):
    rng = random.Random(3)
    words = ["love", "lo", "Night", "la 42", "x", "Über", "city nights"]
    rows = [(i, " ".join(rng.sample(words, 2)), rng.choice(["", "Dub Mix", "Mix"]), rng.choice(words), rng.choice(["", "2020-01-01", "1999-05-05"])) for i in range(80)]
    c = spark.createDataFrame(rows, "id bigint, name string, mix_name string, artists string, publish_date string")
    asks = [(rng.choice([*words, ""]), rng.choice([*words, ""]), rng.choice(["", "mix"])) for _ in range(40)]
    got = search.search(spark.createDataFrame(asks, "s_artist string, s_title string, s_mix string"), c, page=3)
    have = {}
    for r in got.collect():
        have.setdefault((r.s_artist, r.s_title, r.s_mix), []).append((r.place, r.id))
    for a in set(asks):
        hits = sorted((r[4] or "9999", r[0]) for r in rows if all(x.lower() in y.lower() for x, y in zip(a, (r[3], r[1], r[2]))))
        want = [i for _, i in hits[:3]] if a[0] or a[1] else []
        assert [i for _, i in sorted(have.get(a, []))] == want, a
    assert "WindowGroupLimit" in got._jdf.queryExecution().toString()


def test_fallback_sources(spark):
    files = spark.createDataFrame([("f", "Artist", "Track", "Track", 300000)], "path string, artist string, title string, base string, duration_ms bigint")
    release = {"id": 1, "title": "Album", "artists": [{"name": "Artist"}], "labels": [{"name": "A Label"}], "genres": ["Electronic"],
               "styles": ["Tech House"], "tracklist": [{"title": "Track", "duration": "5:00"}], "released": "2023-03-20",
               "images": [{"type": "secondary", "uri": "b"}, {"type": "primary", "uri": "http://img"}]}

    def match(results, rel):
        answer = spark.createDataFrame([("f", json.dumps({"results": results}))], "path string, value string")
        out = waterfall.releases_match(files, remote.release_results(answer, "path"), remote.releases(values(spark, json.dumps(rel))), "path")
        return [(r.publish_date, r.label, r.genre, r.artwork_url) for r in out.collect()]

    result = {"id": 1, "type": "release", "title": "Artist - Track"}
    assert match([result], release) == [("2023-03-20", "A Label", "Tech House", "http://img")]
    assert match([{**result, "title": "Other - Track"}], release) == []
    assert match([{**result, "type": "artist"}], release) == []
    assert match([{**result, "title": "Artist - Odd"}], release) != []
    assert match([result], {**release, "tracklist": [{"title": "Track", "duration": "5:10"}]}) != []
    assert match([result], {**release, "tracklist": [{"title": "Track", "duration": "5:11"}]}) == []
    assert match([result], {**release, "tracklist": [{"title": "Track", "duration": ""}]}) == []
    rec = {"id": "r", "title": "Song", "score": 95, "length": "200000", "artist-credit": [{"name": "Artist"}],
           "releases": [{"title": "Rel", "date": "2023-05-06T1", "label-info": [{"label": {"name": "Lab"}}]}]}
    answers = spark.createDataFrame([("f", 0, json.dumps({**rec, "score": 40})), ("f", 1, json.dumps({**rec, "length": "bad"}))], "path string, rank int, value string")
    got = waterfall.recordings_match(files, remote.recordings(answers, "path"), "path").collect()
    assert [(r.name, r.artists, r.release_name, r.publish_date, r.label) for r in got] == [("Song", "artist", "Rel", "2023-05-06", "Lab")]
    off = waterfall.waterfall(files, [("a", None), ("b", waterfall.conform(files.limit(0), ["path"]))], "path").collect()
    assert off[0].source == "" and off[0].pick is None
    df = spark.createDataFrame([("match",), ("stuck",)], "r string")
    assert [r[0] for r in df.select(waterfall.status_or(F.col("r"))).collect()] == ["no-candidates", "stuck"]


def test_merge_rules(spark):
    cur = spark.createDataFrame([(1, "Bicep", "Haze myfreemp3.vip", "Electronica", "")], "k int, artist string, title string, genre string, date string")
    new = spark.createDataFrame([(1, "X", "Haze", "House", "2020-01-01", "")], "k int, new_artist string, new_title string, new_genre string, new_date string, artwork_url string")
    for f in ("album", "bpm", "key", "label", "isrc"):
        new = new.withColumn(f"new_{f}", F.lit(""))
    planned = lambda **o: {r.field: r.reason for r in merge.plan_fields(cur, new, "k", **o).collect()}
    assert planned() == {"title": "promo-domain:myfreemp3.vip", "date": ""}
    assert set(planned(overwrite=True)) == {"artist", "title", "genre", "date"}
    assert set(planned(fields=["date"])) == {"date"} and planned(fields=[]) == {}
    row = merge.merged(cur, new, "k").collect()[0]
    assert (row.artist, row.title, row.genre, row.date, row.updated) == ("Bicep", "Haze", "Electronica", "2020-01-01", ["title", "date"])


def brute_breaker(rows, limit):
    kept, streak, tripped = [], {}, set()
    for run, pos, status in rows:
        if run in tripped:
            continue
        streak[run] = streak.get(run, 0) + 1 if status == "error" else 0
        kept.append((run, pos, streak[run]))
        if streak[run] >= limit:
            tripped.add(run)
    return sorted(kept)


def breaker_rows():
    rng = random.Random(4)
    # One run holds most of the log, and fails over many blocks in a row.
    rows = [(0, i, "error" if 100 < i < 180 or rng.random() < 0.3 else "matched") for i in range(400)]
    return rows + [(rng.randint(1, 4), i, rng.choice(["error", "matched"])) for i in range(400, 500)]


@pytest.mark.parametrize("limit", [1, 4, 50, 79, 500])
def test_breaker_over_blocks(spark, limit):
    rows = breaker_rows()
    log = spark.createDataFrame(rows, "run int, pos int, status string").repartition(7)
    kept = runs.breaker_prefix(log, "run", "pos", limit=limit, blocks=9)
    assert sorted((r.run, r.pos, r.streak) for r in kept.collect()) == brute_breaker(rows, limit)


def test_positions(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "v int")
    got = position.chunks(df, "v", size=10).collect()
    assert sorted((r.v, r.position, r.chunk) for r in got) == [(i, i + 1, i // 10) for i in range(101)]


def test_playlists(spark, scratch):
    rows = [(1, "/a", "T<1", "A", "2025-03-25T03:11:29-06:00"), (2, "/b", "T2", "B", "2025-03-26"), (3, "/a", "T1", "A", "2025-04-01"), (4, "", "n", "n", "2025-04-01"), (5, "/c.mp3", "T", "C", "")]
    df = spark.createDataFrame(rows, "o bigint, path string, title string, artists string, bought string").withColumn("album", F.lit("R"))
    entries = playlists.entries(df, "path", "bought", "o")
    assert {(r.kind, r.period): r.n for r in playlists.rollup(entries).collect()} == {("month", "2025-03"): 2, ("month", "2025-04"): 1, ("year", "2025"): 3}
    lines = playlists.m3u_lines(entries, "path", "title", "artists", "o")
    playlist_sink.write_m3u(lines, f"{scratch}/m3u")
    assert playlist_sink.name_single_parts(spark, f"{scratch}/m3u") == ["2025-0.m3u", "2025-03.m3u", "2025-04.m3u"]
    assert Path(scratch, "m3u/2025-03.m3u").read_text() == "#EXTM3U\n#EXTINF:-1,A - T<1\n/a\n#EXTINF:-1,B - T2\n/b\n"
    tracks = playlists.collection(df, "path", "title", "artists", "album", "o")
    refs = playlists.references(playlists.unique_entries(entries, "path", "o"), tracks, "path", "o")
    playlist_sink.write_document(playlist_sink.document_lines(tracks, refs), f"{scratch}/xml")
    text = "".join(p.read_text() for p in sorted(Path(scratch, "xml").glob("part-*")))
    from xml.etree import ElementTree

    root = ElementTree.fromstring(text.encode())
    assert root.find("COLLECTION").get("Entries") == "4" and len(root.findall("COLLECTION/TRACK")) == 4
    lists = {n.get("Name"): [t.get("Key") for t in n.findall("TRACK")] for n in root.iter("NODE") if n.get("Type") == "1"}
    assert lists == {"2025 (Full Year)": ["3", "2"], "2025-03": ["3", "2"], "2025-04": ["3"]}
    playlist_sink.write_collection(tracks, f"{scratch}/collection")
    assert spark.read.format("xml").option("rowTag", "TRACK").load(f"{scratch}/collection").count() == 4


def test_stream_resumes_and_breaks(spark, scratch):
    rows = breaker_rows()
    schema = "run int, pos int, status string"
    half = len(rows) // 2

    def land(part, n):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{scratch}/in/{n}")

    def go():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{scratch}/in")
        jobs.breaker_stream(stream, "run", ("pos",), f"{scratch}/log", f"{scratch}/state", f"{scratch}/ck", limit=40).awaitTermination()

    land(rows[:half], 1)
    go()
    land(rows[half:], 2)
    go()
    got = jobs.read_log(spark, f"{scratch}/log").collect()
    assert sorted((r.run, r.pos, r.streak) for r in got) == brute_breaker(rows, 40)


def test_enrich_stream_logs_each_path_once(spark, scratch):
    seen = []

    def go(n):
        spark.createDataFrame([(f"p{i}",) for i in range(n)], "path string").coalesce(1).write.mode("append").parquet(f"{scratch}/in")
        stream = spark.readStream.schema("path string").parquet(f"{scratch}/in")

        def resolve(batch):
            seen.append(batch.count())
            return batch.withColumn("status", F.lit("matched"))

        jobs.enrich_stream(stream, resolve, f"{scratch}/log", f"{scratch}/ck").awaitTermination()

    go(5)
    go(8)
    assert seen == [5, 3]
    assert sorted(r.path for r in jobs.read_log(spark, f"{scratch}/log").collect()) == [f"p{i}" for i in range(8)]


def test_verdict_and_stuck(spark):
    counts = spark.createDataFrame([("a", "matched", 3), ("b", "stopped-early", 1)], "run string, status string, n bigint")
    assert {r.run: r.verdict for r in runs.verdict(counts, "run").collect()} == {"a": 0, "b": 2}
    starts = spark.createDataFrame([("x", "2024-01-01 00:00:00"), ("y", "2024-01-01 00:00:00"), ("z", "2024-01-01 00:04:00")], "item string, s string")
    starts = starts.select("item", F.col("s").cast("timestamp").alias("started_at"))
    finishes = spark.createDataFrame([("y",)], "item string")
    now = F.lit("2024-01-01 00:05:01").cast("timestamp")
    assert [r.item for r in runs.stuck(starts, finishes, "item", now).collect()] == ["x"]


def test_private_folder_is_for_local_masters_only():
    from cratelink.session import check_private

    for master in ("local", "local[4]", "local[*]"):
        check_private(master)
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]", "k8s://https://host"):
        with pytest.raises(ValueError, match="checkpoint"):
            check_private(master)


def test_scratch_keeps_what_is_asked_for(spark):
    def folders(label):
        return list(Path(shared_dir(spark), spark.sparkContext.applicationId).glob(f"{label}-*"))

    rows = spark.range(50).groupBy((F.col("id") % 7).alias("k")).count()
    with scratch(spark):
        with scratch(spark):
            stage(rows, "inner")
            kept = stage(rows, "kept", keep=True)
        assert not folders("inner") and kept.count() == 7
        lasting = stage(kept, "lasting", keep=True)
    assert not folders("kept") and lasting.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_staged_rows_are_never_broadcast(spark):
    files = stage(spark.range(20).selectExpr("id as seq", "id as file_id", "200000 as duration_ms"), "files")
    offers = stage(spark.range(20).selectExpr("id", "'' as publish_date", "200000 as length_ms"), "offers")
    met = offers.withColumn("seq", F.col("id")).withColumn("duration_ms", F.lit(200000))
    for rows in (gates.pick_best(files, met, "seq"), gates.by_id(files, offers)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_references_are_never_broadcast(spark):
    rows = stage(spark.range(20).selectExpr("'year' as kind", "'2020' as period", "cast(id as string) as file_path", "id"), "rows")
    tracks = stage(spark.range(20).selectExpr("cast(id as string) as path", "id as TrackID"), "tracks")
    refs = playlists.references(rows, tracks, "file_path", "id")
    assert "Broadcast" not in refs._jdf.queryExecution().executedPlan().toString()
    assert refs.filter("ordinal = key").count() == 20


def test_query_variants_are_distinct_without_a_shuffle(spark):
    rows = [(1, "Ann & Bob", "Song (feat. Ann)"), (2, "Ann", "Ann"), (3, "", ""), (4, "Bob", "Bob - Song (Dub Mix)")]
    got = search.query_variants(spark.createDataFrame(rows, "seq long, artist string, title string"), "seq")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    asks = [(r.seq, r.s_artist, r.s_title, r.s_mix) for r in got.collect()]
    assert len(asks) == len(set(asks))
    assert {r.seq: r.ordinal for r in got.orderBy(F.desc("ordinal")).collect()} == dict.fromkeys((1, 2, 3, 4), 0)
    assert [(r.ordinal, r.s_artist, r.gated) for r in got.filter("seq = 2").orderBy("ordinal").collect()] == [(0, "Ann", False)]


def test_search_tables_hold_no_text_twice(spark):
    rows = [(1, "Big SONG", "Dix", "DJ Éa", "2020-01-01", 1000), (2, "other", "", "dj", None, 0), (3, None, None, None, None, 0)]
    c = spark.createDataFrame(rows, "id bigint, name string, mix_name string, artists string, publish_date string, length_ms bigint")
    prepared = search.search_table(c)
    assert set(prepared.columns) == set(c.columns)
    asks = spark.createDataFrame([("Dj É", "song", ""), ("", "OTHER", ""), ("dj", "", "DI"), ("", "", ""), ("x", "song", "")], "s_artist string, s_title string, s_mix string")
    got = {(r.s_artist, r.s_title, r.s_mix, r.place, r.id) for r in search.search_in(asks, prepared).collect()}
    assert got == {("Dj É", "song", "", 1, 1), ("", "OTHER", "", 1, 2), ("dj", "", "DI", 1, 1)}
