"""Published versions, bucketed landings, and files read in blocks."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cratelink.operators import merge
from cratelink.schemas import PURCHASE_COLUMNS
from cratelink.sinks import versions
from cratelink.sources import blocks, candidates, catalog, logs, purchases


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_publish_swaps_whole_versions(spark, scratch):
    root = f"{scratch}/t"
    first = spark.range(50).withColumn("v", F.lit("a"))
    with pytest.raises(FileNotFoundError):
        versions.read(spark, root)
    assert versions.publish(first, root, "id", 8) == 1
    bad = first.where("id <> 7").withColumn("v", F.lit("b"))
    with pytest.raises(versions.Refused):
        versions.publish(bad, root, "id", audit=versions.same_keys("id"))
    assert rows_of(versions.read(spark, root)) == rows_of(first)
    assert len(list(Path(root).glob("data-*"))) == 1
    good = first.withColumn("v", F.lit("b"))
    assert versions.publish(good, root, "id", audit=versions.same_keys("id")) == 2
    assert rows_of(versions.read(spark, root)) == rows_of(good)
    assert rows_of(versions.read(spark, root, number=1)) == rows_of(first)
    versions.prune(spark, root, 1)
    assert rows_of(versions.read(spark, root)) == rows_of(good)
    assert len(list(Path(root).glob("data-*"))) == 1
    # An empty table is a version too.
    assert versions.publish(first.limit(0), root, "id") == 3
    assert versions.read(spark, root).count() == 0


def test_interrupted_publish_reads_back_as_before(spark, scratch, monkeypatch):
    root = f"{scratch}/t"
    first = spark.range(20).withColumn("v", F.lit("a"))
    versions.publish(first, root, "id", 4)
    boom = F.udf(lambda i: 1 // (i - 13), "bigint")
    with pytest.raises(Exception, match="ZeroDivision"):
        versions.publish(first.withColumn("v", boom("id").cast("string")), root, "id")
    assert rows_of(versions.read(spark, root)) == rows_of(first)

    def lost(*_):
        raise RuntimeError("lost before the swap")

    with monkeypatch.context() as patch:
        patch.setattr(versions, "_commit", lost)
        with pytest.raises(RuntimeError):
            versions.publish(first.withColumn("v", F.lit("b")), root, "id")
    assert versions.version(spark, root).number == 1
    assert rows_of(versions.read(spark, root)) == rows_of(first)
    versions.publish(first.withColumn("v", F.lit("c")), root, "id")
    assert {r.v for r in versions.read(spark, root).collect()} == {"c"}


def test_two_publishers_cannot_both_win(spark, scratch):
    root = f"{scratch}/t"
    versions.publish(spark.range(5), root, "id", 2)
    again = versions.version(spark, root)
    with pytest.raises(Exception, match="(?i)exist"):
        versions._commit(spark, root, again)
    assert versions.version(spark, root) == again


def test_landing_touches_its_buckets_only(spark, scratch):
    root = f"{scratch}/cache"
    schema = "id long, name string, version long"
    first = spark.createDataFrame([(i, f"n{i}", 1) for i in range(200)], schema)
    versions.update(first, root, "id", candidates.merge_cache, 16)
    before = versions.version(spark, root).parts
    landed = spark.createDataFrame([(3, "new", 2), (4, "old", 0), (1000, "more", 1), (1000, "most", 2)], schema)
    versions.update(landed, root, "id", candidates.merge_cache)
    after = versions.version(spark, root).parts
    touched = {str(r[0]) for r in landed.select(versions.bucket_of("id", 16)).collect()}
    assert {b for b in after if after[b] != before.get(b)} == touched and len(touched) < 5
    assert rows_of(versions.read(spark, root)) == rows_of(candidates.merge_cache(first, landed))
    assert versions.update(landed.limit(0), root, "id", candidates.merge_cache) == 2
    # Only the folders of the buckets asked for are read.
    files = versions.read(spark, root, [int(b) for b in touched]).inputFiles()
    assert {Path(f).parent.name.split("=")[1] for f in files} == touched


def test_catalog_landings_keep_the_first(spark, scratch):
    root = f"{scratch}/catalog"
    schema = "`File Path` string, seq long"
    grow = lambda old, new: old.unionByName(catalog.upsert(old, new))
    versions.update(spark.createDataFrame([("/a", 1), ("/b", 2), ("/a", 3)], schema), root, "File Path", grow, 4)
    versions.update(spark.createDataFrame([("/a", 4), ("/c", 6), ("/c", 5)], schema), root, "File Path", grow, 4)
    assert rows_of(versions.read(spark, root)) == [("/a", 1), ("/b", 2), ("/c", 5)]


def test_publish_keeps_refused_rows(spark, scratch):
    root = f"{scratch}/files"
    before = spark.createDataFrame([(i, "old") for i in range(30)], "seq long, title string")
    versions.publish(before, root, "seq", 4)
    after = before.withColumn("title", F.lit("new"))
    verdict = before.select("seq", (F.col("seq") % 3 != 0).alias("ok"))
    out = merge.publishable(versions.read(spark, root), after, verdict, "seq")
    versions.publish(out, root, "seq", audit=versions.same_keys("seq"))
    assert {r.seq for r in versions.read(spark, root).where("title = 'old'").collect()} == set(range(0, 30, 3))


def hostile_csv(rng, rows, end="\n"):
    """Lines of a CSV file of two columns: breaks, commas and quotes everywhere."""
    parts = ["x", "", ",", '""', end, f'"",{end}""', " ", "é", f'{end}{end}', f'""{end}']
    lines = ["a,b"]
    for _ in range(rows):
        fields = []
        for _ in range(2):
            if rng.random() < 0.6:
                fields.append('"' + "".join(rng.choices(parts, k=rng.randint(0, 6))) + '"')
            else:
                fields.append(rng.choice(["plain", "5 in", 'x"y', 'z""', " lead", "q "]))
        lines.append(",".join(fields))
    return end.join(lines) + rng.choice(["", end])


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("seed", [1, 2])
def test_csv_in_blocks_equals_one_task(spark, scratch, end, seed):
    rng = random.Random(seed)
    for name in ("one", "two"):
        Path(scratch, f"{name}.csv").write_text(hostile_csv(rng, 120, end), newline="")
    expected = purchases.read_csv(spark, scratch, ("a", "b"))
    for size in (37, 400, None):
        got = blocks.read_csv(spark, scratch, ("a", "b"), size)
        assert rows_of(got) == rows_of(expected), size
    assert blocks._pieces(spark, scratch, "\n").count() > 240


def test_csv_is_read_by_many_tasks(spark, scratch):
    wide = f'"{"x" * 5000}\n","b\n"\n'
    Path(scratch, "one.csv").write_text("a,b\n" + "1,2\n" * 2000 + wide + "1,2\n" * 2000)
    with blocks._split_at(spark, 1000):
        assert blocks._pieces(spark, scratch, "\n").rdd.getNumPartitions() >= 4
    got = blocks.read_csv(spark, scratch, ("a", "b"), 1000)
    assert got.count() == 4001
    assert got.where("a <> '1'").collect()[0] == ("x" * 5000 + "\n", "b\n")


def test_csv_edges(spark, scratch):
    Path(scratch, "empty.csv").write_text("")
    Path(scratch, "header.csv").write_text("a,b\n")
    Path(scratch, "open.csv").write_text('a,b\n1,2\n3,"never\nclosed')
    rows = rows_of(blocks.read_csv(spark, scratch, ("a", "b"), 10))
    assert rows == rows_of(purchases.read_csv(spark, scratch, ("a", "b")))
    with pytest.raises(Exception, match="other columns"):
        blocks.read_csv(spark, scratch, ("b", "a")).collect()
    assert len(PURCHASE_COLUMNS) == 17


@pytest.mark.parametrize("indent", [None, 2])
def test_manifest_array_in_blocks(spark, scratch, indent):
    rng = random.Random(5)
    odd = ['}', '{', '"', '\\', '},{"path":"no"', "]", "[", "\n", "é", "plain"]
    entries = [
        {
            "path": f"/{i}" + rng.choice(odd),
            "title": "".join(rng.choices(odd, k=4)),
            "duration_ms": i,
            "missing": rng.choices(odd, k=2),
            "snapshot": {"k}": "v{", "n": rng.choice(odd)},
        }
        for i in range(150)
    ]
    entries[10]["path"] = ""
    Path(scratch, "one.json").write_text(json.dumps(entries, indent=indent))
    Path(scratch, "two.json").write_text(json.dumps(entries[:3], ensure_ascii=False))
    Path(scratch, "none.json").write_text("[]")
    facts = lambda df: rows_of(df.withColumn("snapshot", F.to_json("snapshot")))
    expected = facts(logs.read_manifest(spark, scratch, array=True))
    for size in (29, 700, None):
        assert facts(blocks.read_manifest(spark, scratch, size)) == expected
    assert len(expected) == 152


def test_manifest_skips_what_is_no_object(spark, scratch):
    Path(scratch, "m.json").write_text('[1, "a}{b", {"path": "/x"}, null, "}", [ {"path": "/y"} ], {"path": "/z"}, "{"]')
    for size in (5, None):
        assert [r[0] for r in rows_of(blocks.read_manifest(spark, scratch, size).select("path"))] == ["/x", "/y", "/z"]
