"""The registered queries. Each takes a session and a folder of driver tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from contextlib import suppress
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cratelink.functions import paths, quality, search, sql, text, times
from cratelink.operators import cascade, gates, merge, playlists, position, runs, waterfall
from cratelink.operators.containment import contained_pairs
from cratelink.operators.keys import catalog_keys, query_keys
from cratelink.operators.search import first_usable, query_variants
from cratelink.operators.search import search as search_candidates
from cratelink.operators.strategies import STRATEGIES, Strategy, names_by_level
from cratelink.plans import enrich
from cratelink.session import new_path, shuffled, stage
from cratelink.sinks import playlists as playlist_sink
from cratelink.sinks import tables as table_sink
from cratelink.sinks import versions
from cratelink.sources import candidates as candidate_source
from cratelink.sources import catalog as catalog_source
from cratelink.sources import blocks, logs, purchases, remote
from cratelink.streaming import jobs
from workload.views import CATALOG_FIELDS, PURCHASE_FIELDS, table, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _joined(c: Column | str) -> Column:
    return F.array_join(c, "|")


# --- keys ---------------------------------------------------------------------


def _keys_out(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(
        *extra, "isrc", "artist", "album", "clean", "condensed", _joined("names").alias("names"), "first_name"
    )


@query
def keys_purchase(spark, sf):
    return _keys_out(query_keys(view(spark, sf, "fx_purchases"), PURCHASE_FIELDS))


@query
def keys_catalog(spark, sf):
    return _keys_out(catalog_keys(view(spark, sf, "fx_catalog"), CATALOG_FIELDS), "seq", "path")


@query
def keys_documents(spark, sf):
    """Digests of the title key and of the normalised form, both of the whole text."""
    docs = text.with_title_key(table(spark, sf, "documents"), F.col("text"), "title_key")
    return docs.select(
        "doc_id",
        F.md5("title_key").alias("title_key"),
        text.norm_artist(F.col("source")).alias("source_key"),
        F.md5(text.normalize(F.col("text"))).alias("text_key"),
    )


@query
def keys_sql_functions(spark, sf):
    """The same rules, called from SQL."""
    sql.register(spark)
    table(spark, sf, "conversations").createOrReplaceTempView("cl_turns")
    return spark.sql(
        "select conv_id, turn, cl_clean_title(text) as clean, "
        "md5(cl_normalize(text)) as text_key, md5(cl_norm_artist(text)) as artist_key from cl_turns"
    )


# --- linkage ------------------------------------------------------------------


def _key_tables(spark, sf) -> tuple[DataFrame, DataFrame]:
    q = query_keys(view(spark, sf, "fx_purchases"), PURCHASE_FIELDS)
    r = catalog_keys(view(spark, sf, "fx_catalog"), CATALOG_FIELDS)
    return stage(q, "queries"), stage(r, "catalog")


def _link_one(name: str) -> Query:
    def run(spark, sf):
        q, r = _key_tables(spark, sf)
        hits = cascade.with_path(cascade.strategy_hits(q, r, name), r)
        return q.join(hits, "qid").select("isrc", "artist", "album", "clean", "path")

    return run


for _n in range(1, 14):
    QUERIES[f"link_s{_n:02d}"] = _link_one(f"s{_n:02d}")

_NAMES = names_by_level()


def _strategy_name(level: str = "level", names: dict[int, str] | None = None) -> Column:
    out = F.lit("")
    for number, name in (names or _NAMES).items():
        out = F.when(F.col(level) == number, F.lit(name)).otherwise(out)
    return out


def linked(spark, sf, **options) -> DataFrame:
    return cascade.link(
        view(spark, sf, "fx_purchases"),
        view(spark, sf, "fx_catalog"),
        PURCHASE_FIELDS,
        CATALOG_FIELDS,
        "file_path",
        "level",
        **options,
    )


@query
def link_exact(spark, sf):
    first_five = tuple(s for s in STRATEGIES if s.level <= 50)
    rows = linked(spark, sf, strategies=first_five)
    return rows.select("track_id", "file_path", _strategy_name().alias("strategy"))


@query
def link_full(spark, sf):
    return linked(spark, sf).select("track_id", "file_path", _strategy_name().alias("strategy"))


@query
def link_full_title_way(spark, sf):
    """Full linkage with every residual query forced over title pairs."""
    return linked(spark, sf, fan_limit=0).select("track_id", "file_path", _strategy_name().alias("strategy"))


@query
def link_full_grouped_windows(spark, sf):
    """Full linkage with every containment group forced over windows."""
    return linked(spark, sf, group_limit=0).select("track_id", "file_path", _strategy_name().alias("strategy"))


@query
def link_custom(spark, sf):
    """A job's own ladder: the equal-title rule moved below the residual rules, and a rule of its own last."""
    s05 = next(s for s in STRATEGIES if s.name == "s05")
    own = tuple(s for s in STRATEGIES if s is not s05) + (
        replace(s05, name="s14", level=140),
        Strategy("s15", 150, "residual", title="length(q.clean) = length(r.clean)"),
    )
    name = _strategy_name(names=names_by_level(own))
    return linked(spark, sf, strategies=own).select("track_id", "file_path", name.alias("strategy"))


@query
def link_strategy_counts(spark, sf):
    q, r = _key_tables(spark, sf)
    found = cascade.link_keys(q, r)
    named = q.join(found, "qid", "left").withColumn("strategy", _strategy_name())
    return named.groupBy("strategy").agg(F.count("*").alias("n"))


@query
def match_counts(spark, sf):
    return cascade.match_counts(linked(spark, sf), "file_path")


@query
def artist_overlap_pairs(spark, sf):
    """Artist texts that share a name or hold one another's."""
    q, r = _key_tables(spark, sf)
    ours = q.select("artist", F.explode("names").alias("name")).distinct()
    theirs = r.select("artist", F.explode("names").alias("name")).distinct()

    def names(df):
        return df.select(F.lit("").alias("grp"), F.col("name").alias("v")).distinct()

    pairs = contained_pairs(names(ours), names(theirs))
    return (
        pairs.join(ours.selectExpr("artist as q_artist", "name as l"), "l")
        .join(theirs.selectExpr("artist as r_artist", "name as r"), "r")
        .select("q_artist", "r_artist")
        .distinct()
    )


@query
def album_pairs(spark, sf):
    """Album keys that fit: one holds the other."""
    q, r = _key_tables(spark, sf)

    def albums(df):
        return df.select(F.lit("").alias("grp"), F.col("album").alias("v")).filter("v <> ''").distinct()

    return contained_pairs(albums(q), albums(r)).selectExpr("l as q_album", "r as r_album")


@query
def catalog_stats(spark, sf):
    return catalog_source.stats(view(spark, sf, "fx_catalog"), "isrc")


# --- quality --------------------------------------------------------------------


@query
def junk_titles(spark, sf):
    title = F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)
    return table(spark, sf, "pages").select(
        "page_id",
        quality.junk_reason(title).alias("title_reason"),
        quality.junk_reason(F.col("url")).alias("url_reason"),
        paths.extension(F.regexp_replace("url", r"[?#].*\z", "")).alias("url_ext"),
    )


def _tag_table(spark, sf) -> DataFrame:
    """fx_files as a tag table: path, tags, and one unreadable file in 23."""
    path = F.concat(
        F.lit("/mnt/"),
        F.when(F.col("seq") % 3 == 0, F.lit("c")).otherwise(F.lit("g")),
        F.lit("/music/"),
        F.col("seq").cast("string"),
        F.when(F.col("seq") % 5 == 0, F.lit(".ogg")).otherwise(F.lit(".mp3")),
    )
    title = F.when(F.col("seq") % 6 == 0, F.concat("title", F.lit(" 128"))).otherwise(F.col("title"))
    return (
        view(spark, sf, "fx_files")
        .withColumn("path", path)
        .withColumn("title", title)
        .withColumn("readable", F.col("seq") % 23 != 0)
    )


@query
def missing_profile(spark, sf):
    rows = enrich.sparse(_tag_table(spark, sf))
    return rows.select("path", _joined("missing").alias("missing"))


@query
def sparse_counts(spark, sf):
    return enrich.sparse_counts(_tag_table(spark, sf))


@query
def needs_work(spark, sf):
    tags = _tag_table(spark, sf)
    return enrich.needing_work(tags.select("path"), tags, "c, g:").select("path")


@query
def needs_work_drives(spark, sf):
    """The same by a manifest that names files in drive and address form."""
    tags = _tag_table(spark, sf)
    drive = paths.mount_to_drive(F.col("path"))
    named = F.when(F.length("path") % 2 == 0, drive).otherwise(F.concat(F.lit("file://"), drive))
    return enrich.needing_work(tags.select(named.alias("path")), tags, "c, g:").select("path")


# --- search texts and paths -------------------------------------------------------


def _titled(spark, sf) -> DataFrame:
    """Candidate titles in the written forms a file may carry."""
    mix = F.col("mix_name")
    written = (
        F.when(mix == "", F.col("name"))
        .when(F.col("id") % 3 == 0, F.concat("name", F.lit(" ("), mix, F.lit(")")))
        .when(F.col("id") % 3 == 1, F.concat("name", F.lit(" - "), mix))
        .otherwise(F.concat("name", F.lit(" "), mix))
    )
    return view(spark, sf, "fx_candidates").select("id", "artists", written.alias("written"))


@query
def split_mix(spark, sf):
    rows = _titled(spark, sf).withColumn("m", search.split_mix(F.col("written")))
    return rows.select(
        "id", F.col("m.base").alias("base"), F.col("m.mix").alias("mix"), text.declared_mix(F.col("written")).alias("declared")
    )


@query
def clean_query(spark, sf):
    """Titles led by the artist and trailed by tempo or address, cleaned for search."""
    rows = view(spark, sf, "fx_files").select(
        "seq",
        "artist",
        F.concat(
            F.when(F.col("seq") % 2 == 0, F.concat("artist", F.lit(" - "))).otherwise(F.lit("")),
            "title",
            F.when(F.col("seq") % 3 == 0, F.lit(" 128")).when(F.col("seq") % 3 == 1, F.lit(" djsoundtop.com")).otherwise(F.lit("")),
        ).alias("raw"),
    )
    return rows.select(
        "seq",
        search.clean_search_title(F.col("raw"), F.col("artist")).alias("title"),
        search.clean_search_artist(F.concat("artist", F.lit(" www.example.com"))).alias("artist"),
        search.drop_featuring(F.concat("raw", F.lit(" (feat. Guest)"))).alias("bare"),
    )


@query
def search_artists(spark, sf):
    rows = view(spark, sf, "fx_purchases").select("artists").distinct()
    return rows.select("artists", _joined(search.split_artists(F.col("artists"))).alias("names"))


def _named_paths(spark, sf) -> DataFrame:
    stem = (
        F.when(F.col("seq") % 4 == 0, F.concat(F.lit("03 - "), "artist", F.lit(" - "), "title"))
        .when(F.col("seq") % 4 == 1, F.concat((F.col("seq") + 14000000).cast("string"), F.lit("_"), F.replace("title", F.lit(" "), F.lit("_"))))
        .when(F.col("seq") % 4 == 2, F.col("title"))
        .otherwise(F.concat(F.lit("1-07. "), "title"))
    )
    folder = F.when(F.col("seq") % 5 == 0, F.lit("UnknownArtist")).when(
        F.col("seq") % 5 == 1, F.lit("www.example.com")
    ).otherwise(F.col("artist"))
    return view(spark, sf, "fx_files").select(
        "seq", F.concat(F.lit("/mnt/g/music/"), folder, F.lit("/"), stem, F.lit(".mp3")).alias("path")
    )


@query
def guess_identity(spark, sf):
    rows = _named_paths(spark, sf).select(
        "seq",
        search.resolve_identity(F.col("path"), F.lit(""), F.lit("")).alias("who"),
        search.id_from_name(F.col("path")).alias("num"),
    )
    return rows.select(
        "seq",
        F.coalesce("who.artist", F.lit("")).alias("artist"),
        F.coalesce("who.title", F.lit("")).alias("title"),
        F.col("num.id").alias("file_id"),
        F.col("num.rest").alias("rest"),
    )


@query
def drive_allow(spark, sf):
    path = F.col("file_path")
    rows = view(spark, sf, "fx_catalog").select(
        paths.drive_letter(path).alias("drive"), paths.allowed(path, "G:,?,x1").alias("ok")
    )
    return rows.groupBy("drive").agg(F.count_if("ok").alias("allowed"), F.count_if(~F.col("ok")).alias("blocked"))


@query
def path_forms(spark, sf):
    path = F.col("file_path")
    rows = view(spark, sf, "fx_catalog")
    return rows.select(
        "seq",
        paths.mount_to_drive(path).alias("drive_path"),
        paths.drive_to_mount(paths.mount_to_drive(path)).alias("mount_path"),
        paths.file_uri(F.concat(path, F.lit(" a+b"))).alias("uri"),
    )


@query
def ext_counts(spark, sf):
    ext = paths.extension(F.col("file_path"))
    return view(spark, sf, "fx_catalog").groupBy(ext.alias("ext")).agg(
        F.count("*").alias("n"), F.count_if(paths.has_extension(F.col("file_path"), "mp3,.WAV")).alias("wanted")
    )


@query
def duration_text(spark, sf):
    return view(spark, sf, "fx_candidates").select("id", times.duration_text(F.col("length_ms")).alias("duration"))


@query
def duration_parse(spark, sf):
    """Text forms of every length, parsed back."""
    rows = view(spark, sf, "fx_candidates").withColumn("s", F.expr("cast(length_ms / 1000 as bigint)"))
    shown = (
        F.when(F.col("id") % 3 == 0, F.format_string("%d:%02d:%02d", F.expr("s div 3600"), F.expr("(s div 60) % 60"), F.expr("s % 60")))
        .when(F.col("id") % 3 == 1, times.duration_text(F.col("length_ms")))
        .otherwise(F.concat(F.col("s").cast("string"), F.when(F.col("id") % 2 == 0, F.lit("")).otherwise(F.lit("x"))))
    )
    return rows.select("id", F.coalesce(times.parse_duration(shown), F.lit(-1)).alias("ms"))


# --- candidates -------------------------------------------------------------------


@query
def pick_oldest(spark, sf):
    c = view(spark, sf, "fx_candidates")
    return gates.pick_oldest(c, ["name", "artists"]).select("name", "artists", "id", "publish_date")


def _offers(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Files and the candidates that carry their exact name and artist."""
    files = view(spark, sf, "fx_files").select("seq", "artist", "title", "duration_ms")
    c = view(spark, sf, "fx_candidates")
    met = files.join(c, (files.title == c.name) & (files.artist == c.artists))
    return files, met.select("seq", "duration_ms", *c.columns)


@query
def pick_best(spark, sf):
    files, met = _offers(spark, sf)
    best = gates.pick_best(files, met, "seq")
    return best.select("seq", F.coalesce("pick.id", F.lit(-1)).alias("id"), "reason")


def _worded(files: DataFrame) -> DataFrame:
    tail = F.when(F.col("seq") % 3 == 0, F.lit("")).when(F.col("seq") % 3 == 1, F.lit(" (Original Mix)")).otherwise(F.lit(" (Instrumental)"))
    return files.withColumn("asked", F.concat("title", tail))


@query
def pick_best_titled(spark, sf):
    files, met = _offers(spark, sf)
    files = _worded(files)
    met = met.join(files.select("seq", "asked"), "seq")
    best = gates.pick_best(files, met, "seq", "asked")
    return best.select("seq", F.coalesce("pick.id", F.lit(-1)).alias("id"), "reason")


@query
def title_gate(spark, sf):
    files, met = _offers(spark, sf)
    rows = met.join(_worded(files).select("seq", "asked"), "seq")
    agrees = search.title_agrees(F.col("asked"), F.col("name"), F.col("mix_name"))
    return rows.select("seq", "id", agrees.alias("agrees"))


@query
def id_gate(spark, sf):
    """Ids taken from file names, trusted when lengths agree."""
    named = _named_paths(spark, sf).withColumn("file_id", search.id_from_name(F.col("path"))["id"] - 14000000)
    files = view(spark, sf, "fx_files").select("seq", "duration_ms").join(named, "seq")
    return gates.by_id(files, view(spark, sf, "fx_candidates")).select("seq", "id")


@query
def search_top10(spark, sf):
    files = view(spark, sf, "fx_files")
    asks = files.select(
        F.lower("artist").alias("s_artist"),
        F.upper("title").alias("s_title"),
        F.when(F.col("seq") % 4 == 0, F.lit("mix")).otherwise(F.lit("")).alias("s_mix"),
    )
    return search_candidates(asks, view(spark, sf, "fx_candidates")).select(
        "s_artist", "s_title", "s_mix", F.col("place").cast("bigint").alias("place"), "id"
    )


def _joint_files(spark, sf) -> DataFrame:
    """Files of joined artists and decorated titles."""
    artist = (
        F.when(F.col("seq") % 7 == 0, F.concat("artist", F.lit(" & Guest")))
        .when(F.col("seq") % 7 == 1, F.concat(F.lit("Guest feat. "), "artist"))
        .otherwise(F.col("artist"))
    )
    title = (
        F.when(F.col("seq") % 5 == 0, F.concat("title", F.lit(" (Extended Mix)")))
        .when(F.col("seq") % 5 == 1, F.concat("title", F.lit(" (feat. Guest)")))
        .otherwise(F.col("title"))
    )
    return view(spark, sf, "fx_files").select("seq", artist.alias("artist"), title.alias("title"), "duration_ms")


@query
def search_variants(spark, sf):
    return query_variants(_joint_files(spark, sf), "seq")


@query
def variant_first_usable(spark, sf):
    rows = first_usable(_joint_files(spark, sf), view(spark, sf, "fx_candidates"), "seq")
    return rows.select("seq", "ordinal", "id")


def _candidate_json(spark, sf) -> DataFrame:
    """fx_candidates as search-answer JSON."""
    c = view(spark, sf, "fx_candidates")
    doc = F.to_json(
        F.struct(
            F.col("id").alias("id"),
            "name",
            "mix_name",
            F.array(F.struct(F.col("artists").alias("name")), F.struct(F.lit("Guest").alias("name"))).alias("artists"),
            F.struct(F.lit("House").alias("name")).alias("genre"),
            F.when(F.col("id") % 2 == 0, F.struct(F.lit("Deep House").alias("name"))).alias("sub_genre"),
            F.when(F.col("id") % 3 == 0, F.struct(F.lit("Own").alias("name"))).alias("label"),
            F.struct(
                (F.col("id") + 7).cast("string").alias("id"),
                F.lit("Rel").alias("name"),
                F.struct(F.lit("House Label").alias("name")).alias("label"),
                F.when(F.col("id") % 5 == 0, F.struct(F.lit("http://i/{w}x{h}.jpg").alias("dynamic_uri"))).alias("image"),
            ).alias("release"),
            F.struct(F.lit("http://t/i.jpg").alias("uri")).alias("image"),
            "publish_date",
            F.lit("1999-01-01").alias("new_release_date"),
            F.when(F.col("id") % 4 == 0, F.lit("bad")).otherwise((120 + F.col("id") % 20).cast("string")).alias("bpm"),
            "length_ms",
        )
    )
    return c.select(doc.alias("value"))


@query
def candidate_parse(spark, sf):
    rows = candidate_source.parse(_candidate_json(spark, sf))
    return rows.select(
        "id", "name", "artists", "genre", "sub_genre", "label", "release_id", "publish_date", "bpm", "artwork_url", "length_ms"
    )


@query
def snapshot_roundtrip(spark, sf):
    rows = candidate_source.parse(_candidate_json(spark, sf))
    texts = rows.select(candidate_source.to_snapshot().alias("value"))
    return candidate_source.parse_snapshots(texts).select("id", "name", "mix_name", "bpm", "length_ms", "artwork_url")


def _loose_snapshots(spark, sf) -> DataFrame:
    """Snapshots out of the event properties, of loose types; the event is their version."""
    events = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    forms = ["true", '"bad"', "7.9", '"7.9"', '"true"']
    bpm = F.concat(F.lit('"'), k, F.lit('"'))
    for i, form in enumerate(forms):
        bpm = F.when(F.col("event_id") % 6 == i, F.lit(form)).otherwise(bpm)
    name = F.concat(F.lit('"'), "event_type", F.lit('"'))
    parts = [("id", k), ("name", name), ("bpm", bpm), ("length_ms", F.col("event_id").cast("string"))]
    body = F.concat_ws(", ", *[F.concat(F.lit(f'"{n}": '), v) for n, v in parts])
    loose = F.concat(F.lit("{"), body, F.lit("}"))
    rows = candidate_source.parse_snapshots(events.select("event_id", loose.alias("value")), keep=("event_id",))
    return rows.select("id", "name", "bpm", "length_ms", F.col("event_id").alias("version"))


@query
def props_snapshot(spark, sf):
    """Loose snapshots out of the event properties; the latest per id stays in the cache."""
    rows = _loose_snapshots(spark, sf)
    return candidate_source.merge_cache(rows.filter("version % 2 = 0"), rows.filter("version % 2 = 1"))


@query
def cache_landings(spark, sf):
    """The same cache kept in buckets: one large landing, then those of each tenth id and the rest."""
    rows = stage(_loose_snapshots(spark, sf), "snapshots")
    root = new_path(spark, "cache")
    for part in ("version % 2 = 0", "version % 2 = 1 and id % 10 = 0", "version % 2 = 1 and id % 10 <> 0"):
        versions.update(rows.filter(part), root, "id", candidate_source.merge_cache)
    return versions.read(spark, root)


@query
def catalog_landings(spark, sf):
    """Turns landed twice into a bucketed catalog; the first of each conversation stays."""
    turns = stage(table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"), "turns")
    root = new_path(spark, "catalog")

    def first_wins(old: DataFrame, new: DataFrame) -> DataFrame:
        return old.unionByName(catalog_source.upsert(old, new, "conv_id", "turn"))

    for part in (turns.filter("conv_id % 3 = 0"), turns):
        versions.update(part, root, "conv_id", first_wins)
    return versions.read(spark, root).select("conv_id", "turn", "role", F.md5("text").alias("text_key"))


@query
def snapshot_lookup(spark, sf):
    """Order rows joined to their candidate snapshot; a miss is an error row."""
    cache = view(spark, sf, "fx_candidates").filter("id % 5 <> 0").select("id", "name")
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"))
    joined = candidate_source.with_snapshots(rows, cache)
    return joined.groupBy("status").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


@query
def wanted_ids(spark, sf):
    cache = view(spark, sf, "fx_candidates").filter("id % 5 <> 0").select("id")
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"))
    return candidate_source.wanted_ids(rows, cache)


# --- fallback sources ---------------------------------------------------------------


def _recording_answers(met: DataFrame) -> DataFrame:
    """Per file an answer of ranked recordings, as JSON, drawn from its candidates."""
    doc = F.to_json(
        F.struct(
            F.col("id").cast("string").alias("id"),
            F.when(F.col("id") % 6 == 0, F.lit("")).otherwise(F.col("name")).alias("title"),
            (60 + F.col("id") % 41).cast("string").alias("score"),
            F.when(F.col("length_ms") == 0, F.lit("bad")).otherwise(F.col("length_ms").cast("string")).alias("length"),
            F.array(F.struct(F.when(F.col("id") % 9 == 0, F.lit("Nobody")).otherwise(F.col("artists")).alias("name")), F.struct(F.lit("Live").alias("name"))).alias("artist-credit"),
            F.array(
                F.struct(
                    F.when(F.col("id") % 10 == 0, F.lit("")).otherwise(F.concat(F.lit("Rel "), F.col("id").cast("string"))).alias("title"),
                    F.concat("publish_date", F.lit("T00:00")).alias("date"),
                    F.array(F.struct(F.struct(F.lit("").alias("name")).alias("label")), F.struct(F.struct(F.lit("Lab").alias("name")).alias("label"))).alias("label-info"),
                )
            ).alias("releases"),
        )
    )
    return met.select("seq", F.col("id").alias("rank"), doc.alias("value"))


def _recording_match(files: DataFrame, met: DataFrame) -> DataFrame:
    met = met.join(files.select("seq"), "seq", "left_semi")
    return waterfall.recordings_match(files, remote.recordings(_recording_answers(met), "seq"), "seq")


@query
def mb_gate(spark, sf):
    return _recording_match(*_offers(spark, sf)).select("seq", "name", "artists", "release_name", "publish_date", "label")


def _release_tables(spark, sf, files: DataFrame, met: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files with base titles, one search answer per file, and landed release details."""
    met = met.join(files.select("seq"), "seq", "left_semi")
    files = files.withColumn("base", F.col("title"))
    shown = F.when(F.col("id") % 3 == 0, F.concat(F.col("artists"), F.lit(" - Some Album"))).otherwise(
        F.concat(F.col("artists"), F.lit(" - "), F.col("name"))
    )
    shown = F.when(F.col("id") % 11 == 0, F.lit("Other - X")).otherwise(shown)
    kind = F.when(F.col("id") % 8 == 0, F.lit("artist")).when(F.col("id") % 8 == 1, F.lit(None)).otherwise(F.lit("release"))
    one = F.struct(F.col("id"), kind.alias("type"), shown.alias("title"))
    answer = met.select("seq", F.col("id").alias("page"), F.to_json(F.struct(F.array(one).alias("results"))).alias("value"))
    c = view(spark, sf, "fx_candidates")
    listed = F.when(F.col("length_ms") == 0, F.lit("")).otherwise(times.duration_text(F.col("length_ms")))
    details = c.select(
        F.to_json(
            F.struct(
                "id",
                F.concat(F.lit("Album "), F.col("id").cast("string")).alias("title"),
                F.array(F.struct(F.col("artists").alias("name")), F.struct(F.lit("").alias("name"))).alias("artists"),
                F.array(F.struct(F.lit("Lab").alias("name"))).alias("labels"),
                F.when(F.col("id") % 2 == 0, F.array(F.lit("Rock"), F.lit("Electronic"))).otherwise(F.array(F.lit("Rock"))).alias("genres"),
                F.when(F.col("id") % 4 == 0, F.array(F.lit(" "), F.lit("Tech House"))).otherwise(F.array().cast("array<string>")).alias("styles"),
                F.array(
                    F.struct(F.lit("Intro").alias("title"), F.lit("x:y").alias("duration")),
                    F.struct(F.col("name").alias("title"), listed.alias("duration")),
                ).alias("tracklist"),
                "publish_date",
                F.col("publish_date").alias("released"),
                F.lit(1998).alias("year"),
                F.array(F.struct(F.lit("secondary").alias("type"), F.lit("b").alias("uri")), F.struct(F.lit("primary").alias("type"), F.lit("a").alias("uri"))).alias("images"),
            )
        ).alias("value")
    )
    return files, answer, details


def _release_match(spark, sf, files: DataFrame, met: DataFrame) -> DataFrame:
    files, answers, details = _release_tables(spark, sf, files, met)
    return waterfall.releases_match(
        files, remote.release_results(answers, "seq", page="page"), remote.releases(details), "seq"
    )


@query
def discogs_gate(spark, sf):
    return _release_match(spark, sf, *_offers(spark, sf)).select("seq", "name", "artists", "release_name", "publish_date", "label", "genre", "artwork_url")


@query
def source_waterfall(spark, sf):
    files, met = _offers(spark, sf)
    met = stage(met, "offers")
    best = stage(gates.pick_best(files, met, "seq"), "best")
    primary = waterfall.conform(best.filter("pick is not null").select("seq", "pick.*"), ["seq"])
    sources = [
        ("catalog", primary),
        ("recordings", lambda left: _recording_match(left, met)),
        ("off", None),
        ("releases", lambda left: _release_match(spark, sf, left, met)),
    ]
    decided = waterfall.waterfall(files, sources, "seq")
    status = F.when(F.col("source") != "", F.lit("matched")).otherwise(waterfall.status_or(F.col("reason")))
    return decided.join(best.select("seq", "reason"), "seq").select("seq", "source", status.alias("status"))


@query
def enrich_resolve(spark, sf):
    """The whole flow from paths and tags to a pick per file."""
    tags = _joint_files(spark, sf).join(_named_paths(spark, sf), "seq")
    blank = F.col("seq") % 6 == 0
    files = tags.select(
        "path",
        F.when(blank, F.lit("")).otherwise(F.col("artist")).alias("artist"),
        F.when(blank, F.lit("")).otherwise(F.col("title")).alias("title"),
        "duration_ms",
    )
    got = enrich.resolve(files, waterfall.conform(view(spark, sf, "fx_candidates")))
    return got.select("path", "artist", "title", "status", "source", F.coalesce("pick.id", F.lit(-1)).alias("id"))


# --- merge ------------------------------------------------------------------------


def _merge_tables(spark, sf) -> tuple[DataFrame, DataFrame]:
    files, met = _offers(spark, sf)
    current = view(spark, sf, "fx_files").select(
        "seq", "artist", "title", "album", "genre", "date", (F.col("seq") % 2 == 0).alias("has_artwork")
    )
    best = gates.pick_best(files, met, "seq").filter("pick is not null")
    pick = waterfall.conform(best.select("seq", "pick.*"), ["seq"])
    pick = pick.withColumns(
        {
            "genre": F.when(F.col("id") % 2 == 0, F.lit("Techno")).otherwise(F.lit("")),
            "sub_genre": F.when(F.col("id") % 4 == 0, F.lit("Hard Techno")).otherwise(F.lit("")),
            "bpm": (F.col("id") % 3).cast("int"),
            "release_name": F.lit("Rel"),
            "artwork_url": F.when(F.col("id") % 5 == 0, F.lit("")).otherwise(F.lit("http://i/a.jpg")),
        }
    )
    picks = pick.select("seq", F.struct(*waterfall.CANDIDATE_FIELDS).alias("pick"))
    return current, merge.offered(picks, "seq")


@query
def merge_plan(spark, sf):
    current, new = _merge_tables(spark, sf)
    return merge.plan_fields(current, new, "seq").select("seq", "field", "old", "new", "reason")


@query
def merge_plan_maps(spark, sf):
    current, new = _merge_tables(spark, sf)
    p = merge.plans(current, new, "seq", fields=["genre", "date", "bpm"])
    entries = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"]))), "|")
    return p.select("seq", entries("updates").alias("updates"), entries("reasons").alias("reasons"), "embed_artwork")


@query
def merge_result(spark, sf):
    current, new = _merge_tables(spark, sf)
    out = merge.merged(current, new, "seq", source=F.lit("catalog"))
    return out.select("seq", "artist", "title", "album", "genre", "date", _joined("updated").alias("updated"), "source")


@query
def reconcile(spark, sf):
    """Planned writes checked after the fact; some rows lose a value, art or audio on purpose."""
    current, new = _merge_tables(spark, sf)
    plan = stage(merge.plans(current, new, "seq"), "plan")
    old = current.select(
        "seq",
        F.map_filter(
            F.create_map(*[x for f in ("artist", "title", "album", "genre", "date") for x in (F.lit(f), F.col(f))]),
            lambda k, v: v != "",
        ).alias("tags"),
        F.lit(180.0).alias("seconds"),
        F.lit(1).alias("pictures"),
    )
    merged = F.map_concat(
        F.map_filter("tags", lambda k, v: ~F.map_contains_key("updates", k)), F.col("updates")
    )
    lossy = F.map_filter(merged, lambda k, v: ~((F.col("seq") % 17 == 0) & (k == "artist")))
    after = old.join(plan.select("seq", "updates"), "seq").select(
        "seq",
        F.when(F.col("seq") % 13 == 0, F.col("tags")).otherwise(lossy).alias("tags"),
        F.when(F.col("seq") % 19 == 0, F.lit(180.5)).when(F.col("seq") % 19 == 1, F.lit(180.25)).otherwise(F.lit(180.0)).alias("seconds"),
        F.when(F.col("seq") % 29 == 0, F.lit(0)).otherwise(F.lit(1)).alias("pictures"),
    )
    v = merge.reconcile(old, after, plan, "seq", own_marks=["SOURCE"])
    return v.select("seq", "landed", _joined("lost").alias("lost"), "audio_ok", "status")


# --- runs -------------------------------------------------------------------------


def _run_log(spark, sf) -> DataFrame:
    return view(spark, sf, "fx_run_log")


@query
def resume_todo(spark, sf):
    """Candidate rows not logged by an earlier run; the apply path also needs an id."""
    manifest = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("path"),
        F.when(F.col("o_orderkey") % 3 == 0, F.lit(0)).otherwise(F.col("o_orderkey")).alias("candidate_id"),
        F.when(F.col("o_orderkey") % 6 == 0, F.create_map(F.lit("id"), F.lit("1"))).alias("snapshot"),
    )
    done = _run_log(spark, sf).filter("status <> 'error'").select(F.col("seq").cast("string").alias("path"))
    return runs.todo(manifest, done, need_match=True).select("path")


@query
def status_counts(spark, sf):
    log = _run_log(spark, sf)
    key = runs.count_key(F.col("status"), F.col("seq") % 2 == 0, F.col("seq") % 3 != 0)
    return runs.status_counts(log, key=key)


@query
def run_verdict(spark, sf):
    return runs.verdict(runs.status_counts(_run_log(spark, sf), "run_id"), "run_id")


@query
def run_progress(spark, sf):
    log = _run_log(spark, sf).withColumn("label", F.concat(F.lit("item "), F.col("seq").cast("string")))
    return runs.progress(log, F.lit(500), F.lit(60), "run_id").select(
        "run_id", "done", "matched", "last_matched", "pct", "rate", "eta"
    )


@query
def breaker_prefix(spark, sf):
    kept = runs.breaker_prefix(_run_log(spark, sf), "run_id", "ts", "seq", limit=3)
    return kept.select("run_id", "seq", "status", F.col("streak").cast("bigint").alias("streak"))


@query
def breaker_prefix_dry(spark, sf):
    log = _run_log(spark, sf)
    placed = position.numbered(log, "run_id", "ts", "seq", column="overall")
    first = placed.groupBy("run_id").agg(F.min("overall").alias("first"))
    placed = placed.join(first, "run_id").withColumn("position", F.col("overall") - F.col("first") + 1)
    kept = runs.breaker_prefix(placed, "run_id", "ts", "seq", limit=3, mode="dry", chunk=10)
    return kept.select("run_id", "seq", F.col("position").cast("bigint").alias("position"))


@query
def breaker_totals(spark, sf):
    rows = stage(runs.streaks(_run_log(spark, sf), "run_id", "ts", "seq"), "streaks")
    trips = runs.trip_points(rows, "run_id", "ts", "seq", limit=3)
    kept = rows.join(trips, "run_id", "left").filter(F.col("trip").isNull() | (F.struct("ts", "seq") <= F.col("trip")))
    return runs.run_totals(kept, trips, "run_id")


@query
def chunks(spark, sf):
    rows = position.chunks(_run_log(spark, sf), "ts", "seq", size=50)
    return rows.select("seq", F.col("position").cast("bigint").alias("position"), F.col("chunk").cast("bigint").alias("chunk"))


@query
def first_results(spark, sf):
    return position.first_n(_run_log(spark, sf), 100, "ts", "seq").select("seq", "status")


def _timed(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Every event as a started item; finished after ten seconds per value, unless an error."""
    return _starts(table(spark, sf, "events")), _finishes(table(spark, sf, "events"))


def _starts(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_id").alias("item"), F.col("ts").alias("started_at"))


def _finishes(events: DataFrame) -> DataFrame:
    took = F.expr("make_dt_interval(0, 0, 0, cast(floor(value * 10) as int))")
    return events.filter("event_type <> 'error'").select(
        F.col("event_id").alias("item"), (F.col("ts") + took).alias("finished_at")
    )


@query
def stuck_batch(spark, sf):
    """Items of the whole log that never finished, seen at its last start."""
    starts, finishes = _timed(spark, sf)
    now = F.lit(starts.agg(F.max("started_at")).first()[0])
    return runs.stuck(starts, finishes.filter(F.col("finished_at") <= now), "item", now).select("item")


@query
def result_records(spark, sf):
    """One machine-readable record per logged result."""
    log = _run_log(spark, sf)
    record = logs.result_record({"path": F.col("seq").cast("string"), "status": F.col("status"), "error": F.lit("")})
    return log.select("seq", record.alias("record"))


# --- ingest -----------------------------------------------------------------------


@query
def upsert_first_wins(spark, sf):
    """The first turn of each conversation, then turns of later loads only where new."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    known = catalog_source.upsert(None, turns.filter("conv_id % 3 = 0"), "conv_id", "turn")
    fresh = catalog_source.upsert(known, turns, "conv_id", "turn")
    return known.unionByName(fresh).select("conv_id", "turn", "role", F.md5("text").alias("text_key"))


def _track_json(spark, sf) -> DataFrame:
    """Purchases as the nested JSON they arrive in."""
    c = view(spark, sf, "fx_candidates")
    doc = F.to_json(
        F.struct(
            "id",
            "name",
            F.array(F.struct(F.col("artists").alias("name")), F.struct(F.lit("Guest").alias("name"))).alias("artists"),
            F.array().cast("array<struct<name:string>>").alias("remixers"),
            F.when(F.col("id") % 2 == 0, F.struct(F.lit("House").alias("name"))).alias("genre"),
            F.struct(F.lit(9).alias("id"), F.lit("Rel").alias("name")).alias("release"),
            F.when(F.col("id") % 3 == 0, F.to_json(F.struct(F.lit("$1.49").alias("display")))).alias("price_text"),
            (F.col("id") % 4).alias("bpm"),
            F.col("publish_date").alias("purchase_date"),
            "length_ms",
            F.lit("9:59").alias("length"),
        )
    )
    # The price is an object in some tracks and a bare number in others.
    doc = F.regexp_replace(doc, r'"price_text":"\{\\"display\\":\\"([^"\\]*)\\"\}"', r'"price":{"display":"$1"}')
    doc = F.when(F.col("id") % 3 == 1, F.regexp_replace(doc, r"\}\z", ',"price":1.49}')).otherwise(doc)
    return c.select(F.col("id").alias("order_id"), doc.alias("value"))


@query
def purchase_flatten(spark, sf):
    rows = purchases.parse_tracks(_track_json(spark, sf))
    return rows.select(
        F.col("`Track ID`").alias("track_id"),
        F.col("Title").alias("title"),
        F.col("Artists").alias("artists"),
        F.col("Remixers").alias("remixers"),
        F.col("Genre").alias("genre"),
        F.col("Price").alias("price"),
        F.col("BPM").alias("bpm"),
        F.col("`Release ID`").alias("release_id"),
        F.col("`Release Title`").alias("release_title"),
        F.col("`Purchase Date`").alias("purchase_date"),
        F.col("Duration").alias("duration"),
    )


@query
def page_gaps(spark, sf):
    """Pages of a landed download that are still missing."""
    landed = table(spark, sf, "orders").select(
        F.floor(F.col("o_orderkey") / 100).cast("int").alias("n")
    ).distinct().filter("n % 7 <> 3")
    total = table(spark, sf, "orders").agg(F.count("*").alias("count"))
    pages = landed.select(F.concat((F.col("n") + 1).cast("string"), F.lit("/x")).alias("page"))
    pages = pages.withColumn("count", total.scalar())
    return purchases.missing_pages(pages, per_page=100)


@query
def purchases_resorted(spark, sf):
    """Old and re-fetched purchases together, newest first."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("Track ID"),
        F.when(F.col("o_orderkey") % 50 == 0, F.lit("")).otherwise(day).alias("Purchase Date"),
        F.col("o_orderkey").alias("ordinal"),
    )
    half = rows.agg(F.floor(F.max("ordinal") / 2).alias("h"))
    rows = rows.withColumn("half", half.scalar())
    old = rows.filter("ordinal <= half + 10").drop("half")
    new = rows.filter("ordinal > half").drop("half")
    both = purchases.append(old, new)
    return both.select(F.col("`Track ID`").alias("track_id"), F.col("`Purchase Date`").alias("purchase_date"))


@query
def csv_roundtrip(spark, sf):
    """Purchases written with their 17 columns and read back; blanks and breaks survive."""
    rows = purchases.parse_tracks(_track_json(spark, sf))
    rows = rows.withColumn("Title", F.concat("Title", F.lit('\r\n"x", y')))
    path = new_path(spark, "purchases-csv")
    table_sink.write_purchases(rows, path)
    back = purchases.read_csv(spark, path)
    return back.select(
        F.col("`Track ID`").alias("track_id"), F.col("Title").alias("title"), F.col("Genre").alias("genre"), F.col("BPM").alias("bpm")
    )


@query
def csv_blocks(spark, sf):
    """The same files cut into blocks of 64 KB, whose records are put together again."""
    rows = purchases.parse_tracks(_track_json(spark, sf))
    rows = rows.withColumn("Title", F.concat("Title", F.lit('\r\n"x", y')))
    path = new_path(spark, "purchases-csv")
    table_sink.write_purchases(rows, path)
    back = blocks.read_csv(spark, path, block_bytes=1 << 16)
    return back.select(
        F.col("`Track ID`").alias("track_id"), F.col("Title").alias("title"), F.col("Genre").alias("genre"), F.col("BPM").alias("bpm")
    )


@query
def matched_roundtrip(spark, sf):
    """Purchases with their path written as the matched table and read back."""
    rows = purchases.parse_tracks(_track_json(spark, sf)).withColumn("Local File Path", F.concat(F.lit("/m/"), "`Track ID`"))
    path = new_path(spark, "matched-csv")
    table_sink.write_matched(rows, path)
    back = spark.read.option("header", True).csv(path)
    return back.select(
        F.coalesce("`Track ID`", F.lit("")).alias("track_id"),
        F.col("`Local File Path`").alias("path"),
        F.lit(len(back.columns)).alias("n_columns"),
    )


@query
def catalog_build(spark, sf):
    """Catalog rows of files of which a third has no tags."""
    files = view(spark, sf, "fx_files")
    path = F.concat(F.lit("/m/"), "seq", F.lit(".mp3")).alias("path")
    tags = files.filter("seq % 3 <> 0").select(path, "artist", "title", "genre", (F.col("duration_ms") / 1000).alias("seconds"))
    rows = catalog_source.catalog_rows(files.select(path, (F.col("seq") * 10).alias("size"), "seq"), tags)
    names = ["File Path", "Artist", "Album Artist", "Title", "Genre", "Duration", "File Size"]
    return rows.select("seq", *[F.col(f"`{n}`").alias(n.lower().replace(" ", "_")) for n in names])


@query
def done_paths(spark, sf):
    """Paths that any log line names, after a log was written in two parts."""
    log = _run_log(spark, sf).select(
        (F.col("seq") % 500).cast("string").alias("path"),
        "status",
        F.lit(0).cast("bigint").alias("candidate_id"),
        F.create_map().cast("map<string,string>").alias("applied"),
        F.lit("").alias("source"),
        F.lit(None).cast("map<string,string>").alias("snapshot"),
    )
    root = new_path(spark, "done-log")
    logs.append_log(log.filter("status = 'matched'"), root)
    logs.append_log(log.filter("status <> 'matched'"), root)
    return logs.done_paths(logs.read_log(spark, root))


@query
def plan_allowed_fields(spark, sf):
    """Planned changes of the fields that a job names."""
    current, new = _merge_tables(spark, sf)
    fields = paths.parse_fields(" Genre, ,date,BPM ")
    return merge.plan_fields(current, new, "seq", fields=fields).select("seq", "field", "new")


@query
def log_roundtrip(spark, sf):
    """Results appended to a log in two parts; the matches with an id are read back."""
    log = _run_log(spark, sf).select(
        F.col("seq").cast("string").alias("path"),
        "status",
        F.when(F.col("seq") % 2 == 0, F.col("seq")).otherwise(F.lit(0)).alias("candidate_id"),
        F.create_map(F.lit("genre"), F.lit("House")).alias("applied"),
        F.lit("catalog").alias("source"),
        F.when(F.col("seq") % 4 == 1, F.create_map(F.lit("id"), F.lit("9"))).alias("snapshot"),
    )
    root = new_path(spark, "result-log")
    logs.append_log(log.filter("cast(path as bigint) % 3 = 0"), root)
    logs.append_log(log.filter("cast(path as bigint) % 3 <> 0"), root)
    rows = logs.matched_rows(logs.read_log(spark, root))
    return rows.select("path", "status", "candidate_id", F.coalesce(F.try_element_at("snapshot", F.lit("id")), F.lit("")).alias("snapshot_id"))


@query
def manifest_roundtrip(spark, sf):
    """Sparse entries written as a manifest and read back."""
    entries = enrich.sparse(_tag_table(spark, sf)).select("path", "artist", "title", "duration_ms", "missing")
    root = new_path(spark, "manifest")
    table_sink.write_manifest(entries, root)
    back = logs.read_manifest(spark, root)
    return back.select("path", "artist", "title", "duration_ms", _joined("missing").alias("missing"))


@query
def manifest_blocks(spark, sf):
    """Sparse entries written as JSON arrays on one line each, read in blocks of 64 KB."""
    entries = enrich.sparse(_tag_table(spark, sf)).select("path", "artist", "title", "duration_ms", "missing")
    entries = stage(entries, "entries")
    # Arrays of about 200 entries, however many there are.
    array = F.pmod(F.xxhash64("path"), F.lit(entries.count() // 200 + 1)).alias("array")
    texts = entries.select(array, F.to_json(F.struct(*entries.columns)).alias("entry"))
    lines = texts.groupBy("array").agg(F.concat(F.lit("[1, "), F.array_join(F.collect_list("entry"), ", "), F.lit("]")).alias("value"))
    root = new_path(spark, "manifest-array")
    lines.select("value").write.text(root)
    back = blocks.read_manifest(spark, root, block_bytes=1 << 16)
    return back.select("path", "artist", "title", "duration_ms", _joined("missing").alias("missing"))


@query
def publish_versions(spark, sf):
    """A published table after a publish that the audit refuses, and one that it lets pass."""
    current, new = _merge_tables(spark, sf)
    columns = ["seq", "artist", "title", "album", "genre", "date"]
    root = new_path(spark, "published")
    versions.publish(current.select(*columns), root, "seq")
    before = versions.read(spark, root)
    after = merge.merged(before, new, "seq").drop("updated").select(*columns)
    with suppress(versions.Refused):
        versions.publish(after.filter("seq % 2 = 0"), root, "seq", audit=versions.same_keys("seq"))
    verdict = before.select("seq", (F.col("seq") % 10 != 0).alias("ok"))
    out = merge.publishable(before, after, verdict, "seq")
    versions.publish(out, root, "seq", audit=versions.same_keys("seq"))
    return versions.read(spark, root)


@query
def merge_publish(spark, sf):
    """Rows as published: merged where the check passed, as before where it did not."""
    current, new = _merge_tables(spark, sf)
    after = merge.merged(current, new, "seq").drop("updated")
    verdict = current.select("seq", (F.col("seq") % 10 != 0).alias("ok"))
    out = merge.publishable(current, after, verdict, "seq")
    return out.select("seq", "artist", "title", "album", "genre", "date")


# --- playlists --------------------------------------------------------------------


def _dated(spark, sf) -> DataFrame:
    """Linked purchases with their purchase date as written text, offsets and all."""
    day = F.date_format("purchased_at", "yyyy-MM-dd")
    written = (
        F.when(F.col("track_id") % 10 == 0, F.lit(""))
        .when(F.col("track_id") % 10 == 1, F.concat(day, F.lit("T23:30:00-06:00")))
        .when(F.col("track_id") % 10 == 2, F.concat(day, F.lit("T00:10:00")))
        .when(F.col("track_id") % 10 == 3, F.lit("not-a-date"))
        .otherwise(day)
    )
    return linked(spark, sf).select(
        "track_id", "title", "artists", "release_title", "file_path", written.alias("bought")
    )


def _entries(spark, sf) -> DataFrame:
    return playlists.entries(_dated(spark, sf), "file_path", "bought", "track_id")


@query
def playlist_months(spark, sf):
    return playlists.rollup(_entries(spark, sf)).filter("kind = 'month'").select("period", "n")


@query
def playlist_years(spark, sf):
    return playlists.rollup(_entries(spark, sf)).filter("kind = 'year'").select("period", "n")


@query
def playlist_entries(spark, sf):
    unique = playlists.unique_entries(_entries(spark, sf), "file_path", "track_id")
    return unique.select("kind", "period", "file_path", "track_id")


@query
def m3u_lines(spark, sf):
    return playlists.m3u_lines(_entries(spark, sf), "file_path", "title", "artists", "track_id")


@query
def xml_collection(spark, sf):
    tracks = playlists.collection(_dated(spark, sf), "file_path", "title", "artists", "release_title", "track_id")
    return tracks.select(F.col("TrackID").cast("bigint").alias("track_no"), playlist_sink.track_xml().alias("xml"))


def _references(spark, sf) -> DataFrame:
    rows = stage(_dated(spark, sf), "dated")
    tracks = playlists.collection(rows, "file_path", "title", "artists", "release_title", "track_id")
    entries = playlists.entries(rows, "file_path", "bought", "track_id")
    unique = playlists.unique_entries(entries, "file_path", "track_id")
    return playlists.references(unique, tracks, "file_path", "track_id")


@query
def xml_references(spark, sf):
    return _references(spark, sf).select("kind", "period", F.col("ordinal").cast("bigint").alias("ordinal"), F.col("key").cast("bigint").alias("key"))


@query
def xml_tree(spark, sf):
    return playlist_sink.tree_lines(_references(spark, sf))


# --- streaming --------------------------------------------------------------------


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    schema = table(spark, sf, name).schema
    # A glob, because a stream's plain path must be a folder.
    return spark.readStream.schema(schema).parquet(f"{sf}/{name[:-1]}[{name[-1]}].parquet")


#: Parts a table arrives in where a stream has to last over several batches.
PARTS = 4


def _landed(spark: SparkSession, sf: str, name: str, *order: str, again: Column | None = None) -> Callable[[int], DataFrame]:
    """The table *name* as files that land one after the other, in order of *order*.

    Gives a function that lands all parts up to a number and returns the stream of
    them, one file a batch. Rows that *again* picks land a second time with the last part.
    """
    rows = table(spark, sf, name)
    root, landed = new_path(spark, f"landing-{name}"), []
    first = rows.schema[order[0]].dataType.simpleString()
    place = F.unix_micros(F.col(order[0]).cast("timestamp")) if first.startswith("timestamp") else F.col(order[0])
    cuts = rows.select(F.percentile_approx(place, [n / PARTS for n in range(1, PARTS)], 10_000).alias("c")).first()["c"] or []
    part = F.lit(0)
    for cut in cuts:
        part = part + F.when(place > cut, 1).otherwise(0)
    parted = rows.withColumn("_part", part)

    def land(upto: int) -> DataFrame:
        for n in range(len(landed), upto):
            own = parted.filter(F.col("_part") == n).drop("_part")
            if again is not None and n == PARTS - 1:
                own = own.unionByName(rows.filter(again))
            own.coalesce(1).write.mode("append").parquet(root)
            landed.append(n)
        return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(root)

    return land


def _manifest(part: DataFrame) -> DataFrame:
    return part.select(
        F.col("p_partkey").alias("seq"),
        F.concat(F.lit("Artist "), "p_brand").alias("artist"),
        F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("title"),
        F.when(F.col("p_partkey") % 9 == 0, F.lit(0)).otherwise(180000 + (F.col("p_partkey") % 60) * 1000).alias("duration_ms"),
    )


def _resolver(spark: SparkSession, sf: str) -> Callable[[DataFrame], DataFrame]:
    # Made once: every batch would join its tables anew and broadcast one of them.
    c = stage(view(spark, sf, "fx_candidates"), "candidates")

    def resolve(batch: DataFrame) -> DataFrame:
        met = batch.join(shuffled(c), (batch.title == c.name) & (batch.artist == c.artists)).select("seq", "duration_ms", *c.columns)
        return gates.pick_best(batch, met, "seq").select("seq", F.coalesce("pick.id", F.lit(-1)).alias("id"), "reason")

    return resolve


@query
def stream_enrich(spark, sf):
    """Files arrive as a stream; each is picked for once and logged."""
    root = new_path(spark, "enrich-log")
    files = _manifest(_stream(spark, sf, "part"))
    jobs.enrich_stream(files, _resolver(spark, sf), root, new_path(spark, "enrich-checkpoint"), key="seq").awaitTermination()
    return jobs.read_log(spark, root)


@query
def stream_resume(spark, sf):
    """A manifest in several files, some rows twice: stopped after two, resumed, then run anew from the start."""
    root, checkpoint = new_path(spark, "resume-log"), new_path(spark, "resume-checkpoint")
    land = _landed(spark, sf, "part", "p_partkey", again=F.col("p_partkey") % 3 == 0)
    resolve = _resolver(spark, sf)
    for upto in (2, PARTS):
        jobs.enrich_stream(_manifest(land(upto)), resolve, root, checkpoint, key="seq").awaitTermination()
    jobs.enrich_stream(_manifest(land(PARTS)), resolve, root, new_path(spark, "resume-again"), key="seq").awaitTermination()
    return jobs.read_log(spark, root)


def _log_of(events: DataFrame) -> DataFrame:
    status = (
        F.when(F.col("event_type") == "error", "error")
        .when(F.col("event_type") == "purchase", "matched")
        .when(F.col("event_type") == "view", "no-candidates")
        .when(F.col("event_type") == "click", "skipped")
        .otherwise("ambiguous")
    )
    return events.select(
        F.col("event_id").alias("seq"), "ts", F.col("user_id").alias("run_id"), status.alias("status")
    )


def _broken(spark: SparkSession, logs: Iterable[Callable[[], DataFrame]]) -> DataFrame:
    """What the breaker logs when the streams of *logs* run one after the other on one checkpoint."""
    root, state, checkpoint = (new_path(spark, f"breaker-{n}") for n in ("log", "state", "checkpoint"))
    for log in logs:
        jobs.breaker_stream(_log_of(log()), "run_id", ("ts", "seq"), root, state, checkpoint, limit=3).awaitTermination()
    return jobs.read_log(spark, root).select("run_id", "seq", "status", F.col("streak").cast("bigint").alias("streak"))


@query
def stream_breaker(spark, sf):
    """The run log as one file, so one batch."""
    return _broken(spark, [lambda: _stream(spark, sf, "events")])


@query
def stream_breaker_batches(spark, sf):
    """The run log over four batches and a restart; streaks and trips carry over."""
    land = _landed(spark, sf, "events", "ts")
    return _broken(spark, [lambda: land(2), lambda: land(PARTS)])


@query
def stream_progress(spark, sf):
    """Progress of all runs after the last of four batches, from what was observed in each."""
    root, metrics = new_path(spark, "progress-log"), new_path(spark, "progress-metrics")
    log = _log_of(_landed(spark, sf, "events", "ts")(PARTS))
    log = log.withColumn("label", F.concat(F.lit("item "), F.col("seq").cast("string")))
    jobs.progress_stream(log, root, metrics, new_path(spark, "progress-checkpoint")).awaitTermination()
    seen = spark.read.option("basePath", metrics).parquet(f"{metrics}/batch=*")
    rows = jobs.batch_progress(seen, F.lit(table(spark, sf, "events").count()), F.current_timestamp())
    return rows.orderBy(F.desc("batch")).limit(1).select("done", "matched", "last_matched", "pct")


@query
def stream_watchdog(spark, sf):
    """Items without a finish, reported by a timer although no later event arrives."""
    events = _stream(spark, sf, "events")
    starts = events.select(F.col("event_id").alias("item"), F.lit("start").alias("event"), F.col("ts").alias("at"))
    ends = events.filter("event_type <> 'error'").select(F.col("event_id").alias("item"), F.lit("finish").alias("event"), F.col("ts").alias("at"))
    root = new_path(spark, "watchdog")
    with jobs.on_rocksdb(spark):
        overdue = jobs.watchdog_stream(starts.unionByName(ends), "item").writeStream.format("parquet").option("path", root)
        job = overdue.option("checkpointLocation", new_path(spark, "watchdog-checkpoint")).start()
    jobs.stop_when_quiet(job)
    return spark.read.schema("item bigint, status string").parquet(root)


@query
def stream_stuck(spark, sf):
    events = _stream(spark, sf, "events")
    overdue = jobs.stuck_stream(_starts(events), _finishes(events), "item")
    root = new_path(spark, "stuck")
    (
        overdue.writeStream.format("parquet")
        .option("path", root)
        .option("checkpointLocation", new_path(spark, "stuck-checkpoint"))
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.parquet(root).select("item", "status")


@query
def stream_counts(spark, sf):
    """Status counts over four batches, kept in files."""
    root = new_path(spark, "counts")
    log = _log_of(_landed(spark, sf, "events", "ts")(PARTS))
    jobs.counts_sink(log, root, new_path(spark, "counts-checkpoint")).awaitTermination()
    return jobs.last_counts(spark, root)
