"""Candidate search: query variants per file, and the containment join that answers them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cratelink.functions.search import (
    clean_search_artist,
    clean_search_title,
    drop_featuring,
    split_artists,
    split_mix,
    title_agrees,
)
from cratelink.operators.containment import inside_pairs
from cratelink.operators.gates import age_order, length_fits
from cratelink.session import shuffled, stage

#: Candidates a search returns.
PAGE = 10
_ASK = ("s_artist", "s_title", "s_mix")


def _variant(artist: Column, title: Column, mix: Column, gated: bool) -> Column:
    return F.struct(
        artist.alias("s_artist"),
        title.alias("s_title"),
        mix.alias("s_mix"),
        F.lit(gated).alias("gated"),
    )


def query_variants(files: DataFrame, key: str, artist: str = "artist", title: str = "title") -> DataFrame:
    """(key, ordinal, s_artist, s_title, s_mix, gated): each distinct query once, in order.

    *key* tells the rows of *files* apart, so copies of a query are found within its row. Exact, full title and swapped roles come first. Per-artist, featuring-free and
    title-artist variants follow and are gated, because they are loose.
    """
    f = files.select(
        key,
        F.col(title).alias("_title"),
        clean_search_title(F.col(title), F.col(artist)).alias("_asked"),
        clean_search_artist(F.col(artist)).alias("_artist"),
    )
    f = f.withColumns(
        {
            "_own": split_mix(F.col("_asked")),
            "_full": clean_search_title(F.col("_title"), F.col("_artist")),
            "_names": split_artists(F.col("_artist")),
            "_in_title": split_artists(F.col("_title")),
        }
    )
    f = f.withColumns(
        {
            "_swap": split_mix(F.col("_full")),
            "_bare": drop_featuring(F.col("_full")),
            "_names": F.when(F.size("_names") > 0, F.col("_names")).otherwise(F.array("_artist")),
        }
    )
    f = f.withColumn("_bare_split", split_mix(F.col("_bare")))
    none = F.array().cast("array<struct<s_artist:string,s_title:string,s_mix:string,gated:boolean>>")
    blank = F.lit("")
    base, mix = F.col("_own.base"), F.col("_own.mix")
    variants = F.concat(
        F.array(
            _variant(F.col("_artist"), base, mix, False),
            _variant(F.col("_artist"), F.col("_full"), blank, False),
            _variant(F.col("_swap.base"), F.col("_artist"), F.col("_swap.mix"), False),
        ),
        F.transform("_names", lambda n: _variant(n, base, mix, True)),
        F.when(
            (F.col("_bare") != "") & (F.col("_bare") != F.col("_full")),
            F.transform(
                "_names", lambda n: _variant(n, F.col("_bare_split.base"), F.col("_bare_split.mix"), True)
            ),
        ).otherwise(none),
        F.when(
            F.size("_in_title") > 1,
            F.transform("_in_title", lambda n: _variant(n, base, blank, True)),
        ).otherwise(none),
    )
    rows = f.select(key, variants.alias("_variants"))
    asks = F.transform("_variants", lambda v: F.struct(*[v[a] for a in _ASK]))
    rows = rows.withColumn("_asks", asks)
    first = F.transform("_asks", lambda a, i: F.array_position("_asks", a) == i + 1)
    kept = rows.select(key, F.posexplode(F.arrays_zip("_variants", first.alias("_first"))).alias("ordinal", "z")).filter("z._first")
    return kept.select(key, "ordinal", *[F.col(f"z._variants.{a}").alias(a) for a in (*_ASK, "gated")])


def search_table(candidates: DataFrame, page: int = PAGE) -> DataFrame:
    """Candidates ready to be searched: lower-cased, and of each copy only what can count.

    A query that meets one copy of a (name, artists, mix) meets all of them, so only the
    oldest page of each can reach any answer.
    """
    c = candidates.withColumns(
        {"_name": F.lower("name"), "_artists": F.lower("artists"), "_mix": F.lower("mix_name")}
    )
    copies = Window.partitionBy("_name", "_artists", "_mix").orderBy(age_order(F.col("publish_date"), F.col("id")))
    c = c.withColumn("_copy", F.row_number().over(copies)).filter(F.col("_copy") <= page)
    return stage(c.drop("_copy", "_name", "_artists", "_mix"), "candidates")


def search(asks: DataFrame, candidates: DataFrame, page: int = PAGE) -> DataFrame:
    """:func:`search_in` over a candidate table used once."""
    return search_in(asks, search_table(candidates, page), page)


def search_in(asks: DataFrame, c: DataFrame, page: int = PAGE) -> DataFrame:
    """Up to *page* candidates per distinct (s_artist, s_title, s_mix), oldest first.

    Case-insensitive containment in artist, name and (when asked) mix. Title and
    artist are matched as distinct texts; each query is then expanded through
    whichever of the two it meets fewer candidates by. The page is cut by a ranked
    window, whose per-task group limit keeps a query with many hits off one task.
    A query without artist and title asks nothing and returns nothing.
    """
    # Lower-cased texts are made where they are used: no table or shuffle holds a text twice.
    q = asks.select(*_ASK).distinct()
    q = stage(q.filter("s_artist <> '' or s_title <> ''"), "asks")
    age = age_order(F.col("publish_date"), F.col("id"))
    fields = c.columns

    def texts(df: DataFrame, col: str) -> DataFrame:
        return df.select(F.lit("").alias("grp"), F.lower(F.col(col)).alias("v")).filter("v <> ''").distinct()

    def pairs(ask: str, field: str, out: str) -> DataFrame:
        found = inside_pairs(texts(q, ask), texts(c, field)).selectExpr(
            f"needle as _{ask}", f"hay as _{field}"
        )
        rows = c.groupBy(F.lower(F.col(field)).alias(f"_{field}")).agg(F.count("*").alias("n"))
        return stage(found.join(shuffled(rows), f"_{field}"), out)

    titles = pairs("s_title", "name", "titles")
    artists = pairs("s_artist", "artists", "artists")
    by_title = titles.groupBy("_s_title").agg(F.sum("n").alias("t_fan"))
    by_artist = artists.groupBy("_s_artist").agg(F.sum("n").alias("a_fan"))
    asks_title, asks_artist = (F.lower(F.col(a)) == F.col(f"_{a}") for a in ("s_title", "s_artist"))
    routed = stage(
        q.join(shuffled(by_title), asks_title, "left")
        .join(shuffled(by_artist), asks_artist, "left")
        .filter("(s_title = '' or t_fan is not null) and (s_artist = '' or a_fan is not null)")
        .withColumn("way", F.expr("if(t_fan is not null and t_fan <= coalesce(a_fan, t_fan), 'title', 'artist')"))
        .select(*_ASK, "way"),
        "routed",
    )
    through_title = routed.filter("way = 'title'").join(shuffled(titles.drop("n")), asks_title)
    through_title = through_title.join(shuffled(c), F.lower("name") == F.col("_name"))
    through_artist = routed.filter("way = 'artist'").join(shuffled(artists.drop("n")), asks_artist)
    through_artist = through_artist.join(shuffled(c), F.lower("artists") == F.col("_artists"))
    columns = [*_ASK, *fields]
    met = (
        through_title.select(*columns)
        .unionByName(through_artist.select(*columns))
        .filter(
            "contains(lower(name), lower(s_title)) and contains(lower(artists), lower(s_artist)) "
            "and contains(lower(mix_name), lower(s_mix))"
        )
    )
    order = Window.partitionBy(*_ASK).orderBy(age)
    return (
        met.withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= page)
        .select(*_ASK, "place", *fields)
    )


def _usable(variants: DataFrame, prepared: DataFrame, files: DataFrame, key: str, page: int) -> DataFrame:
    """Survivors of each file's first variant that has any."""
    found = search_in(variants, prepared, page)
    rows = variants.join(shuffled(found), list(_ASK)).join(shuffled(files.select(key, "duration_ms")), key)
    agrees = title_agrees(F.col("s_title"), F.col("name"), F.col("mix_name"))
    rows = rows.filter(
        length_fits(F.col("length_ms"), F.col("duration_ms"))
        & (~F.col("gated") | (F.col("s_title") == "") | agrees)
    )
    first = Window.partitionBy(key).orderBy("ordinal")
    # At most a page of rows per variant and a few variants per file reach this window.
    return rows.withColumn("_r", F.rank().over(first)).filter("_r = 1").drop("_r", "place")


def first_usable(
    files: DataFrame,
    candidates: DataFrame,
    key: str,
    artist: str = "artist",
    title: str = "title",
    page: int = PAGE,
) -> DataFrame:
    """Candidates of the first usable query variant per file.

    Loose variants are searched only for files the exact ones left open.
    """
    variants = stage(query_variants(files, key, artist, title), "variants")
    prepared = search_table(candidates, page)
    exact = stage(_usable(variants.filter("not gated"), prepared, files, key, page), "exact")
    open_variants = variants.filter("gated").join(shuffled(exact.select(key).distinct()), key, "left_anti")
    return exact.unionByName(_usable(open_variants, prepared, files, key, page))
