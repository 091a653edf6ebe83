"""First-hit-wins linkage: at most one catalog row per purchase.

Lookups of every level share one join: the catalog is reduced to its first row per
(level, key) with map-side combine, so the join is N:1 and a popular key costs one
row. Grouped levels compare texts inside an equality group; a group with more than
``GROUP_LIMIT`` distinct values is matched through windows instead of pairs. Only
what is still open reaches the residual levels.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cratelink.operators import residual
from cratelink.operators.containment import contained_pairs
from cratelink.operators.keys import (
    CATALOG_FIELDS,
    QUERY_FIELDS,
    catalog_keys,
    join_links,
    keys_of,
    raw_keys,
)
from cratelink.operators.strategies import ALBUM_FITS, OVERLAP, SEP, STRATEGIES, Strategy
from cratelink.session import shuffled, stage

#: Distinct values per equality group up to which pairs are compared directly.
GROUP_LIMIT = 64

# A hit is one long: preference, then insertion order, then whether the path is blank.
# Longs keep every reduction a hash aggregate and keep paths out of the shuffles; the
# path is fetched once, at the end, by ``seq``.
_SUB_SHIFT = 61


def rank_code(seq: str = "seq", path: str = "path") -> Column:
    """A catalog row's place as a long. ``seq`` is unique and below 2**60."""
    return F.expr(f"shiftleft({seq}, 1) + if({path} = '', 1, 0)")


def _tagged(level: int, keys: Column) -> Column:
    return F.transform(
        F.coalesce(keys, F.array().cast("array<string>")),
        lambda k: F.struct(F.lit(level).alias("level"), k.alias("k")),
    )


def _ranked(s: Strategy) -> Column:
    keys = F.coalesce(s.query(), F.array().cast("array<string>"))
    return F.transform(
        keys,
        lambda k, i: F.struct(
            F.lit(s.level).alias("level"),
            k.alias("k"),
            (i if s.ranked else F.lit(0)).cast("int").alias("sub"),
        ),
    )


def _select(kind: str, strategies: Iterable[Strategy]) -> list[Strategy]:
    return [s for s in strategies if s.kind == kind]


def first_rows(catalog: DataFrame, *keys: str) -> DataFrame:
    """The first catalog row per key as its rank code ``best``: insertion order wins."""
    return catalog.groupBy(*keys).agg(F.min("code").alias("best"))


def lookup_hits(queries: DataFrame, catalog: DataFrame, strategies: Iterable[Strategy]) -> DataFrame:
    """Hits of all lookup levels as (qid, level, hit)."""
    chosen = _select("lookup", strategies)
    offered = catalog.select(
        rank_code().alias("code"),
        F.explode(F.concat(*[_tagged(s.level, s.catalog()) for s in chosen])).alias("o"),
    ).select("code", F.col("o.level").alias("level"), F.col("o.k").alias("k"))
    asked = queries.select(
        "qid", F.explode(F.concat(*[_ranked(s) for s in chosen])).alias("o")
    ).select("qid", F.col("o.level").alias("level"), F.col("o.k").alias("k"), F.col("o.sub").alias("sub"))
    return asked.join(shuffled(first_rows(offered, "level", "k")), ["level", "k"]).select(
        "qid", "level", F.expr(f"shiftleft(cast(sub as bigint), {_SUB_SHIFT}) + best").alias("hit")
    )


def grouped_hits(
    queries: DataFrame,
    catalog: DataFrame,
    strategies: Iterable[Strategy],
    group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Hits of the grouped levels as (qid, level, hit)."""
    chosen = _select("grouped", strategies)

    def groups(s: Strategy, side: str) -> Column:
        return F.transform(
            F.coalesce(getattr(s, side)(), F.array().cast("array<string>")),
            lambda k: F.struct(
                F.concat(F.lit(f"{s.level}{SEP}"), k).alias("grp"), s.values().alias("vs")
            ),
        )

    def spread(df: DataFrame, side: str, *keep: str) -> DataFrame:
        items = F.concat(*[groups(s, side) for s in chosen])
        return (
            df.select(*keep, F.explode(items).alias("o"))
            .select(*keep, F.col("o.grp").alias("grp"), F.explode("o.vs").alias("v"))
        )

    asked = spread(queries, "query", "qid")
    wanted = asked.select("grp").distinct()
    offered = first_rows(
        spread(catalog.withColumn("code", rank_code()), "catalog", "code").join(shuffled(wanted), "grp", "left_semi"), "grp", "v"
    )
    offered = stage(offered, "grouped")
    crowded = offered.groupBy("grp").count().filter(F.col("count") > group_limit).select("grp")
    has_crowds = not crowded.isEmpty()

    q = asked.alias("q")
    # A blank catalog value is inside every text; contains() says so as well.
    fits = F.contains("q.v", "r.v") | F.contains("r.v", "q.v")
    calm = offered.join(crowded, "grp", "left_anti") if has_crowds else offered
    hits = (
        q.join(shuffled(calm.alias("r")), F.col("q.grp") == F.col("r.grp"))
        .filter(fits)
        .select("q.qid", "q.grp", "r.best")
    )
    if has_crowds:
        busy = stage(offered.join(crowded, "grp", "left_semi"), "crowded")
        busy_q = asked.join(crowded, "grp", "left_semi")
        pairs = contained_pairs(
            busy_q.select("grp", "v").filter("v <> ''").distinct(),
            busy.select("grp", "v").filter("v <> ''"),
        )
        # One best row per asked value before it meets the queries that ask it.
        best = (
            pairs.join(shuffled(busy.withColumnRenamed("v", "r")), ["grp", "r"])
            .groupBy("grp", "l")
            .agg(F.min("best").alias("best"))
            .withColumnRenamed("l", "v")
        )
        blank = busy.filter("v = ''").select("grp", "best")
        hits = hits.unionByName(busy_q.join(shuffled(best), ["grp", "v"]).select("qid", "grp", "best"))
        hits = hits.unionByName(busy_q.join(blank, "grp").select("qid", "grp", "best"))
    level = F.substring_index("grp", SEP, 1).cast("int")
    return hits.select("qid", level.alias("level"), F.col("best").alias("hit"))


def resolve(hits: DataFrame, levels: Iterable[int]) -> DataFrame:
    """First level whose first row has a path, as (qid, level, seq).

    All levels are reduced in one aggregation, so a query with many hits is combined
    before the shuffle. A level whose first row has a blank path is a miss.
    """
    levels = sorted(set(levels))
    best = hits.groupBy("qid").agg(
        *[F.expr(f"min(hit) filter (where level = {n}) as h{n}") for n in levels]
    )
    sound = ", ".join(f"if(h{n} & 1 = 0, {n}, null)" for n in levels)
    codes = " ".join(f"when {n} then h{n}" for n in levels)
    mask = (1 << _SUB_SHIFT) - 1
    return (
        best.withColumn("level", F.expr(f"coalesce({sound}, null)"))
        .filter("level is not null")
        .selectExpr("qid", "level", f"shiftright((case level {codes} end) & {mask}, 1) as seq")
    )


def equality_hits(
    queries: DataFrame,
    catalog: DataFrame,
    strategies: Iterable[Strategy] = STRATEGIES,
    group_limit: int = GROUP_LIMIT,
    fan_limit: int = residual.FAN_LIMIT,
) -> DataFrame:
    """Hits of every level that has an equality."""
    strategies = tuple(strategies)
    parts = []
    if _select("lookup", strategies):
        parts.append(lookup_hits(queries, catalog, strategies))
    if _select("grouped", strategies):
        parts.append(grouped_hits(queries, catalog, strategies, group_limit))
    for s in _select("titled", strategies):
        passed = any(t.any_title and t.level < s.level for t in strategies)
        rows = _undecided(catalog) if passed else catalog
        if rows is not None:
            parts.append(album_title_hits(queries, rows, fan_limit, s.level))
    return reduce(DataFrame.unionByName, parts)


def _undecided(catalog: DataFrame) -> DataFrame | None:
    """Rows of titles whose first row has no path: there a rule that takes any row of a
    title misses, and a later rule with the same title may decide. None if there are none."""
    first = first_rows(catalog.filter("clean <> ''").withColumn("code", rank_code()), "clean")
    pathless = stage(first.filter("best & 1 = 1").select("clean"), "pathless")
    return None if pathless.isEmpty() else catalog.join(shuffled(pathless), "clean", "left_semi")


def album_title_hits(
    queries: DataFrame, catalog: DataFrame, fan_limit: int = residual.FAN_LIMIT, level: int = 90
) -> DataFrame:
    """Hits of a titled level (equal title, fitting album, artists overlap).

    A title held by more than *fan_limit* distinct catalog rows is narrowed by album first.
    """
    q = queries.filter("album <> '' and clean <> '' and artist <> ''").select("qid", "album", "clean", "names")
    rows = stage(
        first_rows(catalog.filter("clean <> ''").withColumn("code", rank_code()), "artist", "album", "clean", "names"),
        "titled",
    )
    crowded = rows.groupBy("clean").count().filter(F.col("count") > fan_limit).select("clean")
    test = f"({ALBUM_FITS} and {OVERLAP})"
    columns = ["q.qid", "r.best"]
    if crowded.isEmpty():
        met = q.alias("q").join(rows.alias("r"), F.col("q.clean") == F.col("r.clean")).filter(test).select(*columns)
    else:
        calm = q.join(crowded, "clean", "left_anti").alias("q")
        met = calm.join(rows.alias("r"), F.col("q.clean") == F.col("r.clean")).filter(test).select(*columns)
        busy = q.join(crowded, "clean", "left_semi")
        busy_rows = rows.join(crowded, "clean", "left_semi")

        def albums(df: DataFrame) -> DataFrame:
            return df.select(F.col("clean").alias("grp"), F.col("album").alias("v")).filter("v <> ''").distinct()

        pairs = contained_pairs(albums(busy), albums(busy_rows))
        pairs = pairs.unionByName(albums(busy).selectExpr("grp", "v as l", "'' as r"))
        asked = busy.join(
            pairs.selectExpr("grp as clean", "l as album", "r as r_album"), ["clean", "album"]
        ).alias("q")
        met = met.unionByName(
            asked.join(
                busy_rows.alias("r"),
                (F.col("q.clean") == F.col("r.clean")) & (F.col("q.r_album") == F.col("r.album")),
            )
            .filter(test)
            .select(*columns)
        )
    return met.groupBy("qid").agg(F.min("best").alias("best")).select(
        "qid", F.lit(level).alias("level"), F.col("best").alias("hit")
    )


def link_keys(
    queries: DataFrame,
    catalog: DataFrame,
    strategies: Iterable[Strategy] = STRATEGIES,
    group_limit: int = GROUP_LIMIT,
    fan_limit: int = residual.FAN_LIMIT,
    strict: bool = False,
) -> DataFrame:
    """Resolve distinct query keys against catalog keys: (qid, level, seq).

    *strict* keeps untitled catalog rows out of the residual levels.
    """
    strategies = tuple(strategies)
    equal = [s for s in strategies if s.kind != "residual"]
    rules = [(s.level, s.title) for s in _select("residual", strategies)]
    if not rules:
        return resolve(equality_hits(queries, catalog, equal, group_limit, fan_limit), [s.level for s in equal])
    first = min(level for level, _ in rules)
    early = [s for s in equal if s.level < first]
    late = [s for s in equal if s.level > first]
    found = None
    if early:
        found = stage(resolve(equality_hits(queries, catalog, early, group_limit, fan_limit), [s.level for s in early]), "found")
        queries = queries.join(shuffled(found.select("qid")), "qid", "left_anti")
    rest = residual.residual_hits(queries, catalog, rules, fan_limit=fan_limit, strict=strict)
    if late:
        rest = rest.unionByName(equality_hits(queries, catalog, late, group_limit, fan_limit))
    rest = resolve(rest, [level for level, _ in rules] + [s.level for s in late])
    return rest if found is None else found.unionByName(rest)


def with_path(found: DataFrame, catalog: DataFrame) -> DataFrame:
    """Links with the path of their catalog row."""
    return found.join(shuffled(catalog.select("seq", "path")), "seq")


def link(
    purchases: DataFrame,
    catalog: DataFrame,
    query_fields: dict[str, str] = QUERY_FIELDS,
    catalog_fields: dict[str, str] = CATALOG_FIELDS,
    path_column: str = "Local File Path",
    level_column: str | None = None,
    **options,
) -> DataFrame:
    """Purchases plus the path of the catalog row each one links to (``''`` if none)."""
    raw = stage(raw_keys(purchases, query_fields), "raw")
    queries = stage(keys_of(raw), "queries")
    rows = stage(catalog_keys(catalog, catalog_fields), "catalog")
    links = with_path(link_keys(queries, rows, **options), rows).select(
        "qid", F.col("path").alias("_path"), F.col("level").alias("_level")
    )
    joined = join_links(purchases, raw, links, query_fields)
    out = joined.withColumn(path_column, F.coalesce("_path", F.lit("")))
    if level_column:
        out = out.withColumn(level_column, F.coalesce("_level", F.lit(0)))
    return out.drop("_path", "_level")


def strategy_hits(queries: DataFrame, catalog: DataFrame, name: str, **options) -> DataFrame:
    """What one strategy alone finds: (qid, level, seq)."""
    chosen = [s for s in STRATEGIES if s.name == name]
    levels = [s.level for s in chosen]
    if chosen[0].kind == "residual":
        hits = residual.residual_hits(queries, catalog, [(s.level, s.title) for s in chosen], **options)
    elif chosen[0].kind == "titled":
        hits = album_title_hits(queries, catalog, **options)
    else:
        hits = equality_hits(queries, catalog, chosen, **options)
    return resolve(hits, levels)


def match_counts(linked: DataFrame, path_column: str = "Local File Path") -> DataFrame:
    """Matched and unmatched rows; their sum is the input."""
    path = F.col(f"`{path_column}`")
    return linked.agg(
        F.count_if(path != "").alias("matched"), F.count_if(path == "").alias("unmatched")
    )
