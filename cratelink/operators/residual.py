"""The residual levels: album fits, artists overlap, and titles are akin.

No level here has an equality to join on. Album to album and name to name are relations
between *distinct* texts, found by :mod:`cratelink.operators.containment` at a cost linear in
the distinct texts. Catalog rows form blocks by album and by each of their names, and the
two relations together say which blocks an (album, name) pair of a query fits. Every row
of such a block satisfies both conditions and no other row does, so only titles are left:

* a condition that asks the same expression of both titles is a lookup: the first row of
  each block and value, N:1;
* known conditions (prefix, near, inside) compare all titles of the fitting blocks where a
  pair meets few (``FAN_LIMIT``). Where it meets more, titles go by form: turning digits
  into zeros keeps one text inside another and turns an edit into at most one, so only
  titles of related forms are compared. Where a block holds more than ``FORM_LIMIT``
  titles of the forms related to one, its titles meet by windows and parts of their own;
* any other condition is tested on all rows of the fitting blocks.

The choice never changes the result. A blank album fits every album: it is a block of its
own. Untitled rows fit every prefix: of a block only the first one can win.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cratelink.functions.text import artist_names
from cratelink.operators.containment import FORM, FORM_LIMIT, contained_pairs, edit_pairs, near_in_groups
from cratelink.operators.strategies import TITLE_INSIDE, TITLE_NEAR, TITLE_PREFIX
from cratelink.session import shuffled, stage

#: Titles an (album, name) pair may meet in its blocks before they go by form.
FAN_LIMIT = 100

#: Whether a title condition holds for every untitled row. Other conditions are tested.
_UNTITLED = {TITLE_PREFIX: True, TITLE_NEAR: False, TITLE_INSIDE: False}


def _same(rule: str) -> str | None:
    """The function of ``clean`` that a condition asks to be equal in both titles, or None."""
    left, _, right = rule.partition(" = ")
    call = re.fullmatch(r"\w+\(([\w\s.,()+*-]*)\)", left)
    if not call or right != left.replace("q.clean", "r.clean") or set(re.findall(r"\w+\.\w+", left)) != {"q.clean"}:
        return None
    depth = 0
    for sign in call[1]:
        depth += (sign == "(") - (sign == ")")
        if depth < 0:  # the first call ends before the text does
            return None
    return left.replace("q.clean", "clean")


def _reduced_catalog(catalog: DataFrame, strict: bool) -> DataFrame:
    rows = catalog.filter(F.size("names") > 0)
    if strict:
        rows = rows.filter("clean <> ''")
    return (
        rows.groupBy("artist", "album", "clean")
        .agg(F.min(F.expr("shiftleft(seq, 1) + if(path = '', 1, 0)")).alias("best"))
        .withColumn("names", artist_names(F.col("artist")))
    )


def _pairs(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    def texts(df: DataFrame) -> DataFrame:
        return df.select(F.lit("").alias("grp"), F.col(column).alias("v")).filter("v <> ''").distinct()

    return contained_pairs(texts(left), texts(right)).select("l", "r")


def _fits(wanted: DataFrame, blocks: DataFrame, albums: DataFrame, names: DataFrame) -> DataFrame:
    """(pair, block, n): the blocks whose album and name fit a pair's.

    The relation that a pair has fewer of is followed first, and only blocks that rows
    really have go on.
    """
    albums = albums.selectExpr("l as album", "r as r_album")
    albums = stage(albums.unionByName(wanted.selectExpr("album", "'' as r_album").distinct()), "fitting")
    held = blocks.selectExpr("album as r_album", "name as r", "block", "n")
    named = stage(names.join(shuffled(held), "r").selectExpr("l as name", "r_album", "block", "n"), "named")
    counted = (
        wanted.join(shuffled(named.groupBy("name").agg(F.count("*").alias("by_name"))), "name")
        .join(shuffled(albums.groupBy("album").agg(F.count("*").alias("by_album"))), "album")
    )
    counted = stage(counted, "counted")
    album_first = counted.filter("by_album <= by_name").join(shuffled(albums), "album").join(shuffled(named), ["name", "r_album"])
    name_first = counted.filter("by_album > by_name").join(shuffled(named), "name").join(shuffled(albums), ["album", "r_album"])
    return album_first.select("pair", "block", "n").unionByName(name_first.select("pair", "block", "n"))


def _tested(met: DataFrame, rules: Iterable[tuple[int, str]], *keep: str) -> DataFrame:
    """The best row per *keep* and level among met rows (structs q and r, and ``best``)."""
    marks = ", ".join(f"if({rule}, {level}, null)" for level, rule in rules)
    return (
        met.selectExpr(*keep, f"explode(filter(array({marks}), m -> m is not null)) as level", "best")
        .groupBy(*keep, "level")
        .agg(F.min("best").alias("best"))
    )


_TITLES = ("struct(l as clean) as q", "struct(r as clean) as r")


def _by_form(
    titles: DataFrame, fits: DataFrame, posted: DataFrame, rules: list[tuple[int, str]], form_limit: int
) -> DataFrame:
    """Hits of known conditions among titles of related forms: (pair, clean, level, best)."""
    form = FORM.format("clean")
    fits = fits.select("pair", "block")
    asked = titles.join(shuffled(fits.select("pair").distinct()), "pair", "left_semi")
    asked = stage(asked.selectExpr("pair", "clean as l", f"{form} as l_form"), "asked_forms")
    held = posted.join(shuffled(fits.select("block").distinct()), "block", "left_semi")
    held = stage(held.selectExpr("block", "clean as r", f"{form} as r_form", "best"), "held_forms")

    conditions = {rule for _, rule in rules}
    inside, near = bool(conditions & {TITLE_PREFIX, TITLE_INSIDE}), TITLE_NEAR in conditions
    l_forms, r_forms = asked.selectExpr("l_form as v").distinct(), held.selectExpr("r_form as v").distinct()
    kinds = [_pairs(l_forms, r_forms, "v")] if inside else []
    kinds += [edit_pairs(l_forms, r_forms)] if near else []
    related = stage(reduce(DataFrame.unionByName, kinds).distinct().selectExpr("l as l_form", "r as r_form"), "related")

    offered = held.groupBy("block", "r_form").agg(F.count("*").alias("n")).join(shuffled(related), "r_form")
    wanted = asked.select("pair", "l_form").distinct().join(shuffled(fits), "pair")
    meets = stage(wanted.join(shuffled(offered), ["block", "l_form"]), "meets")
    crowded = meets.groupBy("pair", "block", "l_form").agg(F.sum("n").alias("n")).filter(F.col("n") > form_limit)
    crowded = stage(crowded.select("pair", "block", "l_form"), "crowded_forms")
    has_crowds = not crowded.isEmpty()

    calm = meets.join(shuffled(crowded), ["pair", "block", "l_form"], "left_anti") if has_crowds else meets
    met = (
        asked.join(shuffled(calm.select("pair", "block", "l_form", "r_form")), ["pair", "l_form"])
        .join(shuffled(held), ["block", "r_form"])
        .select("pair", "l", "r", "best")
    )
    if has_crowds:
        own = stage(asked.join(shuffled(crowded), ["pair", "l_form"]).select("pair", "block", "l"), "crowded_titles")
        left = own.selectExpr("block as grp", "l as v").distinct()
        right = held.join(shuffled(crowded.select("block").distinct()), "block", "left_semi")
        right = right.selectExpr("block as grp", "r as v")
        kinds = [contained_pairs(left, right)] if inside else []
        kinds += [near_in_groups(left, right)] if near else []
        pairs = reduce(DataFrame.unionByName, kinds).distinct().withColumnRenamed("grp", "block")
        crowds = own.join(shuffled(pairs), ["block", "l"]).join(shuffled(held.drop("r_form")), ["block", "r"])
        met = met.unionByName(crowds.select("pair", "l", "r", "best"))
    met = met.selectExpr("pair", "l as clean", *_TITLES, "best")
    return _tested(met, rules, "pair", "clean")


def residual_hits(
    queries: DataFrame,
    catalog: DataFrame,
    rules: Iterable[tuple[int, str]],
    fan_limit: int = FAN_LIMIT,
    strict: bool = False,
    form_limit: int = FORM_LIMIT,
) -> DataFrame:
    """Hits of the residual levels as (qid, level, hit); *rules*: level and title condition.

    A condition that is neither known nor a lookup closes no way to the others: it alone is
    tested on all rows of the fitting blocks.
    """
    rules = tuple(rules)
    known = [(level, rule) for level, rule in rules if rule in _UNTITLED]
    same = [(level, _same(rule)) for level, rule in rules if rule not in _UNTITLED and _same(rule)]
    other = [(level, rule) for level, rule in rules if rule not in _UNTITLED and not _same(rule)]

    open_q = stage(queries.filter("album <> '' and clean <> ''").filter(F.size("names") > 0), "open")
    every = stage(_reduced_catalog(catalog, strict), "reduced")
    albums = stage(_pairs(open_q, every, "album"), "albums")
    names = stage(_pairs(_named(open_q), _named(every), "name"), "names")

    # Ids are written once, so every reader sees the same ones.
    asked = open_q.select("qid", "album", "clean", F.explode("names").alias("name"))
    wanted = asked.select("album", "name").distinct().withColumn("pair", F.monotonically_increasing_id())
    wanted = stage(wanted, "wanted")
    rows = every.select("album", F.explode("names").alias("name"), "clean", "best")
    posted = rows.groupBy("album", "name", "clean").agg(F.min("best").alias("best"))
    # Only names that fit some query's are of use.
    posted = stage(posted.join(shuffled(names.selectExpr("r as name").distinct()), "name", "left_semi"), "rows")
    blocks = posted.groupBy("album", "name").agg(F.count("*").alias("n")).withColumn("block", F.monotonically_increasing_id())
    blocks = stage(blocks, "blocks")
    fits = stage(_fits(wanted, blocks, albums, names), "fits")
    posted = stage(posted.join(shuffled(blocks), ["album", "name"]).select("block", "clean", "best"), "posted")
    asked = asked.join(shuffled(wanted), ["album", "name"]).select("qid", "pair", "clean")
    asked = stage(asked.join(shuffled(fits.select("pair").distinct()), "pair", "left_semi"), "asked")

    parts = []
    if known or same:
        titles = stage(asked.select("pair", "clean").distinct(), "titles")
    if known:
        titled = posted.filter("clean <> ''")
        fan = fits.groupBy("pair").agg(F.sum("n").alias("fan"))
        few = fits.join(shuffled(fan.filter(F.col("fan") <= fan_limit)), "pair")
        met = (
            titles.withColumnRenamed("clean", "l")
            .join(shuffled(few.select("pair", "block")), "pair")
            .join(shuffled(titled.withColumnRenamed("clean", "r")), "block")
            .selectExpr("pair", "l as clean", *_TITLES, "best")
        )
        parts.append(_tested(met, known, "pair", "clean"))
        many = stage(fits.join(shuffled(fan.filter(F.col("fan") > fan_limit)), "pair").select("pair", "block"), "many")
        if not many.isEmpty():
            parts.append(_by_form(titles, many, titled, known, form_limit))
    for level, value in same:
        first = posted.selectExpr("block", f"{value} as value", "best").groupBy("block", "value").agg(F.min("best").alias("best"))
        first = fits.select("pair", "block").join(shuffled(first), "block").groupBy("pair", "value").agg(F.min("best").alias("best"))
        found = titles.withColumn("value", F.expr(value)).join(shuffled(first), ["pair", "value"])
        parts.append(found.select("pair", "clean", F.lit(level).alias("level"), "best"))
    hits = []
    if parts:
        found = reduce(DataFrame.unionByName, parts)
        hits.append(asked.join(shuffled(found), ["pair", "clean"]).select("qid", "level", "best"))
    for level in [level for level, rule in known if _UNTITLED[rule]]:
        first = posted.filter("clean = ''").select("block", "best")
        first = fits.select("pair", "block").join(shuffled(first), "block").groupBy("pair").agg(F.min("best").alias("best"))
        hits.append(asked.join(shuffled(first), "pair").select("qid", F.lit(level).alias("level"), "best"))
    if other:
        hits.append(_by_row(open_q, every, asked, fits, blocks, other))
    best = reduce(DataFrame.unionByName, hits).groupBy("qid", "level").agg(F.min("best").alias("hit"))
    return best.select("qid", "level", "hit")


def _by_row(
    open_q: DataFrame, every: DataFrame, asked: DataFrame, fits: DataFrame, blocks: DataFrame, rules: list[tuple[int, str]]
) -> DataFrame:
    """Hits of conditions that are not known, tested on every row of the fitting blocks: (qid, level, best)."""
    texts = ("album", "artist", "clean", "names")
    rows = every.withColumn("name", F.explode("names")).join(shuffled(blocks), ["album", "name"])
    rows = rows.select("block", F.struct(*texts).alias("r"), "best")
    # Queries that differ in their ISRC only are asked once.
    key = F.struct("album", "artist", "clean")
    once = open_q.withColumn("key", key).groupBy("key").agg(F.min("qid").alias("one"))
    ones = stage(open_q.withColumn("key", key).join(shuffled(once), "key").select("qid", "one"), "ones")
    who = open_q.join(shuffled(ones.filter("qid = one")), "qid").select("qid", F.struct(*texts).alias("q"))
    met = (
        asked.select("qid", "pair")
        .join(shuffled(who), "qid")
        .join(shuffled(fits.select("pair", "block")), "pair")
        .join(shuffled(rows), "block")
    )
    found = _tested(met, rules, "qid").withColumnRenamed("qid", "one")
    return ones.join(shuffled(found), "one").select("qid", "level", "best")


def _named(df: DataFrame) -> DataFrame:
    return df.select(F.explode("names").alias("name"))
