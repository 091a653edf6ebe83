"""Containment joins without comparing all pairs.

``needle`` is inside ``hay`` exactly when some window of ``hay`` equals it. Every
hay emits its windows of a fixed set of lengths and every needle emits the one
longest prefix of such a length, so the join is an equality of window hashes. Every
met pair is then verified, so neither a long needle's tail nor a hash collision can
slip through. A hay of n characters emits O(n) small rows, whatever the data looks like.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cratelink.session import shuffled, stage

EXACT = 16
#: Window lengths: all short ones, then ever coarser steps.
WINDOWS = (
    list(range(1, EXACT + 1))
    + list(range(18, 33, 2))
    + list(range(36, 65, 4))
    + list(range(72, 129, 8))
    + [160, 192, 224, 256, 384, 512]
)


_LENGTHS = f"array({', '.join(map(str, WINDOWS))})"


def anchor_length(v: str) -> Column:
    """The longest window length that fits column *v*."""
    return F.expr(f"array_max(filter({_LENGTHS}, w -> w <= length({v})))")


def windows(v: str, lengths: str = _LENGTHS) -> Column:
    """Hashes of the distinct windows of column *v*, of all given lengths that fit."""
    return F.expr(
        f"array_distinct(flatten(transform(filter({lengths}, w -> w <= length({v})), "
        f"w -> transform(sequence(1, length({v}) - w + 1), i -> xxhash64(substring({v}, i, w))))))"
    )


def inside_pairs(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """(grp, needle, hay) for every needle found inside a hay of the same group."""
    n = needles.select("grp", F.col("v").alias("needle"), anchor_length("v").alias("size"))
    # Only lengths some needle asks for are cut from the hays: at most len(WINDOWS) numbers.
    asked = n.agg(F.array_sort(F.collect_set("size")).alias("asked"))
    n = n.select("grp", "needle", F.expr("xxhash64(substring(needle, 1, size))").alias("piece"))
    h = hays.withColumn("asked", asked.scalar()).select(
        "grp",
        F.col("v").alias("hay"),
        F.explode(windows("v", "asked")).alias("piece"),
    )
    return n.join(shuffled(h), ["grp", "piece"]).filter(F.contains("hay", "needle")).select("grp", "needle", "hay")


def contained_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(grp, l, r) where one text holds the other; inputs are distinct (grp, v), v not blank."""
    inside_right = inside_pairs(left, right).select("grp", F.col("needle").alias("l"), F.col("hay").alias("r"))
    inside_left = (
        inside_pairs(right, left)
        .filter(F.col("needle") != F.col("hay"))
        .select("grp", F.col("hay").alias("l"), F.col("needle").alias("r"))
    )
    return inside_right.unionByName(inside_left)


#: Longest part a title can be cut into: n / (n // 5 + 1) stays below five.
MAX_PART = 5
#: Cuts tried: into t + 1 parts and more; of more parts only the t + 1 rarest are asked for.
MORE_PARTS = 2
#: Titles that a form's near forms may hold in all, so that its titles are met by form.
FORM_LIMIT = 2000
EDIT_LIMIT = "cast(greatest(2, floor(length({0}) / 5)) as int)"
#: A title with its digits alike. Numbers tell titles apart, but hardly tell far from near.
FORM = "regexp_replace({0}, '[0-9]', '0')"
_FORM = FORM.format("v")
#: Lengths that share a key: each one alone while short, then steps of a twenty-fourth of e.
_BUCKET = "if({0} < 24, {0}, cast(floor(24 * ln({0})) as int))"

_CUTS = """
transform(sequence(0, m - 1), k -> struct(
    k, cast(floor(k * n / m) as int) + 1 as start,
    substring(l, cast(floor(k * n / m) as int) + 1,
              cast(floor((k + 1) * n / m) as int) - cast(floor(k * n / m) as int)) as part))
"""
#: The lengths within the limit, by key, with the least and largest difference from l's length.
_LENGTHS_NEAR = f"""
transform(array_distinct(transform(sequence(greatest(1, n - t), n + t), x -> {_BUCKET.format('x')})), b -> struct(
    b as bucket,
    array_min(filter(sequence(greatest(1, n - t), n + t), x -> {_BUCKET.format('x')} = b)) - n as lo,
    array_max(filter(sequence(greatest(1, n - t), n + t), x -> {_BUCKET.format('x')} = b)) - n as hi))
"""
#: Where a part can begin in a title of such a length: edits before and after it add up to
#: t at most; and if all t + 1 parts are asked for, one of them has no more edits before it
#: than parts, and no more after it.
_FIRST = "start - floor((t - d.lo) / 2), if(m = t + 1, greatest(start - k, start + d.lo - (t - k)), 1), 1"
_LAST = "start + floor((t + d.hi) / 2), if(m = t + 1, least(start + k, start + d.hi + (t - k)), start + t)"
_PLACES = f"""
filter(sequence(cast(start - t as int), cast(start + t as int)),
       p -> p >= greatest({_FIRST}) and p <= least({_LAST}))
"""


def edit_candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """(grp, l, r) that share a part at a fitting place; inputs are distinct titles (column v).

    Titles with a column grp meet within their group only.

    If at most t edits turn l into r, of m disjoint parts of l at least m - t survive in r, so
    any t + 1 of them hold one that does. Each title picks the cut and the parts that
    the titles of *right* hold least often. A part is met where length and place allow
    no more than t edits. Titles of t characters or fewer cannot be cut; they meet
    the few titles short enough.
    """
    grp = "grp" if "grp" in left.columns else "'' as grp"
    l = left.selectExpr(grp, "v as l", "length(v) as n", f"{EDIT_LIMIT.format('v')} as t")
    offered = right.selectExpr(
        grp,
        "v as r",
        f"{_BUCKET.format('length(v)')} as bucket",
        f"""explode(flatten(transform(filter(sequence(1, {MAX_PART}), w -> w <= length(v)),
            w -> transform(sequence(1, length(v) - w + 1),
                           i -> struct(i as place, substring(v, i, w) as part))))) as w""",
    ).selectExpr("grp", "r", "bucket", "w.part", "w.place")
    held = offered.groupBy("grp", "part").agg(F.count("*").alias("held"))
    cuts = (
        l.filter("n > t")
        .selectExpr("*", f"explode(sequence(t + 1, least(n, t + 1 + {MORE_PARTS}))) as m")
        .selectExpr("grp", "l", "n", "t", "m", f"inline({_CUTS})")
        .join(shuffled(held), ["grp", "part"], "left")
        .groupBy("grp", "l", "n", "t", "m")
        .agg(F.sort_array(F.collect_list(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "k", "start", "part"))).alias("parts"))
        .selectExpr("grp", "l", "n", "t", "m", "slice(parts, 1, t + 1) as parts")
        .withColumn("cost", F.expr("aggregate(parts, 0L, (a, p) -> a + p.held)"))
        .groupBy("grp", "l")
        .agg(F.min_by(F.struct("n", "t", "m", "parts"), F.struct("cost", "m")).alias("c"))
        .selectExpr("grp", "l", "c.n", "c.t", "c.m", "inline(c.parts)")
    )
    asked = (
        cuts.selectExpr("*", f"explode({_LENGTHS_NEAR}) as d")
        .selectExpr("grp", "l", "part", "d.bucket", f"explode({_PLACES}) as place")
    )
    cut = asked.join(shuffled(offered), ["grp", "bucket", "part", "place"]).select("grp", "l", "r")
    short_l = l.filter("n <= t").withColumn("w", F.expr("explode(sequence(1, 2 + n))"))
    short_r = right.selectExpr(grp, "v as r", "length(v) as w").filter("w <= 4")
    return cut.unionByName(short_l.join(short_r, ["grp", "w"]).select("grp", "l", "r"))


def _near(pairs: DataFrame) -> DataFrame:
    limit = EDIT_LIMIT.format("l")
    return pairs.filter(F.expr(f"abs(length(l) - length(r)) <= {limit} and levenshtein(l, r, {limit}) >= 0"))


def edit_pairs(left: DataFrame, right: DataFrame, form_limit: int = FORM_LIMIT) -> DataFrame:
    """(l, r) within the edit threshold of l; inputs are distinct titles (column v).

    Turning digits into zeros turns every edit into at most one, so titles are only near
    where their forms are. There are far fewer forms than titles: near forms are
    found first, and titles meet by them. Titles whose near forms hold more than
    *form_limit* titles go by parts of their own. The way never changes the result.
    """
    forms = stage(_near(edit_candidates(_forms(left), _forms(right))).select("l", "r").distinct(), "forms")
    l, r = left.selectExpr("v as l", f"{_FORM} as l_form"), right.selectExpr("v as r", f"{_FORM} as r_form")
    held = r.groupBy("r_form").count()
    fans = forms.join(shuffled(held), forms["r"] == held["r_form"]).groupBy(F.col("l").alias("l_form")).agg(F.sum("count").alias("fan"))
    few = fans.filter(F.col("fan") <= form_limit).select("l_form")
    many = fans.filter(F.col("fan") > form_limit).select("l_form")
    by_form = (
        l.join(shuffled(few), "l_form")
        .join(shuffled(forms.selectExpr("l as l_form", "r as r_form")), "l_form")
        .join(shuffled(r), "r_form")
        .select("l", "r")
    )
    near = _near(by_form)
    if not many.isEmpty():
        own = l.join(shuffled(many), "l_form", "left_semi").selectExpr("l as v")
        near = near.unionByName(_near(edit_candidates(own, right)).select("l", "r"))
    return near.distinct()


def near_in_groups(left: DataFrame, right: DataFrame) -> DataFrame:
    """(grp, l, r) within the edit threshold of l, by parts; inputs are distinct (grp, v)."""
    return _near(edit_candidates(left, right)).distinct()


def _forms(df: DataFrame) -> DataFrame:
    return df.selectExpr(f"{_FORM} as v").distinct()
