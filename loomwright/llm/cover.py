"""Exact link counts and classes for items under a metric, without writing out the pairs of a group.

Items that a hash family brings together are first covered by balls: an item joins the ball of a
centre that it shares many keys with and that lies within half the limit. Members of a ball are then
linked with each other by the triangle inequality, whatever their number. Only balls that share a key
are compared. For two balls the centres' distance decides all member pairs at once, save in a narrow
band, in which members are compared one by one with the same inequality first.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .graph import connected_components

#: Distances closer than this to a bound are compared exactly.
MARGIN = 1e-7
#: Items join a family up to so many times the limit from its made centre.
REACH = 2.5
#: Items of a block; a task holds two blocks at a time.
BLOCK = 256


@dataclass(frozen=True)
class Metric:
    #: distance of two feature columns, and their exact link decision
    distance: Callable[[Column, Column], Column]
    linked: Callable[[Column, Column], Column]
    #: items are linked up to this distance
    limit: float
    #: (pairs with columns a, b, ra, rb) -> those that may hold a link; ra and rb are the balls' radii
    prune: Callable[[DataFrame], DataFrame]
    #: a test on the columns that both sides of a key carry, before pairs are made distinct
    key_test: Callable[[str, str], Column] | None = None
    carried: tuple[str, ...] = ()
    #: (id, centre, feat) -> (centre, feat, n) of a better centre for the n items (ids from 0 on), and such a centre's keys
    consensus: Callable[[DataFrame], DataFrame] | None = None
    centre_keys: Callable[[Column], Column] | None = None
    #: the Arrow function that links two blocks of a family (a, b, same) -> (i, w, j)
    block: Callable | None = None


def _attach(df: DataFrame, on: str, feats: DataFrame, name: str) -> DataFrame:
    return df.join(feats.select(F.col("id").alias(on), F.col("feat").alias(name)), on)


def _agreed(to: DataFrame, met: DataFrame, have: DataFrame, metric: Metric) -> tuple[DataFrame, DataFrame]:
    """(id, fam, r) of items within the reach of a made centre, and the made centres (id, feat).

    Variants lie nearer to what most of them share than to one another. A key names the made centre of
    most items that has it, so each item is compared with few of them. Items beyond the limit of all
    centres join one within twice and a half of it: their pairs with the family are then decided in
    blocks, not written out.
    """
    members = _attach(to.union(to.select("centre", "centre")).distinct(), "id", have, "feat")
    # items are numbered from 0 on, so these names are no item's
    made = materialize(metric.consensus(members).select((F.lit(-1) - F.col("centre")).alias("id"), "feat", "n"), "consensus")
    names = made.select("n", "id", F.explode(metric.centre_keys(F.col("feat"))).alias("key")).groupBy("key").agg(F.max(F.struct("n", "id")).alias("top"))
    tries = met.select("id", "key").join(names, "key").select("id", F.col("top.id").alias("centre"), F.col("top.n").alias("n")).distinct()
    far = _attach(_attach(tries, "id", have, "fa"), "centre", made, "fb").select("id", "centre", "n", metric.distance(F.col("fa"), F.col("fb")).alias("r"))
    inner = (F.col("r") <= metric.limit).alias("inner")
    best = far.where(F.col("r") <= REACH * metric.limit).groupBy("id").agg(F.max(F.struct(inner, "n", "centre", "r")).alias("x"))
    return materialize(best.select("id", F.col("x.centre").alias("fam"), "x.r"), "families"), made.select("id", "feat")


def _within(family: DataFrame, have: DataFrame, weights: DataFrame, metric: Metric) -> DataFrame:
    """(i, w, j): the weight w that item i is linked with inside its family, and edges i - j that connect what is linked.

    Only pairs with a satellite (an item beyond half the limit) are looked at, in blocks: a task holds two
    blocks, and only sums and a spanning forest of each two blocks come out.
    """
    outer = F.col("r") > metric.limit / 2 - MARGIN
    sizes = family.groupBy("fam", outer.alias("sat")).agg(F.count("*").alias("n"))
    some = sizes.where("sat").select("fam")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("long")
    put = family.withColumn("sat", outer).join(some, "fam", "left_semi").join(sizes, ["fam", "sat"]).withColumn("block", F.pmod(F.xxhash64(F.lit(43), "id"), blocks))
    full = _attach(put.join(weights, "id"), "id", have, "feat")
    packed = materialize(full.groupBy("fam", "sat", "block").agg(F.collect_list(F.struct("id", "r", "weight", "feat")).alias("items")), "blocks")
    a = packed.where("sat").select("fam", F.col("block").alias("x"), F.col("items").alias("a"))
    b = packed.select("fam", F.col("sat").alias("inner_sat"), F.col("block").alias("y"), F.col("items").alias("b"))
    both = a.join(b, "fam").where("not inner_sat or x <= y").select("a", "b", (F.col("inner_sat") & (F.col("x") == F.col("y"))).alias("same"))
    return materialize(both.mapInArrow(metric.block, "i long, w long, j long"), "within")


def cover(keys: DataFrame, feats: Callable[[DataFrame], DataFrame], metric: Metric, votes: int) -> tuple:
    """Balls (id, ball, r), the keys that hold several items, the features of these items, and families with their made centres.

    ``keys`` has (id, key, *carried); ``feats`` gives (id, feat) of a table of ids.
    """
    shared = keys.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1")
    met = materialize(keys.join(shared.select("key", "least"), "key"), "met")
    have = materialize(feats(met.select("id").distinct()), "feats")
    count = met.where("least < id").groupBy("id", "least").agg(F.count("*").alias("n")).where(F.col("n") >= votes)
    best = materialize(count.groupBy("id").agg(F.max(F.struct("n", (-F.col("least")).alias("m"))).alias("x")).select("id", (-F.col("x.m")).alias("centre")), "best")
    over = best.select(F.col("id").alias("centre"), F.col("centre").alias("higher"))
    to = best.join(over, "centre", "left").select("id", F.coalesce("higher", "centre").alias("centre"))
    # a centre that has a centre itself is none: its own members stand alone
    to = to.join(best.select(F.col("id").alias("centre")), "centre", "left_anti")
    near = _attach(_attach(to, "id", have, "fa"), "centre", have, "fb").select("id", "centre", metric.distance(F.col("fa"), F.col("fb")).alias("r"))
    near = near.where(F.col("r") <= metric.limit / 2 - MARGIN)
    family = None
    if metric.consensus is not None:
        family, made = _agreed(to, met, have, metric)
        # an item of a family is no centre any more; its ball is the family's if it lies near enough
        gone = family.select("id")
        near = near.join(gone, "id", "left_anti").join(gone.select(F.col("id").alias("centre")), "centre", "left_anti").select("id", "centre", "r")
        near = near.union(family.where(F.col("r") <= metric.limit / 2 - MARGIN).select("id", F.col("fam").alias("centre"), "r"))
    ids = met.select("id").distinct()
    balls = ids.join(near, "id", "left").select("id", F.coalesce("centre", "id").alias("ball"), F.coalesce("r", F.lit(0.0)).alias("r"))
    return materialize(balls, "balls"), met, have, (family, made) if family is not None else None


def links(keys: DataFrame, feats: Callable[[DataFrame], DataFrame], weights: DataFrame, metric: Metric, votes: int) -> DataFrame:
    """(id, n_links, component) of every item that shares a key with another one.

    n_links: the weight of the other items linked directly (``weights`` has id, weight); component:
    the smallest id reachable by links. Items that are not in the result have no links.
    """
    balls, met, have, families = cover(keys, feats, metric, votes)
    inside = None
    if families is not None:
        family, made = families
        inside = _within(family, have, weights, metric)
        have = have.union(made)
    weighted = materialize(balls.join(weights, "id"), "weighted")
    sizes = materialize(weighted.groupBy("ball").agg(F.max("r").alias("radius"), F.sum("weight").alias("total"), F.min("id").alias("first"), F.count("*").alias("n")), "sizes")
    radius = sizes.select("ball", "radius")
    at = met.select("id", "key").join(balls.select("id", "ball"), "id").select("key", "ball").distinct()
    if inside is not None:
        # pairs inside a family are counted already: only keys of several families, and pairs across them, are left
        of = family.select(F.col("id").alias("ball"), "fam").union(made.select("id", "id"))
        at = at.join(of, "ball", "left").select("key", "ball", F.coalesce("fam", "ball").alias("side"))
    else:
        at = at.withColumn("side", F.col("ball"))
    several = at.groupBy("key").agg(F.min("side").alias("lo"), F.max("side").alias("hi")).where("lo < hi").select("key")
    at = at.join(several, "key").join(radius, "ball")
    if metric.carried:
        at = at.join(met.select(F.col("id").alias("ball"), *metric.carried).distinct(), "ball")
    at = materialize(at, "at")
    left, right = (at.select("key", *(F.col(c).alias(f"{x}_{c}") for c in at.columns if c != "key")) for x in "ab")
    pairs = left.join(right, "key").where("a_ball < b_ball and a_side <> b_side")
    if metric.key_test is not None:
        pairs = pairs.where(metric.key_test("a", "b"))
    pairs = pairs.select(F.col("a_ball").alias("a"), F.col("b_ball").alias("b"), F.col("a_radius").alias("ra"), F.col("b_radius").alias("rb")).distinct()
    pairs = metric.prune(pairs)
    pairs = _attach(_attach(pairs, "a", have, "fa"), "b", have, "fb")
    seen = pairs.select("a", "b", "ra", "rb", metric.distance(F.col("fa"), F.col("fb")).alias("d"), metric.linked(F.col("fa"), F.col("fb")).alias("link"))
    single = (F.col("ra") == 0) & (F.col("rb") == 0)
    whole = F.when(single, F.col("link")).otherwise(F.col("d") + F.col("ra") + F.col("rb") <= metric.limit - MARGIN)
    none = F.when(single, ~F.col("link")).otherwise(F.col("d") - F.col("ra") - F.col("rb") > metric.limit + MARGIN)
    seen = materialize(seen.where(~none).select("a", "b", "d", whole.alias("whole")), "seen")

    # balls of which every member is linked with every member of the other
    full = seen.where("whole")
    full = full.select(F.col("a").alias("ball"), F.col("b").alias("other")).union(full.select("b", "a"))
    gained = full.join(sizes.select(F.col("ball").alias("other"), "total"), "other").groupBy("ball").agg(F.sum("total").alias("gained"))

    # the others, member by member
    one = weighted.select(F.col("ball").alias("a"), F.col("id").alias("i"), F.col("r").alias("ri"), F.col("weight").alias("wi"))
    two = weighted.select(F.col("ball").alias("b"), F.col("id").alias("j"), F.col("r").alias("rj"), F.col("weight").alias("wj"))
    member = seen.where("not whole").select("a", "b", "d").join(one, "a").join(two, "b")
    member = member.where(F.col("d") - F.col("ri") - F.col("rj") <= metric.limit + MARGIN)
    member = materialize(member.withColumn("sure", F.col("d") + F.col("ri") + F.col("rj") <= metric.limit - MARGIN), "members")
    close = member.where("not sure").withColumn("ra", F.lit(0.0)).withColumn("rb", F.lit(0.0)).withColumnsRenamed({"a": "ball_a", "b": "ball_b", "i": "a", "j": "b"})
    close = _attach(_attach(metric.prune(close), "a", have, "fa"), "b", have, "fb").where(metric.linked(F.col("fa"), F.col("fb")))
    found = member.where("sure").select("a", "b", "i", "j", "wi", "wj").union(close.select("ball_a", "ball_b", "a", "b", "wi", "wj"))
    found = materialize(found, "found")
    own = found.select(F.col("i").alias("id"), F.col("wj").alias("w")).union(found.select("j", "wi"))
    if inside is not None:
        own = own.union(inside.where("w is not null").select("i", "w"))
    own = own.groupBy("id").agg(F.sum("w").alias("own"))

    edges = seen.where("whole").select("a", "b").union(found.select("a", "b"))
    edges = edges.join(sizes.select(F.col("ball").alias("a"), F.col("first").alias("u")), "a").join(sizes.select(F.col("ball").alias("b"), F.col("first").alias("v")), "b").select("u", "v")
    if inside is not None:
        firsts = weighted.join(sizes.select("ball", "first"), "ball").select("id", "first")
        tied = inside.where("j is not null").select("i", "j")
        edges = edges.union(tied.join(firsts.select(F.col("id").alias("i"), F.col("first").alias("u")), "i").join(firsts.select(F.col("id").alias("j"), F.col("first").alias("v")), "j").select("u", "v"))
    roots = connected_components(edges)
    every = weighted.join(sizes.select("ball", "total", "first"), "ball").join(gained, "ball", "left").join(own, "id", "left")
    every = every.join(roots.select(F.col("node").alias("first"), "component"), "first", "left")
    total = F.col("total") - F.col("weight") + F.coalesce("gained", F.lit(0)) + F.coalesce("own", F.lit(0))
    return every.select("id", total.cast("long").alias("n_links"), F.coalesce("component", "first").alias("component"))
