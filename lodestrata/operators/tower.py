"""The tower of saturated balls: all orders and levels of a filtration from forests over generators.

A generator is the set of points in the closed ball of a well-centred support, active from that ball's level on.  At order k
two active generators of at least k points belong together where they share k points, and the components are those of the
cofaces of order k, whose number this never lists.

Overlaps are found as a set-similarity join by levels: generators that share a set of k points form a bucket, buckets of one
generator are dropped, and the others are dealt on by one more point.  In a bucket every generator is linked with the
earliest only, which is active whenever two of them are: as many links as a bucket has members.  Of the links of order k
and beyond the minimum spanning forest by level answers every level at that order; of all links active at one level the
maximum-weight spanning forest by shared points answers every order there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cloud import numbered
from .graph import components, spanning_forest
from .hierarchy import _until, classified, level
from .lineage import cut, spread


def generators(points: DataFrame, until: tuple[int, int] | None = None) -> DataFrame:
    """``cloud, id, members, num, den``: every distinct closed ball of a well-centred support, numbered within its cloud by
    level (then by points), up to a level if ``until`` names one."""
    balls = classified(points, until=until).select("cloud", F.array_sort(F.concat("interior", "shell")).alias("members"), "num", "den")
    # A set of points has one smallest ball, so equal sets have equal levels.
    each = balls.groupBy("cloud", "members").agg(F.min(F.struct("num", "den")).alias("at")).select("cloud", "members", "at.num", "at.den")
    keyed = each.withColumn("at", level()).select("cloud", "members", "num", "den", F.col("at.q").alias("q"), F.col("at.hi").alias("hi"), F.col("at.lo").alias("lo"))
    return cut(numbered(keyed, "cloud", "q", "hi", "lo", "members").select("cloud", "id", "members", "num", "den"), "generators")


def links(found: DataFrame, most: int) -> DataFrame:
    """``cloud, u, v, shared``: links of generators that share at least ``shared`` points, for every order up to ``most``.

    u < v, and u is the earliest generator of a bucket: at every order and level the links up to there connect exactly what
    overlaps connect.  Repeats keep the largest ``shared``."""
    at = spread(found, "cloud", "id").select("cloud", "id", "members", F.explode("members").alias("last"))
    at = at.withColumn("bucket", F.array("last"))
    out = None
    for k in range(1, most + 1):
        at = cut(at, "buckets")
        first = at.groupBy("cloud", "bucket").agg(F.min("id").alias("u"), F.count("*").alias("n")).where("n > 1").drop("n")
        met = at.join(first, ["cloud", "bucket"])
        own = cut(met.where("u < id").select("cloud", "u", F.col("id").alias("v")).distinct().withColumn("shared", F.lit(k)), "links")
        out = own if out is None else out.unionByName(own)
        if k < most:
            more = F.expr("filter(members, x -> x > last)")
            at = met.select("cloud", "id", "members", "bucket", F.explode(more).alias("last")).withColumn("bucket", F.concat("bucket", F.array("last")))
    return out.groupBy("cloud", "u", "v").agg(F.max("shared").alias("shared"))


def overlap_forest(found: DataFrame, links: DataFrame) -> DataFrame:
    """The maximum-weight spanning forest of the overlaps of all generators in ``found``: ``cloud, u, v, shared``.

    Its edges of at least k shared points connect the generators of at least k points as all overlaps do: one forest
    for every order at one level."""
    nodes = found.select("cloud", F.col("id").alias("node"))
    f = spanning_forest(nodes, links.withColumn("weight", -F.col("shared")))
    return f.select("cloud", "u", "v", (-F.col("weight")).alias("shared"))


def level_forests(found: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """``cloud, order, u, v``: per order the minimum spanning forest by level of the links of at least that many shared
    points.  A link is active from its later end on, ``v``, as generators are numbered by level."""
    of = links.select("cloud", "u", "v", F.explode(F.sequence(F.lit(1), F.least("shared", F.lit(most)))).alias("order"))
    pair = F.struct("cloud", "order").alias("cloud")
    f = spanning_forest(of.select(pair, F.col("u").alias("node")), of.select(pair, "u", "v", F.col("v").alias("weight")))
    return f.select("cloud.cloud", "cloud.order", "u", "v")


def tower_cut(found: DataFrame, edges: DataFrame, order: int, num: int, den: int = 1, closed: bool = True) -> DataFrame:
    """Components of a cut: ``cloud, component, covered``; ``edges(cloud, u, v)`` are a forest's that hold for the order."""
    active = found.where(_until(num, den, closed)).where(F.size("members") >= order).select("cloud", "id", "members")
    on = edges.join(active.select("cloud", F.col("id").alias("v")), ["cloud", "v"], "left_semi")
    parts = components(active.select("cloud", F.col("id").alias("node")), on.select("cloud", "u", "v"))
    p = parts.join(active.select("cloud", F.col("id").alias("node"), F.explode("members").alias("p")), ["cloud", "node"])
    return p.groupBy("cloud", "component").agg(F.array_join(F.array_sort(F.collect_set("p")), ",").alias("covered"))


def tower(points: DataFrame, most: int, until: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """``(generators, level forests of orders 1 to most)`` of the balls up to a level."""
    found = generators(points, until)
    return found, cut(level_forests(found, cut(links(found, most), "links"), most), "forests")


def tower_cuts(found: DataFrame, forests: DataFrame, cuts: list[tuple[int, int, int]]) -> DataFrame:
    """``order, num, den, cloud, covered`` of the closed cuts at ``(order, num, den)``, from the forests alone."""
    out = None
    for order, num, den in cuts:
        own = tower_cut(found, forests.where(F.col("order") == order), order, num, den)
        own = own.select(F.lit(order).alias("order"), F.lit(num).cast("long").alias("num"), F.lit(den).cast("long").alias("den"), "cloud", "covered")
        out = own if out is None else out.unionByName(own)
    return out


def orders_at(points: DataFrame, most: int, num: int, den: int = 1) -> DataFrame:
    """``order, cloud, covered``: the closed cuts of orders 1 to ``most`` at one level, from one maximum-weight forest."""
    found = generators(points, (num, den))
    forest = cut(overlap_forest(found, links(found, most)), "forest")
    out = None
    for order in range(1, most + 1):
        own = tower_cut(found, forest.where(F.col("shared") >= order), order, num, den).select(F.lit(order).alias("order"), "cloud", "covered")
        out = own if out is None else out.unionByName(own)
    return out
