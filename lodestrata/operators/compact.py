"""The hierarchy of order one in linear space: multifusion nodes with children, sizes and intervals of leaves.

Leaves are the points; a merge node joins, at one length, all components that edges of that length connect.  The tree is walked
once around (down to a node, up from it), and the walk is ranked by pointer doubling: in round i every step knows the step 2**i
further on and how many leaves lie between, so log2 rounds of equi-joins on unique keys number all of it, however deep
the tree.  Then a node's points are the leaves in one interval of places: sizes are differences, and members
are read for the nodes that are asked for, by place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .cloud import numbered
from .forest import merge_forest
from .lineage import cut, release


def _tree(points: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(nodes, links)``: ``cloud, node, weight, point`` (null for merge nodes) and ``cloud, parent, child``."""
    one, none = F.lit(1).cast("long"), F.lit(-1).cast("long")  # points are there before edges of length 0
    found = cut(merge_forest(points.select("cloud", F.array("id").alias("label"), none.alias("num"), one.alias("den")), edges.select("cloud", F.array("u", "v").alias("label"), F.col("weight").alias("num"), one.alias("den"))), "forest")
    point = F.when(F.col("kind") == "birth", F.col("entered").cast("long"))
    nodes = found.where("kind <> 'growth'").select("cloud", "node", F.greatest("num", F.lit(0)).alias("weight"), point.alias("point"))
    links = found.where("children <> ''").select("cloud", F.col("node").alias("parent"), F.explode(F.split("children", ",")).alias("child")).withColumn("child", F.col("child").cast("long"))
    return nodes, links


def _walk(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``cloud, step, next, leaves``: the walk around each tree as a list; step 2 n goes down to node n, 2 n + 1 up from it."""
    among = Window.partitionBy("cloud", "parent").orderBy("child")
    placed = links.withColumns({"after": F.lead("child").over(among), "nth": F.row_number().over(among)})
    first = placed.where("nth = 1").select("cloud", F.col("parent").alias("node"), F.col("child").alias("first"))
    own = nodes.join(first, ["cloud", "node"], "left")
    down = own.select("cloud", (2 * F.col("node")).alias("step"), F.coalesce(2 * F.col("first"), 2 * F.col("node") + 1).alias("next"), F.col("point").isNotNull().cast("long").alias("leaves"))
    up = nodes.join(placed.select("cloud", F.col("child").alias("node"), "parent", "after"), ["cloud", "node"], "left")
    up = up.select("cloud", (2 * F.col("node") + 1).alias("step"), F.coalesce(2 * F.col("after"), 2 * F.col("parent") + 1).alias("next"), F.lit(0).cast("long").alias("leaves"))
    return down.unionByName(up)


def ranked(walk: DataFrame, most_rounds: int = 64) -> DataFrame:
    """``cloud, step, leaves``: how many leaves lie from each step to the end of its list."""
    walk = cut(walk, "walk")
    for _ in range(most_rounds):
        if not walk.where("next IS NOT NULL").limit(1).count():
            return walk.select("cloud", "step", "leaves")
        ahead = walk.select("cloud", F.col("step").alias("next"), F.col("next").alias("far"), F.col("leaves").alias("more"))
        further = cut(walk.join(ahead, ["cloud", "next"], "left").select("cloud", "step", F.col("far").alias("next"), (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves")), "walk")
        release(walk)
        walk = further
    raise RuntimeError(f"a walk did not end in 2**{most_rounds} steps")


def _least(leaves: DataFrame, spans: DataFrame) -> DataFrame:
    """``spans(cloud, node, lo, size)`` with the ``least`` point among their leaves: of two runs of a power of two that cover
    the interval, each the minimum of two runs half as long."""
    longest = int(spans.agg(F.max("size")).first()[0] or 1)
    runs, out, k = leaves.select("cloud", F.col("place").alias("at"), F.col("point").alias("least")), None, 0
    power = F.floor(F.log2(F.col("size").cast("double")) + 1e-9).cast("long")
    asked = spans.withColumn("power", power)
    asked = asked.select("cloud", "node", "power", F.explode(F.array("lo", F.expr("lo + size - shiftleft(1L, cast(power as int))"))).alias("at"))
    while 1 << k <= longest:
        own = asked.where(F.col("power") == k).join(runs, ["cloud", "at"]).select("cloud", "node", "least")
        out = own if out is None else out.unionByName(own)
        half = runs.select("cloud", (F.col("at") - (1 << k)).alias("at"), F.col("least").alias("other"))
        runs = cut(runs.join(half, ["cloud", "at"]).select("cloud", "at", F.least("least", "other").alias("least")), "runs")
        k += 1
    return spans.join(out.groupBy("cloud", "node").agg(F.min("least").alias("least")), ["cloud", "node"])


def compact_forest(points: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(nodes, children, leaves)`` of the merge hierarchy of spanning trees (or forests) ``edges(cloud, u, v, weight)``.

    Nodes: ``cloud, node, weight, parent, lo, size, least, child_offset, child_count``; a point has weight 0, size 1 and no
    children.  The points of a node are the ``size`` leaves from place ``lo`` on, the least of them is ``least``.  Children:
    ``cloud, place, parent, child``, those of a node from its offset on.  Leaves: ``cloud, place, point``.
    """
    nodes, links = _tree(points, edges)
    nodes, links = cut(nodes, "nodes"), cut(links, "links")
    left = ranked(_walk(nodes, links))
    n = points.groupBy("cloud").agg(F.count("*").alias("n"))
    # Trees of a forest are walked one by one: each begins after the leaves of those before.
    tops = nodes.join(links.select("cloud", F.col("child").alias("node")), ["cloud", "node"], "left_anti").select("cloud", F.col("node").alias("top"))
    size_of = tops.join(left.select("cloud", (F.col("step") / 2).cast("long").alias("top"), "leaves", (F.col("step") % 2).alias("up")).where("up = 0"), ["cloud", "top"]).select("cloud", "top", "leaves")
    base = size_of.select("cloud", "top", (F.sum("leaves").over(Window.partitionBy("cloud").orderBy("top")) - F.col("leaves")).alias("base"), F.col("leaves").alias("whole"))
    if base.groupBy("cloud").count().where("count > 1").limit(1).count():
        from .graph import components

        of = components(nodes.select("cloud", (-F.col("node")).alias("node")), links.select("cloud", (-F.col("parent")).alias("u"), (-F.col("child")).alias("v")))
        top_of = of.select("cloud", (-F.col("node")).alias("node"), (-F.col("component")).alias("top"))
    else:
        top_of = nodes.select("cloud", "node").join(tops, "cloud")
    at = lambda up: left.where(F.col("step") % 2 == up).select("cloud", F.floor(F.col("step") / 2).cast("long").alias("node"), F.col("leaves").alias(f"left_{up}"))
    spans = top_of.join(at(0), ["cloud", "node"]).join(at(1), ["cloud", "node"]).join(base, ["cloud", "top"])
    spans = cut(spans.select("cloud", "node", (F.col("base") + F.col("whole") - F.col("left_0")).alias("lo"), (F.col("left_0") - F.col("left_1")).alias("size")), "spans")
    leaves = cut(nodes.where("point IS NOT NULL").join(spans, ["cloud", "node"]).select("cloud", F.col("lo").alias("place"), "point"), "leaves")
    children = cut(numbered(links, "cloud", "parent", "child").select("cloud", F.col("id").alias("place"), "parent", "child"), "children")
    offsets = children.groupBy("cloud", F.col("parent").alias("node")).agg(F.min("place").alias("child_offset"), F.count("*").alias("child_count"))
    up = links.select("cloud", F.col("child").alias("node"), "parent")
    out = nodes.join(_least(leaves, spans), ["cloud", "node"]).join(up, ["cloud", "node"], "left").join(offsets, ["cloud", "node"], "left").join(n, "cloud")
    return out.select("cloud", "node", "weight", "parent", "lo", "size", "least", "child_offset", F.coalesce("child_count", F.lit(0)).cast("long").alias("child_count")), children, leaves


def members(chosen: DataFrame, leaves: DataFrame) -> DataFrame:
    """``cloud, node, point`` of the points of chosen nodes (``cloud, node, lo, size``): as many rows as are asked for."""
    asked = chosen.select("cloud", "node", F.explode(F.sequence(F.col("lo"), F.col("lo") + F.col("size") - 1)).alias("place"))
    return asked.join(leaves, ["cloud", "place"]).select("cloud", "node", "point")


def alive(nodes: DataFrame, weight: int, closed: bool = True) -> DataFrame:
    """The nodes of a cut at a length: those whose weight is reached and whose parent's is not (yet, or not strictly)."""
    parent = nodes.select("cloud", F.col("node").alias("parent"), F.col("weight").alias("above"))
    reached = (lambda c: F.col(c) <= weight) if closed else (lambda c: F.col(c) < weight)
    return nodes.join(parent, ["cloud", "parent"], "left").where(reached("weight") & (F.col("above").isNull() | ~reached("above")))
