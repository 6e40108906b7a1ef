"""Maps between the merge forests of adjacent orders, at every level at once.

A component of order k + 1 lies in the component of order k that holds its facets' facets.  Between events nothing
changes, so a map is known when it is known for every node at its own level: later on the target is the ancestor that is alive.
Ancestors at a level are found by binary lifting over the lower forest, log2(nodes) equi-joins whatever the depth.

That the maps are sound is checked, not assumed: every facet that enters a node must lead to the node's own target, and
the target of a child, followed up to its parent's level, must be the parent's (the squares commute).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .cloud import facets
from .forest import covered, merge_forest
from .hierarchy import Engine, level
from .lineage import cut


def _births(forest: DataFrame) -> DataFrame:
    """The row that makes each node: ``cloud, node, num, den, at``."""
    return forest.where("q <> 1").select("cloud", "node", "num", "den", level().alias("at"))


def _parents(forest: DataFrame) -> DataFrame:
    return forest.where("children <> ''").select("cloud", F.col("node").alias("parent"), F.explode(F.split("children", ",")).alias("child")).select("cloud", F.col("child").cast("long").alias("node"), "parent")


def lifts(forest: DataFrame) -> list[DataFrame]:
    """``cloud, node, up, at``: each node's ancestor 1, 2, 4, ... generations up, with its level; until none has one."""
    births = _births(forest).select("cloud", F.col("node").alias("up"), "at")
    step = cut(_parents(forest).withColumnRenamed("parent", "up").join(births, ["cloud", "up"]).select("cloud", "node", "up", "at"), "lift")
    out = []
    while step.limit(1).count():
        out.append(step)
        more = step.select("cloud", F.col("node").alias("up"), F.col("up").alias("far"), F.col("at").alias("far_at"))
        step = cut(step.join(more, ["cloud", "up"]).select("cloud", "node", F.col("far").alias("up"), F.col("far_at").alias("at")), "lift")
    return out


def climb(rows: DataFrame, node: str, at: str, up: list[DataFrame]) -> DataFrame:
    """``rows`` with ``node`` replaced by its highest ancestor that exists at the level ``at`` (closed)."""
    for step in reversed(up):
        s = step.select("cloud", F.col("node").alias(node), F.col("up").alias("_up"), F.col("at").alias("_at"))
        rows = rows.join(s, ["cloud", node], "left").withColumn(node, F.when(F.col("_at") <= F.col(at), F.col("_up")).otherwise(F.col(node))).drop("_up", "_at")
    return rows


def vertical_nodes(upper: DataFrame, lower: DataFrame) -> DataFrame:
    """Per node of ``upper`` its target in ``lower`` at its own closed level: ``cloud, source, num, den, target, targets,
    squares, failures``.

    ``targets`` counts the nodes that the facets which make it lead to (1 if the map is well defined); ``squares`` the children and later growths whose targets are
    compared, and ``failures`` those that differ (0)."""
    up = lifts(lower)
    entry = lower.where("facets <> ''").select("cloud", F.col("node").alias("target"), F.explode(F.split("facets", " ")).alias("part"))
    entered = upper.where("facets <> ''").select("cloud", "node", "num", "den", level().alias("at"), "q", F.explode(F.split("facets", " ")).alias("facet"))
    parts = entered.select("*", F.explode(facets(F.split("facet", ","))).alias("p")).withColumn("part", F.array_join("p", ",")).drop("p", "facet")
    led = cut(climb(parts.join(entry, ["cloud", "part"]), "target", "at", up).select("cloud", "node", "num", "den", "at", "q", "target").distinct(), "led")
    nodes = cut(_births(upper), "births")
    # A node that no facet enters stands for its first child's, and so down to one that some enter: by doubling.
    own = led.where("q <> 1").groupBy("cloud", "node").agg(F.min("target").alias("target"), F.count_distinct("target").alias("targets"))
    links = cut(_parents(upper), "links")
    jump = nodes.select("cloud", "node").join(own.select("cloud", "node", "target"), ["cloud", "node"], "left").join(links.groupBy("cloud", F.col("parent").alias("node")).agg(F.min("node").alias("next")), ["cloud", "node"], "left")
    jump = cut(jump, "jump")
    while jump.where("target IS NULL").limit(1).count():
        ahead = jump.select("cloud", F.col("node").alias("next"), F.col("target").alias("theirs"), F.col("next").alias("far"))
        jump = cut(jump.join(ahead, ["cloud", "next"], "left").select("cloud", "node", F.coalesce("target", "theirs").alias("target"), F.when(F.col("target").isNull(), F.col("far")).alias("next")), "jump")
    start = climb(nodes.join(jump.select("cloud", "node", "target"), ["cloud", "node"]), "target", "at", up)
    start = cut(start, "starts")
    to = start.select("cloud", F.col("node").alias("parent"), F.col("at").alias("later"), F.col("target").alias("theirs"))
    rising = start.select("cloud", "node", "target").join(links, ["cloud", "node"]).join(to, ["cloud", "parent"])
    squares = climb(rising, "target", "later", up).select("cloud", F.col("parent").alias("node"), (F.col("target") != F.col("theirs")).alias("off"))
    grown = led.where("q = 1").select("cloud", "node", F.col("at").alias("later"), F.col("target").alias("theirs")).join(start.select("cloud", "node", "target"), ["cloud", "node"])
    squares = squares.unionByName(climb(grown, "target", "later", up).select("cloud", "node", (F.col("target") != F.col("theirs")).alias("off")))
    checked = squares.groupBy("cloud", "node").agg(F.count("*").alias("squares"), F.count_if("off").alias("failures"))
    out = start.join(own.select("cloud", "node", "targets"), ["cloud", "node"], "left").join(checked, ["cloud", "node"], "left")
    zero = F.lit(0).cast("long")
    return out.select("cloud", F.col("node").alias("source"), "num", "den", "target", F.coalesce("targets", F.lit(1).cast("long")).alias("targets"), F.coalesce("squares", zero).alias("squares"), F.coalesce("failures", zero).alias("failures"))


def vertical_at(maps: DataFrame, upper: DataFrame, lower: DataFrame, num: int, den: int = 1) -> DataFrame:
    """``cloud, source, target`` at the closed cut of any level: the sources alive then, and where their targets have gone."""
    at = F.lit(num).cast("long").alias("n"), F.lit(den).cast("long").alias("d")
    cutoff = upper.sparkSession.range(1).select(*at).select(level("n", "d").alias("cutoff"))
    ends = _parents(upper).join(_births(upper).select("cloud", F.col("node").alias("parent"), F.col("at").alias("end")), ["cloud", "parent"]).select("cloud", F.col("node").alias("source"), "end")
    alive = maps.withColumn("begin", level()).join(ends, ["cloud", "source"], "left").join(F.broadcast(cutoff), on=F.col("begin") <= F.col("cutoff")).where("end IS NULL OR end > cutoff")
    return climb(alive.select("cloud", "source", "target", "cutoff"), "target", "cutoff", lifts(lower)).select("cloud", "source", "target")


def sets_of(maps: DataFrame, upper: DataFrame, lower: DataFrame) -> DataFrame:
    """The maps with the points that source and target cover at the level: ``cloud, num, den, source_covered, target_covered``."""
    mine = covered(upper).where("q <> 1").select("cloud", F.col("node").alias("source"), F.col("covered").alias("source_covered"))
    theirs = covered(lower).select("cloud", F.col("node").alias("target"), level().alias("since"), "covered")
    met = maps.withColumn("at", level()).join(theirs, ["cloud", "target"]).where("since <= at")
    last = met.withColumn("nth", F.row_number().over(Window.partitionBy("cloud", "source").orderBy(F.desc("since"), F.desc(F.length("covered"))))).where("nth = 1")
    return last.join(mine, ["cloud", "source"]).select("cloud", "num", "den", "source_covered", F.col("covered").alias("target_covered"), "targets", "squares", "failures")


class Result:
    """What :func:`whole_result` computes: ``catalog``, ``forests`` by order, ``maps`` by upper order, and ``summary``."""

    def __init__(self, catalog: DataFrame, forests: dict[int, DataFrame], maps: dict[int, DataFrame], summary: DataFrame):
        self.catalog, self.forests, self.maps, self.summary = catalog, forests, maps, summary

    def json_lines(self) -> DataFrame:
        """``cloud, record, line``: catalogue, forests and maps of all orders, a JSON object each, fields in order, no blanks."""
        c = self.catalog.select("cloud", "label", "num", "den", "interior", "shell", "rank", "kind")
        tables = {"critical_catalog": c}
        for order, f in self.forests.items():
            tables[f"forest_{order}"] = covered(f).select("cloud", "num", "den", "kind", "q", "covered")
        for order, m in self.maps.items():
            tables[f"vertical_{order}"] = sets_of(m, self.forests[order], self.forests[order - 1]).select("cloud", "num", "den", "source_covered", "target_covered")
        out = None
        for record, t in tables.items():
            own = t.select("cloud", F.lit(record).alias("record"), F.to_json(F.struct(*t.columns)).alias("line"))
            out = own if out is None else out.unionAll(own)
        return out


def whole_result(points: DataFrame, k_max: int, engine: Engine | None = None) -> Result:
    """Catalogue, reduced forests of orders 1 to ``k_max``, the maps between them and a summary per cloud and order.

    Summary: ``cloud, order_, points, events, status, steps, nodes, maps, failures``; ``refused`` where a shell holds more than its support,
    ``failures`` counts facets and squares of the maps that disagree.  A cloud has rows up to its number of points."""
    engine = engine or Engine()
    catalog = cut(engine.catalog(points, k_max), "catalog")
    event = F.col("kind") == "event"
    found = catalog.groupBy("cloud").agg(F.count_if(event).alias("events"), F.when(F.count_if(~event) > 0, "refused").otherwise("complete").alias("status"))
    size = points.groupBy("cloud").agg(F.count("*").alias("points")).join(found, "cloud", "left")
    forests, maps, summary = {}, {}, None
    for k in range(1, k_max + 1):
        forests[k] = cut(merge_forest(*(cut(t, "filtration") for t in engine.order(points, k))), "forest")
        own = forests[k].groupBy("cloud").agg(F.count("*").alias("steps"), F.count_if(F.col("q") != 1).alias("nodes"))
        rows = size.where(F.col("points") >= k).join(own, "cloud", "left")
        if k > 1:
            maps[k] = cut(vertical_nodes(forests[k], forests[k - 1]), "maps")
            rows = rows.join(maps[k].groupBy("cloud").agg(F.count("*").alias("maps"), F.sum(F.col("failures") + F.col("targets") - 1).alias("failures")), "cloud", "left")
        else:
            rows = rows.withColumns({"maps": F.lit(0).cast("long"), "failures": F.lit(0).cast("long")})
        zero = F.lit(0).cast("long")
        rows = rows.select("cloud", F.lit(k).alias("order_"), "points", F.coalesce("events", zero).alias("events"), F.coalesce("status", F.lit("complete")).alias("status"), *(F.coalesce(c, zero).alias(c) for c in ("steps", "nodes", "maps", "failures")))
        summary = rows if summary is None else summary.unionByName(rows)
    return Result(catalog, forests, maps, summary)
