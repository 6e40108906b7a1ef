"""Connected components and minimum spanning forests of edge tables, group by group.

Every table carries a ``cloud`` column; clouds never touch each other, so any number of them is solved in
the same jobs.  A cloud's edges are first dealt into lots of at most about ``LOT`` and each lot is replaced by a forest of its own:
what a lot drops closes a cycle within it, so components and minimum forests stay what they were.  A cloud of one lot
is solved by that; the others go on in rounds of joins over what is left.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .lineage import cut, release

#: Edges of a lot: what one task holds at once.
LOT = 100_000


def _key(x):
    return tuple(x.values()) if isinstance(x, dict) else x


def lot_forest(u: list, v: list, weight: list | None = None) -> list[int]:
    """Places of the edges of the minimum spanning forest under (weight, u, v); without weights of any forest."""
    root: dict = {}

    def find(x):
        at = x
        while (up := root.setdefault(at, at)) != at:
            at = up
        while root[x] != at:
            root[x], x = at, root[x]
        return at

    order = range(len(u)) if weight is None else sorted(range(len(u)), key=lambda i: (_key(weight[i]), u[i], v[i]))
    kept = []
    for i in order:
        a, b = find(u[i]), find(v[i])
        if a != b:
            root[max(a, b)] = min(a, b)
            kept.append(i)
    return kept


def in_lots(held: DataFrame, lot: int = LOT) -> tuple[DataFrame, DataFrame | None]:
    """``(rows of clouds of one lot, rows of the others or None)``; the latter with their number of ``lots``."""
    lots = held.groupBy("cloud").agg(F.ceil(F.count("*") / lot).alias("lots"))
    many = cut(lots.where("lots > 1"), "lots")
    if not many.limit(1).count():
        return held, None
    return held.join(many.select("cloud"), "cloud", "left_anti"), held.join(many, "cloud")


def by_lot(rows: DataFrame) -> DataFrame:
    """Rows of large clouds (with ``lots``) dealt out by their two ends: a column ``lot``."""
    return rows.withColumn("lot", F.pmod(F.xxhash64("u", "v"), F.col("lots"))).drop("lots")


def _reduce(rows: DataFrame, keys: list[str], weighted: bool) -> DataFrame:
    """Each group of edges replaced by its forest."""

    def run(table: pa.Table) -> pa.Table:
        u, v = table.column("u").to_pylist(), table.column("v").to_pylist()
        kept = lot_forest(u, v, table.column("weight").to_pylist() if weighted else None)
        return table.take(pa.array(kept, pa.int64()))

    return rows.groupBy(*keys).applyInArrow(run, rows.schema)


def _stars(rows: DataFrame) -> DataFrame:
    """``cloud, node, component`` of the nodes with an edge, a cloud of one lot at a time."""
    schema = rows.select("cloud", F.col("u").alias("node"), F.col("u").alias("component")).schema

    def run(table: pa.Table) -> pa.Table:
        root: dict = {}

        def find(x):
            at = x
            while (up := root.setdefault(at, at)) != at:
                at = up
            while root[x] != at:
                root[x], x = at, root[x]
            return at

        for a, b in zip(table.column("u").to_pylist(), table.column("v").to_pylist(), strict=True):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        kind, nodes = table.column("u").type, list(root)
        cloud = pa.repeat(table.column("cloud")[0], len(nodes))
        return pa.Table.from_arrays([cloud, pa.array(nodes, kind), pa.array([find(x) for x in nodes], kind)], ["cloud", "node", "component"])

    return rows.groupBy("cloud").applyInArrow(run, schema)


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 64, lot: int = LOT) -> DataFrame:
    """``cloud, node, component`` of every node; the component is its least node.

    ``nodes(cloud, node)``, ``edges(cloud, u, v)``; both ends of an edge are nodes of its cloud.
    """
    held = cut(edges.where("u <> v").select("cloud", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    nodes = nodes.select("cloud", "node").distinct()
    small, large = in_lots(held, lot)
    found = _stars(small)
    if large is not None:
        rest = cut(_reduce(by_lot(large), ["cloud", "lot"], False).select("cloud", "u", "v"), "edges")
        small, large = in_lots(rest, lot)
        found = found.unionAll(_stars(small))
    if large is not None:
        rest = cut(large.select("cloud", "u", "v"), "edges")
        ends = rest.select("cloud", F.explode(F.array("u", "v")).alias("node")).distinct()
        found = found.unionAll(_spread(ends, rest, most_rounds))
    return cut(nodes.join(found, ["cloud", "node"], "left").select("cloud", "node", F.coalesce("component", "node").alias("component")), "labels")


def _spread(nodes: DataFrame, edges: DataFrame, most_rounds: int) -> DataFrame:
    """Components in rounds: minimum labels spread along edges, and each round also jumps to the label's own label, so
    that long paths settle in few rounds."""
    both = cut(edges.select("cloud", "u", "v").unionAll(edges.select("cloud", F.col("v").alias("u"), F.col("u").alias("v"))), "edges")
    labels = held = cut(nodes.select("cloud", "node", F.col("node").alias("component")).distinct(), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.withColumnRenamed("node", "v"), ["cloud", "v"]).groupBy("cloud", F.col("u").alias("node")).agg(F.min("component").alias("near"))
        seen = labels.join(near, ["cloud", "node"], "left").select("cloud", "node", F.least("component", F.coalesce("near", "component")).alias("to"), F.col("component").alias("was"))
        jump = labels.select("cloud", F.col("node").alias("to"), F.col("component").alias("far"))
        moved = Observation()
        after = seen.join(jump, ["cloud", "to"], "left").select("cloud", "node", F.least("to", F.coalesce("far", "to")).alias("component"), "was")
        found = cut(after.observe(moved, F.count_if(F.col("component") != F.col("was")).alias("n")), "labels")
        release(held)
        held, labels = found, found.select("cloud", "node", "component")
        if not moved.get["n"]:
            release(both)
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def spanning_forest(nodes: DataFrame, edges: DataFrame, weight: str = "weight", most_rounds: int = 40, lot: int = LOT) -> DataFrame:
    """The minimum spanning forest under the total order (weight, u, v), which makes it unique: ``cloud, u, v, weight``."""
    held = edges.where("u <> v").select("cloud", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.col(weight).alias("weight")).distinct()
    small, large = in_lots(cut(held, "edges"), lot)
    found = _reduce(small, ["cloud"], True)
    if large is None:
        return found
    reduced = cut(_reduce(by_lot(large), ["cloud", "lot"], True).select("cloud", "u", "v", "weight"), "edges")
    small, large = in_lots(reduced, lot)
    found = found.unionByName(_reduce(small, ["cloud"], True))
    if large is None:
        return found
    large = cut(large.select("cloud", "u", "v", "weight"), "edges")
    ends = large.select("cloud", F.explode(F.array("u", "v")).alias("node")).distinct()
    return found.unionByName(_boruvka(ends, large, most_rounds))


def _boruvka(nodes: DataFrame, held: DataFrame, most_rounds: int) -> DataFrame:
    """The same in rounds: every component takes its least outgoing edge; components at least halve, so there are at
    most log2(n) rounds."""
    labels = nodes.select("cloud", "node", F.col("node").alias("component")).distinct()
    chosen = None
    for _ in range(most_rounds):
        a = labels.select("cloud", F.col("node").alias("u"), F.col("component").alias("cu"))
        b = labels.select("cloud", F.col("node").alias("v"), F.col("component").alias("cv"))
        out = held.join(a, ["cloud", "u"]).join(b, ["cloud", "v"]).where("cu <> cv")
        best = out.select("cloud", F.explode(F.array("cu", "cv")).alias("c"), F.struct("weight", "u", "v", "cu", "cv").alias("e")).groupBy("cloud", "c").agg(F.min("e").alias("e"))
        found = Observation()
        picked = cut(best.select("cloud", "e.*").distinct().observe(found, F.count(F.lit(1)).alias("n")), "picked")
        if not found.get["n"]:
            break
        own = picked.select("cloud", "u", "v", "weight")
        chosen = own if chosen is None else chosen.unionByName(own)
        # The picked edges join components, not points: the graph halves from round to round.
        tops = labels.select("cloud", F.col("component").alias("node")).distinct()
        joined = components(tops, picked.select("cloud", F.col("cu").alias("u"), F.col("cv").alias("v")))
        labels = cut(labels.join(joined.select("cloud", F.col("node").alias("component"), F.col("component").alias("top")), ["cloud", "component"]).select("cloud", "node", F.col("top").alias("component")), "labels")
    if chosen is None:
        return held.where("false").select("cloud", "u", "v", "weight")
    return chosen.distinct()
