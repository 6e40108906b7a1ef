"""Connected components by alternating large-star and small-star, on DataFrames.

Each round is two grouped minima and two joins; the edges of a round are written to the shared folder,
so that a lost executor costs a re-read and not the rounds before.  Minima are aggregated before the
shuffle, and a hub's edges are an ordinary skewed join, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least of its neighbourhood.  ``edges``: u < v."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u < v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them.  ``edges``: u < v."""
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    linked = edges.join(least, "v")
    inner = linked.where("u > m").select(F.col("m").alias("u"), F.col("u").alias("v"))
    return inner.unionAll(least.select(F.col("m").alias("u"), "v")).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, component`` of every node with an edge; the component is its least node.

    ``edges`` has long columns ``u`` and ``v`` in either order; loops, repeats and nulls are dropped.
    No edges: no rows.
    """
    known = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    known = store.materialize(known, "edges")
    mark = _mark(known)
    for _ in range(most_rounds):
        if mark[0] == 0:
            break
        after = store.materialize(small_star(large_star(known)), "edges")
        store.release(known)
        known, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    stars = known.select(F.col("v").alias("node"), F.col("u").alias("component"))
    out = stars.unionAll(known.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
    out._lodestrata_path = known._lodestrata_path  # for store.release
    return out


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
    return r.n, r.s
