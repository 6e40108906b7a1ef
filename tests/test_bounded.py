"""Supports by branch and bound, towers of saturated balls, and graphs in lots, against enumeration."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import bounded, graph, hierarchy, tower

POINTS = "cloud long, id long, x long, y long, z long"


def clouds(*sizes, seed=1):
    """One cloud a size and side; the last of three or more is flat."""
    draw = random.Random(seed)
    out = []
    for c, (n, side) in enumerate(sizes):
        flat = len(sizes) > 2 and c == len(sizes) - 1
        pts = sorted({(draw.randrange(side), draw.randrange(side), 7 if flat else draw.randrange(side)) for _ in range(n)})
        out += [(c, i, *p) for i, p in enumerate(pts)]
    return out


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(clouds((30, 63), (24, 9), (2, 5), (1, 1), (20, 40)), POINTS).cache()


@pytest.fixture(scope="module")
def every(points):
    """All supports of all clouds by enumeration, with what lies in and on their balls."""
    found = hierarchy._classify(hierarchy.supports(points), points, None).collect()
    return {(r.cloud, tuple(r.label)): (r.num, r.den, tuple(r.interior), tuple(r.shell)) for r in found}


@pytest.mark.parametrize("most", [2, 3, 4, 6])
def test_no_support_within_the_rank_is_pruned(points, every, most):
    got = {(r.cloud, tuple(r.label)): (r.num, r.den, tuple(r.interior), tuple(r.shell)) for r in bounded.classify_within(bounded.supports_within(points, most), points).collect()}
    assert all(every[k] == v for k, v in got.items())
    assert {k for k, v in every.items() if len(v[2]) + len(k[1]) <= most} <= set(got)
    assert len(got) < len(every) // 3


def test_a_descent_stops_at_its_budget_and_goes_on(spark):
    points = spark.createDataFrame(clouds((150, 63), (12, 20), seed=5), POINTS).cache()
    whole, end = bounded.descend(points, 2)
    want = sorted(map(tuple, whole.collect()))
    budget, frontier, stops = 2000, None, 0
    while True:
        pairs, frontier = bounded.descend(points, 2, frontier, budget)
        if pairs is not None:
            break
        stops, budget = stops + 1, budget * 4
        assert frontier.examined <= budget and frontier.rows.count()
    assert stops and sorted(map(tuple, pairs.collect())) == want and frontier.examined == end.examined


def test_points_certain_in_a_spindle_lie_in_every_ball():
    draw = np.random.default_rng(2)
    for _ in range(200):
        middle, radius = draw.normal(size=3) * 10, draw.random()
        known = draw.normal(size=(20, 3)) * 3
        n = int(bounded.certain_in_spindle(middle[None], radius, known)[0])
        worst = np.full(len(known), -np.inf)
        for _ in range(60):
            step = draw.normal(size=3)
            e = middle + step / np.linalg.norm(step) * radius
            side = np.cross(e, draw.normal(size=3))
            centre = e / 2 + side / np.linalg.norm(side) * np.linalg.norm(e) / np.sqrt(8)
            worst = np.maximum(worst, ((known - centre) ** 2).sum(axis=1) - (centre**2).sum())
        assert n <= (worst < 0).sum()


def naive_cut(every, order, num, den):
    """Components of the generators of a level that share ``order`` points, by comparing all of them."""
    out = set()
    by = defaultdict(set)
    for (cloud, _), (n, d, inside, shell) in every.items():
        if n * den <= num * d and len(inside) + len(shell) >= order:
            by[cloud].add(frozenset(inside + shell))
    for cloud, sets in by.items():
        left = list(sets)
        while left:
            part, edge = [left.pop()], 0
            while edge < len(part):
                near = [s for s in left if len(s & part[edge]) >= order]
                left = [s for s in left if s not in near]
                part += near
                edge += 1
            out.add((cloud, ",".join(map(str, sorted(frozenset().union(*part))))))
    return out


def test_one_tower_answers_every_order_and_level(points, every):
    found, forests = tower.tower(points, 4, (200, 1))
    cuts = [(k, n, d) for k in (1, 2, 3, 4) for n, d in ((0, 1), (81, 4), (200, 1))]
    got = defaultdict(set)
    for r in tower.tower_cuts(found, forests, cuts).collect():
        got[r.order, r.num, r.den].add((r.cloud, r.covered))
    for cut in cuts:
        assert got[cut] == naive_cut(every, *cut), cut
    at_end = defaultdict(set)
    for r in tower.orders_at(points, 4, 200).collect():
        at_end[r.order].add((r.cloud, r.covered))
    assert all(at_end[k] == got[k, 200, 1] for k in (1, 2, 3, 4))


def naive_forest(edges):
    root, out = {}, []

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for w, u, v in sorted(edges):
        if find(u) != find(v):
            root[find(u)] = find(v)
            out.append((u, v, w))
    return sorted(out), find


@pytest.mark.parametrize("lot", [7, 40, 100_000])
def test_graphs_in_lots_of_any_size(spark, lot):
    draw = random.Random(lot)
    edges = [(c, *draw.sample(range(60), 2), draw.randrange(9)) for c, n in ((0, 150), (1, 20), (2, 35)) for _ in range(n)]
    df = spark.createDataFrame(edges + edges[:5] + [(1, 3, 3, 0)], "cloud long, u long, v long, weight long")
    nodes = spark.createDataFrame([(c, i) for c in range(4) for i in range(61)], "cloud long, node long")
    got = {(r.cloud, r.node): r.component for r in graph.components(nodes, df, lot=lot).collect()}
    forest = [tuple(r) for r in graph.spanning_forest(nodes, df, lot=lot).collect()]
    for c in range(4):
        want, find = naive_forest({(w, min(u, v), max(u, v)) for x, u, v, w in edges if x == c})
        assert sorted((u, v, w) for x, u, v, w in forest if x == c) == want
        least = {}
        for i in range(61):
            least[find(i)] = min(least.get(find(i), i), i)
        assert all(got[c, i] == least[find(i)] for i in range(61))


def test_weights_and_nodes_may_be_structs_and_texts(spark):
    df = spark.createDataFrame([(0, "b", "a", 2), (0, "c", "b", 1), (0, "a", "c", 3)], "cloud long, u string, v string, w long").select("cloud", "u", "v", F.struct("w", F.lit(1).alias("x")).alias("weight"))
    nodes = df.select("cloud", F.explode(F.array("u", "v")).alias("node"))
    assert sorted((r.u, r.v, r.weight.w) for r in graph.spanning_forest(nodes, df).collect()) == [("a", "b", 2), ("b", "c", 1)]
