"""Geometry and hierarchies against plain rational arithmetic and known small clouds."""

from __future__ import annotations

import itertools
import random
from fractions import Fraction as Q

import pytest

from lodestrata.operators import cloud, condense, graph, hierarchy, metrics, spatial
from lodestrata.operators.lineage import cut

FIVE = [(0, 0, 7), (0, 9, 6), (1, 4, 0), (0, 0, 1), (4, 1, 2)]


def table(spark, points, number=0):
    return spark.createDataFrame([(number, i, *p) for i, p in enumerate(points)], "cloud long, id long, x long, y long, z long")


def ball(points):
    """Circumball (centre, squared radius) of affinely independent points, or None, by elimination."""
    p0, rest = points[0], points[1:]
    e = [[Q(a - b) for a, b in zip(p, p0)] for p in rest]
    n = len(e)
    g = [[sum(a * b for a, b in zip(u, v)) for v in e] + [sum(a * a for a in u) / Q(2)] for u in e]
    for i in range(n):
        k = next((r for r in range(i, n) if g[r][i]), None)
        if k is None:
            return None
        g[i], g[k] = g[k], g[i]
        g[i] = [v / g[i][i] for v in g[i]]
        for r in range(n):
            if r != i and g[r][i]:
                g[r] = [a - g[r][i] * b for a, b in zip(g[r], g[i])]
    w = [g[i][n] for i in range(n)]
    if any(v <= 0 for v in w) or sum(w) >= 1:
        return None
    centre = [Q(c) + sum(w[i] * e[i][j] for i in range(n)) for j, c in enumerate(p0)]
    return centre, sum((a - b) ** 2 for a, b in zip(centre, p0))


def supports(points):
    for size in range(1, 5):
        for s in itertools.combinations(range(len(points)), size):
            b = (list(map(Q, points[s[0]])), Q(0)) if size == 1 else ball([points[i] for i in s])
            if b:
                yield s, *b


def d2(c, p):
    return sum((a - b) ** 2 for a, b in zip(c, p))


def level(points, label):
    return min(r2 for s, c, r2 in supports([points[i] for i in label]) if all(d2(c, points[i]) <= r2 for i in label))


def gamma_components(points, order, at, closed, gabriel=False):
    n = range(len(points))
    fits = (lambda v: v <= at) if closed else (lambda v: v < at)
    parent = {f: f for f in itertools.combinations(n, order) if fits(level(points, f))}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for c in itertools.combinations(n, order + 1):
        if fits(level(points, c)):
            if gabriel:
                own = [(centre, r2) for s, centre, r2 in supports(points) if set(s) <= set(c) and all(d2(centre, points[i]) <= r2 for i in c)][0]
                if any(d2(own[0], points[i]) < own[1] for i in n if i not in c):
                    continue
            parts = [c[:i] + c[i + 1 :] for i in range(len(c))]
            for p in parts[1:]:
                parent[find(p)] = find(parts[0])
    groups = {}
    for f in parent:
        groups.setdefault(find(f), set()).add(f)
    return {frozenset(g) for g in groups.values()}


def as_sets(df):
    groups = {}
    for r in df.collect():
        groups.setdefault(r.component, set()).add(tuple(map(int, r.facet.split(","))))
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("gabriel", [False, True])
def test_five_points_where_empty_balls_delay_a_merge(spark, gabriel):
    facets, cofaces = hierarchy.gamma_filtration(table(spark, FIVE), 2)
    got = as_sets(hierarchy.gamma_cut(facets, cofaces, 83886, 3563, gabriel=gabriel))
    joined = {frozenset(g) for g in got if len(g) > 1}
    if gabriel:
        assert joined == {frozenset({(0, 1), (0, 2), (1, 2)}), frozenset({(0, 3), (0, 4), (2, 3), (2, 4), (3, 4)})}
    else:
        assert joined == {frozenset({(0, 1), (0, 2), (0, 3), (0, 4), (1, 2), (2, 3), (2, 4), (3, 4)})}
    assert got == gamma_components(FIVE, 2, Q(83886, 3563), True, gabriel)


def test_catalogue_levels_and_saturated_balls_on_random_clouds(spark):
    draw = random.Random(3)
    clouds = [list(dict.fromkeys(tuple(draw.randint(-8, 8) for _ in range(3)) for _ in range(6))) for _ in range(4)]
    rows = [(k, i, *p) for k, c in enumerate(clouds) for i, p in enumerate(c)]
    points = spark.createDataFrame(rows, "cloud long, id long, x long, y long, z long")
    found = {(r.cloud, tuple(r.label)): (Q(r.num, r.den), set(r.interior), set(r.shell)) for r in hierarchy.classified(points).collect()}
    want = {}
    for k, c in enumerate(clouds):
        for s, centre, r2 in supports(c):
            want[k, s] = r2, {i for i, p in enumerate(c) if d2(centre, p) < r2}, {i for i, p in enumerate(c) if d2(centre, p) == r2}
    assert found == want
    facets, cofaces = (cut(t) for t in hierarchy.gamma_filtration(points, 2))
    for at in (10, 30):
        got = hierarchy.gamma_cut(facets, cofaces, at)
        covered = {(r.cloud, r.covered) for r in hierarchy.coverage(got).collect()}
        for k, c in enumerate(clouds):
            assert as_sets(got.where(f"cloud = {k}")) == gamma_components(c, 2, at, True)
        assert sorted((r.cloud, r.covered) for r in hierarchy.saturated_cut(points, 2, at).collect()) == sorted(covered) or {(r.cloud, r.covered) for r in hierarchy.saturated_cut(points, 2, at).collect()} == covered
    forest = cut(hierarchy.merge_forest(facets, cofaces, reduced=False))
    for at in (10, 30):
        replay = sorted((r.cloud, r.covered) for r in hierarchy.forest_cut(forest, at).collect())
        assert replay == sorted((r.cloud, r.covered) for r in hierarchy.coverage(hierarchy.gamma_cut(facets, cofaces, at)).collect())


def test_rank_window_and_pair_level(spark):
    points = table(spark, [(-2, 0, 0), (2, 0, 0), (0, 1, 0), (0, 0, 1), (0, 0, 6)])
    event = hierarchy.critical_catalog(points, 5).where("label = array(0L, 1L)").first()
    assert (event.num, event.den, list(event.interior), event["rank"], event.birth_order, event.saddle_order) == (4, 1, [2, 3], 4, 4, 3)


def test_equal_levels_merge_at_once(spark):
    square = table(spark, [(0, 0, 0), (2, 0, 0), (0, 2, 0), (2, 2, 0)])
    forest = hierarchy.merge_forest(*hierarchy.gamma_filtration(square, 1)).collect()
    merges = [r for r in forest if r.kind == "merge"]
    assert len(merges) == 1 and merges[0].q == 4 and merges[0].entered == "" and len(forest) == 5


def test_spanning_forest_and_components(spark):
    draw = random.Random(5)
    n, edges = 30, []
    for u, v in itertools.combinations(range(30), 2):
        if draw.random() < 0.1:
            edges.append((0, u, v, draw.randint(1, 5)))
    nodes = spark.createDataFrame([(0, i) for i in range(n)], "cloud long, node long")
    table_ = spark.createDataFrame(edges, "cloud long, u long, v long, weight long")
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    want = set()
    for _, u, v, w in sorted(edges, key=lambda e: (e[3], e[1], e[2])):
        if find(u) != find(v):
            parent[max(find(u), find(v))] = min(find(u), find(v))
            want.add((u, v, w))
    assert {(r.u, r.v, r.weight) for r in graph.spanning_forest(nodes, table_).collect()} == want
    assert {r.node: r.component for r in graph.components(nodes, table_).collect()} == {i: find(i) for i in range(n)}


def test_neighbours_with_ties_by_grid(spark):
    draw = random.Random(7)
    points = list(dict.fromkeys(tuple(draw.randint(0, 6) for _ in range(3)) for _ in range(40)))
    got = {}
    for r in spatial.nearest_grid(table(spark, points), 3, 2).collect():
        got.setdefault(r.q, {})[r.p] = r.d2
    for q, a in enumerate(points):
        d = sorted((d2(a, b), p) for p, b in enumerate(points) if p != q)
        assert got[q] == {p: v for v, p in d if v <= d[2][0]}


def test_canonical_points_refuse_and_merge(spark):
    rows = [(0, 5, 1.0, 2.0, -0.0), (0, 6, 1.0, 2.0, 0.0), (0, 7, float("nan"), 0.0, 0.0), (0, 8, None, 0.0, 0.0), (0, 9, 0.5, 0.0, 0.0)]
    points = spark.createDataFrame(rows, "cloud long, source long, x double, y double, z double")
    got = cloud.canonical(points).orderBy("id").collect()
    assert [(r.id, r.x, r.multiplicity, r.sources) for r in got] == [(0, 0.5, 1, [9]), (1, 1.0, 2, [5, 6])]
    with pytest.raises(Exception, match="not finite"):
        cloud.strict(points).collect()
    with pytest.raises(Exception, match="duplicate point"):
        cloud.strict(points.where("source in (5, 6)")).collect()


def test_condensed_tree_keeps_the_parent_on_ties(spark):
    edges = spark.createDataFrame([(0, 0, 1, 1.0), (0, 2, 3, 1.0), (0, 1, 2, 4.0), (0, 3, 4, 5.0)], "cloud long, u long, v long, weight double")
    masses = spark.createDataFrame([(0, i, 1.0) for i in range(5)], "cloud long, node long, mass double")
    tree = cut(condense.condensed_tree(edges, masses, 2.0))
    rows = {r.members: r for r in tree.collect()}
    assert set(rows) == {"0,1", "2,3", "0,1,2,3,4"} and rows["0,1"].parent == rows["0,1,2,3,4"].node
    assert rows["0,1"].stability == pytest.approx(2 * 1.0 - 2 * 0.25)
    assert {r.members for r in condense.select_leaves(tree).collect()} == {"0,1", "2,3"}
    assert {r.members for r in condense.select_stable(tree).collect()} == {"0,1", "2,3"}
    assert {r.members for r in condense.select_cut(tree, 2.0).collect()} == {"0,1", "2,3"}


def test_empty_tables_give_empty_results(spark):
    none = table(spark, FIVE).where("false")
    assert spatial.cut_order_one(none, 4).count() == 0
    assert hierarchy.critical_catalog(none, 3).count() == 0
    facets, cofaces = hierarchy.gamma_filtration(none, 2)
    assert hierarchy.merge_forest(facets, cofaces).count() == 0
    assert metrics.confusion(spark.createDataFrame([], "truth long, cluster long")).count() == 0


@pytest.mark.parametrize("shift,scale", [((3, -2, 1), 1), ((0, 0, 0), 2)])
def test_moves_and_scalings_keep_the_catalogue(spark, shift, scale):
    moved = [tuple(scale * a + b for a, b in zip(p, shift)) for p in FIVE]
    read = lambda pts: {(tuple(r.label), Q(r.num, r.den), tuple(r.interior)) for r in hierarchy.critical_catalog(table(spark, pts), 3).collect()}
    assert {(a, v / scale**2, i) for a, v, i in read(moved)} == read(FIVE)
