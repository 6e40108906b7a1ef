"""What the reviewer of round 3 projected to larger tables: the same results from less than all pairs, rows or dense groups."""

from __future__ import annotations

import itertools
import random
import tracemalloc

import numpy as np

from lodestrata.functions import arrays
from lodestrata.operators import facegraph, graph, hierarchy, journals, percolation, spatial
from lodestrata.operators.lineage import cut
from lodestrata.streaming import tracking


def lattice(seed, n, side=12):
    draw = random.Random(seed)
    return sorted({tuple(draw.randrange(side) for _ in range(3)) for _ in range(n)})


def table(spark, *clouds):
    return cut(spark.createDataFrame([(c, i, *p) for c, places in enumerate(clouds) for i, p in enumerate(sorted(places))], "cloud long, id long, x long, y long, z long"))


def d2(p, q):
    return sum((a - b) ** 2 for a, b in zip(p, q))


SQUARE = [(0, 0, 0), (2, 0, 0), (0, 2, 0), (2, 2, 0)]


def test_few_pairs_hold_cores_forests_and_sweeps(spark):
    clouds = [lattice(1, 120, 9), SQUARE, [(0, 0, 0), (5, 0, 0)], [(1, 1, 1)], [(i, 0, 0) for i in range(40)]]
    p = table(spark, *clouds)
    every = cut(spark.createDataFrame([(c, u, v, d2(at[u], at[v])) for c, at in enumerate(clouds) for u, v in itertools.combinations(range(len(at)), 2)], "cloud long, u long, v long, d2 long"))
    few = cut(spatial.reachability_pairs(p, 2))
    assert few.exceptAll(every).count() == 0 and few.where("cloud = 4").count() < 200 < every.where("cloud = 4").count()
    found = {}
    for name, pairs in (("few", few), ("every", every)):
        core = cut(facegraph.core_distances(pairs, p, 2))
        c = {(r.cloud, r.id): r.core2 or 0 for r in core.collect()}
        rows = [(r.cloud, r.u, r.v, max(r.d2, c[r.cloud, r.u], c[r.cloud, r.v])) for r in pairs.collect()]
        tree = graph.spanning_forest(p.selectExpr("cloud", "id AS node"), spark.createDataFrame(rows, "cloud long, u long, v long, weight long"))
        swept = percolation.sweep(core.withColumnRenamed("core2", "core"), pairs)
        found[name] = c, sorted((r.cloud, r.weight) for r in tree.collect()), sorted(map(tuple, swept.collect()))
    assert found["few"] == found["every"]


def test_descents_of_pairs_are_those_of_all_points(spark):
    clouds = [lattice(2, 40, 7), SQUARE, [(0, 0, 0), (5, 0, 0)], [(1, 1, 1)], [(i, 0, 0) for i in range(9)]]
    p = table(spark, *clouds)
    found = cut(hierarchy.supports(p, 2))
    names = ("cloud", "label", "num", "den", "support", "successor")
    want = sorted(map(tuple, journals.descents(hierarchy.miniballs(hierarchy.k_subsets(p, 2), found), found, p).select(*names).collect()))
    for lot in (60, 10_000):
        steps = cut(journals.pair_descents(p, lot))
        assert sorted(map(tuple, steps.select(*names).collect())) == want
        for c in range(len(clouds)):
            rows = sorted((tuple(r.label), r.place) for r in steps.where(f"cloud = {c}").collect())
            assert [place for _, place in rows] == list(range(len(rows)))


def test_saturated_cut_lists_no_balls(spark, monkeypatch):
    p = table(spark, lattice(4, 24, 7), SQUARE, [(0, 0, 0), (2, 0, 0), (30, 0, 0)])
    filtration = [cut(t) for t in hierarchy.gamma_filtration(p, 2)]

    def none(*_):
        raise AssertionError("balls are listed")

    monkeypatch.setattr(hierarchy, "generators", none)
    for at in (1, 5, 12):
        want = hierarchy.coverage(hierarchy.gamma_cut(*filtration, at)).select("cloud", "covered")
        assert sorted(map(tuple, hierarchy.saturated_cut(p, 2, at).collect())) == sorted(map(tuple, want.collect()))


def test_few_links_connect_what_all_near_pairs_do(spark):
    clouds = [lattice(5, 150, 30), lattice(6, 300, 9), SQUARE, [(-3, -3, -3), (0, 0, 0), (-9, 5, 5)], [(2 * i - 30, 0, 0) for i in range(30)]]
    p = table(spark, *clouds)
    nodes = p.selectExpr("cloud", "id AS node")
    for squared in (0, 1, 2, 5, 12, 75):
        every, few = spatial.pairs_within(p, squared), cut(spatial.near_links(p, squared))
        assert sorted(map(tuple, graph.components(nodes, few).collect())) == sorted(map(tuple, graph.components(nodes, every).collect()))
    assert spatial.near_links(p, 300).where("cloud = 1").count() < 400 < spatial.pairs_within(p, 300).where("cloud = 1").count()


def test_sums_over_later_points_by_blocks(spark, monkeypatch):
    clouds = [lattice(7, 90, 30), SQUARE, [(1, 1, 1)], [(0, 0, 0), (-5, 0, 2)]]
    want = [(c, u, len(at) - u - 1, sum(d), min(d)) for c, at in enumerate(map(sorted, clouds)) for u in range(len(at) - 1) if (d := [d2(at[u], q) for q in at[u + 1 :]])]
    for block in (7, 2048):
        monkeypatch.setattr(spatial, "POINTS", block)
        assert sorted(map(tuple, spatial.pair_sums(table(spark, *clouds)).collect())) == want


def test_spectral_coordinates_by_bands_are_the_dense_ones():
    p = np.asarray(lattice(8, 700, 25))
    w = 1 / (1 + ((p[:, None] - p[None]) ** 2).sum(axis=2).astype(float))
    np.fill_diagonal(w, 0)
    want = arrays.spectral_coordinates(w, 2)
    for n, most in ((2000, 60), (512, 60), (512, 3)):  # dense, at once, starting anew
        assert np.abs(arrays.inverse_spectral_coordinates(p, 2, dense=n, most=most) - want).max() < 1e-11
    many = np.asarray(lattice(9, 3000, 40))
    tracemalloc.start()
    assert np.isfinite(arrays.inverse_spectral_coordinates(many, 2)).all()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * len(many) ** 2


def test_assignments_are_best_also_of_some_pairs():
    draw = np.random.default_rng(3)
    for n, m in ((1, 1), (4, 4), (3, 6), (6, 3), (5, 5)):
        for _ in range(20):
            cost = draw.integers(-4, 3, (n, m)).astype(float)  # with ties
            pairs = arrays.assignment(cost)
            assert len(pairs) == min(n, m) == len({i for i, _ in pairs}) == len({j for _, j in pairs}) and pairs == sorted(pairs)
            best = min(sum((cost if n <= m else cost.T)[i, j] for i, j in enumerate(way)) for way in itertools.permutations(range(max(n, m)), min(n, m)))
            assert sum(cost[i, j] for i, j in pairs) == best
    for n, m in ((1, 1), (6, 6), (8, 5), (5, 9), (30, 30), (40, 25)):
        for _ in range(30):
            gain = draw.integers(0, 6, (n, m)) * (draw.random((n, m)) < 0.4) + 0.0
            rows, columns = np.nonzero(gain)
            pairs = arrays.sparse_assignment(n, m, rows, columns, gain[rows, columns])
            assert len(pairs) == len({i for i, _ in pairs}) == len({j for _, j in pairs}) and all(gain[i, j] > 0 for i, j in pairs)
            assert sum(gain[i, j] for i, j in pairs) == sum(gain[i, j] for i, j in arrays.assignment(-gain))


def test_gates_and_transport_of_near_pairs_only():
    draw = np.random.default_rng(4)
    a, b = draw.random((80, 3)) * 30 - 9, draw.random((70, 3)) * 30 - 9
    d2_ = ((a[:, None] - b[None]) ** 2).sum(axis=2)
    rows, columns, near = arrays.gated(a, b, 6.0)
    assert [rows.tolist(), columns.tolist()] == [x.tolist() for x in np.nonzero(d2_ <= 36)] and np.allclose(near, d2_[rows, columns])
    want = arrays.unbalanced_transport(np.ones(80), np.ones(70), np.where(d2_ <= 36, d2_, np.inf) / 36, 0.2, 3.0)
    assert np.abs(arrays.sparse_transport(80, 70, rows, columns, near / 36, 0.2, 3.0) - want[rows, columns]).max() < 1e-12
    tracks = tracking.Tracks()
    many = np.stack([np.arange(6000) * 9.0, np.zeros(6000), np.zeros(6000)], axis=1)
    tracemalloc.start()
    assert tracks.step(many, 6.0, 1.0).tolist() == tracks.step(many + 0.5, 6.0, 1.0).tolist() == list(range(6000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * 6000**2 / 4
