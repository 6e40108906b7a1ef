"""What the reviewer of round 4 found, by operator."""

from __future__ import annotations

import random

import pytest

from pyspark.sql import functions

from lodestrata.operators import facegraph, forest, hierarchy, journals, metrics, percolation, spatial, triples
from lodestrata.operators.lineage import cut


@pytest.fixture(scope="module")
def clouds(spark):
    random.seed(4)
    rows = []
    for cloud in range(2):
        at = sorted({(random.randrange(9), random.randrange(7), random.randrange(6)) for _ in range(11)})
        rows += [(cloud, i, *p) for i, p in enumerate(at)]
    return cut(spark.createDataFrame(rows, "cloud long, id long, x long, y long, z long"), "points")


@pytest.fixture(scope="module")
def by_subsets(clouds):
    """Facets and cofaces of order 2 by all subsets and supports."""
    f, c = hierarchy.gamma_filtration(clouds, 2, ball=lambda labels, balls: hierarchy.miniballs(labels, balls))
    return cut(f.select("cloud", "label", "num", "den")), cut(c.select("cloud", "label", "num", "den", "gabriel"))


def rows(df, *names):
    return sorted(tuple(map(str, r)) for r in df.select(*(names or df.columns)).collect())


def test_order_two_is_made_of_triples_without_supports_of_four(clouds, by_subsets, monkeypatch):
    def never(*_, **__):
        raise AssertionError("supports of a cloud were listed")

    monkeypatch.setattr(hierarchy, "supports", never)
    f, c = hierarchy.gamma_filtration(clouds, 2)
    assert rows(f) == rows(by_subsets[0]) and rows(c) == rows(by_subsets[1])
    for until in ((10, 1), (7, 2)):
        f, c = hierarchy.gamma_filtration(clouds, 2, until)
        for new, whole in ((f, by_subsets[0]), (c, by_subsets[1])):
            assert rows(new) == rows(whole.where(f"num * {until[1]} <= {until[0]} * den"))


@pytest.mark.parametrize("lot", [20, 10_000])
def test_few_cofaces_do_for_logs_levels_and_curves(clouds, by_subsets, lot):
    f, c = by_subsets
    joins = cut(triples.cofaces(clouds, "joining", lot=lot))
    assert joins.count() < c.count() and rows(journals.facet_log(f, joins)) == rows(journals.facet_log(f, c))
    levels = triples.cofaces(clouds, "levels", lot=lot).select("cloud", "num", "den")
    assert rows(levels.distinct()) == rows(c.select("cloud", "num", "den").distinct())
    curve = percolation.largest_cover(f, joins, levels)
    assert rows(curve) == rows(metrics.percolation_curve(forest.covered(hierarchy.merge_forest(f, c, reduced=False))))
    assert rows(triples.cofaces(clouds, "gabriel", lot=lot), "cloud", "label") == rows(c.where("gabriel"), "cloud", "label")


@pytest.mark.parametrize("lot", [20, 10_000])
def test_gates_and_their_gaps_are_those_of_all_cofaces(clouds, by_subsets, lot):
    f, c = by_subsets
    least = cut(triples.least_levels(clouds, lot=lot))
    first = cut(hierarchy.first_incidence(f, c))
    gates = cut(journals.gateways(c, first))
    names = ["cloud", "label", "num", "den", "gabriel", "first"]
    assert rows(triples.cofaces(clouds, "gates", least=least, lot=lot), *names) == rows(gates, *names)
    found = triples.first_incidences(clouds, least, lot=lot)
    assert rows(found.select("cloud", hierarchy.label_text("facet"), hierarchy.label_text("label"), "num", "den")) == rows(first, "cloud", "facet", "coface", "num", "den")
    some = cut(triples.cofaces(clouds, "genealogy", least=least, lot=lot))
    for kept in ("gabriel OR first", "gabriel", "first"):
        whole = journals.partition_gaps(f, journals.coface_relations(c), journals.coface_relations(gates.where(kept)))
        assert rows(journals.partition_gaps(f, journals.coface_relations(some), journals.coface_relations(some.where(kept)), c.select("cloud", "num", "den"))) == rows(whole)


def test_descents_of_pairs_end_without_a_join(spark, clouds, monkeypatch):
    steps = cut(journals.pair_descents(clouds))
    whole = rows(journals.descent_closure(steps), "cloud", "label", "terminal", "steps")
    monkeypatch.setattr(journals, "cut", None)  # no table of steps is written
    for lot in (10, 10_000):
        assert rows(journals.pair_closure(clouds, lot)) == whole
        falls = {r[:2]: r[2:] for r in rows(journals.pair_falls(clouds, lot))}
        for cloud, label, successor, num, den in rows(steps.select("cloud", hierarchy.label_text("label"), hierarchy.label_text("successor"), "num", "den")):
            to = falls[cloud, successor][1:3]
            assert falls[cloud, label] == (successor, num, den, *to, str(label == successor))
    some = [r for k, r in enumerate(whole) if k % 3 == 0]
    asked = spark.createDataFrame([(int(r[0]), r[1]) for r in some], "cloud long, label string")
    assert rows(journals.ends_of_pairs(clouds, asked, 4)) == some and journals.ends_of_pairs(clouds, asked.where("false"), 4).count() == 0


def test_faces_are_added_up_without_listing_triangles(clouds, monkeypatch):
    for squared in (5, 20, 40_000):
        whole = cut(facegraph.rips(spatial.pairs_within(clouds, squared)))
        masses = facegraph.face_masses(whole)
        face = functions.concat_ws(",", "u", "v").alias("face")
        assert rows(facegraph.triangles(clouds, squared)) == rows(whole)
        assert rows(facegraph.node_weights(masses).select("cloud", "face", functions.round("w", 9))) == rows(facegraph.pair_weights(cut(facegraph.pair_masses(clouds, squared))).select("cloud", face, functions.round("w", 9)))
        with monkeypatch.context() as m:
            m.setattr(facegraph, "facets", None)  # no triangle is taken apart
            m.setattr(facegraph, "pairs_within", None)  # and no pair is a row
            for triples_ in (300, 10**9):
                assert rows(facegraph.pair_masses(clouds, squared, triples_).select("cloud", face, functions.round("s", 9))) == rows(masses.select("cloud", "face", functions.round("s", 9)))
