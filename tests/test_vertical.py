"""Vertical maps of random complexes, a node at a time and at any cut, against components recomputed from nothing."""

from __future__ import annotations

import random
from fractions import Fraction
from itertools import combinations

import pytest

from lodestrata.operators import forest, vertical

FACETS = "cloud long, label array<long>, num long, den long"


def complex_(seed, n=7, largest=4):
    """Random levels of all small subsets, none earlier than its parts."""
    draw = random.Random(seed)
    level = {(i,): Fraction(0) for i in range(n)}
    for k in range(2, largest + 1):
        for s in combinations(range(n), k):
            level[s] = max(level[p] for p in combinations(s, k - 1)) + Fraction(draw.choice((0, 1, 2, 3, 5)), draw.choice((1, 2, 3)))
    return level


def parts(level, k, until):
    left = {s for s, t in level.items() if len(s) == k and t <= until}
    links = [set(combinations(s, k)) for s, t in level.items() if len(s) == k + 1 and t <= until]
    out = []
    while left:
        part, grown = {left.pop()}, True
        while grown:
            more = {f for fs in links if part & fs for f in fs} - part
            part, grown = part | more, bool(more)
        left -= part
        out.append(frozenset(part))
    return out


def cover(part):
    return ",".join(map(str, sorted({p for f in part for p in f})))


@pytest.mark.parametrize("reduced", [True, False])
def test_maps_of_all_nodes_and_cuts(spark, reduced):
    clouds = {0: complex_(1), 1: complex_(2, 6), 2: complex_(3, 3)}
    made = {}
    for k in (1, 2, 3):
        row = lambda c, s, t: (c, list(s), t.numerator, t.denominator)
        of = lambda size: spark.createDataFrame([row(c, s, t) for c, level in clouds.items() for s, t in level.items() if len(s) == size], FACETS)  # noqa: E731, B023
        made[k] = forest.merge_forest(of(k), of(k + 1), reduced, lot=40).cache()
    for k in (2, 3):
        maps = vertical.vertical_nodes(made[k], made[k - 1]).cache()
        rows = vertical.sets_of(maps, made[k], made[k - 1]).collect()
        assert rows and all(r.targets == 1 and r.failures == 0 for r in rows) and sum(r.squares for r in rows) > 0
        got = sorted((r.cloud, Fraction(r.num, r.den), r.source_covered, r.target_covered) for r in rows)
        want = []
        for c, level in clouds.items():
            times = sorted(set(level.values()))
            for i, t in enumerate(times):
                before = [b for b in (parts(level, k, times[i - 1]) if i else []) if len(b) > 1 or not reduced]
                for part in parts(level, k, t):
                    if (len(part) > 1 or not reduced) and sum(b <= part for b in before) != 1:
                        below = next(iter(part))[1:]
                        want.append((c, t, cover(part), next(cover(p) for p in parts(level, k - 1, t) if below in p)))
        assert got == sorted(want)
        for at in (Fraction(3, 2), Fraction(7, 1)):
            found = vertical.vertical_at(maps, made[k], made[k - 1], at.numerator, at.denominator).collect()
            for c, level in clouds.items():
                alive = [p for p in parts(level, k, at) if len(p) > 1 or not reduced]
                mine = [r for r in found if r.cloud == c]
                assert len(mine) == len({r.source for r in mine}) == len(alive)
                tops = {r.node for r in forest.forest_cut(made[k - 1], at.numerator, at.denominator).collect() if r.cloud == c}
                assert {r.target for r in mine} <= tops
