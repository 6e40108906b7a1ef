"""Merge forests by ranges of levels against one range, and against cuts recomputed from nothing."""

from __future__ import annotations

import random
from fractions import Fraction
from itertools import combinations

import pytest

from lodestrata.operators import forest

FACETS = "cloud long, label array<long>, num long, den long"


def filtration(seed: int, n: int = 7, order: int = 2):
    """Facets and cofaces of random levels (many equal, some fractions), a coface no earlier than its facets."""
    draw = random.Random(seed)
    level = {}
    for f in combinations(range(n), order):
        level[f] = Fraction(0) if order == 1 else Fraction(draw.randrange(12), draw.choice((1, 2, 3)))
    cofaces = []
    for c in combinations(range(n), order + 1):
        if draw.random() < 0.6:
            cofaces.append((c, max(level[f] for f in combinations(c, order)) + Fraction(draw.randrange(4), 2)))
    return level, cofaces


@pytest.fixture(scope="module")
def tables(spark):
    given = {0: filtration(1), 1: filtration(2, 5), 2: filtration(3, 9, 1), 3: ({(1, 2): Fraction(1)}, [])}
    row = lambda c, label, t: (c, list(label), t.numerator, t.denominator)
    f = spark.createDataFrame([row(c, x, t) for c, (level, _) in given.items() for x, t in level.items()], FACETS).cache()
    g = spark.createDataFrame([row(c, x, t) for c, (_, cofaces) in given.items() for x, t in cofaces], FACETS).cache()
    return given, f, g


def naive(level, cofaces, reduced):
    """Per level and component of the closed cut that something of the level touches: q and all points covered."""

    def parts(until, closed):
        inside = lambda t: t < until or closed and t == until
        left = {f for f, t in level.items() if inside(t)}
        links = [[f for f in combinations(c, len(c) - 1)] for c, t in cofaces if inside(t)]
        out = []
        while left:
            part, grown = {left.pop()}, True
            while grown:
                more = {f for fs in links if part & set(fs) for f in fs} - part
                part, grown = part | more, bool(more)
            left -= part
            out.append(frozenset(part))
        return out

    rows = []
    for t in sorted({*level.values(), *(x for _, x in cofaces)}):
        before = parts(t, False)
        for part in parts(t, True):
            joined = any(x == t and part & set(combinations(c, len(c) - 1)) for c, x in cofaces)
            born = any(level[f] == t for f in part)
            single = len(part) == 1 and len(next(iter(part))) == 1
            if not (joined or born and (not reduced or single)):
                continue
            prior = [b for b in before if b <= part and (not reduced or len(b) > 1 or len(next(iter(b))) == 1)]
            rows.append((t, len(prior), ",".join(map(str, sorted({p for f in part for p in f})))))
    return sorted(rows)


@pytest.mark.parametrize("reduced", [True, False])
def test_ranges_of_any_size_give_the_same_forest(tables, reduced):
    given, f, g = tables
    found = {}
    for lot in (1, 4, 25, 10**6):
        made = forest.merge_forest(f, g, reduced, lot)
        found[lot] = sorted(tuple(r) for r in made.collect())
        if lot in (4, 10**6):
            rows = forest.covered(made).collect()
            for c, (level, cofaces) in given.items():
                assert sorted((Fraction(r.num, r.den), r.q, r.covered) for r in rows if r.cloud == c) == naive(level, cofaces, reduced)
    assert found[1] == found[4] == found[25] == found[10**6] and len(found[1]) > 25
    entered = [p for r in found[1] if r[0] == 2 for p in filter(None, r[7].split(","))]
    assert sorted(map(int, entered)) == list(range(9))  # every point of order 1 enters once


def test_cuts_replayed_from_ranges(tables):
    given, f, g = tables
    made = forest.merge_forest(f, g, False, 10)
    for num, den, closed in ((3, 1, True), (3, 1, False), (11, 2, True)):
        got = {(r.cloud, r.covered) for r in forest.forest_cut(made, num, den, closed).collect()}
        want = set()
        for c, (level, cofaces) in given.items():
            until = Fraction(num, den)
            ok = lambda t: t < until or closed and t == until  # noqa: E731, B023
            left = {x for x, t in level.items() if ok(t)}
            links = [set(combinations(x, len(x) - 1)) for x, t in cofaces if ok(t)]
            while left:
                part, grown = {left.pop()}, True
                while grown:
                    more = {y for fs in links if part & fs for y in fs} - part
                    part, grown = part | more, bool(more)
                left -= part
                want.add((c, ",".join(map(str, sorted({p for y in part for p in y})))))
        assert got == want
