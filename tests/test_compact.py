"""Compact forests of order one: sizes, members, intervals and children of every node."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lodestrata.operators import compact


def naive(n, edges):
    """Multifusions by batches of equal weight: (weight, members, how many components they join)."""
    part = {i: frozenset([i]) for i in range(n)}
    out = []
    for w in sorted({w for _, _, w in edges}):
        before = set(part.values())
        for u, v, x in edges:
            if x == w:
                both = part[u] | part[v]
                for p in both:
                    part[p] = both
        out += [(w, tuple(sorted(s)), sum(b <= s for b in before)) for s in set(part.values()) - before]
    return sorted(out)


def test_every_node_of_trees_and_forests(spark):
    draw = random.Random(3)
    trees = {
        0: (30, [(draw.randrange(i), i, draw.randrange(1, 6)) for i in range(1, 30)]),
        1: (40, [(i - 1, i, i) for i in range(1, 40)]),  # as deep as it is long
        2: (12, [(0, i, 7) for i in range(1, 12)]),  # one multifusion of all
        3: (15, [(i - 1, i, draw.randrange(3)) for i in range(1, 15) if i not in (5, 9)]),  # three trees
        4: (1, []),
    }
    points = spark.createDataFrame([(c, i) for c, (n, _) in trees.items() for i in range(n)], "cloud long, id long")
    edges = spark.createDataFrame([(c, *e) for c, (_, es) in trees.items() for e in es], "cloud long, u long, v long, weight long")
    nodes, children, leaves = (t.cache() for t in compact.compact_forest(points, edges))
    held = {}
    for r in compact.members(nodes, leaves).collect():
        held.setdefault((r.cloud, r.node), set()).add(r.point)
    rows = {(r.cloud, r.node): r for r in nodes.collect()}
    links = {}
    for r in children.collect():
        links.setdefault((r.cloud, r.parent), []).append((r.place, r.child))
    for c, (n, es) in trees.items():
        mine = [r for r in rows.values() if r.cloud == c]
        fused = sorted((r.weight, tuple(sorted(held[c, r.node])), r.child_count) for r in mine if r.child_count)
        assert fused == naive(n, es)
        assert sorted(r.least for r in mine if not r.child_count) == list(range(n))
        assert sorted(r.place for r in leaves.where(F.col("cloud") == c).collect()) == list(range(n))
    for key, r in rows.items():
        assert r.size == len(held[key]) and r.least == min(held[key])
        own = sorted(links.get(key, []))
        assert [p for p, _ in own] == list(range(r.child_offset or 0, (r.child_offset or 0) + r.child_count))
        inside = [rows[key[0], k] for _, k in own]
        assert all(k.parent == r.node and r.lo <= k.lo and k.lo + k.size <= r.lo + r.size and k.weight < r.weight or k.weight == 0 for k in inside)
        assert not own or sum(k.size for k in inside) == r.size
    cut = sorted((r.cloud, r.least, r.size) for r in compact.alive(nodes, 2, closed=False).collect())
    assert [x for x in cut if x[0] == 1] == [(1, 0, 2)] + [(1, i, 1) for i in range(2, 40)]
    assert compact.compact_forest(points.where("false"), edges.where("false"))[0].count() == 0
