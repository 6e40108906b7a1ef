"""Condensed trees, the clusterer, mosaics, descents and tracks against plain computations."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import arrays
from lodestrata.operators import condense, hierarchy, journals, polytopes, spatial
from lodestrata.operators.clusterer import HypergraphClusterer
from lodestrata.operators.lineage import cut
from lodestrata.sources import stores
from lodestrata.streaming import frames, tracking

from test_hierarchy import d2, level, supports, table  # isort: skip


def naive_tree(nodes, edges, least, epsilon):
    """Clusters as ``(members, joins, birth, death, children)``: components from nothing at the end of every batch."""
    batches, k, edges = [], 0, sorted(edges)
    while k < len(edges):
        first = edges[k][0]
        while k < len(edges) and edges[k][0] - first <= epsilon:
            k += 1
        batches.append((k, edges[k - 1][0]))
    parts = {frozenset([n]) for n in nodes}
    alive, done = {}, []  # component -> cluster
    for k, w in batches:
        up = {n: n for n in nodes}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for _, a, b in edges[:k]:
            up[find(a)] = find(b)
        groups = {}
        for n in nodes:
            groups.setdefault(find(n), set()).add(n)
        after = {frozenset(g) for g in groups.values()}
        held = {}
        for g in sorted(after, key=min):
            inner = [p for p in parts if p <= g]
            kids = [alive[p] for p in inner if p in alive]
            if len(inner) == 1:
                if kids:
                    held[g] = kids[0]
                continue
            new = set().union(*(p for p in inner if p not in alive))
            if len(kids) == 1:
                kids[0]["joins"] |= dict.fromkeys(new, w)
                held[g] = kids[0]
            elif kids or sum(nodes[n] for n in g) >= least:
                for c in kids:
                    c["death"] = w
                joins = {n: w for n in new}
                for c in kids:
                    joins |= c["joins"]
                held[g] = {"birth": w, "death": None, "joins": joins, "in": {n: w for n in g}, "kids": kids}
                done.append(held[g])
        for g, c in held.items():
            c["in"] |= {n: w for n in g if n not in c["in"]}
        alive, parts = held, after
    out = {}
    for c in done:
        lam = lambda r: 1 / (r + 1e-12) if r is not None else 0.0
        stability = sum(nodes[n] * (lam(r) - lam(c["death"])) for n, r in c["in"].items())
        out[frozenset(c["in"])] = (c["birth"], c["death"], stability, {n: c["joins"][n] for n in c["in"]}, [frozenset(x["in"]) for x in c["kids"]])
    return out


def forest_of(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    out = []
    for w, a, b in sorted(edges):
        if find(a) != find(b):
            up[find(a)] = find(b)
            out.append((w, a, b))
    return out


@pytest.mark.parametrize("epsilon", [0.0, 1.5])
def test_condensed_trees_equal_brute_force(spark, epsilon):
    draw = random.Random(4)
    rows, masses, want = [], [], {}
    for c in range(6):
        nodes = {f"{i:02d}": draw.choice([0.5, 1.0, 2.0]) for i in range(draw.randint(2, 14))}
        edges = forest_of(nodes, [(float(draw.randint(1, 9)), a, b) for a, b in itertools.combinations(nodes, 2)])
        rows += [(c, a, b, w) for w, a, b in edges]
        masses += [(c, n, m) for n, m in nodes.items()]
        want[c] = naive_tree(nodes, edges, 2.0, epsilon)
    tree = cut(condense.condensed_tree(spark.createDataFrame(rows, "cloud long, u string, v string, weight double"), spark.createDataFrame(masses, "cloud long, node string, mass double"), 2.0, epsilon))
    got = {c: {} for c in want}
    for r in tree.collect():
        members = r.members.split(",")
        got[r.cloud][frozenset(members)] = (r.birth, r.death, r.stability, dict(zip(members, map(float, r.joins.split(",")))))
    for c, clusters in want.items():
        assert set(got[c]) == set(clusters)
        for key, (birth, death, stability, joins, _) in clusters.items():
            a, b, s, j = got[c][key]
            assert (a, b) == (pytest.approx(1 / (birth + 1e-12)), pytest.approx(1 / (death + 1e-12) if death else 0)) and s == pytest.approx(stability) and j == joins
    stable = {(r.cloud, frozenset(r.members.split(","))) for r in condense.select_stable(tree).collect()}
    for c, clusters in want.items():
        best = {}

        def value(key):
            kids = clusters[key][4]
            below = sum(value(x)[0] for x in kids)
            if not kids or clusters[key][2] >= below - 1e-9:
                best[key] = (clusters[key][2], {key})
            else:
                best[key] = (below, set().union(*(best[x][1] for x in kids)))
            return best[key]

        roots = [k for k in clusters if clusters[k][1] is None]
        assert {k for cloud, k in stable if cloud == c} == set().union(*(value(k)[1] for k in roots), set())
    at = 4.0
    cuts = {(r.cloud, frozenset(r.members.split(","))) for r in condense.select_cut(tree, at).collect()}
    assert cuts == {(c, frozenset(n for n, r in x[3].items() if r <= at)) for c, clusters in want.items() for x in clusters.values() if x[0] <= at and (x[1] is None or x[1] > at)}


def test_a_cut_leaves_out_who_joins_later(spark):
    edges = spark.createDataFrame([(0, "0", "1", 1.0), (0, "1", "2", 10.0), (0, "3", "4", 1.0), (0, "2", "3", 20.0)], "cloud long, u string, v string, weight double")
    tree = cut(condense.condensed_tree(edges, spark.createDataFrame([(0, str(i), 1.0) for i in range(5)], "cloud long, node string, mass double"), 2.0))
    assert sorted(r.members for r in condense.select_cut(tree, 5.0).collect()) == ["0,1", "3,4"]
    assert sorted(r.members for r in condense.select_cut(tree, 10.0).collect()) == ["0,1,2", "3,4"]
    assert condense.select_cut(tree, 0.5).count() == 0
    layout = {r.node: (r.start, r.own_end, r.end, r.points) for r in condense.tree_layout(tree).collect()}
    assert layout == {2: (0, 0, 5, []), 0: (0, 3, 3, [0, 1, 2]), 1: (3, 5, 5, [3, 4])} or len(layout) == 3 and sum(len(x[3]) for x in layout.values()) == 5
    split = condense.select_split(tree, lambda points, parts: len(parts) == 2 and sorted(map(len, parts)) == [2, 3], keep=lambda *_: True)
    assert sorted(r.members for r in split.collect()) == ["0,1,2", "3,4"]
    none = condense.select_split(tree, lambda points, parts: False, keep=lambda *_: True)
    assert [r.members for r in none.collect()] == ["0,1,2,3,4"]


def naive_faces(points, most):
    """Labels of points by the faces of triangles, with plain loops; clusters as point sets."""
    dist = {(a, b): sum((x - y) ** 2 for x, y in zip(points[a], points[b])) for a, b in itertools.combinations(range(len(points)), 2)}
    tri = [(t, max(dist[p] for p in itertools.combinations(t, 2))) for t in itertools.combinations(range(len(points)), 3) if all(dist[p] <= most for p in itertools.combinations(t, 2))]
    s, edges = {}, {}
    for t, w in tri:
        faces = [t[:i] + t[i + 1 :] for i in range(3)]
        for f in faces:
            s[f] = s.get(f, 0) + 1 / w
        for f, g in zip(faces, faces[1:]):
            a, b = sorted((" ".join(map(str, f)), " ".join(map(str, g))))
            edges[a, b] = min(w, edges.get((a, b), math.inf))
    total = {}
    for f, x in s.items():
        for p in f:
            total[p] = total.get(p, 0) + x
    mass = {" ".join(map(str, f)): x * sum(1 / total[p] for p in f) for f, x in s.items()}
    return {" ".join(map(str, f)): x for f, x in s.items()}, mass, forest_of(mass, [(float(w), a, b) for (a, b), w in edges.items()])


def test_clusterer_by_faces_equals_brute_force(spark):
    draw = random.Random(9)
    clouds = []
    for _ in range(3):
        centres = [(draw.randint(0, 40), draw.randint(0, 40), draw.randint(0, 40)) for _ in range(2)]
        clouds.append(list(dict.fromkeys(tuple(c + draw.randint(-4, 4) for c in draw.choice(centres)) for _ in range(14))))
    rows = [(k, i, *p) for k, c in enumerate(clouds) for i, p in enumerate(c)]
    points = spark.createDataFrame(rows, "cloud long, id long, x long, y long, z long")
    model = HypergraphClusterer(complex="rips", most_squared=120, least_mass=3.0).fit(points)
    for method in ("eom", "leaf", 40.0):
        labels = model.refine_clusters(method).collect()
        for k, c in enumerate(clouds):
            s, mass, forest = naive_faces(c, 120)
            tree = naive_tree(mass, forest, 3.0, 0.0)
            if method == "leaf":
                chosen = [key for key, x in tree.items() if not x[4]]
            elif method == "eom":
                def best(key):
                    kids = tree[key][4]
                    below = [best(x) for x in kids]
                    if not kids or tree[key][2] >= sum(b[0] for b in below):
                        return tree[key][2], [key]
                    return sum(b[0] for b in below), [x for b in below for x in b[1]]

                chosen = [x for key in tree if tree[key][1] is None for x in best(key)[1]]
            else:
                chosen = [frozenset(n for n, r in x[3].items() if r <= method) for x in tree.values() if x[0] <= method and (x[1] is None or x[1] > method)]
            votes = {}
            for j, members in enumerate(chosen):
                for f in members:
                    for p in map(int, f.split()):
                        votes.setdefault(p, {}).setdefault(j, 0.0)
                        votes[p][j] += s[f]
            got = {r.id: r.label for r in labels if r.cloud == k}
            assert {p for p, x in got.items() if x >= 0} == set(votes)
            for p, q in itertools.combinations(sorted(votes), 2):
                tops = [sorted(votes[x].values())[-2:] for x in (p, q)]
                if all(len(t) < 2 or t[1] - t[0] > 1e-6 for t in tops):
                    assert (got[p] == got[q]) == (max(votes[p], key=votes[p].get) == max(votes[q], key=votes[q].get))
    full = HypergraphClusterer(complex="rips", most_squared=120, least_mass=3.0, label_all=True).fit_predict(points).collect()
    assert len(full) == len(rows) and all(r.label >= 0 for r in full)
    weighed = HypergraphClusterer(complex="orderk_delaunay", least_mass=2.0, weigh=lambda t: t.withColumn("w2", F.lit(1.0))).fit_predict(points)
    assert weighed.count() == len(rows)
    assert HypergraphClusterer(complex="rips", most_squared=120).fit_predict(points.where("false")).count() == 0


def sphere(points):
    """Centre and squared radius of the sphere through four points, or None."""
    e = np.asarray([[b - a for a, b in zip(points[0], p)] for p in points[1:]], float)
    if abs(np.linalg.det(e)) < 1e-9:
        return None
    c = np.linalg.solve(2 * e, (e * e).sum(axis=1))
    return c + np.asarray(points[0]), float(c @ c)


@pytest.mark.parametrize("k", [1, 2, 3])
def test_mosaics_equal_brute_force(spark, k):
    draw = random.Random(k)
    points = list(dict.fromkeys(tuple(draw.randint(0, 50) for _ in range(3)) for _ in range(11)))
    want = set()
    for t in itertools.combinations(range(len(points)), 4):
        ball = sphere([points[i] for i in t])
        if ball:
            gap = [((np.asarray(p) - ball[0]) ** 2).sum() - ball[1] for p in points]
            inside = [i for i, g in enumerate(gap) if g < -1e-7 and i not in t]
            for u in range(2, 5):
                if len(inside) + u == k + 1:
                    want |= {tuple(sorted([*inside, *s])) for s in itertools.combinations(t, u)}
    got = polytopes.orderk_delaunay(table(spark, points), k).collect()
    assert {tuple(r.label) for r in got} == want and len(got) == len(want)
    for r in got:
        assert r.num / r.den == pytest.approx(float(level(points, r.label)))


def test_descents_and_logs(spark):
    draw = random.Random(8)
    points = list(dict.fromkeys(tuple(draw.randint(-9, 9) for _ in range(3)) for _ in range(8)))
    t = table(spark, points)
    found = cut(hierarchy.supports(t, 2))
    steps = cut(journals.descents(hierarchy.miniballs(hierarchy.k_subsets(t, 2), found), found, t))
    nxt = {}
    for r in steps.collect():
        centre = next(c for s, c, r2 in supports(points) if set(s) == set(r.label))
        near = sorted((d2(centre, p), i) for i, p in enumerate(points))[:2]
        assert tuple(r.successor) == tuple(sorted(i for _, i in near))
        nxt[",".join(map(str, r.label))] = ",".join(map(str, r.successor))
    for r in journals.descent_closure(steps).collect():
        at, n = r.label, 0
        while nxt[at] != at:
            at, n = nxt[at], n + 1
        assert (r.terminal, r.steps) == (at, n)
    f, c = (cut(x) for x in hierarchy.gamma_filtration(t, 2))
    log = cut(journals.facet_log(f, c))
    for at in (5, 20, 60):
        want = {r.facet: r.component for r in hierarchy.gamma_cut(f, c, at).collect()}
        assert {r.facet: r.component for r in journals.as_of(log, at).collect()} == want
    assert journals.partition_gaps(f, journals.coface_relations(c), journals.coface_relations(c)).where("differing > 0").count() == 0


def test_levels_that_share_a_double_are_told_apart(spark):
    fib = [1, 1]
    while len(fib) < 61:
        fib.append(fib[-1] + fib[-2])
    a, b = (fib[60], fib[59]), (fib[58], fib[57])  # neighbours of the golden ratio, 1e-24 apart
    assert a[0] / a[1] == b[0] / b[1] and a[0] * b[1] != b[0] * a[1]
    rows = spark.createDataFrame([(1, *a), (2, *b), (3, 1, 3), (4, 2, 6)], "k long, num long, den long")
    got = [r.k for r in rows.orderBy(hierarchy.level(), "k").collect()]
    assert got == [3, 4, *((1, 2) if a[0] * b[1] < b[0] * a[1] else (2, 1))]
    import duckdb

    from lodestrata.functions import exact

    sql = f"SELECT k FROM (VALUES (1, {a[0]}, {a[1]}), (2, {b[0]}, {b[1]}), (3, 1, 3), (4, 2, 6)) t(k, num, den) ORDER BY {exact.level_order_sql()}, k"
    assert [k for (k,) in duckdb.sql(sql).fetchall()] == got


def test_trees_and_nearest_others_down_a_tree_of_boxes(spark):
    from lodestrata.operators import bounded, graph

    draw = random.Random(2)
    points = list(dict.fromkeys(tuple(draw.randint(0, 60) + 200 * (i % 2) for _ in range(3)) for i in range(300)))
    rows = [(c, i, *p) for c in (0, 1, 2) for i, p in enumerate(points[: (20, 300, 1)[c]])]
    t = spark.createDataFrame(rows, "cloud long, id long, x long, y long, z long").cache()
    pairs = [(c, i, j, d2(p, q)) for c, i, *p in rows for k, j, *q in rows if k == c and i < j]
    all_ = spark.createDataFrame(pairs, "cloud long, u long, v long, weight long")
    want = {tuple(r) for r in graph.spanning_forest(t.select("cloud", F.col("id").alias("node")), all_).select("cloud", "u", "v", "weight").collect()}
    assert {tuple(r) for r in spatial.spanning_tree(t).select("cloud", "u", "v", "weight").collect()} == want and len(want) == len(rows) - 3
    for part in (None, lambda i: i % 3, lambda i: 0):
        given = t if part is None else t.withColumn("part", F.col("id") % 3 if part(1) else F.lit(0))
        near = {(r.cloud, r.q): (r.d2, r.p) for r in bounded.nearest_by_tree(given, part and "part").collect()}
        for c, i, *p in rows:
            others = [(d2(p, q), j) for d, j, *q in rows if d == c and (j != i if part is None else part(j) != part(i))]
            assert near.get((c, i)) == min(others, default=None)


def test_balls_and_boxes_of_all_sizes(spark):
    draw = random.Random(8)
    points = [(c, i, *(draw.randint(-40, 40) for _ in range(3))) for c in (0, 1) for i in range(60)]
    p = spark.createDataFrame(points, "cloud long, id long, x long, y long, z long")
    balls = [(c, b, *(draw.randint(-60, 60) for _ in range(3)), draw.choice([0, 1, 9, 400, 10_000])) for c in (0, 1) for b in range(40)]
    got = {(r.cloud, r.ball): (r.interior, r.shell, r.exterior, r.closed) for r in spatial.closed_balls(p, spark.createDataFrame(balls, "cloud long, ball long, x long, y long, z long, r2 long")).collect()}
    for c, b, *m, r2 in balls:
        far = {i: d2(m, q) for k, i, *q in points if k == c}
        assert got[c, b] == (sum(d < r2 for d in far.values()), sum(d == r2 for d in far.values()), sum(d > r2 for d in far.values()), ",".join(str(i) for i in sorted(far) if far[i] <= r2))
    boxes = [(c, b, *(x for lo in (draw.randint(-50, 50) for _ in range(3)) for x in (lo, lo + draw.choice([0, 1, 3, 20, 70])))) for c in (0, 1) for b in range(40)]
    t = spark.createDataFrame(boxes, "cloud long, box long, lox long, hix long, loy long, hiy long, loz long, hiz long")
    meet = lambda a, b: all(a[2 + 2 * k] <= b[3 + 2 * k] and b[2 + 2 * k] <= a[3 + 2 * k] for k in range(3))
    assert sorted(map(tuple, spatial.overlapping_boxes(t).collect())) == sorted((a[0], a[1], b[1]) for a in boxes for b in boxes if a[0] == b[0] and a[1] < b[1] and meet(a, b))
    held = {(r.cloud, r.id): r.box for r in spatial.in_boxes(p, t).collect()}
    for c, i, *q in points:
        assert held[c, i] == max((b[1] for b in boxes if b[0] == c and all(b[2 + 2 * k] <= q[k] <= b[3 + 2 * k] for k in range(3))), default=-1)


def test_hulls():
    square, line, dot = (arrays.convex_hull(np.asarray(p)) for p in ([(0, 0), (4, 0), (4, 4), (0, 4), (2, 2)], [(5, 5), (9, 9), (7, 7)], [(4, 4)]))
    assert len(square) == 4 and line.tolist() == [[5, 5], [9, 9]]
    assert arrays.hulls_meet(square, dot) and not arrays.hulls_meet(square, line) and not arrays.hulls_meet(line, dot)
    assert not arrays.hulls_meet(line, arrays.convex_hull(np.asarray([(10, 10), (12, 12)])))


def test_point_files(tmp_path):
    raw = b"ply\nformat binary_big_endian 1.0\nelement vertex 1\nproperty uchar c\nproperty float x\nproperty double y\nproperty short z\nelement face 0\nproperty list uchar int vertex_index\nend_header\n"
    import struct

    got = stores.from_ply(raw + struct.pack(">Bfdh", 7, 1.5, 2.5, -3))
    assert got.values.tolist() == [[0, 1.5, 2.5, -3]]
    with pytest.raises(ValueError, match="not a ply"):
        stores.from_ply(b"OFF\n")
    import pandas as pd

    chunk = stores.encode_chunk(pd.DataFrame({"a": [1, 2], "b": [3, 4]}))
    assert stores.decode_chunk(chunk).tolist() == [[1, 3], [2, 4]]
    for bad in (chunk[:-1], chunk[:20] + b"y" + chunk[21:], b"", b"XXXX" + chunk[4:]):
        with pytest.raises(ValueError):
            stores.decode_chunk(bad)
    with pytest.raises(ValueError, match="too large"):
        stores.decode_chunk(chunk, most_bytes=8)


def test_runs_are_committed_whole(spark, tmp_path):
    base = f"file://{tmp_path}/store"
    rows = spark.createDataFrame([(1,), (2,)], "k long")
    store = stores.RunStore(spark, base)
    assert store.read("k long").count() == 0 and store.commit("a", rows) and not store.commit("a", rows)
    rows.write.parquet(f"{base}/runs/dead-job")  # written, never committed
    with pytest.raises(ValueError, match="refused"):
        stores.RunStore(spark, base, recertify=lambda run: run.count() > 5).commit("b", rows)
    assert store.commit("c", rows.where("k = 2")) and sorted(r.k for r in store.read("k long").collect()) == [1, 2, 2]
    assert [e["name"] for e in store.log()] == ["a", "c"]
    first = tmp_path / "store" / "log" / "00000000.json"
    first.write_text(first.read_text().replace('"rows": 2', '"rows": 3'))
    with pytest.raises(ValueError, match="doesn't follow"):
        store.log()


def test_a_stream_that_dies_is_resumed_without_loss_or_repeat(spark, tmp_path):
    for k in range(4):
        spark.createDataFrame([(k * 10 + i,) for i in range(10)], "n long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("n long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def run(fail_at):
        def commit(batch, number):
            if number == fail_at:
                batch.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={number}"))
                raise RuntimeError("lost")
            batch.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={number}"))

        q = stream().writeStream.foreachBatch(commit).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()

    with pytest.raises(Exception, match="lost"):
        run(2)
    run(None)
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(40))


def test_verifier_stays_poisoned_across_batches(spark, tmp_path):
    rows = [[("a", 1, False), ("b", 1, True)], [("a", 2, False), ("b", 2, False)], [("a", 3, True), ("a", 4, False), ("b", 3, True)]]
    schema = "key string, number long, bad boolean"
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    import os

    for k, name in enumerate(sorted((tmp_path / "in").glob("*.parquet"), key=os.path.getmtime)):
        os.utime(name, (k, k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r.key, r.number): r.status for r in frames.run_to_table(frames.verify_stream(stream), "verified").collect()}
    assert got == {("a", 1): "verified", ("a", 2): "verified", ("a", 3): "failed", ("a", 4): "poisoned", ("b", 1): "failed", ("b", 2): "poisoned", ("b", 3): "poisoned"}


def test_tracks_in_space(spark, tmp_path):
    draw = random.Random(1)
    rows, n = [], 0
    for key, objects in (("a", 3), ("b", 2)):
        starts = [(40.0 * o, 0.0, 5.0 * o) for o in range(objects)]
        for f in range(12):
            for o, (x, y, z) in enumerate(starts):
                if not (key == "a" and o == 1 and f in (6, 7)):
                    rows.append((key, f, n, x + 2 * f + draw.uniform(-0.2, 0.2), y - f + draw.uniform(-0.2, 0.2), z))
                    n += 1
    schema = "key string, frame long, detection long, x double, y double, z double"
    table_ = spark.createDataFrame(rows, schema)
    batch = tracking.track_batch(table_, 6.0, 1.0).collect()
    of = {r.detection: r.track for r in batch}
    for key, objects in (("a", 3), ("b", 2)):
        own = [r for r in rows if r[0] == key]
        for o in range(objects):
            ids = {of[r[2]] for r in own if round((r[3] - 2 * r[1]) / 40) == o}
            assert len(ids) == 1
        assert len({of[r[2]] for r in own}) == objects
    tracks = tracking.Tracks(born=0)
    tracks.step(np.asarray([[0.0, 0, 0]]), 6.0, 1.0)
    tracks.place[0, 3:] = (100, 0, 0)
    tracks.predict(1.0)
    assert np.linalg.norm(tracks.place[0, 3:]) == pytest.approx(35.0)
    lone = tracking.Tracks()
    for seen in ([[0.0, 0, 0]], [], [[0.0, 0, 0]]):
        ids = lone.step(np.asarray(seen).reshape(-1, 3), 6.0, 1.0)
    assert ids.tolist() == [1]  # a track that isn't confirmed doesn't survive a frame unseen
    import os

    for f in range(0, 12, 4):
        spark.createDataFrame([r for r in rows if f <= r[1] < f + 4], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for k, name in enumerate(sorted((tmp_path / "in").glob("*.parquet"), key=os.path.getmtime)):
        os.utime(name, (k, k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = frames.run_to_table(tracking.track_stream(stream, 6.0, 1.0), "tracks").collect()
    assert {r.detection: r.track for r in got} == of
    assert tracking.track_batch(table_.where("false"), 6.0, 1.0).count() == 0


def test_engines_and_balls_can_be_replaced(spark):
    draw = random.Random(6)
    t = table(spark, list(dict.fromkeys(tuple(draw.randint(-9, 9) for _ in range(3)) for _ in range(6))))
    asked = []

    class Counting(hierarchy.Engine):
        def order(self, points, k):
            asked.append(k)
            return hierarchy.gamma_filtration(points, k, ball=lambda labels, balls: asked.append("ball") or hierarchy.miniballs(labels, balls))

    own, other = (hierarchy.run_oracle(t, 3, 30, e).collect() for e in (None, Counting()))
    assert own == other and asked.count(1) == asked.count(2) == 1 and asked.count("ball") == 4 and own[0].points == 6 and own[0].maps_sound
