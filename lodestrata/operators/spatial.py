"""Neighbourhoods in clouds: grid joins within a radius, exact nearest neighbours with ties, balls and boxes."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exact
from .graph import components
from .lineage import cut, dealt, spread


def pairs_within(points: DataFrame, squared: int, other: DataFrame | None = None, offsets: bool = False) -> DataFrame:
    """``cloud, u, v, d2`` of all pairs u < v (or of points u and ``other`` v) with squared distance <= ``squared``; with
    ``offsets`` also ``dx, dy, dz``, from u to v.

    Points fall into grid cells as wide as the radius; a point meets its own and the 26 cells around, so the
    join is an equi-join on (cloud, cell) and each pair is made once, whatever its cells.
    """
    side = max(1, math.isqrt(max(squared, 1) - 1) + 1)
    cell = [F.floor(F.col(c) / side).cast("long").alias(f"c{c}") for c in "xyz"]
    shifts = F.array(*(F.lit(d).cast("long") for d in (-1, 0, 1)))
    a = points.select("cloud", F.col("id").alias("u"), *(F.col(c).alias(f"u_{c}") for c in "xyz"), *cell)
    for c in "xyz":
        a = a.withColumn(f"d{c}", F.explode(shifts)).withColumn(f"c{c}", F.col(f"c{c}") + F.col(f"d{c}")).drop(f"d{c}")
    b = (other if other is not None else points).select("cloud", F.col("id").alias("v"), *(F.col(c).alias(f"v_{c}") for c in "xyz"), *cell)
    met = dealt(a).join(b, ["cloud", "cx", "cy", "cz"]).where("true" if other is not None else "u < v").withColumn("d2", F.expr(exact.squared_distance("u", "v")))
    return met.where(F.col("d2") <= squared).select("cloud", "u", "v", "d2", *((F.col(f"v_{c}") - F.col(f"u_{c}")).alias(f"d{c}") for c in "xyz" if offsets))


#: Cells along a side of a block of :func:`near_links`, points of a block of :func:`pair_sums`, entries of a table of pairs.
BLOCK, POINTS, TABLE = 4, 2048, 1 << 20


def _meet(a: np.ndarray, b: np.ndarray, squared: int) -> bool:
    """Whether a point of ``a`` and one of ``b`` are within the distance; those that face each other come first."""
    outside = lambda p, q: (np.maximum(np.maximum(q.min(axis=0) - p, p - q.max(axis=0)), 0) ** 2).sum(axis=1)
    far_a, far_b = outside(a, b), outside(b, a)
    a, b = (p[np.argsort(far, kind="stable")[: (far <= squared).sum()]] for p, far in ((a, far_a), (b, far_b)))
    lo, step = 0, 32
    while lo < len(a):
        for k in range(0, len(b), wide := max(1, TABLE // step)):
            if (((a[lo : lo + step, None] - b[None, k : k + wide]) ** 2).sum(axis=2) <= squared).any():
                return True
        lo, step = lo + step, min(1024, 2 * step)
    return False


def near_links(points: DataFrame, squared: int) -> DataFrame:
    """``cloud, u, v`` of few pairs that connect what all pairs within the squared distance connect, and nothing else.

    Cells are so small that all points of one are within the distance: each is linked with the first of its cell, and two cells by one
    link if any of their points are within it.  A block of cells and those around it are a group; a cell is never in two parts."""
    if squared < 0:
        return points.select("cloud", F.col("id").alias("u"), F.col("id").alias("v")).where("false")
    side = math.isqrt(squared // 3) + 1
    around = (max(math.isqrt(squared), 1) - 1) // side + 1  # cells between points within the distance
    p = points.where("cloud IS NOT NULL").select("cloud", "id", *"xyz", *(F.floor(F.col(c) / side).cast("long").alias(f"c{c}") for c in "xyz"))
    for c in "xyz":
        low = 0 if c == "x" else around  # a pair of cells belongs to the one that comes first
        ends = [F.floor((F.col(f"c{c}") - around) / BLOCK).cast("long"), F.floor((F.col(f"c{c}") + low) / BLOCK).cast("long")]
        p = p.withColumn(f"b{c}", F.explode(F.sequence(*ends)))

    def run(table: pa.Table) -> pa.Table:
        column = lambda *names: np.stack([table.column(n).to_numpy() for n in names], axis=1)
        ids, at, block = table.column("id").to_numpy(), column(*"xyz"), column("bx", "by", "bz")[0]
        cells, of = np.unique(column("cx", "cy", "cz"), axis=0, return_inverse=True)
        order = np.lexsort((ids, of.ravel()))
        ends = np.searchsorted(of.ravel()[order], np.arange(len(cells) + 1))
        held = [order[lo:hi] for lo, hi in zip(ends[:-1], ends[1:], strict=True)]
        own = (cells // BLOCK == block).all(axis=1)
        u = [np.repeat(ids[held[i][0]], len(held[i]) - 1) for i in np.flatnonzero(own)]
        v = [ids[held[i][1:]] for i in np.flatnonzero(own)]
        root = list(range(len(cells)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i in np.flatnonzero(own):
            gap = cells[i + 1 :] - cells[i]  # cells are sorted
            gap = gap[: np.searchsorted(gap[:, 0], around, "right")]
            for j in i + 1 + np.flatnonzero((np.abs(gap) <= around).all(axis=1)):
                if find(i) != find(j) and _meet(at[held[i]], at[held[j]], squared):
                    root[find(j)] = find(i)
                    u.append(ids[held[i][:1]])
                    v.append(ids[held[j][:1]])
        u, v = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (u, v))
        return pa.table({"cloud": pa.repeat(pa.scalar(table.column("cloud")[0].as_py(), pa.int64()), len(u)), "u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return dealt(p).groupBy("cloud", "bx", "by", "bz").applyInArrow(run, "cloud long, u long, v long")


def pair_sums(points: DataFrame) -> DataFrame:
    """``cloud, u, later, total, least``: of every point that later ones follow their number, and the sum and the least of the squared distances.

    All pairs are looked at, a block of points by a block of later ones at a time, so a large cloud is many groups and no pair is a row.  Ids are
    numbered from 0 in their cloud."""
    n = points.groupBy("cloud").agg(F.floor((F.count("*") - 1) / POINTS).alias("last"))
    p = points.join(n, "cloud").select("cloud", "id", *"xyz", F.floor(F.col("id") / POINTS).alias("block"), "last")
    zero = F.lit(0).cast("long")
    early = p.select("cloud", "id", *"xyz", F.col("block").alias("i"), F.explode(F.sequence("block", "last")).alias("j"), F.lit(True).alias("early"))
    late = p.select("cloud", "id", *"xyz", F.explode(F.sequence(zero, "block")).alias("i"), F.col("block").alias("j"), F.lit(False).alias("early"))

    def run(table: pa.Table) -> pa.Table:
        ids, at = table.column("id").to_numpy(), np.stack([table.column(c).to_numpy() for c in "xyz"], axis=1)
        first = table.column("early").to_numpy(zero_copy_only=False)
        u, a, v, b = ids[first], at[first], ids[~first], at[~first]
        later, total, least = (np.zeros(len(u), np.int64) for _ in range(3))
        for lo in range(0, len(u), step := max(1, TABLE // max(1, len(v)))):
            k = slice(lo, lo + step)
            d2 = sum((a[k, None, c] - b[None, :, c]) ** 2 for c in range(3))
            on = v[None] > u[k, None]
            later[k], total[k], least[k] = on.sum(axis=1), (d2 * on).sum(axis=1), np.where(on, d2, np.iinfo(np.int64).max).min(axis=1)
        some = later > 0
        cloud = pa.repeat(pa.scalar(table.column("cloud")[0].as_py(), pa.int64()), int(some.sum()))
        return pa.table({"cloud": cloud, "u": u[some], "later": later[some], "total": total[some], "least": least[some]})

    parts = spread(early.unionByName(late), "cloud", "i", "j").groupBy("cloud", "i", "j").applyInArrow(run, "cloud long, u long, later long, total long, least long")
    return parts.groupBy("cloud", "u").agg(F.sum("later").alias("later"), F.sum("total").alias("total"), F.min("least").alias("least"))


def cut_order_one(points: DataFrame, squared_level: int) -> DataFrame:
    """The order-1 cut: components of points whose balls of the level meet (squared distance <= 4 level), closed."""
    labels = components(points.select("cloud", F.col("id").alias("node")), near_links(points, 4 * squared_level))
    return labels.groupBy("cloud", "component").agg(F.count("*").alias("size"), F.array_join(F.array_sort(F.collect_list("node")), ",").alias("members"))


def nearest(points: DataFrame, k: int, queries: DataFrame | None = None) -> DataFrame:
    """The k nearest others of each query with every tie at the cutoff: ``cloud, q, p, d2, rank, choice``.

    ``rank`` is shared by ties, ``choice`` numbers the canonical order (d2, id).  Every pair of a cloud is
    looked at, so nothing is missed; a cloud should be a group of bounded size or use :func:`nearest_grid`.
    """
    q = (queries if queries is not None else points).select("cloud", F.col("id").alias("q"), *(F.col(c).alias(f"q_{c}") for c in "xyz"))
    p = points.select("cloud", F.col("id").alias("p"), *(F.col(c).alias(f"p_{c}") for c in "xyz"))
    met = q.join(p, "cloud").where("true" if queries is not None else "q <> p").withColumn("d2", F.expr(exact.squared_distance("q", "p")))
    own = Window.partitionBy("cloud", "q")
    ranked = met.select("cloud", "q", "p", "d2", F.rank().over(own.orderBy("d2")).alias("rank"), F.row_number().over(own.orderBy("d2", "p")).alias("choice"))
    return ranked.where(F.col("rank") <= k)


def nearest_grid(points: DataFrame, k: int, first_squared: int, queries: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """:func:`nearest` by grid joins: a radius that doubles for the points that don't yet see k others.

    A point with at least k others within the radius has its k nearest, ties included, inside it: exact, whatever the first radius.  That
    is ``first_squared``, or less where points lie so dense that about k are nearer.
    Points whose cloud has too few others stop once the radius spans the cloud, or passes ``most`` (squared).
    """
    both = points if queries is None else points.select("cloud", *"xyz").unionByName(queries.select("cloud", *"xyz"))
    span = [int(s or 0) for s in both.agg(*(F.max(c) - F.min(c) for c in "xyz")).first()]
    limit = sum(s**2 for s in span) if most is None else min(most, sum(s**2 for s in span))
    n = points.groupBy("cloud").count().agg(F.max("count")).first()[0] or 1
    dense = math.ceil((math.prod(s + 1 for s in span) / n * k * 3 / (4 * math.pi)) ** (2 / 3))
    found, left, radius = None, points if queries is None else queries, min(first_squared, dense, limit)
    while True:
        near = pairs_within(left, radius, other=points)
        near = near.where("u <> v") if queries is None else near
        own = Window.partitionBy("cloud", "u")
        ranked = near.withColumns({"n": F.count("*").over(own), "rank": F.rank().over(own.orderBy("d2")), "choice": F.row_number().over(own.orderBy("d2", "v"))})
        done = ranked.where((F.col("n") >= k) | F.lit(radius >= limit)).where(F.col("rank") <= k).select("cloud", F.col("u").alias("q"), F.col("v").alias("p"), "d2", "rank", "choice")
        done = cut(done, "near")
        found = done if found is None else found.unionAll(done)
        if radius >= limit:
            return found
        left = cut(left.join(done.select("cloud", F.col("q").alias("id")).distinct(), ["cloud", "id"], "left_anti"), "left")
        if not left.limit(1).count():
            return found
        radius = min(radius * 4, limit)


def nearest_budgeted(points: DataFrame, k: int, squared: int) -> DataFrame:
    """Per point its k nearest others as far as one look within a radius goes: ``cloud, q, found, farthest, status``.

    ``complete``: the k nearest (ties aside) lie within the radius, and ``farthest`` is the exact cutoff; ``exhausted``: the
    radius shows fewer, all of which are counted."""
    seen = nearest_grid(points, k, squared, most=squared).where(F.col("choice") <= k).groupBy("cloud", "q").agg(F.count("*").alias("found"), F.max("d2").alias("farthest"))
    out = points.select("cloud", F.col("id").alias("q")).join(seen, ["cloud", "q"], "left")
    return out.select("cloud", "q", F.coalesce("found", F.lit(0)).cast("long").alias("found"), "farthest", F.when(F.col("found") >= k, "complete").otherwise("exhausted").alias("status"))


def spanning_tree(points: DataFrame) -> DataFrame:
    """The Euclidean minimum spanning tree of every cloud under (d2, u, v): ``cloud, u, v, weight``.

    No edge of it has a point strictly inside the ball over it, as two shorter edges would go around; so the pairs are
    those that a descent with empty balls leaves, about as many as points, and the tree is their minimum forest."""
    from .bounded import descend
    from .graph import spanning_forest

    pairs, _ = descend(points, 0, lean=0.0)
    side = lambda n: points.select("cloud", F.col("id").alias(n), *(F.col(c).alias(f"{n}_{c}") for c in "xyz"))
    edges = dealt(dealt(pairs).join(side("u"), ["cloud", "u"])).join(side("v"), ["cloud", "v"]).select("cloud", "u", "v", F.expr(exact.squared_distance("u", "v")).alias("weight"))
    return spanning_forest(points.select("cloud", F.col("id").alias("node")), edges)


def reachability_pairs(points: DataFrame, nth: int) -> DataFrame:
    """``cloud, u, v, d2`` of few pairs that hold every point's ``nth`` nearest others and a minimum forest under the larger of distance
    and both core distances, the nth nearest others being the cores.

    They are those with fewer than ``nth`` points strictly inside the ball over them, and some more.  A point that is nearer than the nth nearest
    has no more within its ball.  With ``nth`` points inside, both ends and each of these have ``nth`` others nearer than the pair is long: the way
    over one of them is shorter in all three respects, so the pair is in no minimum forest."""
    from .bounded import descend

    pairs, _ = descend(points, nth - 1, lean=0.0)
    side = lambda n: points.select("cloud", F.col("id").alias(n), *(F.col(c).alias(f"{n}_{c}") for c in "xyz"))
    return dealt(dealt(pairs).join(side("u"), ["cloud", "u"])).join(side("v"), ["cloud", "v"]).select("cloud", "u", "v", F.expr(exact.squared_distance("u", "v")).alias("d2"))


def empty_ball_pairs(points: DataFrame) -> DataFrame:
    """Pairs with no point strictly inside the ball over them: ``cloud, u, v, weight``.  A descent leaves few, and each meets
    the points of the boxes around it."""
    from .bounded import descend, within

    side = lambda n: points.select("cloud", F.col("id").alias(n), *(F.col(c).alias(f"{n}_{c}") for c in "xyz"))
    pairs, _ = descend(points, 0, lean=0.0)
    e = dealt(dealt(pairs).join(side("u"), ["cloud", "u"])).join(side("v"), ["cloud", "v"]).withColumn("weight", F.expr(exact.squared_distance("u", "v")))
    e = e.withColumns({f"m_{c}": F.expr(f"(u_{c} + v_{c}) div 2") for c in "xyz"})
    inside = " + ".join(f"(p.{c} - u_{c}) * (p.{c} - v_{c})" for c in "xyz") + " < 0"  # u and v themselves give 0
    met = within(e, points, "m", "cast(ceil(sqrt(weight) / 2) as bigint) + 1")
    return met.groupBy("cloud", "u", "v", "weight").agg(F.count_if(F.expr(inside)).alias("inside")).where("inside = 0").drop("inside")


def closed_balls(points: DataFrame, balls: DataFrame) -> DataFrame:
    """Per ball ``cloud, ball, x, y, z, r2`` how many points are inside, on and outside, and which are in the closed ball.

    A ball meets the points of the boxes around it that are about as wide as it is; those outside are counted from the rest."""
    from .bounded import within

    b = balls.select("cloud", "ball", *(F.col(c).alias(f"b_{c}") for c in "xyz"), F.col("r2").cast("long").alias("r2"))
    n = points.groupBy("cloud").agg(F.count("*").alias("n"))
    met = within(b, points, "b", "cast(ceil(sqrt(r2)) as bigint)").select("cloud", "ball", *(f"b_{c}" for c in "xyz"), "r2", F.col("p.id").alias("id"), *(F.col(f"p.{c}").alias(f"p_{c}") for c in "xyz"))
    held = met.withColumn("side", F.expr(f"{exact.squared_distance('b', 'p')} - r2")).where("side <= 0").groupBy("cloud", "ball").agg(
        F.count_if(F.col("side") < 0).alias("interior"), F.count_if(F.col("side") == 0).alias("shell"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("closed")
    )
    inner, shell = (F.coalesce(c, F.lit(0).cast("long")) for c in ("interior", "shell"))
    return b.select("cloud", "ball").join(n, "cloud").join(held, ["cloud", "ball"], "left").select("cloud", "ball", inner.alias("interior"), shell.alias("shell"), (F.col("n") - inner - shell).alias("exterior"), F.coalesce("closed", F.lit("")).alias("closed"))


def in_boxes(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Per point the last box (largest number) that holds it, else -1; boxes meet the points of the grid around them."""
    from .bounded import within

    middle = boxes.select("*", *(F.expr(f"lo{c} + (hi{c} - lo{c}) div 2").alias(f"m_{c}") for c in "xyz"))
    reach = f"greatest({', '.join(f'hi{c} - lo{c}' for c in 'xyz')}) div 2 + 1"
    inside = " AND ".join(f"p.{c} BETWEEN lo{c} AND hi{c}" for c in "xyz")
    held = within(middle, points, "m", reach).where(inside).groupBy("cloud", F.col("p.id").alias("id")).agg(F.max("box").alias("box"))
    return points.select("cloud", "id").join(held, ["cloud", "id"], "left").select("cloud", "id", F.coalesce("box", F.lit(-1)).cast("long").alias("box"))


def overlapping_boxes(boxes: DataFrame) -> DataFrame:
    """Pairs u < v of boxes of a cloud that meet (closed), by the three-axis test.

    A box lies in at most eight cells of a grid at least as wide as it is.  Two boxes meet in the grid of the wider one, where the
    narrower one is entered too: an equi-join on grid and cell, whatever the sizes."""
    wide = F.greatest(*(F.col(f"hi{c}") - F.col(f"lo{c}") for c in "xyz"))
    b = boxes.select("cloud", "box", *(f"{e}{c}" for e in ("lo", "hi") for c in "xyz"), F.ceil(F.log2(F.greatest(wide, F.lit(1)).cast("double"))).cast("int").alias("grid"))
    top = b.agg(F.max("grid")).first()[0] or 0

    def entered(t: DataFrame, s: str) -> DataFrame:
        for c in "xyz":
            ends = [F.call_function("shiftright", F.col(f"{e}{c}"), F.col("grid")) for e in ("lo", "hi")]
            t = t.withColumn(f"c{c}", F.explode(F.sequence(*ends)))
        return t.select("cloud", "grid", "cx", "cy", "cz", F.col("box").alias(s), *(F.col(f"{e}{c}").alias(f"{s}{e}{c}") for e in ("lo", "hi") for c in "xyz"))

    a = entered(b, "a")
    all_ = entered(b.withColumn("grid", F.explode(F.sequence(F.col("grid"), F.lit(int(top))))), "b")
    met = a.join(all_, ["cloud", "grid", "cx", "cy", "cz"]).where("a <> b AND " + " AND ".join(f"alo{c} <= bhi{c} AND blo{c} <= ahi{c}" for c in "xyz"))
    return met.select("cloud", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def vote(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """Majority label of each query's neighbours (q, p): ties go to the least label."""
    counted = neighbours.join(labels.select("cloud", F.col("id").alias("p"), "label"), ["cloud", "p"]).groupBy("cloud", "q", "label").agg(F.count("*").alias("votes"))
    best = counted.groupBy("cloud", "q").agg(F.max(F.struct("votes", (-F.col("label")).alias("least"))).alias("b"))
    return best.select("cloud", "q", (-F.col("b.least")).alias("label"), F.col("b.votes").alias("votes"))


def whitened(rows: DataFrame, columns: list[str], names: list[str], digits: int) -> DataFrame:
    """``rows`` with ``columns`` turned to their principal axes and scaled to unit variance, rounded, under ``names``.

    One aggregate gives means and covariances, whose few numbers the driver decomposes; the projection is an expression.  An
    axis's largest part is positive.  Axes without variance give nulls."""
    n = len(columns)
    sums = rows.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)), *(F.covar_pop(a, b).alias(f"c{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j)).first()
    if sums[0] is None:
        return rows.select(*(c for c in rows.columns if c not in columns), *(F.lit(None).cast("double").alias(w) for w in names))
    values, axes = np.linalg.eigh(np.asarray([[sums[f"c{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)]))
    out = []
    for k, name in zip(range(n - 1, -1, -1), names):
        axis = axes[:, k] * np.sign(axes[np.abs(axes[:, k]).argmax(), k])
        turned = sum(((F.col(c) - sums[f"m{i}"]) * float(axis[i]) for i, c in enumerate(columns)), F.lit(0.0))
        out.append((F.round(turned / float(np.sqrt(values[k])), digits) if values[k] > 0 else F.lit(None).cast("double")).alias(name))
    return rows.select(*(c for c in rows.columns if c not in columns), *out)
