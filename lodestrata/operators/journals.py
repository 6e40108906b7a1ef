"""Journals of a filtration: where each facet is at each level, descents of facets, arms of saddles, gateways.

A facet log names, from each level on, the component that holds a facet (by its least facet).  Everything that asks
for a component strictly below or up to a level is an as-of join with it, by exact level keys.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exact
from .cloud import facets
from .hierarchy import NAMES, label_text, level
from .lineage import cut, let, spread

LOG = "cloud long, facet string, num long, den long, component string"


def _log(frame: pd.DataFrame) -> pd.DataFrame:
    """One cloud: a row per facet and level at which the name of its component changes."""
    from fractions import Fraction

    cloud = frame["cloud"].iloc[0]
    rows = sorted((Fraction(int(n), int(d)), kind == "coface", text) for n, d, kind, text in zip(frame["num"], frame["den"], frame["kind"], frame["label"], strict=True))
    root: dict[str, str] = {}
    held: dict[str, list[str]] = {}
    out, k = [], 0

    def find(x: str) -> str:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    while k < len(rows):
        at, named = rows[k][0], {}
        while k < len(rows) and rows[k][0] == at:
            _, coface, text = rows[k]
            k += 1
            if not coface:
                root[text], held[text] = text, [text]
                named[text] = text
                continue
            ids = text.split(",")
            parts = sorted({find(",".join(ids[:i] + ids[i + 1 :])) for i in range(len(ids))})
            for p in parts[1:]:  # the least name stays
                root[p] = parts[0]
                named.update(dict.fromkeys(held[p]))
                held[parts[0]] += held.pop(p)
        out += [(cloud, f, at.numerator, at.denominator, find(f)) for f in named]
    return pd.DataFrame(out, columns=["cloud", "facet", "num", "den", "component"])


def facet_log(found_facets: DataFrame, cofaces: DataFrame) -> DataFrame:
    """``cloud, facet, num, den, component``: from which level on a facet is in which component (its least facet, as
    text).  A cloud is a group: its facets bound the memory."""
    both = found_facets.select("cloud", "num", "den", F.lit("facet").alias("kind"), label_text("label").alias("label")).unionAll(cofaces.select("cloud", "num", "den", F.lit("coface").alias("kind"), label_text("label").alias("label")))
    return both.groupBy("cloud").applyInPandas(_log, LOG)


def located(asked: DataFrame, log: DataFrame, strictly: bool) -> DataFrame:
    """``asked`` (cloud, facet, num, den, ...) with the ``component`` that holds the facet at the level, or strictly
    below it; null where the facet isn't there yet."""
    l = log.select("cloud", "facet", level().alias("since"), "component")
    a = asked.withColumn("at", level())
    met = a.join(l, ["cloud", "facet"], "left")
    inside = F.col("since") < F.col("at") if strictly else F.col("since") <= F.col("at")
    return met.groupBy(*asked.columns).agg(F.max_by(F.when(inside, F.col("component")), F.when(inside, F.col("since"))).alias("component"))


def as_of(log: DataFrame, num: int, den: int = 1) -> DataFrame:
    """The state of the log at a level: ``cloud, facet, component``."""
    upto = log.where(f"num * {den} <= {num} * den")
    return upto.groupBy("cloud", "facet").agg(F.max_by("component", level()).alias("component"))


def descents(balls: DataFrame, found: DataFrame, points: DataFrame) -> DataFrame:
    """Per label its successor: the points nearest to the centre of its ball, as many as it has (ties: least id).

    ``balls`` has the labels with their smallest balls and supports, ``found`` the supports of the cloud.  The successor's ball is never larger; a label
    that is its own successor is terminal.  Distances from the centre are compared by the power of the ball, in integers.
    """
    own = found.drop("num", "den").withColumnRenamed("label", "support")
    p = points.select("cloud", F.col("id").alias("p_id"), *(F.col(c).alias(f"p_{c}") for c in "xyz"))
    met = let(balls.join(own, ["cloud", "support"]).join(p, "cloud"), side=exact.power_sign(list(NAMES), "p"))
    ranked = met.withColumn("place", F.row_number().over(Window.partitionBy("cloud", "label").orderBy("side", "p_id"))).where(F.col("place") <= F.size("label"))
    return ranked.groupBy("cloud", "label", "num", "den", "support").agg(F.array_sort(F.collect_list("p_id")).alias("successor"))


#: Pairs of a group of :func:`pair_descents`, centres that are looked at together, entries of a table of centres by points.
PAIRS, CENTRES, TABLE = 500_000, 256, 1 << 20
_STEP = "cloud long, label array<long>, num long, den long, support array<long>, successor array<long>, place long"
_FALL = "cloud long, label string, successor string, num long, den long, to_num long, to_den long, terminal boolean"
_END = "cloud long, label string, terminal string, steps long"


def nearest_two(centres: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per centre the places of the nearest two of the points ``at`` (ties: the first), sorted; all are integers.

    Centres of one box share what may be near: no point is that lies farther from the middle than the second nearest there and
    twice the centres' distance from it."""
    low, wide = centres.min(axis=0), np.ptp(centres, axis=0) + 1
    side = max(1.0, float((wide.astype(float).prod() * CENTRES / len(centres)) ** (1 / 3)))
    box = np.floor((centres - low) / side).astype(np.int64)
    _, of = np.unique(box, axis=0, return_inverse=True)
    order = np.argsort(of.ravel(), kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(of.ravel()[order]) != 0, True])
    out = np.empty((len(centres), 2), np.int64)
    for lo, hi in zip(starts[:-1], starts[1:], strict=True):
        own = order[lo:hi]
        c = centres[own]
        middle = c.mean(axis=0)
        off = np.sqrt(((at - middle) ** 2).sum(axis=1))
        reach = np.partition(off, 1)[1] + 2 * np.sqrt(((c - middle) ** 2).sum(axis=1).max())
        near = np.flatnonzero(off <= reach * (1 + 1e-9) + 1e-6)
        for k in range(0, len(own), step := max(1, TABLE // len(near))):
            d2 = ((c[k : k + step, None, :] - at[near][None]) ** 2).sum(axis=2)
            rows = np.arange(len(d2))
            first = d2.argmin(axis=1)
            d2[rows, first] = np.iinfo(np.int64).max
            out[own[k : k + step]] = np.sort(near[np.stack([first, d2.argmin(axis=1)], axis=1)], axis=1)
    return out


def _sorted_points(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, places and the order of a table's points by id."""
    order = np.argsort(table.column("id").to_numpy(), kind="stable")
    return table.column("id").to_numpy()[order], np.stack([table.column(c).to_numpy() for c in "xyz"], axis=1)[order], order


def _own_pairs(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids and places of a lot's points, the places ``u, v`` of its own pairs, and of each pair those of the nearest two."""
    ids, at, order = _sorted_points(table)
    own, n = table.column("own").to_numpy(zero_copy_only=False)[order], len(ids)
    firsts = np.flatnonzero(own)
    firsts = firsts[firsts < n - 1]
    u = np.repeat(firsts, n - 1 - firsts)
    begin = np.repeat(np.cumsum(n - 1 - firsts) - (n - 1 - firsts), n - 1 - firsts)
    v = u + 1 + np.arange(len(u)) - begin
    return ids, at, u, v, nearest_two(at[u] + at[v], 2 * at) if len(u) else np.empty((0, 2), np.int64)


def _level(at: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    l2 = ((at[u] - at[v]) ** 2).sum(axis=1)
    g = np.gcd(l2, 4)
    return l2 // g, 4 // g


def _texts(ids: np.ndarray, u: np.ndarray, v: np.ndarray) -> pa.Array:
    return pc.binary_join_element_wise(pa.array(ids[u]).cast(pa.string()), pa.array(ids[v]).cast(pa.string()), ",")


def _falls(table: pa.Table) -> pa.Table:
    ids, at, u, v, to = _own_pairs(table)
    p, q = to.T
    columns = [_texts(ids, u, v), _texts(ids, p, q), *map(pa.array, (*_level(at, u, v), *_level(at, p, q), (u == p) & (v == q)))]
    return pa.Table.from_arrays([pa.repeat(pa.scalar(table.column("cloud")[0].as_py(), pa.int64()), len(u)), *columns], [c.split()[0] for c in _FALL.split(", ")])


def _ends(at: np.ndarray, u: np.ndarray, v: np.ndarray, to: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the pairs in which the descents of pairs end, and after how many steps: those that many pairs fall to are followed once."""
    n = len(at)
    if not len(u):
        return u, v, u
    to = nearest_two(at[u] + at[v], 2 * at) if to is None else to
    names, of = np.unique(to[:, 0] * n + to[:, 1], return_inverse=True)
    spot, steps, left = names.copy(), np.zeros(len(names), np.int64), np.arange(len(names))
    while left.size:
        p, q = spot[left] // n, spot[left] % n
        to = nearest_two(at[p] + at[q], 2 * at)
        after = to[:, 0] * n + to[:, 1]
        moved = after != spot[left]
        spot[left], steps[left] = after, steps[left] + moved
        left = left[moved]
    of = of.ravel()
    return spot[of] // n, spot[of] % n, steps[of] + (names[of] != u * n + v)


def _closures(table: pa.Table) -> pa.Table:
    ids, at, u, v, to = _own_pairs(table)
    p, q, steps = _ends(at, u, v, to)
    return pa.Table.from_arrays([pa.repeat(pa.scalar(table.column("cloud")[0].as_py(), pa.int64()), len(u)), _texts(ids, u, v), _texts(ids, p, q), pa.array(steps)], [c.split()[0] for c in _END.split(", ")])


def _pair_steps(table: pa.Table) -> pa.Table:
    """The pairs of the points that are this lot's own with all later ones: rows of ``_STEP``."""
    ids, at, u, v, to = _own_pairs(table)
    n, (num, den) = len(ids), _level(at, u, v)
    lists = lambda two: pa.ListArray.from_arrays(pa.array(np.arange(0, two.size + 1, 2, dtype=np.int32)), pa.array(two.ravel()))
    label = lists(ids[np.stack([u, v], axis=1)])
    cloud = pa.repeat(pa.scalar(table.column("cloud")[0].as_py(), pa.int64()), len(u))
    place = u * (2 * n - u - 1) // 2 + v - u - 1
    return pa.Table.from_arrays([cloud, label, pa.array(num), pa.array(den), label, lists(ids[to]), pa.array(place)], [c.split()[0] for c in _STEP.split(", ")])


def pair_descents(points: DataFrame, lot: int = PAIRS) -> DataFrame:
    """:func:`descents` of all pairs of a cloud, and the ``place`` of each among them in the order of labels.

    A pair's ball is the one over it.  Pairs are made in tasks: a group has the points of a cloud and of about ``lot`` pairs the first ones, and finds the
    nearest two of every middle box by box, so pairs are no rows before their steps are known.  ``points`` are numbered from 0 in their cloud."""
    return _by_pairs(points, _pair_steps, _STEP, lot)


def pair_falls(points: DataFrame, lot: int = PAIRS) -> DataFrame:
    """``cloud, label, successor, num, den, to_num, to_den, terminal`` of all pairs, made likewise; labels are texts."""
    return _by_pairs(points, _falls, _FALL, lot)


def pair_closure(points: DataFrame, lot: int = PAIRS) -> DataFrame:
    """:func:`descent_closure` of all pairs, made likewise: descents are followed to their ends in the task."""
    return _by_pairs(points, _closures, _END, lot)


def ends_of_pairs(points: DataFrame, asked: DataFrame, lots: int = 64) -> DataFrame:
    """The same of the pairs of ``asked`` (cloud, label: two ids as text) only, dealt over lots."""
    lot = F.pmod(F.xxhash64("label"), F.lit(lots).cast("long"))
    pairs = asked.select("cloud", "label").distinct().withColumn("lot", lot)
    p = points.select("cloud", "id", *"xyz", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lots - 1).cast("long"))).alias("lot"))

    def run(own: pa.Table, labels: pa.Table) -> pa.Table:
        ids, at, _ = _sorted_points(own) if own.num_rows else (np.zeros(0, np.int64), np.zeros((0, 3), np.int64), None)
        two = np.array([t.split(",") for t in labels.column("label").to_pylist()], np.int64).reshape(-1, 2)
        p, q, steps = _ends(at, *np.searchsorted(ids, two).T)
        cloud = pa.repeat(pa.scalar(labels.column("cloud")[0].as_py(), pa.int64()), len(two)) if len(two) else pa.array([], pa.int64())
        return pa.Table.from_arrays([cloud, labels.column("label").combine_chunks(), _texts(ids, p, q), pa.array(steps)], [c.split()[0] for c in _END.split(", ")])

    return p.groupBy("cloud", "lot").cogroup(pairs.groupBy("cloud", "lot")).applyInArrow(run, _END)


def _by_pairs(points: DataFrame, run, schema: str, lot: int) -> DataFrame:
    n = points.groupBy("cloud").agg(F.count("*").alias("n"))
    before = F.expr("id * (2 * n - id - 1) div 2")
    p = points.join(n, "cloud").select("cloud", "id", *"xyz", F.floor(before / lot).alias("mine"), F.floor(F.expr("n * (n - 1) div 2") / lot).alias("last"))
    each = p.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), "last"))).select("cloud", "lot", "id", *"xyz", (F.col("mine") == F.col("lot")).alias("own"))
    return spread(each, "cloud", "lot").groupBy("cloud", "lot").applyInArrow(run, schema)


def descent_closure(steps: DataFrame, most_rounds: int = 40) -> DataFrame:
    """``cloud, label, terminal, steps``: where repeated descent ends, by doubling pointers."""
    at = cut(steps.select("cloud", label_text("label").alias("label"), label_text("successor").alias("terminal"), (F.col("label") != F.col("successor")).cast("long").alias("steps")), "descent")
    for _ in range(most_rounds):
        nxt = at.select("cloud", F.col("label").alias("terminal"), F.col("terminal").alias("further"), F.col("steps").alias("more"))
        after = cut(at.join(nxt, ["cloud", "terminal"]).select("cloud", "label", F.col("further").alias("terminal"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("more") > 0).alias("moved")), "descent")
        at = after.drop("moved")
        if not after.where("moved").limit(1).count():
            return at
    raise RuntimeError(f"descents did not end in 2 ** {most_rounds} steps")


def saddle_arm_facets(catalog: DataFrame, order: int) -> DataFrame:
    """``cloud, saddle, num, den, facet``: the arms of the saddles of an order, as texts."""
    s = catalog.where(F.col("saddle_order") == order).withColumn("all", F.array_sort(F.concat("interior", "shell")))
    return s.select("cloud", label_text("label").alias("saddle"), "num", "den", "all", F.explode("shell").alias("out")).select("cloud", "saddle", "num", "den", label_text(F.array_remove("all", F.col("out"))).alias("facet"))


def morse_relations(steps: DataFrame, arms: DataFrame) -> DataFrame:
    """Edges of the Morse genealogy, ``cloud, u, v, num, den``: a facet with its successor at the facet's level, the arms of
    a saddle with each other at the saddle's."""
    down = steps.where("label <> successor").select("cloud", label_text("label").alias("u"), label_text("successor").alias("v"), "num", "den")
    first = arms.groupBy("cloud", "saddle", "num", "den").agg(F.min("facet").alias("u"))
    star = arms.join(first, ["cloud", "saddle", "num", "den"]).select("cloud", "u", F.col("facet").alias("v"), "num", "den")
    return down.unionByName(star.where("u <> v"))


def _partition_gap(frame: pd.DataFrame) -> pd.DataFrame:
    """One cloud: per level the facets whose class differs between the two sets of relations.  A part that ends takes the name of the
    other, and only its facets are looked at again."""
    from fractions import Fraction

    cloud = frame["cloud"].iloc[0]
    rows = sorted((Fraction(int(n), int(d)), kind, u, v) for n, d, kind, u, v in zip(frame["num"], frame["den"], frame["kind"], frame["u"], frame["v"], strict=True))
    names: tuple[dict[str, str], dict[str, str]] = ({}, {})
    held: tuple[dict[str, list[str]], dict[str, list[str]]] = ({}, {})
    out, k, gap = [], 0, 0
    while k < len(rows):
        at = rows[k][0]
        while k < len(rows) and rows[k][0] == at:
            _, kind, u, v = rows[k]
            k += 1
            if kind == "0 facet":
                for own, parts in zip(names, held, strict=True):
                    own[u], parts[u] = u, [u]
                continue
            own, parts, other = names[kind == "2 other"], held[kind == "2 other"], names[kind != "2 other"]
            a, b = sorted((own[u], own[v]))
            if a != b:
                lost = parts.pop(b)
                parts[a] += lost
                for f in lost:
                    gap += (other[f] == b) - (other[f] == a)
                    own[f] = a
        out.append((cloud, at.numerator, at.denominator, len(names[0]), gap))
    return pd.DataFrame(out, columns=["cloud", "num", "den", "facets", "differing"])


def partition_gaps(found_facets: DataFrame, relations: DataFrame, others: DataFrame, levels: DataFrame | None = None) -> DataFrame:
    """At every level, how many facets are in another component (by its least facet) under ``others`` than under
    ``relations``, both ``cloud, u, v, num, den``: ``cloud, num, den, facets, differing``.  ``levels`` (cloud, num, den) adds
    levels at which no relation is and nothing changes."""
    f = found_facets.select("cloud", label_text("label").alias("u"), label_text("label").alias("v"), "num", "den", F.lit("0 facet").alias("kind"))
    both = f.unionByName(relations.withColumn("kind", F.lit("1 one"))).unionByName(others.withColumn("kind", F.lit("2 other")))
    gaps = both.groupBy("cloud").applyInPandas(_partition_gap, "cloud long, num long, den long, facets long, differing long")
    if levels is None:
        return gaps
    none = F.lit(None).cast("long")
    rows = gaps.unionByName(levels.select("cloud", "num", "den", none.alias("facets"), none.alias("differing")))
    at = rows.groupBy("cloud", "num", "den").agg(F.max("facets").alias("facets"), F.max("differing").alias("differing"))
    past = Window.partitionBy("cloud").orderBy(level()).rowsBetween(Window.unboundedPreceding, 0)
    return at.select("cloud", "num", "den", *(F.last(c, True).over(past).alias(c) for c in ("facets", "differing")))


def coface_relations(cofaces: DataFrame) -> DataFrame:
    """Each coface as a star of its facets: ``cloud, u, v, num, den``."""
    f = cofaces.select("cloud", "num", "den", facets(F.col("label")).alias("f"))
    return f.select("cloud", label_text(F.col("f")[0]).alias("u"), "num", "den", F.explode(F.slice("f", 2, 100)).alias("g")).select("cloud", "u", label_text("g").alias("v"), "num", "den")


def gateways(cofaces: DataFrame, incidences: DataFrame) -> DataFrame:
    """Cofaces that are Gabriel or the first that some facet meets, once each, with which: ``gabriel``, ``first``."""
    first = incidences.select("cloud", F.col("coface").alias("text")).distinct().withColumn("first", F.lit(True))
    c = cofaces.withColumn("text", label_text("label")).join(first, ["cloud", "text"], "left")
    return c.withColumn("first", F.coalesce("first", F.lit(False))).where("gabriel OR first").drop("text")


def quotient_by_batch(log: DataFrame, gates: DataFrame) -> DataFrame:
    """Per level and gateway coface the roots it binds: components strictly below (or the facet itself where it is born
    at the level) and the component that holds them then: ``cloud, num, den, root, component``."""
    f = gates.select("cloud", "num", "den", F.explode(facets(F.col("label"))).alias("f")).select("cloud", "num", "den", label_text("f").alias("facet")).distinct()
    before = located(f, log, strictly=True).withColumn("root", F.coalesce("component", "facet")).drop("component")
    return located(before, log, strictly=False).select("cloud", "num", "den", "root", "component").distinct()


def digest_chain(rows: DataFrame, text: Column) -> DataFrame:
    """``cloud, batch, num, den, digest``: batches of equal level in order, each with a digest of its rows' texts and of
    the digest before it.  A cloud's batches are folded within one expression."""
    at = rows.groupBy("cloud", "num", "den").agg(F.array_join(F.array_sort(F.collect_list(text)), " ").alias("text")).withColumn("k", level())
    held = at.groupBy("cloud").agg(F.array_sort(F.collect_list(F.struct("k", "num", "den", "text"))).alias("b"))
    step = F.expr("slice(aggregate(b, array(''), (acc, y) -> concat(acc, array(sha2(concat(element_at(acc, -1), '|', y.text), 256)))), 2, size(b))")
    return held.withColumn("d", step).select("cloud", F.posexplode("b").alias("batch", "x"), "d").select("cloud", "batch", "x.num", "x.den", F.get("d", F.col("batch")).alias("digest"))


