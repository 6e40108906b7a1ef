"""The filtration of order 2 at all levels: triples made in tasks, a lot of first points at a time.

A group has the points of a cloud and of about ``LOT`` triples the first ones; it finds the exact level of each from the offsets
of its later points, and gives on only those that are asked for: all, or those on which something rests (:data:`KEPT`).  No
triple is a row before that, and no support of four points, which a triple cannot have, is looked at.

A triple's ball is that of its longest side if the angle across is right or obtuse, else its circumball.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exact
from .lineage import cut, spread
from .spatial import pairs_within

#: Triples of a group that gives them all, as many times that of one that gives few, and entries of a table that are looked at together.
LOT, MOST, TABLE = 500_000, 10, 1 << 19
COFACES = "cloud long, label array<long>, num long, den long, gabriel boolean, first boolean"
INCIDENCES = "cloud long, facet array<long>, label array<long>, num long, den long"
LEAST = "cloud long, u long, v long, num long, den long"


def lowest(num: np.ndarray, den: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    g = np.gcd(num, den)
    return num // g, den // g


def level_keys(num: np.ndarray, den: np.ndarray) -> tuple[np.ndarray, ...]:
    """Keys that sort as num / den does (the last counts most, as in ``np.lexsort``): the quotient and 100 binary digits of the rest."""
    rest, digits = num % den, []
    for _ in range(5):
        rest = rest << 20
        digits.append(rest // den)
        rest = rest % den
    return (digits[3] << 20) + digits[4], (((digits[0] << 20) + digits[1]) << 20) + digits[2], num // den


def ranks(num: np.ndarray, den: np.ndarray) -> np.ndarray:
    """The place of each level among the different ones."""
    if not len(num):
        return np.zeros(0, np.int64)
    if num.dtype == object:
        levels = [Fraction(a, b) for a, b in zip(num, den, strict=True)]
        place = {x: i for i, x in enumerate(sorted(set(levels)))}
        return np.array([place[x] for x in levels], np.int64)
    keys = level_keys(num, den)
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


Table = dict[str, np.ndarray]
#: Of a triple: the places i < j < k of its points, its level num / den in lowest terms, and what :func:`empty_balls` needs.
COLUMNS = ("i", "j", "k", "num", "den", "form")


def take(t: Table, some: np.ndarray) -> Table:
    return {c: x[some] for c, x in t.items()}


def joined(parts: list[Table]) -> Table:
    return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}


def facets_of(t: Table, n: int) -> np.ndarray:
    """Three numbers of pairs a triple: of (j, k), (i, k) and (i, j)."""
    return np.stack([t["j"] * n + t["k"], t["i"] * n + t["k"], t["i"] * n + t["j"]], axis=1)


def triples_of(at: np.ndarray, i: int, until: tuple[int, int] | None = None) -> Iterator[Table]:
    """The triples whose first point is ``i``, some at a time; up to the level num / den ``until``.

    ``form`` has what :func:`empty_balls` needs: a point p from i is inside the ball where ``a p.p - (b ej + c ek).p + d`` is negative."""
    w = at[i + 1 :] - at[i]
    a2 = (w * w).sum(axis=1)
    own = np.arange(i + 1, len(at)) if until is None else i + 1 + np.flatnonzero(a2 * until[1] <= 4 * until[0])
    w, a2 = w[own - i - 1], a2[own - i - 1]
    for lo in range(0, len(own) - 1, step := max(1, TABLE // max(1, len(own)))):
        dot = w[lo : lo + step] @ w.T
        j, k = np.nonzero(np.arange(lo, lo + len(dot))[:, None] < np.arange(len(own))[None])
        dot = dot[j, k]
        j = j + lo
        ij, ik = a2[j], a2[k]
        jk = ij + ik - 2 * dot
        longest = np.maximum(np.maximum(ij, ik), jk)
        if until is not None:
            some = np.flatnonzero(longest * until[1] <= 4 * until[0])
            j, k, dot, ij, ik, jk, longest = (x[some] for x in (j, k, dot, ij, ik, jk, longest))
        blunt = (2 * longest >= ij + ik + jk).astype(bool)
        area = np.where(blunt, 1, ij * ik - dot * dot)
        num, den = lowest(np.where(blunt, longest, ij * ik * jk), 4 * area)
        on_jk, on_ik = blunt & (longest == jk), blunt & (longest == ik)
        on_ik &= ~on_jk
        on_ij = blunt & ~on_jk & ~on_ik
        b = np.where(blunt, (on_jk | on_ij).astype(np.int64), ik * (ij - dot))
        c = np.where(blunt, (on_jk | on_ik).astype(np.int64), ij * (ik - dot))
        d = np.where(on_jk, dot, 0)
        third = np.where(on_jk, i, np.where(on_ik, own[j], np.where(on_ij, own[k], -1)))
        form = np.stack([area, *(b * w[j, x] + c * w[k, x] for x in range(3)), d, third], axis=1)
        found = dict(zip(COLUMNS, (np.full(len(j), i), own[j], own[k], num, den, form), strict=True))
        if until is not None:
            # Compared without products: quotient first, then what is left.
            q, r = divmod(until[0], until[1])
            keep = (num // den < q) | ((num // den == q) & ((num % den) * until[1] <= r * den))
            found = take(found, np.flatnonzero(keep.astype(bool)))
        yield found


def empty_balls(t: Table, at: np.ndarray) -> np.ndarray:
    """Whether no other point is strictly inside a triple's ball.  Points come in a mixed order, a few at first: most balls hold one of them."""
    out = np.ones(len(t["i"]), bool)
    mixed = np.random.default_rng(0).permutation(len(at))
    place = np.argsort(mixed)
    lo, wide = 0, 16
    largest = int(np.abs(at).max(initial=0)) * 2 + 1
    kind = np.float64 if at.dtype != object and 12 * (3 * largest**2) ** 3 < 2**52 else at.dtype
    while lo < len(at):
        cols = mixed[lo : lo + wide]
        left = np.flatnonzero(out)
        for s in range(0, len(left), step := max(1, TABLE // len(cols))):
            rows = left[s : s + step]
            # A first point's triples are beside each other.
            starts = np.flatnonzero(np.r_[True, np.diff(t["i"][rows]) != 0])
            for a, b in zip(starts, np.r_[starts[1:], len(rows)], strict=True):
                own = rows[a:b]
                p = (at[cols] - at[t["i"][own[0]]]).astype(kind)
                form = t["form"][own]
                power = form[:, :1].astype(kind) * (p * p).sum(axis=1)[None] - form[:, 1:4].astype(kind) @ p.T + form[:, 4:5].astype(kind)
                inside = power < 0
                third = form[:, 5].astype(np.int64)
                spot = np.where(third < 0, -1, place[third] - lo)
                here = np.flatnonzero((spot >= 0) & (spot < len(cols)))
                inside[here, spot[here]] = False
                out[own] = ~inside.any(axis=1)
        lo, wide = lo + wide, min(4 * wide, 1024)
    return out


def least_of(keys: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Of every different key the place of a row of the least rank, in the order of keys."""
    order = np.lexsort((rank, keys))
    return order[np.r_[True, keys[order][1:] != keys[order][:-1]]] if len(keys) else order


def joining(facets: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Places of rows of ``facets`` that join parts which nothing of a lower level joins, as few as do: what the others join is
    joined by then."""
    names, f = np.unique(facets, return_inverse=True)
    f = f.reshape(facets.shape)
    order = np.argsort(rank, kind="stable")
    root = np.arange(len(names))
    kept, lo, step = [], 0, max(1024, len(names))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    while lo < len(order):
        rows = order[lo : lo + step]
        held = root[f[rows]]
        rows = rows[(held != held[:, :1]).any(axis=1)]
        up = root.tolist()
        for place, ends in zip(rows.tolist(), f[rows].tolist(), strict=True):
            first, new = find(ends[0]), False
            for e in ends[1:]:
                e = find(e)
                if e != first:
                    up[e], new = first, True
            if new:
                kept.append(place)
        root = np.array(up, np.int64)
        while not (root[root] == root).all():
            root = root[root]
        lo, step = lo + step, 2 * step
    return np.array(kept, np.int64)


def _whole(t: Table, n: int) -> Table:
    return t


def _levels(t: Table, n: int) -> Table:
    rank = ranks(t["num"], t["den"])
    return take(t, np.unique(rank, return_index=True)[1])


def _joining(t: Table, n: int) -> Table:
    return take(t, joining(facets_of(t, n), ranks(t["num"], t["den"])))


def _genealogy(t: Table, n: int) -> Table:
    rank, f = ranks(t["num"], t["den"]), facets_of(t, n)
    kinds = [np.ones(len(rank), bool), t["empty"] | t["first"], t["empty"], t["first"]]
    return take(t, np.unique(np.concatenate([k[joining(f[k], rank[k])] for k in map(np.flatnonzero, kinds)])))


#: What :func:`cofaces` may keep of some triples: which are looked at, and which of those are needed.
KEPT = {
    "all": (None, _whole), "gabriel": (lambda t: t["empty"], _whole), "gates": (lambda t: t["empty"] | t["first"], _whole), "levels": (None, _levels), "joining": (None, _joining), "genealogy": (None, _genealogy),
}


class Lot:
    """The points of a cloud, sorted, and the triples of some first ones."""

    def __init__(self, table: pa.Table, until: tuple[int, int] | None):
        ids = table.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        at = np.stack([table.column(c).to_numpy() for c in "xyz"], axis=1)[order]
        at = at - at.min(axis=0)
        if (3 * int(at.max(initial=0)) ** 2 + 1) ** 3 >= 2**61:
            at = at.astype(object)
        self.cloud, self.ids, self.at, self.n, self.until = table.column("cloud")[0].as_py(), ids[order], at, len(ids), until
        self.own = np.flatnonzero(table.column("own").to_numpy(zero_copy_only=False)[order])

    def some(self) -> Iterator[Table]:
        """About ``TABLE`` triples at a time."""
        held = [{c: np.zeros((0, 6) if c == "form" else 0, self.at.dtype) for c in COLUMNS}]
        for i in self.own:
            for t in triples_of(self.at, int(i), self.until):
                held.append(t)
                if sum(len(x["i"]) for x in held) >= TABLE:
                    yield joined(held)
                    held = held[:1]
        yield joined(held)

    def labels(self, *places: np.ndarray) -> pa.Array:
        rows = self.ids[np.stack(places, axis=1).astype(np.int64)]
        return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)), pa.array(rows.ravel(), pa.int64()))

    def table(self, schema: str, *columns) -> pa.Table:
        held = [x if isinstance(x, pa.Array) else pa.array(x.astype(np.int64) if x.dtype != bool else x) for x in columns]
        return pa.Table.from_arrays([pa.repeat(pa.scalar(self.cloud, pa.int64()), len(held[0])), *held], [c.split()[0] for c in schema.split(", ")])


def _dealt(points: DataFrame, until: tuple[int, int] | None, lot: int) -> tuple[DataFrame, DataFrame]:
    """``(cloud, lot, id, x, y, z, own; cloud, lots)``: all points of a cloud in each of its lots, with the first ones that are the lot's own."""
    p = points.where("cloud IS NOT NULL").select("cloud", "id", *"xyz")
    if until is None:
        n = p.groupBy("cloud").agg(F.expr("CAST(count(*) AS DOUBLE) * (count(*) - 1) * (count(*) - 2) / 6").alias("n"))
    else:
        later = pairs_within(p, 4 * until[0] // until[1]).groupBy("cloud", "u").agg(F.count("*").alias("d"))
        n = p.select("cloud").distinct().join(later.groupBy("cloud").agg(F.sum(F.expr("CAST(d AS DOUBLE) * (d - 1) / 2")).alias("n")), "cloud", "left").fillna(0.0, ["n"])
    lots = F.greatest(F.ceil(F.col("n") / lot), F.lit(1)).cast("long")
    lots = cut(n.select("cloud", lots.alias("lots")), "lots")
    each = p.join(F.broadcast(lots), "cloud").withColumn("lot", F.expr("explode(sequence(0L, lots - 1))"))
    return spread(each.select("cloud", "lot", "id", *"xyz", (F.pmod("id", "lots") == F.col("lot")).alias("own")), "cloud", "lot"), lots


def _per_lot(points: DataFrame, until: tuple[int, int] | None, least: DataFrame | None, run, schema: str, lot: int) -> DataFrame:
    """``run(lot, low)`` of every lot; ``low`` has numbers of pairs, sorted, and their levels in ``least``."""
    dealt, lots = _dealt(points, until, lot)
    if least is None:
        return dealt.groupBy("cloud", "lot").applyInArrow(lambda own: run(Lot(own, until), None), schema)

    def with_levels(own: pa.Table, low: pa.Table) -> pa.Table:
        here = Lot(own, until)
        names = np.searchsorted(here.ids, low.column("u").to_numpy()) * here.n + np.searchsorted(here.ids, low.column("v").to_numpy())
        order = np.argsort(names)
        return run(here, (names[order], low.column("num").to_numpy()[order], low.column("den").to_numpy()[order]))

    low = least.join(F.broadcast(lots), "cloud").withColumn("lot", F.expr("explode(sequence(0L, lots - 1))")).drop("lots").toDF("cloud", "u", "v", "num", "den", "lot")
    return dealt.groupBy("cloud", "lot").cogroup(low.groupBy("cloud", "lot")).applyInArrow(with_levels, schema)


def _firsts(t: Table, n: int, names: np.ndarray, num: np.ndarray, den: np.ndarray) -> np.ndarray:
    """Per triple and pair of it whether the pair's least level is the triple's."""
    spot = np.searchsorted(names, facets_of(t, n).astype(np.int64))
    return ((num[spot] == t["num"][:, None]) & (den[spot] == t["den"][:, None])).astype(bool)


def least_levels(points: DataFrame, until: tuple[int, int] | None = None, lot: int = LOT) -> DataFrame:
    """``cloud, u, v, num, den``: the least level of the triples that each pair is in."""

    def run(own: Lot, _) -> pa.Table:
        held = {"f": np.zeros(0, np.int64), "num": np.zeros(0, np.int64), "den": np.zeros(0, np.int64)}
        for t in own.some():
            new = {"f": facets_of(t, own.n).ravel().astype(np.int64), "num": np.repeat(t["num"], 3), "den": np.repeat(t["den"], 3)}
            both = joined([held, new])
            held = take(both, least_of(both["f"], ranks(both["num"], both["den"])))
        return own.table(LEAST, own.ids[held["f"] // own.n], own.ids[held["f"] % own.n], held["num"], held["den"])

    found = _per_lot(points, until, None, run, LEAST, lot)
    least = F.struct(F.expr(exact.level_key("num", "den")).alias("k"), "num", "den")
    return found.groupBy("cloud", "u", "v").agg(F.min(least).alias("m")).select("cloud", "u", "v", "m.num", "m.den")


def cofaces(points: DataFrame, kept: str = "all", until: tuple[int, int] | None = None, gabriel: bool = True, least: DataFrame | None = None, lot: int = LOT) -> DataFrame:
    """``cloud, label, num, den, gabriel, first`` of triples: all, or those that ``kept`` names.

    ``joining``: enough of them that at every level the components are those of all.  ``levels``: one of every level of a lot.  ``gates``: Gabriel ones
    and those of the least level of a pair, for which ``least`` has :func:`least_levels`.  ``genealogy``: those that join, of all triples, of
    gates, and of either kind of gates alone.  ``gabriel`` is null where it is not asked for, ``first`` without ``least``."""
    asked, needed = KEPT[kept]
    gabriel = kept in ("gabriel", "gates", "genealogy") or (gabriel and kept == "all")

    def run(own: Lot, low) -> pa.Table:
        held = []
        for t in own.some():
            if gabriel:
                t["empty"] = empty_balls(t, own.at)
            if low is not None:
                t["first"] = _firsts(t, own.n, *low).any(axis=1)
            del t["form"]
            t = t if asked is None else take(t, np.flatnonzero(asked(t)))
            held = [needed(joined([*held, t]), own.n)] if needed is not _whole else [*held, t]
        t = joined(held)
        flags = [t[c] if c in t else pa.nulls(len(t["i"]), pa.bool_()) for c in ("empty", "first")]
        return own.table(COFACES, own.labels(t["i"], t["j"], t["k"]), t["num"], t["den"], *flags)

    return _per_lot(points, until, least, run, COFACES, lot if needed is _whole else MOST * lot)


def first_incidences(points: DataFrame, least: DataFrame, until: tuple[int, int] | None = None, lot: int = LOT) -> DataFrame:
    """``cloud, facet, label, num, den``: every pair with its triples of least level, all of them."""

    def run(own: Lot, low) -> pa.Table:
        held = []
        for t in own.some():
            rows, side = np.nonzero(_firsts(t, own.n, *low))
            del t["form"]
            held.append(take(t, rows) | {"f": facets_of(t, own.n)[rows, side]})
        t = joined(held)
        return own.table(INCIDENCES, own.labels(t["f"] // own.n, t["f"] % own.n), own.labels(t["i"], t["j"], t["k"]), t["num"], t["den"])

    return _per_lot(points, until, least, run, INCIDENCES, lot)
