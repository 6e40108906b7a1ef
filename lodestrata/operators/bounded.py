"""Supports of bounded rank by branch and bound, without listing the tuples of a cloud.

A support's ball may hold few points inside.  Let e = v - u be its longest edge; the centre of a well-centred support lies
on the plane halfway along e and, by Jung's bound on the radius (3/8 of the squared edge), at most |e| / sqrt(8) off the
edge.  A point z beyond u lies in every such ball if ``e.z - |z|^2 > |e x z| / sqrt(2)``: a spindle around the edge.  More
points in the spindle than the rank leaves room for rule out every support that the edge is the longest of.

The inequality is linear in e, so it also rules out all v of a box at once, with a margin for the box's half diagonal.
:func:`descend` goes from every point through ever smaller boxes: a round is an equi-join of the frontier with the boxes'
children and a test against the nearest of a few points known around u.  A frontier is a table; a run that stops at its
budget returns it, and a later run goes on from there.  What is left is grown to triples and quadruples within the points that are
no farther from either end than the edge is long.  Pruning is in floating point, with slack on the safe side; everything that decides is exact.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exact
from .cloud import gcd
from .growth import SCHEMA, grown
from .lineage import cut, dealt, let, release, spread

#: Lanes over which a box's children are dealt; points of a box, on average, that are looked at one by one; points
#: known around each point.
LANES, LEAF, KNOWN = 16, 4, 48
#: Edges of a box, about, that are grown in one group.
GROWN = 2000
NAMES = ("a", "b", "c", "d")
#: Relative slack of the pruning tests.
SLACK = 1e-9
#: How far centres of higher supports lean off the middle of their longest edge, by its half: Jung's bound.
LEAN = 1 / math.sqrt(2)


def _extent(points: DataFrame) -> tuple[dict[str, int], int]:
    """The least coordinates, and how many bits cover the widest axis."""
    r = points.agg(*(F.min(c).alias(f"lo{c}") for c in "xyz"), *(F.max(c).alias(f"hi{c}") for c in "xyz")).first()
    if r["lox"] is None:
        return dict.fromkeys("xyz", 0), 1
    return {c: int(r[f"lo{c}"]) for c in "xyz"}, max(1, max(int(r[f"hi{c}"]) - int(r[f"lo{c}"]) for c in "xyz").bit_length())


def _cells(names: str, lo: dict[str, int], shift) -> list:
    """Columns ``cx, cy, cz``: the box of a point at a shift (a number or a column)."""
    right = (lambda v: F.shiftright(v, shift)) if isinstance(shift, int) else (lambda v: F.call_function("shiftright", v, shift))
    return [right(F.col(names.format(c)) - F.lit(lo[c])).cast("long").alias(f"c{c}") for c in "xyz"]


def _known(points: DataFrame, lo: dict[str, int], bits: int) -> DataFrame:
    """``cloud, u, wx, wy, wz``: up to ``KNOWN`` points around each point, the nearest of those that the 27 boxes of every
    size around it name.  Any points would do; near ones rule out more."""
    a = points.select("cloud", F.col("id").alias("u"), *(F.col(c).alias(f"u_{c}") for c in "xyz"), F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("shift"))
    a = a.select("*", *_cells("u_{}", lo, F.col("shift")))
    shifts = F.array(*(F.lit(d).cast("long") for d in (-1, 0, 1)))
    for c in "xyz":
        a = a.withColumn("s", F.explode(shifts)).withColumn(f"c{c}", F.col(f"c{c}") + F.col("s")).drop("s")
    at = F.struct("id", "x", "y", "z")
    named = _by_size(points, lo, bits - 1).groupBy("cloud", "shift", "cx", "cy", "cz").agg(F.array_distinct(F.array(F.min(at), F.max(at))).alias("known"))
    met = dealt(a).join(named, ["cloud", "shift", "cx", "cy", "cz"]).select("cloud", "u", *(f"u_{c}" for c in "xyz"), F.explode("known").alias("w")).where("w.id <> u")
    met = met.select("cloud", "u", *(F.col(f"w.{c}").alias(f"w{c}") for c in "xyz"), F.expr(" + ".join(f"(w.{c} - u_{c}) * (w.{c} - u_{c})" for c in "xyz")).alias("d2")).distinct()
    near = Window.partitionBy("cloud", "u").orderBy("d2", "wx", "wy", "wz")
    return met.withColumn("nth", F.row_number().over(near)).where(F.col("nth") <= KNOWN).select("cloud", "u", "wx", "wy", "wz")


def certain_in_spindle(edges: np.ndarray, radius: float, known: np.ndarray, lean: float = LEAN) -> np.ndarray:
    """Per edge (from the origin to the middle of a box of half diagonal ``radius``) how many of ``known`` lie strictly in
    the spindle of every edge that ends in the box; with ``lean`` 0 in the ball whose diameter the edge is."""
    dot = edges @ known.T
    z2 = (known * known).sum(axis=1)
    e2 = (edges * edges).sum(axis=1)
    cross = np.sqrt(np.maximum(e2[:, None] * z2[None] - dot * dot, 0))
    left = dot - lean * cross - z2[None]
    right = math.sqrt(1 + lean * lean) * radius * np.sqrt(z2)[None] + SLACK * (e2[:, None] + z2[None])
    return (left > right).sum(axis=1)


def _test(lo: dict[str, int], shift: int, most: int, lean: float):
    """Children of the frontier of one point that its known points leave open."""
    side = (1 << shift) - 1
    low = np.asarray([lo[c] for c in "xyz"], float)

    def run(frontier: pa.Table, known: pa.Table) -> pa.Table:
        if not frontier.num_rows or not known.num_rows:
            return frontier
        column = lambda t, *names: np.stack([t.column(n).to_numpy() for n in names], axis=1).astype(float)
        u = column(frontier, "ux", "uy", "uz")[0]
        middle = column(frontier, "cx", "cy", "cz") * (1 << shift) + low + side / 2
        inside = certain_in_spindle(middle - u, side * math.sqrt(3) / 2, column(known, "wx", "wy", "wz") - u, lean)
        return frontier.filter(pa.array(inside <= most))

    return run


_FRONTIER = "cloud long, u long, ux long, uy long, uz long, cx long, cy long, cz long"


class Frontier:
    """Where a descent stands: the open boxes per point at ``shift`` (a table), and how many products were examined."""

    def __init__(self, rows: DataFrame, shift: int, examined: int = 0):
        self.rows, self.shift, self.examined = rows, shift, examined


def start(points: DataFrame) -> Frontier:
    """Every point with the box of its whole cloud."""
    _, bits = _extent(points)
    zero = [F.lit(0).cast("long").alias(f"c{c}") for c in "xyz"]
    return Frontier(points.select("cloud", F.col("id").alias("u"), *(F.col(c).alias(f"u{c}") for c in "xyz"), *zero), bits)


def _next(points: DataFrame, bits: int, shift: int) -> int:
    """The shift after ``shift``: a bit less while the largest cloud fills its boxes, and then the points."""
    n = points.groupBy("cloud").count().agg(F.max("count")).first()[0] or 0
    return shift - 1 if shift > 1 and 8 ** (bits - shift + 1) * LEAF <= n else 0


def descend(points: DataFrame, most: int, frontier: Frontier | None = None, budget: int | None = None, lean: float = LEAN) -> tuple[DataFrame | None, Frontier]:
    """``(pairs, frontier)``: the descent from ``frontier`` on; pairs are None if the budget stopped it.

    ``most``: points strictly inside the spindle (``lean`` 0: the ball over the edge) that rule nothing out.  ``budget`` counts products of a point and a box; a
    round that would pass it is not begun, and the frontier before it is returned to go on from.
    """
    lo, bits = _extent(points)
    frontier = frontier or start(points)
    rows, shift, examined = frontier.rows, frontier.shift, frontier.examined
    known = cut(_known(points, lo, bits), "known")
    lanes = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(LANES - 1).cast("long")))
    while shift > 0:
        below = _next(points, bits, shift)
        cells = points.select("cloud", *_cells("{}", lo, below)).distinct()
        child = cells.select("cloud", *(F.shiftright(f"c{c}", shift - below).alias(f"p{c}") for c in "xyz"), "cx", "cy", "cz", lanes.alias("lane"))
        up = rows.select("cloud", "u", "ux", "uy", "uz", *(F.col(f"c{c}").alias(f"p{c}") for c in "xyz"), F.pmod("u", F.lit(LANES)).alias("lane"))
        opened = cut(dealt(up).join(child, ["cloud", "px", "py", "pz", "lane"]).select("cloud", "u", "ux", "uy", "uz", "cx", "cy", "cz"), "opened")
        n = opened.count()
        if budget is not None and examined + n > budget:
            return None, Frontier(rows, shift, examined)
        examined, shift = examined + n, below
        left = cut(opened.groupBy("cloud", "u").cogroup(known.groupBy("cloud", "u")).applyInArrow(_test(lo, shift, most, lean), _FRONTIER), "frontier")
        release(opened, *([] if rows is frontier.rows else [rows]))  # a caller may go on from its own frontier again
        rows = left
    ends = dealt(rows).join(points.select("cloud", F.col("id").alias("v"), *_cells("{}", lo, 0)), ["cloud", "cx", "cy", "cz"]).where("u <> v")
    # Kept from both ends.
    both = ends.groupBy("cloud", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.count("*").alias("n")).where("n = 2")
    return cut(both.select("cloud", "u", "v"), "edges"), Frontier(rows, shift, examined)


def nearest_by_tree(points: DataFrame, part: str | None = None) -> DataFrame:
    """Each point's nearest other: ``cloud, q, p, d2`` (ties: least id); with ``part``, a column, the nearest of another part.

    Boxes carry their extents and the least and largest part in them.  Going down, a point keeps the boxes that hold
    another part and begin no farther off than the nearest of them ends; a round is an equi-join and a minimum per point."""
    lo, bits = _extent(points)
    own = points.select("cloud", "id", "x", "y", "z", (F.col(part) if part else F.col("id")).alias("part"))
    zero = [F.lit(0).cast("long").alias(f"c{c}") for c in "xyz"]
    rows, shift = own.select("cloud", F.col("id").alias("q"), *(F.col(c).alias(f"q_{c}") for c in "xyz"), "part", F.lit(None).cast("long").alias("bound"), *zero), bits
    lanes = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(LANES - 1).cast("long")))
    reach = Window.partitionBy("cloud", "q")
    while True:
        below = _next(points, bits, shift)
        ends = [f(c).alias(f"{e}{c}") for c in "xyz" for e, f in (("lo", F.min), ("hi", F.max))]
        boxes = own.select("*", *_cells("{}", lo, below)).groupBy("cloud", "cx", "cy", "cz").agg(*ends, F.min("part").alias("low"), F.max("part").alias("high"), F.min("id").alias("p"))
        child = boxes.withColumns({f"p{c}": F.shiftright(f"c{c}", shift - below) for c in "xyz"}).select("*", lanes.alias("lane"))
        up = rows.select("cloud", "q", *(f"q_{c}" for c in "xyz"), "part", F.col("bound").alias("known"), *(F.col(f"c{c}").alias(f"p{c}") for c in "xyz"), F.pmod("q", F.lit(LANES)).alias("lane"))
        met = dealt(up).join(child, ["cloud", "px", "py", "pz", "lane"]).where("low <> part or high <> part")
        met = met.withColumns({"near": F.expr(exact.box_distance("q", "lo", "hi")), "far": F.expr(exact.box_distance("q", "lo", "hi", True))})
        # What the last round knows drops boxes before they are dealt.
        met = met.where("known IS NULL OR near <= known")
        if below == 0:
            return met.groupBy("cloud", "q").agg(F.min(F.struct(F.col("near").alias("d2"), "p")).alias("m")).select("cloud", "q", "m.p", "m.d2")
        met = met.select("cloud", "q", *(f"q_{c}" for c in "xyz"), "part", "cx", "cy", "cz", "near", "far", "known")
        rows = met.withColumn("bound", F.least("known", F.min("far").over(reach))).where("near <= bound").drop("near", "far", "known")
        rows, shift = cut(rows, "near"), below


def _by_size(points: DataFrame, lo: dict[str, int], bits: int) -> DataFrame:
    """Every point at every box size: ``cloud, shift, cx, cy, cz, id, x, y, z``."""
    p = points.select("cloud", "id", "x", "y", "z", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("shift"))
    return p.select("cloud", "shift", *_cells("{}", lo, F.col("shift")), "id", "x", "y", "z")


def within(rows: DataFrame, points: DataFrame, centre: str, reach: str) -> DataFrame:
    """``rows`` with every point of their cloud (as a struct ``p``) in the boxes that a cube around a centre meets.

    ``centre`` names integer columns ``{centre}_x`` and so on, ``reach`` is half the cube's side, an integer expression.  Boxes are at least as
    wide as the reach, so a row meets at most 27 of them whatever its size: an equi-join."""
    lo, bits = _extent(points)
    held = rows.withColumn("shift", F.least(F.lit(bits), F.ceil(F.log2(F.greatest(F.expr(reach), F.lit(1)).cast("double"))).cast("int")))
    for c in "xyz":
        ends = [F.call_function("shiftright", F.greatest(F.expr(f"{centre}_{c} {s} ({reach})") - F.lit(lo[c]), F.lit(0).cast("long")), F.col("shift")) for s in "-+"]
        held = held.withColumn(f"c{c}", F.explode(F.sequence(*ends)))
    at = _by_size(points, lo, bits).select("cloud", "shift", "cx", "cy", "cz", F.struct("id", "x", "y", "z").alias("p"))
    return dealt(held).join(at, ["cloud", "shift", "cx", "cy", "cz"]).drop("shift", "cx", "cy", "cz")


def _lenses(pairs: DataFrame, points: DataFrame, most: int) -> DataFrame:
    """Pairs that may be the longest edge of a support of three or more, with the points no farther from either end:
    ``cloud, u_*, v_*, l2, lens``.  The spindle is counted exactly."""
    side = lambda n: points.select("cloud", F.col("id").alias(n), *(F.col(c).alias(f"{n}_{c}") for c in "xyz"))
    e = dealt(dealt(pairs).join(side("u"), ["cloud", "u"])).join(side("v"), ["cloud", "v"])
    e = e.withColumn("l2", F.expr(exact.squared_distance("v", "u"))).withColumns({f"m_{c}": F.expr(f"(u_{c} + v_{c}) div 2") for c in "xyz"})
    met = within(e, points, "m", "cast(ceil(sqrt(l2)) as bigint)").where("p.id <> u and p.id <> v")
    met = met.select("cloud", "u", "v", *(f"{n}_{c}" for n in "uv" for c in "xyz"), "l2", "p", *(F.col(f"p.{c}").alias(f"p_{c}") for c in "xyz"))
    met = let(met, du=exact.squared_distance("p", "u"), dv=exact.squared_distance("p", "v")).where("du <= l2 and dv <= l2")
    dot = exact.dot(exact.minus("v", "u"), exact.minus("p", "u"))
    met = let(met, dot=dot)
    inside = "dot > du and 2.0D * (dot - du) * (dot - du) > (cast(l2 as double) * du - cast(dot as double) * dot) * (1 + 1e-9D) + 1e-3D"
    grown = met.groupBy("cloud", "u", "v", *(f"{n}_{c}" for n in "uv" for c in "xyz"), "l2").agg(F.count_if(F.expr(inside)).alias("inside"), F.collect_list("p").alias("lens"))
    return grown.where(F.col("inside") <= most - 3)


def _shorter(a: str, b: str, d2: str) -> str:
    """Whether edge (a, b) of a squared length comes before (u, v): shorter, or as long and first in order."""
    return f"({d2} < l2 or ({d2} = l2 and (least({a}.id, {b}.id) < u or (least({a}.id, {b}.id) = u and greatest({a}.id, {b}.id) < v))))"


def _d2(a: str, b: str) -> str:
    return "(" + " + ".join(f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in "xyz") + ")"


def _ball(rows: DataFrame, size: int) -> DataFrame:
    """Well-centred supports among tuples ``a_*`` to ``d_*``: adds d, m1.., num, den."""
    names = list(NAMES[:size])
    ball = exact.circumball(names)
    ms = [f"m{i + 1}" for i in range(size - 1)]
    t = let(rows, **exact.gram_columns(names))
    t = let(t, d=ball["D"], **dict(zip(ms, ball["M"], strict=True)))
    return t.withColumn("centred", F.expr("d > 0 AND " + " AND ".join(f"{m} > 0" for m in ms) + f" AND 2 * d - ({' + '.join(ms)}) > 0"))


def _level(t: DataFrame, size: int) -> DataFrame:
    names = list(NAMES[:size])
    t = let(t.where("centred"), raw=exact.circumball(names)["level"]).withColumn("g", F.greatest(gcd(F.col("raw"), 4 * F.col("d")), F.lit(1).cast("long")))
    return t.select(
        "cloud", F.array(*(F.col(f"{n}_id") for n in names)).alias("label"), F.expr("raw div g").alias("num"), F.expr("(4 * d) div g").alias("den"), "d",
        *((F.col(f"m{i}") if i < size else F.lit(0).cast("long")).alias(f"m{i}") for i in (1, 2, 3)), *(F.col(f"{n if n in names else 'a'}_{c}").alias(f"{n}_{c}") for n in NAMES for c in "xyz"),
    )


def _tuple(rows: DataFrame, points: list[str], *keep: str) -> DataFrame:
    """Structs (id, x, y, z) as columns of a tuple in the order of ids."""
    names = NAMES[: len(points)]
    t = rows.withColumn("all", F.array_sort(F.array(*map(F.col, points))))
    return t.select("cloud", *keep, *(F.col("all")[i][f].alias(f"{n}_{f}") for i, n in enumerate(names) for f in ("id", "x", "y", "z")))


def _few_inside(lens: str, size: int, most: int) -> str:
    """Whether so few points of an array lie strictly in the ball that its rank may be ``most``."""
    inside = exact.power_sign(list(NAMES[:size]), "p")
    for c in "xyz":
        inside = inside.replace(f"p_{c}", f"p.{c}")
    return f"size(filter({lens}, p -> {inside} < 0)) + {size} <= {most}"


def _extendable(most: int) -> str:
    """Whether the triple may be a face of a support of four: not if too many points of the lens lie in every ball through it of at
    most Jung's radius, whose centre moves along the normal from the triple's circumcentre."""
    p = [f"(p.{c} - a_{c})" for c in "xyz"]
    power = exact.power_sign(list(NAMES[:3]), "p")
    for c in "xyz":
        power = power.replace(f"p_{c}", f"p.{c}")
    height = "(" + " + ".join(f"n{c} * {q}" for c, q in zip("xyz", p, strict=True)) + ")"
    sure = f"cast({power} as double) / d + 2 * reach * abs(cast({height} as double)) / sqrt(n2) < -1e-6D * (1 + l2)"
    return f"d > 0 and reach >= 0 and size(filter(lens, p -> {sure})) <= {most - 4}"


def supports_within(points: DataFrame, most: int, largest: int = 4, pairs: DataFrame | None = None) -> DataFrame:
    """The well-centred supports of 1 to ``largest`` points, without those whose ball holds so many points that their
    rank (points inside, and the support) is shown to pass ``most``; columns as of :func:`.hierarchy.supports`.

    ``pairs(cloud, u, v)`` are the result of a descent with at least ``most - 1``; otherwise it is made here.  Per edge the points
    no farther from both its ends are an array of one row: few where points are spread, all of a cloud at worst.
    """
    zero = F.lit(0).cast("long")
    out = points.select("cloud", F.array("id").alias("label"), zero.alias("num"), F.lit(1).cast("long").alias("den"), F.lit(1).cast("long").alias("d"), *(zero.alias(f"m{i}") for i in (1, 2, 3)), *(F.col(c).alias(f"{n}_{c}") for n in NAMES for c in "xyz"))
    if largest < 2:
        return out
    if pairs is None:
        pairs, _ = descend(points, max(0, most - 2), lean=LEAN if largest > 2 else 0.0)
    at = points.select("cloud", "id", F.struct("id", "x", "y", "z").alias("p"))
    ends = dealt(dealt(pairs).join(at.select("cloud", F.col("id").alias("u"), F.col("p").alias("pu")), ["cloud", "u"])).join(at.select("cloud", F.col("id").alias("v"), F.col("p").alias("pv")), ["cloud", "v"])
    out = out.unionByName(_level(_ball(_tuple(ends, ["pu", "pv"]), 2), 2))
    if largest < 3 or most < 3:
        return out
    lenses = cut(_lenses(pairs, points, most), "lenses")
    whole = lenses.select("cloud", "u", "v", "l2", *(F.struct(F.col(n).alias("id"), *(F.col(f"{n}_{c}").alias(c) for c in "xyz")).alias(f"p{n}") for n in "uv"), "lens")
    three = spread(whole, "cloud", "u", "v").select("*", F.explode("lens").alias("pw")).where(_shorter("pu", "pw", _d2("pu", "pw"))).where(_shorter("pv", "pw", _d2("pv", "pw")))
    t = _ball(_tuple(three, ["pu", "pv", "pw"], "u", "v", "l2", "lens", "pw"), 3)
    out = out.unionByName(_level(t.where(_few_inside("lens", 3, most)), 3))
    if largest < 4 or most < 4:
        return out
    # A face's normal, and how far a centre may lie off its circumcentre.
    cross = {f"n{c}": f"(b_{a} - a_{a}) * (c_{b} - a_{b}) - (b_{b} - a_{b}) * (c_{a} - a_{a})" for c, (a, b) in zip("xyz", ("yz", "zx", "xy"), strict=True)}
    t = let(t, **cross, n2="0")
    t = t.withColumn("n2", F.expr("cast(nx * nx + ny * ny + nz * nz as double)")).where("d > 0")
    spare = f"0.375D * l2 - cast({exact.circumball(list(NAMES[:3]))['level']} as double) / (4.0D * d)"
    t = let(t, spare=spare).withColumn("reach", F.when(F.col("spare") > -1e-9 * F.col("l2"), F.sqrt(F.greatest("spare", F.lit(0.0)))).otherwise(-1.0))
    faces = t.where(_extendable(most)).groupBy("cloud", "u", "v").agg(F.array_sort(F.collect_list("pw")).alias("ws"))
    four = dealt(whole).join(faces, ["cloud", "u", "v"]).select("*", F.posexplode("ws").alias("i", "pw")).select("*", F.explode(F.expr("slice(ws, i + 2, size(ws))")).alias("px")).where(_shorter("pw", "px", _d2("pw", "px")))
    t = _ball(_tuple(four, ["pu", "pv", "pw", "px"], "lens"), 4)
    return out.unionByName(_level(t.where(_few_inside("lens", 4, most)), 4))


def classify_within(found: DataFrame, points: DataFrame) -> DataFrame:
    """Supports with the points in and on their balls: every point of a ball is within its diameter of the support's first."""
    reach = "cast(ceil(2 * sqrt(cast(num as double) / den)) as bigint)"
    met = within(found, points, "a", reach).select(*found.columns, F.col("p.id").alias("p_id"), *(F.col(f"p.{c}").alias(f"p_{c}") for c in "xyz"))
    met = let(met, side=exact.power_sign(list(NAMES), "p")).where("side <= 0")
    return met.groupBy("cloud", "label", "num", "den").agg(
        F.array_sort(F.collect_list(F.when(F.col("side") < 0, F.col("p_id")))).alias("interior"), F.array_sort(F.collect_list(F.when(F.col("side") == 0, F.col("p_id")))).alias("shell")
    )


def classified_within(points: DataFrame, most: int, largest: int = 4, pairs: DataFrame | None = None) -> DataFrame:
    """The supports of 1 to ``largest`` points whose rank (points inside, and the support) is at most ``most``, with the points in and on their
    balls: ``cloud, label, num, den, interior, shell``.  ``pairs`` as of :func:`supports_within`; tuples are grown and classified in tasks
    that hold the points near a box and some of its edges (see :mod:`.growth`), so neither tuples nor lenses are rows.
    """
    empty = F.expr("cast(array() as array<bigint>)")
    out = points.select("cloud", F.array("id").alias("label"), F.lit(0).cast("long").alias("num"), F.lit(1).cast("long").alias("den"), empty.alias("interior"), F.array("id").alias("shell"))
    if largest < 2 or most < 2:
        return out
    if pairs is None:
        pairs, _ = descend(points, max(0, most - 2), lean=LEAN if largest > 2 else 0.0)
    lo, bits = _extent(points)
    side = lambda n: points.select("cloud", F.col("id").alias(n), *(F.col(c).alias(f"{n}_{c}") for c in "xyz"))
    e = dealt(dealt(pairs).join(side("u"), ["cloud", "u"])).join(side("v"), ["cloud", "v"])
    # A box is as wide as a ball reaches: 1.5 squared edges.
    e = e.withColumn("shift", F.least(F.lit(bits), F.ceil(F.log2(F.greatest(F.sqrt(1.5 * F.expr(exact.squared_distance("v", "u"))) * (1 + SLACK), F.lit(1.0)))).cast("int")))
    key = ["cloud", "shift", "cx", "cy", "cz"]
    e = cut(e.select("*", *_cells("u_{}", lo, F.col("shift"))), "edges")
    boxes = e.groupBy(*key).agg(F.ceil(F.count("*") / GROWN).alias("lots"))
    lots = cut(boxes, "lots")
    around = lots
    for c in "xyz":
        around = around.withColumn(f"n{c}", F.explode(F.sequence(F.col(f"c{c}") - 1, F.col(f"c{c}") + 1)))
    named = _by_size(points, lo, bits).withColumnsRenamed({f"c{c}": f"n{c}" for c in "xyz"})
    near = dealt(around).join(named, ["cloud", "shift", "nx", "ny", "nz"]).select(*key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)).alias("lot"), "id", "x", "y", "z")
    e = dealt(e).join(lots, key).withColumn("lot", F.pmod(F.xxhash64("u"), F.col("lots"))).drop("lots")
    n = max(2 * points.sparkSession.sparkContext.defaultParallelism, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = [*key, "lot"]
    return out.unionByName(e.repartition(n, *at).groupBy(*at).cogroup(near.repartition(n, *at).groupBy(*at)).applyInArrow(grown(most, largest), SCHEMA))
