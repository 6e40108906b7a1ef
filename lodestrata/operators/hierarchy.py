"""Critical supports, exact miniballs, Gamma filtrations and cuts, saturated balls (merge forests: :mod:`.forest`).

All clouds of a table are worked on at once, grouped by ``cloud``.  Coordinates are integers of at most 6
bits where supports of four points are asked for (see :mod:`lodestrata.functions.exact`).  A label is a
sorted array of point ids, and its text (ids with commas between) names a node of a graph.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exact
from . import triples
from .bounded import classified_within
from .cloud import facets, gcd
from .forest import forest_cut, merge_forest
from .graph import components
from .lineage import cut, let, spread
from .spatial import pairs_within
from .stars import covered_order_two, cut_order_one, cut_order_two

NAMES = ("a", "b", "c", "d")


def label_text(label: str | Column) -> Column:
    return F.array_join(label, ",")


def level(num: str = "num", den: str = "den") -> Column:
    """The exact level as a key that sorts."""
    return F.expr(exact.level_key(num, den))


def _tuples(points: DataFrame, size: int, pairs: DataFrame | None = None) -> DataFrame:
    """All sorted tuples of ``size`` points of a cloud with their coordinates; with ``pairs(cloud, u, v)``, u < v, only
    those whose points are all paired.  Work is dealt out by pairs, so a large cloud is no large task."""
    out = None
    for k, name in enumerate(NAMES[:size]):
        p = points.select("cloud", F.col("id").alias(f"{name}_id"), *(F.col(c).alias(f"{name}_{c}") for c in "xyz"))
        if out is None:
            out = p
        elif pairs is None:
            out = out.join(p, "cloud").where(f"{NAMES[k - 1]}_id < {name}_id")
        else:
            for n, earlier in enumerate(NAMES[k - 1 :: -1] if k > 1 else NAMES[:1]):
                e = pairs.select("cloud", F.col("u").alias(f"{earlier}_id"), F.col("v").alias(f"{name}_id"))
                out = out.join(e, ["cloud", f"{earlier}_id"] + [f"{name}_id"] * (n > 0))
            out = out.join(p, ["cloud", f"{name}_id"])
        if k == 1 and size > 2:
            out = spread(out, "cloud", "a_id", "b_id")
    return out


def k_subsets(points: DataFrame, k: int, pairs: DataFrame | None = None) -> DataFrame:
    """``cloud, label`` of every k-subset: a join on the cloud per member, each id larger than the last; with ``pairs``
    (cloud, u, v), u < v, of those whose points are all paired."""
    out = points.select("cloud", F.array("id").alias("label"))
    for _ in range(k - 1):
        last = F.element_at("label", -1)
        if pairs is None:
            out = out.join(points.select("cloud", "id"), "cloud").where(F.col("id") > last)
        else:
            out = out.withColumn("u", last).join(pairs.select("cloud", "u", F.col("v").alias("id")), ["cloud", "u"])
        out = out.select("cloud", F.concat("label", F.array("id")).alias("label"))
    if pairs is None or k < 3:
        return out
    # Every pair of a label is a pair: as many as it has, after an equi-join.
    at = out.select("cloud", "label", F.explode(F.expr("flatten(transform(label, (x, i) -> transform(slice(label, i + 2, size(label)), y -> struct(x AS u, y AS v))))")).alias("e"))
    whole = at.select("cloud", "label", "e.u", "e.v").join(pairs.select("cloud", "u", "v"), ["cloud", "u", "v"]).groupBy("cloud", "label").agg(F.count("*").alias("n"))
    return whole.where(F.col("n") == k * (k - 1) // 2).select("cloud", "label")


def coface_counts(points: DataFrame, order: int) -> DataFrame:
    """``cloud, label, cofaces`` of every ``order``-subset that has a coface: every other point of the cloud makes one, so they are
    counted by the cloud's points and not listed."""
    n = points.groupBy("cloud").agg((F.count("*") - order).alias("cofaces")).where("cofaces > 0")
    return k_subsets(spread(points, "cloud", "id"), order).join(F.broadcast(n), "cloud").select("cloud", "label", "cofaces")


def supports(points: DataFrame, largest: int = 4, pairs: DataFrame | None = None) -> DataFrame:
    """Every affinely independent, well-centred support of 1 to ``largest`` points: ``cloud, label, num, den``
    (squared level, in lowest terms) and what its power test needs.  Well-centred: every barycentric numerator
    of the circumcentre is positive.  With ``pairs`` only supports whose points are all paired.
    """
    one = points.select("cloud", F.array("id").alias("label"), F.lit(0).cast("long").alias("num"), F.lit(1).cast("long").alias("den"), F.lit(1).cast("long").alias("d"), *(F.lit(0).cast("long").alias(f"m{i}") for i in (1, 2, 3)), *(F.col(c).alias(f"a_{c}") for c in "xyz"), *(F.col(c).alias(f"{n}_{c}") for n in NAMES[1:] for c in "xyz"))
    out = one
    for size in range(2, largest + 1):
        names = list(NAMES[:size])
        ball = exact.circumball(names)
        ms = [f"m{i + 1}" for i in range(size - 1)]
        t = let(_tuples(points, size, pairs), **exact.gram_columns(names))
        t = let(t, d=ball["D"], **dict(zip(ms, ball["M"], strict=True)))
        t = t.where("d > 0 AND " + " AND ".join(f"{m} > 0" for m in ms) + f" AND 2 * d - ({' + '.join(ms)}) > 0")
        t = let(t, raw=ball["level"]).withColumn("g", F.greatest(gcd(F.col("raw"), 4 * F.col("d")), F.lit(1).cast("long")))
        t = t.select(
            "cloud", F.array(*(F.col(f"{n}_id") for n in names)).alias("label"), F.expr("raw div g").alias("num"), F.expr("(4 * d) div g").alias("den"), "d",
            *((F.col(f"m{i}") if i < size else F.lit(0).cast("long")).alias(f"m{i}") for i in (1, 2, 3)), *(F.col(f"{n if n in names else 'a'}_{c}").alias(f"{n}_{c}") for n in NAMES for c in "xyz"),
        )
        out = out.unionByName(t)
    return out


def _classify(found: DataFrame, points: DataFrame, near: DataFrame | None) -> DataFrame:
    p = points.select("cloud", F.col("id").alias("p_id"), *(F.col(c).alias(f"p_{c}") for c in "xyz"))
    if near is None:
        met = found.join(p, "cloud")
    else:
        met = found.withColumn("id", F.col("label")[0]).join(near, ["cloud", "id"]).join(p, ["cloud", "p_id"])
    met = let(met, side=exact.power_sign(list(NAMES), "p")).where("side <= 0")
    return met.groupBy("cloud", "label", "num", "den").agg(
        F.array_sort(F.collect_list(F.when(F.col("side") < 0, F.col("p_id")))).alias("interior"), F.array_sort(F.collect_list(F.when(F.col("side") == 0, F.col("p_id")))).alias("shell")
    )


def classified(points: DataFrame, largest: int = 4, until: tuple[int, int] | None = None) -> DataFrame:
    """Supports with the points inside (``interior``) and on (``shell``) their ball: ``cloud, label, num, den`` and these.

    ``until`` = (num, den) asks for balls up to that level only: then points of a support, and points in its ball, are
    at most its diameter apart, and pairs within it, found by grid cells, take the place of the whole cloud.
    """
    if until is None:
        return _classify(supports(points, largest), points, None)
    pairs = cut(near_pairs(points, until), "near")
    return _classify(supports(points, largest, pairs).where(_until(*until, True)), points, _neighbours(points, pairs))


def near_pairs(points: DataFrame, until: tuple[int, int]) -> DataFrame:
    """``cloud, u, v`` of pairs u < v that fit in a ball of a squared level: squared distance at most 4 of it."""
    return pairs_within(points, 4 * until[0] // until[1]).select("cloud", "u", "v")


def _neighbours(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """``cloud, id, p_id``: every point with itself and what it is paired with."""
    u, v = F.col("u"), F.col("v")
    both = pairs.select("cloud", u.alias("id"), v.alias("p_id")).unionAll(pairs.select("cloud", v.alias("id"), u.alias("p_id")))
    return both.unionAll(points.select("cloud", "id", F.col("id").alias("p_id")))


def critical_catalog(points: DataFrame, k_max: int, largest: int = 4) -> DataFrame:
    """Critical events and degeneracies of rank at most s_max = min(k_eff + 1, n), k_eff = min(k_max, n).

    ``kind`` is ``event`` (the shell is the support) or ``extra_shell``; ``birth_order`` and ``saddle_order``
    are null where the event has no such role.  Supports are grown from edges whose spindle holds few points (see
    :mod:`.bounded`), and their balls meet only the points of the boxes around them: tuples of a cloud are never listed.
    """
    n = points.groupBy("cloud").agg(F.count("*").alias("n")).withColumn("k_eff", F.least(F.lit(k_max), "n"))
    found = cut(classified_within(points, k_max + 1, largest), "supports")
    c = found.join(n, "cloud").withColumn("rank", F.size("interior") + F.size("shell"))
    s_max = F.least(F.col("k_eff") + 1, F.col("n"))
    extra = F.size("shell") > F.size("label")
    c = c.where(F.when(extra, F.size("interior") + F.size("label")).otherwise(F.col("rank")) <= s_max)
    event = ~extra
    return c.select(
        "cloud", "label", "num", "den", "interior", "shell", "rank", F.when(extra, "extra_shell").otherwise("event").alias("kind"),
        F.when(event & (F.col("rank") <= F.col("k_eff")), F.col("rank")).alias("birth_order"), F.when(event & (F.col("rank") >= 2) & (F.col("rank") <= F.col("k_eff") + 1), F.col("rank") - 1).alias("saddle_order"),
    )


def saddle_arms(catalog: DataFrame) -> DataFrame:
    """Per saddle the facets (interior + shell) without one shell point."""
    s = catalog.where("saddle_order IS NOT NULL").withColumn("all", F.array_sort(F.concat("interior", "shell")))
    return s.select("cloud", "label", "saddle_order", F.explode("shell").alias("left_out"), "all").select("cloud", "label", "saddle_order", "left_out", F.array_remove("all", F.col("left_out")).alias("facet"))


def closed_incidences(catalog: DataFrame) -> DataFrame:
    """Per saddle the facets of the same level: (interior + shell) without one interior point."""
    s = catalog.where("saddle_order IS NOT NULL").withColumn("all", F.array_sort(F.concat("interior", "shell")))
    return s.select("cloud", "label", "saddle_order", F.explode("interior").alias("left_out"), "all").select("cloud", "label", "saddle_order", "left_out", F.array_remove("all", F.col("left_out")).alias("facet"))


def event_batches(catalog: DataFrame) -> DataFrame:
    """Births and saddles by (order, exact level): how many, at once."""
    roles = catalog.select("cloud", "num", "den", F.explode(F.array(F.struct(F.lit("birth").alias("role"), F.col("birth_order").alias("order")), F.struct(F.lit("saddle").alias("role"), F.col("saddle_order").alias("order")))).alias("r")).where("r.order IS NOT NULL")
    return roles.groupBy("cloud", F.col("r.order").alias("order"), "num", "den").agg(F.count_if(F.col("r.role") == "birth").alias("births"), F.count_if(F.col("r.role") == "saddle").alias("saddles"))


def miniballs(labels: DataFrame, balls: DataFrame) -> DataFrame:
    """Exact smallest enclosing ball of every label: ``cloud, label, num, den, support``.

    ``balls(cloud, label, num, den)`` has the well-centred supports among the labels' points.  Of those inside a label
    the one of the largest ball is the label's (no ball that holds the label is smaller, and its own support is among them;
    equal balls have equal points, and the first support is given): an equi-join on the sub-labels, and a maximum.
    """
    subs = F.expr("filter(transform(sequence(1, shiftleft(1, size(label)) - 1), m -> filter(label, (x, i) -> getbit(m, i) = 1)), s -> size(s) <= 4)")
    at = labels.select("cloud", "label", F.explode(subs).alias("support"))
    b = balls.select("cloud", F.col("label").alias("support"), "num", "den", level().alias("at"))
    least = F.struct((-F.col("at.q")).alias("q"), (-F.col("at.hi")).alias("hi"), (-F.col("at.lo")).alias("lo"), F.size("support").alias("n"), "support", "num", "den")
    best = at.join(b, ["cloud", "support"]).groupBy("cloud", "label").agg(F.min(least).alias("b"))
    return best.select("cloud", "label", "b.num", "b.den", "b.support")


def pair_facets(points: DataFrame, until: tuple[int, int] | None = None) -> DataFrame:
    """The facets of order 2, ``cloud, label, num, den``: a pair's ball is the one over it."""
    if until is None:
        a = spread(points, "cloud", "id").select("cloud", F.col("id").alias("u"), *(F.col(c).alias(f"u_{c}") for c in "xyz"))
        b = points.select("cloud", F.col("id").alias("v"), *(F.col(c).alias(f"v_{c}") for c in "xyz"))
        pairs = a.join(b, "cloud").where("u < v").withColumn("d2", F.expr(exact.squared_distance("u", "v")))
    else:
        pairs = pairs_within(points, 4 * until[0] // until[1])
    den = F.when(F.col("d2") % 4 == 0, 1).when(F.col("d2") % 2 == 0, 2).otherwise(4).cast("long")
    return pairs.select("cloud", F.array("u", "v").alias("label"), "d2", den.alias("den")).select("cloud", "label", F.expr("d2 * den div 4").alias("num"), "den")


def gamma_filtration(points: DataFrame, order: int, until: tuple[int, int] | None = None, ball: Callable[[DataFrame, DataFrame], DataFrame] | None = None, kept: str = "all", gabriel: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(facets, cofaces)`` of one order with exact levels; a coface is ``gabriel`` if no other point is strictly
    inside its ball.  ``until`` asks for those up to a level only, which are cliques of near pairs (see :func:`classified`).
    ``ball`` replaces :func:`miniballs`: a function of labels and supports.

    Cofaces of order 2 are made in tasks (see :mod:`.triples`); of these ``kept`` may ask for some that do for what follows, and ``gabriel`` be left out."""
    if order == 2 and ball is None:
        return pair_facets(points, until), triples.cofaces(points, kept, until, gabriel).select("cloud", "label", "num", "den", "gabriel")
    ball = ball or miniballs
    pairs = None if until is None else cut(near_pairs(points, until), "near")
    found = cut(supports(points, min(4, order + 1), pairs=pairs), "supports")

    def upto(t: DataFrame) -> DataFrame:
        return t if until is None else t.where(_until(*until, True))

    found_facets = upto(ball(k_subsets(points, order, pairs), found))
    cofaces = cut(upto(ball(k_subsets(points, order + 1, pairs), found)), "cofaces")
    used = found.join(cofaces.select("cloud", F.col("support").alias("label")).distinct(), ["cloud", "label"], "left_semi")
    inside = _classify(used, points, None if pairs is None else _neighbours(points, pairs)).select("cloud", F.col("label").alias("support"), "interior")
    cofaces = cofaces.join(inside, ["cloud", "support"])
    return found_facets, cofaces.select("cloud", "label", "num", "den", "support", (F.size(F.array_except("interior", "label")) == 0).alias("gabriel"))


def _until(num: int, den: int, closed: bool) -> str:
    return f"num * {den} {'<=' if closed else '<'} {num} * den"


def gamma_cut(found_facets: DataFrame, cofaces: DataFrame, num: int, den: int = 1, closed: bool = True, gabriel: bool = False) -> DataFrame:
    """Components of facets at a level: ``cloud, facet, component`` (texts).  A coface joins its facets as a star."""
    kept = cofaces.where(_until(num, den, closed))
    kept = kept.where("gabriel") if gabriel else kept
    f = kept.select("cloud", facets(F.col("label")).alias("f"))
    edges = f.select("cloud", label_text(F.col("f")[0]).alias("u"), F.explode("f").alias("g")).select("cloud", "u", label_text("g").alias("v"))
    nodes = found_facets.where(_until(num, den, closed)).select("cloud", label_text("label").alias("node"))
    return components(nodes, edges).select("cloud", F.col("node").alias("facet"), "component")


def level_cut(points: DataFrame, order: int, num: int, den: int = 1, closed: bool = True) -> DataFrame:
    """The same from the points: orders 1 and 2 by the neighbours of every point (see :mod:`.stars`), higher ones by subsets."""
    if order <= 2:
        return (cut_order_one if order == 1 else cut_order_two)(points, num, den, closed)
    return gamma_cut(*gamma_filtration(points, order, (num, den)), num, den, closed)


def gabriel_cofaces(points: DataFrame, order: int, num: int, den: int = 1) -> DataFrame:
    """The Gabriel cofaces of :func:`gamma_filtration` up to a level: ``cloud, label, num, den, gabriel`` (true).

    A ball without other points inside has a support of a rank of at most ``order + 1``: those come by branch and bound.  What its rank
    leaves room for is taken from the shell, in every way."""
    found = cut(classified_within(points, order + 1, min(4, order + 1)).where(_until(num, den, True)), "supports")
    c = found.withColumn("base", F.array_sort(F.concat("label", "interior"))).withColumn("spare", F.array_except("shell", "label"))
    out = None
    for more in range(order):
        t = c.where(F.size("base") == order + 1 - more)
        if more:
            t = t.select("*", F.explode(sub_labels("spare", more)).alias("some"))
        t = t.select("cloud", (F.array_sort(F.concat("base", "some")) if more else F.col("base")).alias("label"), "num", "den")
        out = t if out is None else out.unionByName(t)
    return out.distinct().withColumn("gabriel", F.lit(True))


def gabriel_level_cut(points: DataFrame, num: int, den: int = 1, closed: bool = True) -> DataFrame:
    """:func:`gamma_cut` of order 2 with ``gabriel``, from the points: every pair within the level, joined by its Gabriel cofaces."""
    f = pairs_within(points, 4 * num // den).select("cloud", F.array("u", "v").alias("label"), F.col("d2").alias("num"), F.lit(4).cast("long").alias("den"))
    return gamma_cut(f, gabriel_cofaces(points, 2, num, den), num, den, closed, True)


def locate(asked: DataFrame, components_of_facets: DataFrame) -> DataFrame:
    """``cloud, facet, component, facets`` of asked facets (``cloud, label``) at a cut: whose component each is in and how many
    facets that has; nulls where a facet is not there at the level."""
    sizes = components_of_facets.groupBy("cloud", "component").agg(F.count("*").alias("facets"))
    found = components_of_facets.join(sizes, ["cloud", "component"])
    return asked.select("cloud", label_text("label").alias("facet")).distinct().join(found, ["cloud", "facet"], "left").select("cloud", "facet", "component", "facets")


def coverage(components_of_facets: DataFrame) -> DataFrame:
    """Facets and covered points per component."""
    p = components_of_facets.select("cloud", "component", "facet", F.explode(F.split("facet", ",")).alias("p"))
    return p.groupBy("cloud", "component").agg(F.count_distinct("facet").alias("facets"), F.array_join(F.array_sort(F.collect_set(F.col("p").cast("long"))), ",").alias("covered"))


def first_incidence(found_facets: DataFrame, cofaces: DataFrame) -> DataFrame:
    """Per facet its cofaces of least level, all of them."""
    c = cofaces.select("cloud", "num", "den", label_text("label").alias("coface"), F.explode(facets(F.col("label"))).alias("f")).select("cloud", "num", "den", "coface", label_text("f").alias("facet"))
    least = c.groupBy("cloud", "facet").agg(F.min(F.struct(level().alias("k"), "num", "den")).alias("m"))
    return c.join(least, ["cloud", "facet"]).where("num = m.num AND den = m.den").select("cloud", "facet", "coface", "num", "den")


def vertical_map(upper: DataFrame, lower: DataFrame) -> DataFrame:
    """Component of order k + 1 to the component of order k that holds its facets' facets, at one cut.

    ``targets`` counts distinct targets and is 1 where the map is well defined."""
    f = upper.select("cloud", F.col("component").alias("source"), F.explode(facets(F.split("facet", ","))).alias("f"))
    met = f.join(lower.select("cloud", F.col("facet").alias("f_text"), F.col("component").alias("target")), (F.array_join("f", ",") == F.col("f_text")) & (f["cloud"] == lower["cloud"])).select(f["cloud"], "source", "target")
    return met.groupBy("cloud", "source").agg(F.min("target").alias("target"), F.count_distinct("target").alias("targets"))


def generators(points: DataFrame, order: int, num: int, den: int = 1) -> DataFrame:
    """``cloud, node, members``: the point sets, of at least ``order`` points, of the closed balls of well-centred
    supports up to a level; ``node`` is their text."""
    balls = classified(points, until=(num, den)).select("cloud", F.array_sort(F.concat("interior", "shell")).alias("members")).distinct()
    return balls.where(F.size("members") >= order).select("cloud", label_text("members").alias("node"), "members")


def sub_labels(label: str, size: int) -> Column:
    """All sorted sub-labels of ``size`` ids of a sorted label."""
    out = f"transform({label}, (x, i) -> array(x))"
    for _ in range(size - 1):
        out = f"flatten(transform({out}, s -> transform(filter({label}, y -> y > element_at(s, -1)), y -> concat(s, array(y)))))"
    return F.expr(out)


def saturated_cut(points: DataFrame, order: int, num: int, den: int = 1) -> DataFrame:
    """Components of the closed cut at an order by saturated balls: ``cloud, covered``.

    Generators are the closed balls of well-centred supports, as sets of points; two are joined where they
    share at least ``order`` points.  Balls with the same ``order`` points form a bucket, in which each is linked with the
    first only: as many links as buckets have members.  Subsets are listed within balls, never of a cloud.

    At order 2 no ball need be listed: the pairs in one ball are joined by its triples, and triples join neighbours of a point (see
    :mod:`.stars`), where a ball of many points is as large as a ball of few.
    """
    if order == 2:
        return covered_order_two(points, num, den)
    g = cut(generators(points, order, num, den), "generators")
    at = g.select("cloud", "node", F.explode(sub_labels("members", order)).alias("shared"))
    first = at.groupBy("cloud", "shared").agg(F.min("node").alias("u"))
    met = at.join(first, ["cloud", "shared"]).select("cloud", "u", F.col("node").alias("v")).where("u <> v").distinct()
    found = components(g.select("cloud", "node"), met)
    p = found.join(g.select("cloud", "node", F.explode("members").alias("p")), ["cloud", "node"])
    return p.groupBy("cloud", "component").agg(F.array_join(F.array_sort(F.collect_set("p")), ",").alias("covered")).select("cloud", "covered")


class Engine:
    """What :func:`run_oracle` asks for; another engine may give any of the three in another way."""

    def catalog(self, points: DataFrame, k_max: int) -> DataFrame:
        return critical_catalog(points, k_max)

    def order(self, points: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """Facets and cofaces of an order."""
        return gamma_filtration(points, k)

    def vertical(self, upper: DataFrame, lower: DataFrame) -> DataFrame:
        return vertical_map(upper, lower)


def run_oracle(points: DataFrame, k_max: int, at: int, engine: Engine | None = None) -> DataFrame:
    """Per cloud one result: ``points, events, status, steps_1, steps_2, maps_sound``.

    ``refused`` where a shell holds more than its support (degenerate), else ``complete``; steps of the reduced forests of orders 1
    and 2; whether every component of order 2 has one image at order 1 at a level."""
    engine = engine or Engine()
    c = engine.catalog(points, k_max)
    event = F.col("kind") == "event"
    found = c.groupBy("cloud").agg(F.count_if(event).alias("events"), F.when(F.count_if(~event) > 0, "refused").otherwise("complete").alias("status"))
    out = points.groupBy("cloud").agg(F.count("*").alias("points")).join(found, "cloud", "left")
    cuts = {}
    for order in (1, 2):
        f, cofaces = (cut(t, "filtration") for t in engine.order(points, order))
        steps = merge_forest(f, cofaces).groupBy("cloud").agg(F.count("*").alias(f"steps_{order}"))
        out = out.join(steps, "cloud", "left")
        cuts[order] = gamma_cut(f, cofaces, at)
    sound = engine.vertical(cuts[2], cuts[1]).groupBy("cloud").agg((F.max("targets") == 1).alias("maps_sound"))
    out = out.join(sound, "cloud", "left")
    counts = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("steps_1", "steps_2")]
    return out.select("cloud", "points", F.coalesce("events", F.lit(0)).cast("long").alias("events"), F.coalesce("status", F.lit("complete")).alias("status"), *counts, F.coalesce("maps_sound", F.lit(True)).alias("maps_sound"))
