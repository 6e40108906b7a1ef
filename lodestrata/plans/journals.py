"""Queries over journals: facet logs, descents, arms of saddles, overlays, gateways and their clocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exact
from ..operators import hierarchy, journals, triples
from ..operators.lineage import cut
from .catalog import query
from .clouds import sup
from .hierarchies import CATALOG_SQL, CLASSIFIED_SQL, K_MAX, LEVEL, ORDER, _cut_sql, _gamma, _gamma_sql, _history_sql, _text, _with

_LEVELS = exact.level_order_sql()
_FULL = _history_sql(ORDER, "h", reduced=False)
_GAMMA = f"{_gamma_sql(ORDER)}, {_FULL}"
_N = "CAST(num AS BIGINT) AS num, CAST(den AS BIGINT) AS den"


def _log(spark, sf_dir, order=ORDER, until=None):
    f, c = _gamma(spark, sf_dir, order, until, kept="joining")  # nothing changes at the others
    return f, c, cut(journals.facet_log(f, c), "log")


@query("facet_locator", _with(CLASSIFIED_SQL, _GAMMA) + f"SELECT cloud, facet, {_N}, component FROM (SELECT *, lag(component) OVER (PARTITION BY cloud, facet ORDER BY {_LEVELS}) AS was FROM h_k WHERE closed) WHERE was IS NULL OR was <> component")
def facet_locator(spark, sf_dir):
    """The commit log of facets and components."""
    return _log(spark, sf_dir)[2]


@query("facet_prefix_sweep", _with(CLASSIFIED_SQL, _gamma_sql(ORDER), _cut_sql(ORDER, LEVEL)) + "SELECT cloud, facet, component FROM cut")
def facet_prefix_sweep(spark, sf_dir):
    """The log as of a level; its SQL twin recomputes the cut."""
    return journals.as_of(_log(spark, sf_dir, until=LEVEL)[2], LEVEL)


def _arms_sql(order: int, name: str = "arm") -> str:
    return f"{name}_s AS (SELECT *, unnest(shell) AS left_out FROM catalog WHERE saddle_order = {order}), {name} AS (SELECT cloud, array_to_string(label, ',') AS saddle, num, den, array_to_string(list_filter(list_sort(list_concat(interior, shell)), lambda v: v <> left_out), ',') AS facet FROM {name}_s)"


_BELOW = "below AS (SELECT a.*, k.component FROM arm a LEFT JOIN h_k k ON NOT k.closed AND k.cloud = a.cloud AND k.num = a.num AND k.den = a.den AND k.facet = a.facet)"


def _located_arms(spark, sf_dir, log, order=ORDER):
    c = cut(hierarchy.critical_catalog(sup(spark, sf_dir), K_MAX), "catalogue")
    return c, journals.located(journals.saddle_arm_facets(c, order), log, strictly=True)


@query("critical_arm_gamma", _with(CATALOG_SQL, _GAMMA, _arms_sql(ORDER), _BELOW) + f"SELECT cloud, saddle, {_N}, facet, component FROM below")
def critical_arm_gamma(spark, sf_dir):
    """Arms of saddles with the component that holds them strictly below."""
    return _located_arms(spark, sf_dir, _log(spark, sf_dir)[2])[1]


def _journal_sql(order: int) -> str:
    g, h = _gamma_sql(order), _history_sql(order, f"h{order}", reduced=False)
    below = _BELOW.replace("below AS", f"below{order} AS").replace("FROM arm a", f"FROM arm{order} a").replace("h_k", f"h{order}_k")
    return f"{g}, {h}, {_arms_sql(order, f'arm{order}')}, {below}"


_ENTRY = "SELECT cloud, saddle AS label, {n}, CAST({o} AS INT) AS order_, CASE WHEN count(DISTINCT component) > 1 THEN 'multifusion' ELSE 'continuation' END AS kind, CAST(count(DISTINCT component) AS BIGINT) AS q FROM below{o} GROUP BY cloud, saddle, num, den UNION ALL SELECT cloud, array_to_string(label, ','), {n}, CAST({o} AS INT), 'birth', CAST(0 AS BIGINT) FROM catalog WHERE birth_order = {o}"


@query("morse_forest_journal", _with(CATALOG_SQL, _journal_sql(1), _journal_sql(2)) + " UNION ALL ".join(_ENTRY.format(n=_N, o=o) for o in (1, 2)))
def morse_forest_journal(spark, sf_dir):
    """Births, continuations and fusions of orders 1 and 2, event by event, from the catalogue alone and the log below."""
    out = None
    for order in (1, 2):
        c, arms = _located_arms(spark, sf_dir, _log(spark, sf_dir, order)[2], order)
        q = F.count_distinct("component")
        saddles = arms.groupBy("cloud", F.col("saddle").alias("label"), "num", "den").agg(F.lit(order).alias("order_"), F.when(q > 1, "multifusion").otherwise("continuation").alias("kind"), q.alias("q"))
        births = c.where(F.col("birth_order") == order).select("cloud", hierarchy.label_text("label").alias("label"), "num", "den", F.lit(order).alias("order_"), F.lit("birth").alias("kind"), F.lit(0).cast("long").alias("q"))
        both = saddles.unionByName(births)
        out = both if out is None else out.unionByName(both)
    return out


@query("morse_vertical_trace", _with(CATALOG_SQL, _journal_sql(1), _journal_sql(2)) + f"SELECT b.cloud, b.saddle, b.facet, b.component AS upper, min(k.component) AS lower, CAST(count(DISTINCT k.component) AS BIGINT) AS targets, CAST(b.num AS BIGINT) AS num, CAST(b.den AS BIGINT) AS den FROM (SELECT *, unnest(string_split(component, ',')) AS p FROM below2) b LEFT JOIN (SELECT l.cloud, l.num, l.den, r.facet, r.component FROM h2_l l JOIN h1_k r ON r.closed AND r.cloud = l.cloud JOIN (SELECT l.cloud, l.num, l.den, max(z.rank) AS rank FROM h2_l l JOIN (SELECT *, row_number() OVER (PARTITION BY cloud ORDER BY {_LEVELS}) AS rank FROM h1_l) z ON z.cloud = l.cloud AND CAST(z.num AS HUGEINT) * l.den < CAST(l.num AS HUGEINT) * z.den GROUP BY 1, 2, 3) m ON m.cloud = l.cloud AND m.num = l.num AND m.den = l.den JOIN (SELECT *, row_number() OVER (PARTITION BY cloud ORDER BY {_LEVELS}) AS rank FROM h1_l) z ON z.cloud = l.cloud AND z.rank = m.rank AND z.num = r.num AND z.den = r.den) k ON k.cloud = b.cloud AND k.num = b.num AND k.den = b.den AND k.facet = b.p GROUP BY b.cloud, b.saddle, b.facet, b.component, b.num, b.den")
def morse_vertical_trace(spark, sf_dir):
    """The components of order 2 that a saddle's arms end in, each traced to the component of order 1 that holds its
    points strictly below the saddle's level (``targets`` is 1)."""
    arms = _located_arms(spark, sf_dir, _log(spark, sf_dir, 2)[2], 2)[1].withColumnRenamed("component", "upper")
    asked = arms.select("cloud", "saddle", F.col("facet").alias("arm"), "upper", "num", "den", F.explode(F.split("upper", ",")).alias("facet"))
    down = journals.located(asked, _log(spark, sf_dir, 1)[2], strictly=True)
    return down.groupBy("cloud", "saddle", F.col("arm").alias("facet"), "upper", "num", "den").agg(F.min("component").alias("lower"), F.count_distinct("component").alias("targets"))


_STEPS = (
    f"placed AS (SELECT f.cloud, f.label, f.num, f.den, f.support, p.p_id, row_number() OVER (PARTITION BY f.cloud, f.label ORDER BY {exact.power_sign(list(hierarchy.NAMES), 'p')}, p.p_id) AS place FROM facets{ORDER} f JOIN supports s ON s.cloud = f.cloud AND s.label = f.support "
    f"JOIN (SELECT cloud AS pc, id AS p_id, x AS p_x, y AS p_y, z AS p_z FROM sup) p ON pc = f.cloud), steps AS (SELECT cloud, label, num, den, support, list(p_id ORDER BY p_id) AS successor FROM placed WHERE place <= {ORDER} GROUP BY ALL), "
    "fall(cloud, label, spot, n) AS (SELECT cloud, label, label, 0 FROM steps UNION ALL SELECT d.cloud, d.label, s.successor, d.n + 1 FROM fall d JOIN steps s ON s.cloud = d.cloud AND s.label = d.spot WHERE s.successor <> s.label), "
    "ends AS (SELECT cloud, label, arg_max(spot, n) AS terminal, max(n) AS n FROM fall GROUP BY 1, 2)"
)
_DESCENT = f"{_gamma_sql(ORDER)}, {_STEPS}"


def _steps(spark, sf_dir):
    return cut(journals.pair_descents(sup(spark, sf_dir)), "steps")  # ORDER is 2


@query("facet_descent", _with(CLASSIFIED_SQL, _DESCENT) + f"SELECT s.cloud, {_text('s.label', 's.successor').replace('AS s.', 'AS ')}, CAST(s.num AS BIGINT) AS num, CAST(s.den AS BIGINT) AS den, CAST(t.num AS BIGINT) AS to_num, CAST(t.den AS BIGINT) AS to_den, s.label = s.successor AS terminal FROM steps s JOIN facets{ORDER} t ON t.cloud = s.cloud AND t.label = s.successor")
def facet_descent(spark, sf_dir):
    """One step of every facet: the points nearest to its ball's centre, with both levels."""
    return journals.pair_falls(sup(spark, sf_dir))  # ORDER is 2


@query("descent_closure", _with(CLASSIFIED_SQL, _DESCENT) + f"SELECT cloud, {_text('label', 'terminal')}, CAST(n AS BIGINT) AS steps FROM ends")
def descent_closure(spark, sf_dir):
    """Where repeated steps end, and after how many."""
    return journals.pair_closure(sup(spark, sf_dir))


@query("critical_arm", _with(CATALOG_SQL, _DESCENT, _arms_sql(ORDER)) + "SELECT a.cloud, a.saddle, array_to_string(e.terminal, ',') AS terminal, CAST(count(*) AS BIGINT) AS arms, CAST(max(e.n) AS BIGINT) AS longest FROM arm a JOIN ends e ON e.cloud = a.cloud AND array_to_string(e.label, ',') = a.facet GROUP BY 1, 2, 3")
def critical_arm(spark, sf_dir):
    """The arms of every saddle, grouped by the facet in which their descent ends."""
    p = sup(spark, sf_dir)
    arms = cut(journals.saddle_arm_facets(hierarchy.critical_catalog(p, K_MAX), ORDER), "arms")
    ends = journals.ends_of_pairs(p, arms.select("cloud", F.col("facet").alias("label"))).withColumnRenamed("label", "facet")
    return arms.join(ends, ["cloud", "facet"]).groupBy("cloud", "saddle", "terminal").agg(F.count("*").alias("arms"), F.max("steps").alias("longest"))


@query("descent_batch_plan", _with(CLASSIFIED_SQL, _DESCENT) + "SELECT cloud, CAST(lane AS INT) AS lane, CAST(k // 8 AS INT) AS chunk, CAST(count(*) AS BIGINT) AS facets, CAST(count(*) FILTER (label <> successor) AS BIGINT) AS moving FROM (SELECT *, len(support) AS lane, row_number() OVER (PARTITION BY cloud, len(support) ORDER BY label) - 1 AS k FROM steps) GROUP BY 1, 2, 3")
def descent_batch_plan(spark, sf_dir):
    """Facets dealt into lanes by the size of their support and into chunks of eight, and how many of a chunk move."""
    s = journals.pair_descents(sup(spark, sf_dir)).withColumn("lane", F.size("support"))  # of pairs: all in one lane, numbered where they are made
    return s.withColumn("chunk", F.floor(F.col("place") / 8).cast("int")).groupBy("cloud", "lane", "chunk").agg(F.count("*").alias("facets"), F.count_if(F.col("label") != F.col("successor")).alias("moving"))


@query("descent_transcript", _with(CLASSIFIED_SQL, _DESCENT) + "SELECT cloud, sha256(string_agg(t, ' ' ORDER BY t)) AS digest FROM (SELECT cloud, array_to_string(label, ',') || '>' || array_to_string(successor, ',') AS t FROM steps) GROUP BY 1")
def descent_transcript(spark, sf_dir):
    """A digest of all steps of a cloud."""
    t = F.concat(hierarchy.label_text("label"), F.lit(">"), hierarchy.label_text("successor"))
    return _steps(spark, sf_dir).groupBy("cloud").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(t)), " "), 256).alias("digest"))


@query("event_gamma_overlay", _with(CATALOG_SQL, _GAMMA, _arms_sql(ORDER), _BELOW) + ", e AS (SELECT cloud, num, den, count(*) AS n FROM (SELECT cloud, saddle, num, den FROM below GROUP BY ALL HAVING count(DISTINCT component) > 1) GROUP BY 1, 2, 3), g AS (SELECT cloud, num, den, count(*) AS n, sum(q) AS q FROM h WHERE q > 1 GROUP BY 1, 2, 3) SELECT coalesce(e.cloud, g.cloud) AS cloud, CAST(coalesce(e.num, g.num) AS BIGINT) AS num, CAST(coalesce(e.den, g.den) AS BIGINT) AS den, CAST(coalesce(e.n, 0) AS BIGINT) AS fusions, CAST(coalesce(g.n, 0) AS BIGINT) AS merges, CAST(coalesce(g.q, 0) AS BIGINT) AS merged FROM e FULL JOIN g ON e.cloud = g.cloud AND e.num = g.num AND e.den = g.den")
def event_gamma_overlay(spark, sf_dir):
    """Level by level, the saddles that join components against the merges of the filtration: a full outer join."""
    f, c, log = _log(spark, sf_dir)
    at = ["cloud", "num", "den"]
    arms = _located_arms(spark, sf_dir, log)[1].groupBy(*at, "saddle").agg(F.count_distinct("component").alias("q")).where("q > 1")
    e = arms.groupBy(*at).agg(F.count("*").alias("fusions"))
    g = hierarchy.merge_forest(f, c, reduced=False).where("q > 1").groupBy(*at).agg(F.count("*").alias("merges"), F.sum("q").alias("merged"))
    return e.join(g, at, "full").select(*at, *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("fusions", "merges", "merged")))


def _sweep_sql(name: str, edges: str) -> str:
    """Components by least facet at every level under relations ``edges``, and the gaps to the full cuts."""
    n = name
    return (
        f"{n}_b AS (SELECT l.cloud, l.num, l.den, e.u, e.v FROM h_l l JOIN ({edges}) e ON e.cloud = l.cloud AND CAST(e.num AS HUGEINT) * l.den <= CAST(l.num AS HUGEINT) * e.den), {n}_d AS (SELECT * FROM {n}_b UNION SELECT cloud, num, den, v, u FROM {n}_b), "
        f"{n}_r(cloud, num, den, u, v) AS (SELECT cloud, num, den, node, node FROM h_n UNION SELECT r.cloud, r.num, r.den, r.u, d.v FROM {n}_r r JOIN {n}_d d ON d.cloud = r.cloud AND d.num = r.num AND d.den = r.den AND d.u = r.v), "
        f"{n} AS (SELECT k.cloud, CAST(k.num AS BIGINT) AS num, CAST(k.den AS BIGINT) AS den, CAST(count(*) AS BIGINT) AS facets, CAST(count(*) FILTER (m.component <> k.component) AS BIGINT) AS differing FROM h_k k JOIN (SELECT cloud, num, den, u, min(v) AS component FROM {n}_r GROUP BY 1, 2, 3, 4) m ON m.cloud = k.cloud AND m.num = k.num AND m.den = k.den AND m.u = k.facet WHERE k.closed GROUP BY 1, 2, 3)"
    )


_MORSE_EDGES = "SELECT cloud, array_to_string(label, ',') AS u, array_to_string(successor, ',') AS v, num, den FROM steps WHERE label <> successor UNION ALL SELECT a.cloud, b.facet, a.facet, a.num, a.den FROM arm a JOIN arm b ON a.cloud = b.cloud AND a.saddle = b.saddle AND a.facet <> b.facet"


@query("morse_gamma_sweep", _with(CATALOG_SQL, _GAMMA, _STEPS, _arms_sql(ORDER), _sweep_sql("m", _MORSE_EDGES)) + "SELECT * FROM m")
def morse_gamma_sweep(spark, sf_dir):
    """At every level, facets that the Morse genealogy (descents and saddles) puts elsewhere than the filtration."""
    f, c = _gamma(spark, sf_dir, kept="joining")
    arms = cut(journals.saddle_arm_facets(hierarchy.critical_catalog(sup(spark, sf_dir), K_MAX), ORDER), "arms")
    return journals.partition_gaps(f, journals.coface_relations(c), journals.morse_relations(_steps(spark, sf_dir), arms), _levels_of(sup(spark, sf_dir)))


_FIRST = f"fi_x AS (SELECT cloud, num, den, label AS coface, gabriel, list_filter(label, lambda v: v <> label[k]) AS facet FROM (SELECT *, len(list_filter(interior, lambda v: NOT list_contains(label, v))) = 0 AS gabriel, unnest(range(1, {ORDER + 2})) AS k FROM cofaces{ORDER})), fi_r AS (SELECT *, rank() OVER (PARTITION BY cloud, facet ORDER BY {_LEVELS}) = 1 AS first FROM fi_x), gates AS (SELECT cloud, num, den, coface AS label, gabriel, bool_or(first) AS first FROM fi_r GROUP BY ALL HAVING gabriel OR bool_or(first))"
_STAR = "SELECT cloud, array_to_string(list_filter(label, lambda v: v <> label[1]), ',') AS u, array_to_string(list_filter(label, lambda v: v <> label[k]), ',') AS v, num, den FROM (SELECT *, unnest(range(2, {n})) AS k FROM gates WHERE {kept})"
_KINDS = {"both": "true", "gabriel": "gabriel", "first": "first"}


def _gates(spark, sf_dir, kept="gates"):
    p = sup(spark, sf_dir)
    return p, cut(triples.cofaces(p, kept, least=cut(triples.least_levels(p), "least")), "gates")


def _levels_of(points):
    return triples.cofaces(points, "levels").select("cloud", "num", "den")


@query("gateway_differential", _with(CLASSIFIED_SQL, _GAMMA, _FIRST, *(_sweep_sql(f"g_{k}", _STAR.format(n=ORDER + 2, kept=kept)) for k, kept in _KINDS.items())) + " UNION ALL ".join(f"SELECT *, '{k}' AS generator FROM g_{k}" for k in _KINDS))
def gateway_differential(spark, sf_dir):
    """Do Gabriel cofaces and first incidences generate the filtration?  Facets in another component, at every level, with
    both, and with either left out."""
    p, some = _gates(spark, sf_dir, "genealogy")
    f, levels = hierarchy.pair_facets(p), cut(_levels_of(p).distinct(), "levels")
    out = None
    for k, kept in (_KINDS | {"both": "gabriel OR first"}).items():
        gap = journals.partition_gaps(f, journals.coface_relations(some), journals.coface_relations(some.where(kept)), levels).withColumn("generator", F.lit(k))
        out = gap if out is None else out.unionByName(gap)
    return out


@query("gateway_candidate", _with(CLASSIFIED_SQL, _gamma_sql(ORDER), _FIRST) + f"SELECT cloud, {_text('label')}, {_N}, gabriel, first, CAST(dense_rank() OVER (PARTITION BY cloud ORDER BY {_LEVELS}) AS INT) AS batch FROM gates")
def gateway_candidate(spark, sf_dir):
    """Candidate cofaces, once each, with the batch of their level."""
    from pyspark.sql.window import Window

    g = _gates(spark, sf_dir)[1]
    return g.select("cloud", hierarchy.label_text("label").alias("label"), "num", "den", "gabriel", "first", F.dense_rank().over(Window.partitionBy("cloud").orderBy(hierarchy.level())).alias("batch"))


@query("gateway_quotient", _with(CLASSIFIED_SQL, _GAMMA, _FIRST) + f"SELECT DISTINCT g.cloud, CAST(g.num AS BIGINT) AS num, CAST(g.den AS BIGINT) AS den, coalesce(o.component, g.facet) AS root, z.component FROM (SELECT cloud, num, den, array_to_string(list_filter(label, lambda v: v <> label[k]), ',') AS facet FROM (SELECT *, unnest(range(1, {ORDER + 2})) AS k FROM gates)) g LEFT JOIN h_k o ON NOT o.closed AND o.cloud = g.cloud AND o.num = g.num AND o.den = g.den AND o.facet = g.facet JOIN h_k z ON z.closed AND z.cloud = g.cloud AND z.num = g.num AND z.den = g.den AND z.facet = g.facet")
def gateway_quotient(spark, sf_dir):
    """The roots that each batch of gateways binds: located strictly below the level, and the component of the level."""
    return journals.quotient_by_batch(_log(spark, sf_dir)[2], _gates(spark, sf_dir)[1])


@query("gateway_clock", _with(CLASSIFIED_SQL, _gamma_sql(ORDER), _FIRST) + f", b AS (SELECT cloud, num, den, string_agg(array_to_string(label, ','), ' ' ORDER BY array_to_string(label, ',')) AS t FROM gates GROUP BY 1, 2, 3), c AS (SELECT cloud, list(t ORDER BY {_LEVELS}) AS ts FROM b GROUP BY 1), k AS (SELECT b.*, row_number() OVER (PARTITION BY cloud ORDER BY {_LEVELS}) AS i FROM b) SELECT k.cloud, CAST(i - 1 AS INT) AS batch, {_N}, list_reduce(list_prepend('', list_slice(ts, 1, i)), lambda a, t: sha256(a || '|' || t)) AS digest FROM k JOIN c ON c.cloud = k.cloud")
def gateway_clock(spark, sf_dir):
    """The gateways of each batch, bound to those before by a chain of digests."""
    return journals.digest_chain(_gates(spark, sf_dir)[1], hierarchy.label_text("label"))
