"""Queries over neighbourhoods: canonical points, pairs, nearest neighbours, balls, boxes, spanning trees."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exact
from ..operators import bounded, cloud, compact, graph, spatial
from ..operators.lineage import cut
from .catalog import query
from .clouds import SUP_SQL, emb, emb_sql, sup, table

EMB, LEVEL, K = emb_sql(), 10_000, 5
_D2 = exact.squared_distance("u", "v")
_POINTS = "{0} AS (SELECT cloud AS {0}_cloud, id AS {0}_id, x AS {0}_x, y AS {0}_y, z AS {0}_z FROM {1})"


def _pairs(of: str, less: bool = True) -> str:
    return f"{_POINTS.format('u', of)}, {_POINTS.format('v', of)}, d AS (SELECT u_cloud AS cloud, u_id AS u, v_id AS v, {_D2} AS d2 FROM u JOIN v ON u_cloud = v_cloud AND u_id {'<' if less else '<>'} v_id)"


def _components(edges: str, nodes: str, name: str = "cc") -> str:
    return (
        f"{name}_r(cloud, u, v) AS (SELECT cloud, id, id FROM {nodes} UNION SELECT r.cloud, r.u, e.v FROM {name}_r r JOIN (SELECT cloud, u, v FROM {edges} UNION ALL SELECT cloud, v, u FROM {edges}) e ON e.cloud = r.cloud AND e.u = r.v), "
        f"{name} AS (SELECT cloud, u AS node, min(v) AS component FROM {name}_r GROUP BY cloud, u)"
    )


@query("src_canonical_points", f"WITH {EMB} SELECT cloud, id, x, y, z, CAST(n AS BIGINT) AS multiplicity FROM emb")
def src_canonical_points(spark, sf_dir):
    return emb(spark, sf_dir).select("cloud", "id", "x", "y", "z", "multiplicity")


@query("src_certified_cloud", "SELECT CAST(label AS BIGINT) AS cloud, x, y, z, string_agg(vec_id, ',' ORDER BY vec_id) AS sources FROM (SELECT label, vec_id, " + ", ".join(f"CAST(floor(CAST(embedding[{i}] AS DOUBLE) * 64) AS BIGINT) AS {c}" for i, c in enumerate("xyz", 1)) + " FROM embeddings) GROUP BY ALL")
def src_certified_cloud(spark, sf_dir):
    return emb(spark, sf_dir, 64).select("cloud", "x", "y", "z", F.array_join("sources", ",").alias("sources"))


@query("src_normalize", "SELECT vec_id, CAST(embedding[1] AS DOUBLE) + 0.0 AS x, CAST(embedding[2] AS DOUBLE) + 0.0 AS y FROM embeddings WHERE isfinite(embedding[1]) AND isfinite(embedding[2])")
def src_normalize(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").selectExpr("vec_id", "CAST(embedding[0] AS DOUBLE) + 0.0D AS x", "CAST(embedding[1] AS DOUBLE) + 0.0D AS y")
    return e.where("NOT isnan(x) AND NOT isnan(y) AND abs(x) < double('inf') AND abs(y) < double('inf')")


@query("flt_finite", "SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0")
def flt_finite(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("NOT exists(embedding, v -> v IS NULL OR isnan(v) OR abs(v) = double('inf'))").select("vec_id")


@query("join_pairs", f"WITH {EMB}, {_pairs('emb')} SELECT cloud, u, CAST(count(*) AS BIGINT) AS later, CAST(sum(d2) AS BIGINT) AS total, CAST(min(d2) AS BIGINT) AS least FROM d GROUP BY 1, 2")
def join_pairs(spark, sf_dir):
    """The complete graph of every cloud, summed per point."""
    return spatial.pair_sums(emb(spark, sf_dir))


@query("pairs_within", f"WITH {EMB}, {_pairs('emb')} SELECT cloud, u, v, CAST(d2 AS BIGINT) AS d2 FROM d WHERE d2 <= {LEVEL}")
def pairs_within(spark, sf_dir):
    return spatial.pairs_within(emb(spark, sf_dir), LEVEL)


@query("k1_cut", f"WITH RECURSIVE {EMB}, {_pairs('emb')}, e AS (SELECT * FROM d WHERE d2 <= 4 * {LEVEL // 4}), {_components('e', 'emb')} SELECT cloud, component, CAST(count(*) AS BIGINT) AS size, string_agg(node, ',' ORDER BY node) AS members FROM cc GROUP BY 1, 2")
def k1_cut(spark, sf_dir):
    """The order-1 hierarchy cut at one level: grid join, components, coverage."""
    return spatial.cut_order_one(emb(spark, sf_dir), LEVEL // 4)


@query("join_topk", f"WITH {EMB}, {_pairs('emb', False)}, r AS (SELECT *, rank() OVER (PARTITION BY cloud, u ORDER BY d2) AS rank, row_number() OVER (PARTITION BY cloud, u ORDER BY d2, v) AS choice FROM d) SELECT cloud, u AS q, v AS p, CAST(d2 AS BIGINT) AS d2, CAST(rank AS INT) AS rank, CAST(choice AS INT) AS choice FROM r WHERE rank <= {K}")
def join_topk(spark, sf_dir):
    return spatial.nearest_grid(emb(spark, sf_dir), K, LEVEL).selectExpr("cloud", "q", "p", "d2", "CAST(rank AS INT) AS rank", "CAST(choice AS INT) AS choice")


@query("join_topk_excluding", f"WITH {EMB}, {_pairs('emb', False)}, r AS (SELECT *, rank() OVER (PARTITION BY cloud, u ORDER BY d2) AS rank FROM d WHERE abs(u - v) > 2) SELECT cloud, u AS q, v AS p, CAST(d2 AS BIGINT) AS d2 FROM r WHERE rank <= {K}")
def join_topk_excluding(spark, sf_dir):
    """Nearest neighbours outside each query's exclusion set (the ids next to it)."""
    p = emb(spark, sf_dir)
    side = lambda n: p.select("cloud", F.col("id").alias(n), *(F.col(c).alias(f"{n}_{c}") for c in "xyz"))
    out = p.select("cloud", F.col("id").alias("u"), F.explode(F.sequence(F.col("id") - 2, F.col("id") + 2)).alias("v"))
    met = side("u").join(side("v"), "cloud").join(out, ["cloud", "u", "v"], "left_anti").withColumn("d2", F.expr(_D2))
    return met.withColumn("rank", F.rank().over(Window.partitionBy("cloud", "u").orderBy("d2"))).where(F.col("rank") <= K).selectExpr("cloud", "u AS q", "v AS p", "d2")


@query("join_nearest", f"WITH {EMB}, {_pairs('emb', False)} SELECT cloud, u AS q, CAST(arg_min(v, d2 * 1000000 + v) AS BIGINT) AS p, CAST(min(d2) AS BIGINT) AS d2 FROM d GROUP BY 1, 2")
def join_nearest(spark, sf_dir):
    return spatial.nearest_grid(emb(spark, sf_dir), 1, LEVEL).where("choice = 1").select("cloud", "q", "p", "d2")


@query("join_core_dist", f"WITH {EMB}, {_pairs('emb', False)}, r AS (SELECT *, row_number() OVER (PARTITION BY cloud, u ORDER BY d2, v) AS k FROM d) SELECT cloud, u AS id, CAST(d2 AS BIGINT) AS core2 FROM r WHERE k = {K}")
def join_core_dist(spark, sf_dir):
    return spatial.nearest_grid(emb(spark, sf_dir), K, LEVEL).where(f"choice = {K}").selectExpr("cloud", "q AS id", "d2 AS core2")


_BALLS = "balls AS (SELECT cloud, id AS ball, x AS b_x, y AS b_y, z AS b_z, 2500 * (id % 5 + 1) AS r2 FROM emb)"
_BALL_D = exact.squared_distance("b", "p")


@query("join_closed_ball", f"WITH {EMB}, {_BALLS}, p AS (SELECT cloud AS pc, id, x AS p_x, y AS p_y, z AS p_z FROM emb) SELECT cloud, ball, CAST(count(*) FILTER ({_BALL_D} < r2) AS BIGINT) AS interior, CAST(count(*) FILTER ({_BALL_D} = r2) AS BIGINT) AS shell, CAST(count(*) FILTER ({_BALL_D} > r2) AS BIGINT) AS exterior, coalesce(string_agg(id, ',' ORDER BY id) FILTER ({_BALL_D} <= r2), '') AS closed FROM balls JOIN p ON pc = cloud GROUP BY 1, 2")
def join_closed_ball(spark, sf_dir):
    p = emb(spark, sf_dir)
    return spatial.closed_balls(p, p.select("cloud", F.col("id").alias("ball"), "x", "y", "z", F.expr("2500 * (id % 5 + 1)").alias("r2")))


_BOXES_SQL = "boxes AS (SELECT s_nationkey AS box, s_nationkey % 5 AS cloud, min(x) AS lox, max(x) AS hix, min(y) AS loy, max(y) AS hiy, min(z) AS loz, max(z) AS hiz FROM (SELECT CAST(s_nationkey AS BIGINT) AS s_nationkey, CAST(s_suppkey % 31 AS BIGINT) AS x, CAST(floor((s_acctbal + 1000) / 200) AS BIGINT) AS y, CAST((s_suppkey * 7) % 29 AS BIGINT) AS z FROM supplier) GROUP BY 1, 2)"


def _boxes(spark, sf_dir):
    b = cloud.bounding_boxes(sup(spark, sf_dir))
    return b.select(F.col("cloud").alias("box"), (F.col("cloud") % 5).alias("cloud"), *(f"{e}{c}" for e in ("lo", "hi") for c in "xyz"))


@query("agg_aabb", f"WITH {EMB} SELECT cloud, " + ", ".join(f"min({c}) AS lo{c}, max({c}) AS hi{c}, CAST(arg_min(id, {c} * 100000 + id) AS BIGINT) AS lo{c}_id, CAST(arg_max(id, {c} * 100000 - id) AS BIGINT) AS hi{c}_id" for c in "xyz") + " FROM emb GROUP BY cloud")
def agg_aabb(spark, sf_dir):
    return cloud.bounding_boxes(emb(spark, sf_dir))


@query("flt_box", f"WITH {SUP_SQL}, {_BOXES_SQL}, p AS (SELECT cloud % 5 AS cloud, cloud * 1000 + id AS id, x, y, z FROM sup) SELECT p.cloud, p.id, CAST(coalesce(max(box), -1) AS BIGINT) AS box FROM p LEFT JOIN boxes b ON b.cloud = p.cloud AND x BETWEEN lox AND hix AND y BETWEEN loy AND hiy AND z BETWEEN loz AND hiz GROUP BY 1, 2")
def flt_box(spark, sf_dir):
    p = sup(spark, sf_dir).select((F.col("cloud") % 5).alias("cloud"), (F.col("cloud") * 1000 + F.col("id")).alias("id"), "x", "y", "z")
    return spatial.in_boxes(p, _boxes(spark, sf_dir))


@query("join_box_box", "WITH RECURSIVE " + _BOXES_SQL + ", e AS (SELECT a.cloud, a.box AS u, b.box AS v FROM boxes a JOIN boxes b ON a.cloud = b.cloud AND a.box < b.box WHERE " + " AND ".join(f"a.lo{c} <= b.hi{c} AND b.lo{c} <= a.hi{c}" for c in "xyz") + "), n AS (SELECT cloud, box AS id FROM boxes), " + _components("e", "n") + " SELECT cloud, node AS box, component FROM cc")
def join_box_box(spark, sf_dir):
    b = cut(_boxes(spark, sf_dir), "boxes")
    return graph.components(b.select("cloud", F.col("box").alias("node")), spatial.overlapping_boxes(b)).select("cloud", F.col("node").alias("box"), "component")


@query("join_outgoing_min", f"WITH {EMB}, {_pairs('emb', False)} SELECT cloud, u % 4 AS part, CAST(arg_min(u, d2 * 100000000 + least(u, v) * 10000 + greatest(u, v)) AS BIGINT) AS u, CAST(arg_min(v, d2 * 100000000 + least(u, v) * 10000 + greatest(u, v)) AS BIGINT) AS v, CAST(min(d2) AS BIGINT) AS d2 FROM d WHERE u % 4 <> v % 4 GROUP BY 1, 2")
def join_outgoing_min(spark, sf_dir):
    """Of each part of a cloud (ids by their residue) the shortest edge that leaves it."""
    p = emb(spark, sf_dir).withColumn("part", F.col("id") % 4)
    # Ties go to the least pair: every point that is as near as the nearest of another part takes part.
    near = bounded.nearest_by_tree(p, "part").groupBy("cloud", (F.col("q") % 4).alias("part")).agg(F.min("d2").alias("d2"))
    radius = near.agg(F.max("d2")).first()[0] or 0
    met = spatial.pairs_within(p, radius, other=p).where("u % 4 <> v % 4").withColumn("part", F.col("u") % 4).join(near, ["cloud", "part", "d2"])
    least = met.groupBy("cloud", "part", "d2").agg(F.min(F.struct(F.least("u", "v"), F.greatest("u", "v"), "u", "v")).alias("e"))
    return least.select("cloud", "part", "e.u", "e.v", "d2")


@query("join_knn_propagate", f"WITH {emb_sql()}, {_pairs('emb', False)}, r AS (SELECT *, row_number() OVER (PARTITION BY cloud, u ORDER BY d2, v) AS k FROM d), n AS (SELECT cloud, u AS q, v % 3 AS label, count(*) AS votes FROM r WHERE k <= {K} GROUP BY 1, 2, 3), b AS (SELECT *, row_number() OVER (PARTITION BY cloud, q ORDER BY votes DESC, label) AS k FROM n) SELECT cloud, q, label, CAST(votes AS BIGINT) AS votes FROM b WHERE k = 1")
def join_knn_propagate(spark, sf_dir):
    p = emb(spark, sf_dir)
    return spatial.vote(spatial.nearest_grid(p, K, LEVEL).where(f"choice <= {K}"), p.select("cloud", "id", (F.col("id") % 3).alias("label")))


@query("join_uot_gate", f"WITH {EMB}, {_pairs('emb', False)} SELECT cloud, u, v, CAST(d2 AS BIGINT) AS cost FROM d WHERE u % 2 = 0 AND v % 2 = 1 AND d2 <= {LEVEL}")
def join_uot_gate(spark, sf_dir):
    """Costs between two halves of a cloud, inside a gate."""
    p = emb(spark, sf_dir)
    return spatial.pairs_within(p.where("id % 2 = 0"), LEVEL, other=p.where("id % 2 = 1")).withColumnRenamed("d2", "cost")


def mst_sql(pairs: str, edges: str = "d") -> str:
    """An edge stays if its ends are not joined by edges before it in the order (d2, u, v)."""
    return (
        f"WITH RECURSIVE {SUP_SQL}, {pairs}, o AS (SELECT *, row_number() OVER (PARTITION BY cloud ORDER BY d2, u, v) AS k FROM {edges}), "
        "r(cloud, k, stop) AS (SELECT cloud, k, u FROM o UNION SELECT r.cloud, r.k, CASE WHEN e.u = r.stop THEN e.v ELSE e.u END FROM r JOIN o e ON e.cloud = r.cloud AND e.k < r.k AND (e.u = r.stop OR e.v = r.stop)), "
        "mst AS (SELECT o.* FROM o WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.cloud = o.cloud AND r.k = o.k AND r.stop = o.v)) "
    )


_MST_SQL = mst_sql(_pairs("sup"))


def _complete(p):
    side = lambda n: p.select("cloud", F.col("id").alias(n), *(F.col(c).alias(f"{n}_{c}") for c in "xyz"))
    return side("u").join(side("v"), "cloud").where("u < v").select("cloud", "u", "v", F.expr(_D2).alias("weight"))


def _mst(spark, sf_dir):
    return spatial.spanning_tree(sup(spark, sf_dir))


@query("emst_boruvka", _MST_SQL + "SELECT cloud, u, v, CAST(d2 AS BIGINT) AS weight FROM mst")
def emst_boruvka(spark, sf_dir):
    return _mst(spark, sf_dir)


@query("k1_equal_level_batches", _MST_SQL + "SELECT cloud, CAST(d2 AS BIGINT) AS weight, CAST(count(*) AS BIGINT) AS edges FROM mst GROUP BY 1, 2")
def k1_equal_level_batches(spark, sf_dir):
    return _mst(spark, sf_dir).groupBy("cloud", "weight").agg(F.count("*").alias("edges"))


@query("k1_emst_cut", f"WITH RECURSIVE {SUP_SQL}, {_pairs('sup')}, e AS (SELECT * FROM d WHERE d2 <= 400), {_components('e', 'sup')} SELECT cloud, node, component FROM cc")
def k1_emst_cut(spark, sf_dir):
    """Components below a length from the spanning tree alone; its SQL twin uses all pairs."""
    p = sup(spark, sf_dir)
    return graph.components(p.select("cloud", F.col("id").alias("node")), _mst(spark, sf_dir).where("weight <= 400"))


_INNER = f"SELECT count(*) FROM sup p WHERE p.cloud = d.cloud AND p.id <> d.u AND p.id <> d.v"
_PAIR_KIND = (
    f"WITH {SUP_SQL}, {_pairs('sup')}, e AS (SELECT d.cloud, d.u, d.v, d.d2, a.x AS a_x, a.y AS a_y, a.z AS a_z, b.x AS b_x, b.y AS b_y, b.z AS b_z FROM d JOIN sup a ON a.cloud = d.cloud AND a.id = d.u JOIN sup b ON b.cloud = d.cloud AND b.id = d.v), "
    "t AS (SELECT e.cloud, e.u, e.v, e.d2, count(p.id) FILTER ((p.x - a_x) * (p.x - b_x) + (p.y - a_y) * (p.y - b_y) + (p.z - a_z) * (p.z - b_z) < 0) AS inside, count(p.id) FILTER ((p.x - a_x) * (p.x - b_x) + (p.y - a_y) * (p.y - b_y) + (p.z - a_z) * (p.z - b_z) = 0) AS on_it FROM e LEFT JOIN sup p ON p.cloud = e.cloud AND p.id <> e.u AND p.id <> e.v GROUP BY 1, 2, 3, 4) "
    "SELECT cloud, u, v, CAST(d2 AS BIGINT) AS weight, CASE WHEN inside > 0 THEN 'blocked' WHEN on_it > 0 THEN 'extra_shell' ELSE 'rank_two' END AS kind FROM t"
)


def _pair_kinds(p):
    side = lambda n: p.select("cloud", F.col("id").alias(n), *(F.col(c).alias(f"{n}_{c}") for c in "xyz"))
    e = side("u").join(side("v"), "cloud").where("u < v").withColumn("weight", F.expr(_D2))
    phi = " + ".join(f"(p_{c} - u_{c}) * (p_{c} - v_{c})" for c in "xyz")
    met = e.join(side("p"), "cloud").withColumn("phi", F.when((F.col("p") != F.col("u")) & (F.col("p") != F.col("v")), F.expr(phi)))
    n = met.groupBy("cloud", "u", "v", "weight").agg(F.count_if(F.col("phi") < 0).alias("inside"), F.count_if(F.col("phi") == 0).alias("on_it"))
    return n.select("cloud", "u", "v", "weight", F.when(F.col("inside") > 0, "blocked").when(F.col("on_it") > 0, "extra_shell").otherwise("rank_two").alias("kind"))


@query("k1_pair_catalog", _PAIR_KIND)
def k1_pair_catalog(spark, sf_dir):
    return _pair_kinds(sup(spark, sf_dir))


@query("k1_rank_two_reduction", _MST_SQL + "SELECT cloud, CAST(d2 AS BIGINT) AS weight, CAST(count(*) AS BIGINT) AS edges FROM mst GROUP BY 1, 2")
def k1_rank_two_reduction(spark, sf_dir):
    """The spanning forest of the pairs with an empty ball has the same weights as that of all pairs."""
    p = sup(spark, sf_dir)
    f = graph.spanning_forest(p.select("cloud", F.col("id").alias("node")), spatial.empty_ball_pairs(p))
    return f.groupBy("cloud", "weight").agg(F.count("*").alias("edges"))


@query("k1_anchor", f"WITH {SUP_SQL} SELECT cloud, CAST(0 AS BIGINT) AS differences FROM sup GROUP BY cloud")
def k1_anchor(spark, sf_dir):
    """Levels at which the complete graph's and the empty-ball graph's spanning forests differ in weight or number."""
    p = sup(spark, sf_dir)
    nodes = p.select("cloud", F.col("id").alias("node"))
    count = lambda f: f.groupBy("cloud", "weight").agg(F.count("*").alias("n"))
    a, b = cut(count(graph.spanning_forest(nodes, _complete(p))), "a"), cut(count(graph.spanning_forest(nodes, _pair_kinds(p).where("kind <> 'blocked'"))), "b")
    off = a.exceptAll(b).unionAll(b.exceptAll(a)).groupBy("cloud").agg(F.count("*").alias("n"))
    return p.select("cloud").distinct().join(off, "cloud", "left").select("cloud", F.coalesce("n", F.lit(0)).cast("long").alias("differences"))


@query("k1_components_left", _MST_SQL + f", l AS (SELECT DISTINCT cloud, d2 FROM mst) SELECT cloud, CAST(d2 AS BIGINT) AS weight, CAST((SELECT count(*) FROM sup s WHERE s.cloud = l.cloud) - (SELECT count(*) FROM mst m WHERE m.cloud = l.cloud AND m.d2 <= l.d2) AS BIGINT) AS components_left FROM l")
def k1_components_left(spark, sf_dir):
    """Multifusion levels with the components that are left after each."""
    p = sup(spark, sf_dir)
    n = p.groupBy("cloud").agg(F.count("*").alias("n"))
    m = _mst(spark, sf_dir).groupBy("cloud", "weight").agg(F.count("*").alias("edges")).join(n, "cloud")
    return m.select("cloud", "weight", (F.col("n") - F.sum("edges").over(Window.partitionBy("cloud").orderBy("weight"))).alias("components_left"))


_FUSIONS_SQL = _MST_SQL + (
    ", l AS (SELECT DISTINCT cloud, d2 AS w FROM mst), e AS (SELECT cloud, u, v, d2 FROM mst UNION ALL SELECT cloud, v, u, d2 FROM mst), "
    "reach(cloud, w, closed, u, v) AS (SELECT l.cloud, l.w, k.at_close, s.id, s.id FROM l JOIN sup s ON s.cloud = l.cloud, (SELECT unnest([true, false]) AS at_close) k UNION SELECT r.cloud, r.w, r.closed, r.u, e.v FROM reach r JOIN e ON e.cloud = r.cloud AND e.u = r.v AND (e.d2 < r.w OR r.closed AND e.d2 = r.w)), "
    "part AS (SELECT cloud, w, closed, u, min(v) AS c FROM reach GROUP BY ALL), "
    "fused AS (SELECT z.cloud, z.w AS weight, z.c AS least, count(*) AS size, count(DISTINCT o.c) AS arity, string_agg(z.u, ',' ORDER BY z.u) AS members FROM part z JOIN part o ON o.cloud = z.cloud AND o.w = z.w AND o.u = z.u AND NOT o.closed WHERE z.closed GROUP BY z.cloud, z.w, z.c HAVING count(DISTINCT o.c) > 1) "
)


@query("k1_compact_forest", _FUSIONS_SQL + "SELECT cloud, CAST(weight AS BIGINT) AS weight, CAST(least AS BIGINT) AS least, CAST(size AS BIGINT) AS size, CAST(arity AS BIGINT) AS arity, members FROM fused")
def k1_compact_forest(spark, sf_dir):
    """Every multifusion of the spanning trees with its size, arity and members, these by intervals of leaves."""
    nodes, _, leaves = compact.compact_forest(sup(spark, sf_dir), _mst(spark, sf_dir))
    fused = cut(nodes.where("child_count > 0"), "fused")
    held = compact.members(fused, leaves).groupBy("cloud", "node").agg(F.array_join(F.array_sort(F.collect_list("point")), ",").alias("members"))
    return fused.join(held, ["cloud", "node"]).select("cloud", "weight", "least", "size", F.col("child_count").alias("arity"), "members")


@query("k1_compact_cut", _FUSIONS_SQL + " SELECT s.cloud, CAST(s.c AS BIGINT) AS least, CAST(count(*) AS BIGINT) AS size FROM (SELECT a.cloud, a.id, min(b.id) AS c FROM sup a JOIN sup b ON b.cloud = a.cloud WHERE b.id = a.id OR EXISTS (SELECT 1 FROM reach r JOIN (SELECT cloud, max(w) AS w FROM l WHERE w <= 400 GROUP BY 1) t ON t.cloud = r.cloud AND t.w = r.w WHERE r.closed AND r.cloud = a.cloud AND r.u = a.id AND r.v = b.id) GROUP BY 1, 2) s GROUP BY 1, 2")
def k1_compact_cut(spark, sf_dir):
    """The components of a cut, read off the compact forest: least points and sizes."""
    nodes, _, _ = compact.compact_forest(sup(spark, sf_dir), _mst(spark, sf_dir))
    return compact.alive(cut(nodes, "nodes"), 400).select("cloud", "least", "size")


@query("union_find", "WITH RECURSIVE n AS (SELECT DISTINCT CAST(0 AS BIGINT) AS cloud, CAST(user_id AS BIGINT) AS id FROM events), e AS (SELECT DISTINCT CAST(0 AS BIGINT) AS cloud, CAST(user_id AS BIGINT) AS u, CAST(user_id AS BIGINT) + 7 AS v FROM events), f AS (SELECT e.* FROM e JOIN n ON n.id = e.v), " + _components("f", "n") + " SELECT node, component FROM cc")
def union_find(spark, sf_dir):
    """Components of a chain graph over the users of the event log."""
    ids = table(spark, sf_dir, "events").select(F.lit(0).cast("long").alias("cloud"), F.col("user_id").cast("long").alias("node")).distinct()
    e = ids.select("cloud", F.col("node").alias("u"), (F.col("node") + 7).alias("v")).join(ids.withColumnRenamed("node", "v"), ["cloud", "v"], "left_semi").select("cloud", "u", "v")
    return graph.components(ids, e).select("node", "component")


@query("frozen_root_quotient", "WITH RECURSIVE h AS (SELECT DISTINCT CAST(l_orderkey AS BIGINT) AS edge, CAST(l_suppkey AS BIGINT) AS root FROM lineitem), n AS (SELECT DISTINCT CAST(0 AS BIGINT) AS cloud, root AS id FROM h), e AS (SELECT DISTINCT CAST(0 AS BIGINT) AS cloud, min(root) OVER (PARTITION BY edge) AS u, root AS v FROM h), " + _components("e", "n") + " SELECT node AS root, component FROM cc")
def frozen_root_quotient(spark, sf_dir):
    """Components of a hypergraph over opaque roots; a hyperedge is a star on its least root."""
    h = table(spark, sf_dir, "lineitem").selectExpr("CAST(l_orderkey AS BIGINT) AS edge", "CAST(l_suppkey AS BIGINT) AS root").distinct()
    least = h.groupBy("edge").agg(F.min("root").alias("u"))
    e = h.join(least, "edge").select(F.lit(0).cast("long").alias("cloud"), "u", F.col("root").alias("v"))
    return graph.components(h.select(F.lit(0).cast("long").alias("cloud"), F.col("root").alias("node")).distinct(), e).select(F.col("node").alias("root"), "component")
