"""Queries over filters, interval bounds, budgets, block pairs, hulls, whitening, and whole results."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import arrays, exact
from ..operators import bounded, hierarchy, spatial
from ..operators.lineage import cut, let
from .catalog import query
from .clouds import QUADS_SQL, SUP_SQL, emb, emb_sql, quads, sup, table
from .hierarchies import _STEP, CATALOG_SQL, CLASSIFIED_SQL, K_MAX, LEVEL, _cut_sql, _gamma, _gamma_sql, _history_sql, _steps, _with
from .neighbours import _pairs
from .scalars import _sign

_FILTER = exact.filtered_orientation("a", "b", "c", "d")


@query("fp_filter_orientation", f"WITH {emb_sql(64, 'emb6')}, {QUADS_SQL}, f AS (SELECT *, " + ", ".join(f"{e} AS {k}" for k, e in _FILTER.items()) + f" FROM quads) SELECT cloud, id, abs(det) > bound AS certified, CAST(CASE WHEN abs(det) > bound THEN {_sign('det')} ELSE {_sign('exact')} END AS INT) AS side FROM f")
def fp_filter_orientation(spark, sf_dir):
    """Orientations decided in floating point where its error bound allows, else in integers."""
    f = let(quads(spark, sf_dir), **_FILTER).withColumn("certified", F.expr("abs(det) > bound"))
    return f.select("cloud", "id", "certified", F.expr(f"CAST(CASE WHEN certified THEN {_sign('det')} ELSE {_sign('exact')} END AS INT)").alias("side"))


@query("fp_expansions", f"WITH {emb_sql(64, 'emb6')}, {QUADS_SQL}, t AS (SELECT cloud, id, a_x / 3.0::DOUBLE AS a, b_y / 7.0::DOUBLE AS b FROM quads), s AS (SELECT *, a + b AS hi FROM t), e AS (SELECT *, hi - a AS back FROM s) SELECT cloud, id, hi, (a - (hi - back)) + (b - back) AS lo FROM e")
def fp_expansions(spark, sf_dir):
    """Sums of two doubles as a rounded sum and the exact rest."""
    t = quads(spark, sf_dir).select("cloud", "id", F.expr("a_x / 3.0D").alias("a"), F.expr("b_y / 7.0D").alias("b"))
    e = let(let(t, hi="a + b"), back="hi - a")
    return e.select("cloud", "id", "hi", F.expr("(a - (hi - back)) + (b - back)").alias("lo"))


_BOX = {f"{n}{e}{c}": f"{f}({', '.join(f'{p}_{c}' for p in ps)})" for n, ps in (("u", "ab"), ("v", "bc"), ("w", "cd")) for c in "xyz" for e, f in (("lo", "least"), ("hi", "greatest"))}
_GRAM, _DETS = exact.gram_bounds(["u", "v", "w"]), exact.determinant_bounds()


@query("higher_product_bounds", f"WITH {emb_sql(64, 'emb6')}, {QUADS_SQL}, b AS (SELECT cloud, id, {', '.join(f'{e} AS {k}' for k, e in _BOX.items())} FROM quads), g AS (SELECT *, " + ", ".join(f"{e} AS {k}" for k, e in _GRAM.items()) + " FROM b), d AS (SELECT *, " + ", ".join(f"{e} AS {k}" for k, e in _DETS.items()) + " FROM g) SELECT cloud, id, " + ", ".join(f"CAST({k} AS BIGINT) AS {k}" for k in (*_GRAM, *_DETS)) + ", dhi <= 0 OR m1hi <= 0 OR m2hi <= 0 AS excluded FROM d")
def higher_product_bounds(spark, sf_dir):
    """Bounds of Gram entries, determinant and numerators over products of three boxes, and whether they rule out a support."""
    d = let(let(let(quads(spark, sf_dir), **_BOX), **_GRAM), **_DETS)
    return d.select("cloud", "id", *(F.col(k).cast("long").alias(k) for k in (*_GRAM, *_DETS)), F.expr("dhi <= 0 OR m1hi <= 0 OR m2hi <= 0").alias("excluded"))


_planes = [[f"{p}_x", f"{p}_y", f"{p}_z"] for p in "abc"]
_right = ["d_x", "d_y", "d_z"]
_CRAMER = {"det": exact.det3(_planes)} | {f"n{c}": exact.det3([[_right[r] if k == i else _planes[r][k] for k in range(3)] for r in range(3)]) for i, c in enumerate("xyz")}


@query("solve_square", f"WITH {emb_sql(64, 'emb6')}, {QUADS_SQL}, s AS (SELECT *, " + ", ".join(f"{e} AS {k}" for k, e in _CRAMER.items()) + " FROM quads), g AS (SELECT *, greatest(gcd(gcd(CAST(nx AS BIGINT), CAST(ny AS BIGINT)), gcd(CAST(nz AS BIGINT), CAST(det AS BIGINT))), 1) * sign(det) AS g FROM s WHERE det <> 0) SELECT cloud, id, CAST(nx // g AS BIGINT) AS x, CAST(ny // g AS BIGINT) AS y, CAST(nz // g AS BIGINT) AS z, CAST(det // g AS BIGINT) AS den FROM g")
def solve_square(spark, sf_dir):
    """Nonsingular systems of three unknowns solved exactly, in lowest terms."""
    from ..operators.cloud import gcd

    s = let(quads(spark, sf_dir), **_CRAMER).where("det <> 0")
    g = s.withColumn("g", (F.greatest(gcd(gcd(F.col("nx"), F.col("ny")), gcd(F.col("nz"), F.col("det"))), F.lit(1)) * F.signum("det")).cast("long"))
    return g.select("cloud", "id", *(F.expr(f"n{c} div g").alias(c) for c in "xyz"), F.expr("det div g").alias("den"))


BUDGET, NEAR = 40_000, 5


@query("join_topk_budgeted", f"WITH {emb_sql()}, {_pairs('emb', False)}, r AS (SELECT cloud, u AS q, d2, row_number() OVER (PARTITION BY cloud, u ORDER BY d2, v) AS k FROM d WHERE d2 <= {BUDGET}), s AS (SELECT cloud, q, count(*) AS found, max(d2) AS farthest FROM r WHERE k <= {NEAR} GROUP BY 1, 2) SELECT e.cloud, e.id AS q, CAST(coalesce(found, 0) AS BIGINT) AS found, CAST(farthest AS BIGINT) AS farthest, CASE WHEN found >= {NEAR} THEN 'complete' ELSE 'exhausted' END AS status FROM emb e LEFT JOIN s ON s.cloud = e.cloud AND s.q = e.id")
def join_topk_budgeted(spark, sf_dir):
    return spatial.nearest_budgeted(emb(spark, sf_dir), NEAR, BUDGET)


@query("join_dual_tree", f"WITH {emb_sql()}, {_pairs('emb', False)} SELECT cloud, u AS q, CAST(arg_min(v, d2 * 1000000 + v) AS BIGINT) AS p, CAST(min(d2) AS BIGINT) AS d2 FROM d GROUP BY 1, 2")
def join_dual_tree(spark, sf_dir):
    """Each point's nearest other, down a tree of boxes."""
    return bounded.nearest_by_tree(emb(spark, sf_dir))


_AXES = "x AS (SELECT DISTINCT p.cloud, q.x - p.x AS nx, q.y - p.y AS ny FROM sup p JOIN sup q ON p.cloud = q.cloud AND p.id < q.id), n AS (SELECT * FROM x UNION SELECT cloud, -ny, nx FROM x), u AS (SELECT a.cloud AS u, b.cloud AS v FROM (SELECT DISTINCT cloud FROM sup) a JOIN (SELECT DISTINCT cloud FROM sup) b ON a.cloud < b.cloud), z AS (SELECT u.u, u.v, n.nx, n.ny FROM u JOIN n ON n.cloud = u.u OR n.cloud = u.v UNION SELECT u, v, 1, 0 FROM u UNION SELECT u, v, 0, 1 FROM u)"


@query("join_hull_overlap", f"WITH {SUP_SQL}, {_AXES}, s AS (SELECT z.u, z.v, z.nx, z.ny, max(p.x * nx + p.y * ny) FILTER (p.cloud = z.u) AS uhi, min(p.x * nx + p.y * ny) FILTER (p.cloud = z.u) AS ulo, max(p.x * nx + p.y * ny) FILTER (p.cloud = z.v) AS vhi, min(p.x * nx + p.y * ny) FILTER (p.cloud = z.v) AS vlo FROM z JOIN sup p ON p.cloud = z.u OR p.cloud = z.v GROUP BY 1, 2, 3, 4) SELECT u, v FROM s GROUP BY 1, 2 HAVING NOT bool_or(uhi < vlo OR vhi < ulo)")
def join_hull_overlap(spark, sf_dir):
    """Nations whose suppliers' convex hulls in the plane meet: boxes first, then hulls."""
    p = sup(spark, sf_dir)

    def hull(frame: pd.DataFrame) -> pd.DataFrame:
        h = arrays.convex_hull(frame[["x", "y"]].to_numpy())
        return pd.DataFrame({"cloud": frame["cloud"][:1], "lox": [h[:, 0].min()], "hix": [h[:, 0].max()], "loy": [h[:, 1].min()], "hiy": [h[:, 1].max()], "corners": [h.ravel().tolist()]})

    hulls = cut(p.groupBy("cloud").applyInPandas(hull, "cloud long, lox long, hix long, loy long, hiy long, corners array<long>"), "hulls")
    near = hulls.alias("a").join(hulls.alias("b"), F.expr("a.cloud < b.cloud AND a.lox <= b.hix AND b.lox <= a.hix AND a.loy <= b.hiy AND b.loy <= a.hiy"))
    near = near.select(F.col("a.cloud").alias("u"), F.col("b.cloud").alias("v"), F.col("a.corners").alias("a"), F.col("b.corners").alias("b"))

    def keep(frames):
        for frame in frames:
            met = [arrays.hulls_meet(np.reshape(a, (-1, 2)), np.reshape(b, (-1, 2))) for a, b in zip(frame["a"], frame["b"], strict=True)]
            yield frame.loc[met, ["u", "v"]]

    return near.mapInPandas(keep, "u long, v long")


@query("prj_whiten_pca", "WITH v AS (SELECT CAST(event_id AS BIGINT) AS event_id, value AS a, CAST(user_id AS DOUBLE) AS b FROM events), m AS (SELECT avg(a) AS ma, avg(b) AS mb, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab FROM v), l AS (SELECT *, (aa + bb) / 2 + sqrt((aa - bb) * (aa - bb) / 4 + ab * ab) AS l1, (aa + bb) / 2 - sqrt((aa - bb) * (aa - bb) / 4 + ab * ab) AS l2, 0.5 * atan2(2 * ab, aa - bb) AS t FROM m), w AS (SELECT event_id, ((a - ma) * cos(t) + (b - mb) * sin(t)) / sqrt(l1) AS p, ((b - mb) * cos(t) - (a - ma) * sin(t)) / sqrt(l2) AS q, abs(cos(t)) >= abs(sin(t)) AS flat, cos(t) AS c, sin(t) AS s FROM v, l) SELECT event_id, round(p * CASE WHEN flat THEN sign(c) ELSE sign(s) END, 6) AS w1, round(q * CASE WHEN flat THEN sign(c) ELSE -sign(s) END, 6) AS w2 FROM w")
def prj_whiten_pca(spark, sf_dir):
    """Two columns turned to their principal axes and scaled to unit variance; an axis's largest part is positive."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("event_id"), F.col("value").alias("a"), F.col("user_id").cast("double").alias("b"))
    return spatial.whitened(e, ["a", "b"], ["w1", "w2"], 6)


EVENT_JSON = "to_json({'cloud': cloud, 'label': label, 'num': CAST(num AS BIGINT), 'den': CAST(den AS BIGINT), 'interior': interior, 'shell': shell, 'rank': rank, 'kind': kind})"


@query("sink_contract_json_full", _with(CATALOG_SQL, *(x for o in (1, 2) for x in (_gamma_sql(o), _history_sql(o, f"h{o}")))) + f"SELECT cloud, 'critical_catalog' AS record, CAST({EVENT_JSON} AS VARCHAR) AS line FROM catalog UNION ALL " + " UNION ALL ".join(f"SELECT cloud, 'forest_{o}', CAST(to_json({{'cloud': cloud, 'num': num, 'den': den, 'kind': kind, 'q': q, 'covered': covered}}) AS VARCHAR) FROM (SELECT {_STEP} FROM h{o})" for o in (1, 2)))
def sink_contract_json_full(spark, sf_dir):
    """The whole result of orders 1 and 2 as canonical JSON lines: catalogue and forests, fields in order, no blanks."""
    c = hierarchy.critical_catalog(sup(spark, sf_dir), K_MAX).select("cloud", "label", "num", "den", "interior", "shell", "rank", "kind")
    out = c.select("cloud", F.lit("critical_catalog").alias("record"), F.to_json(F.struct(*c.columns)).alias("line"))
    for order in (1, 2):
        f = _steps(hierarchy.merge_forest(*_gamma(spark, sf_dir, order)))
        out = out.unionAll(f.select("cloud", F.lit(f"forest_{order}").alias("record"), F.to_json(F.struct(*f.columns)).alias("line")))
    return out


@query("sink_cuts_json_full", _with(CLASSIFIED_SQL, *(x for o in (1, 2) for x in (_gamma_sql(o), _history_sql(o, f"h{o}", reduced=False)))) + " UNION ALL ".join(f"SELECT cloud, CAST(to_json({{'order': {o}, 'num': CAST(num AS BIGINT), 'den': CAST(den AS BIGINT), 'closed': closed, 'component': component, 'facets': list(facet ORDER BY facet)}}) AS VARCHAR) AS line FROM h{o}_k GROUP BY cloud, num, den, closed, component" for o in (1, 2)))
def sink_cuts_json_full(spark, sf_dir):
    """Every open and closed cut of orders 1 and 2 as JSON lines, a component each."""
    from ..operators import journals

    out = None
    for order in (1, 2):
        f, c = _gamma(spark, sf_dir, order)
        log = cut(journals.facet_log(f, c), "log")
        levels = log.select("cloud", "num", "den").distinct()
        facets = log.select("cloud", "facet").distinct()
        # Cofaces that join nothing new make levels of their own, at which nothing changes.
        levels = levels.unionByName(f.select("cloud", "num", "den")).unionByName(c.select("cloud", "num", "den")).distinct()
        asked = cut(levels.join(facets, "cloud").select("cloud", "facet", "num", "den"), "asked")
        for closed in (True, False):
            at = journals.located(asked, log, strictly=not closed).where("component IS NOT NULL")
            lines = at.groupBy("cloud", "num", "den", "component").agg(F.array_sort(F.collect_list("facet")).alias("facets"))
            json = F.to_json(F.struct(F.lit(order).alias("order"), "num", "den", F.lit(closed).alias("closed"), "component", "facets"))
            part = lines.select("cloud", json.alias("line"))
            out = part if out is None else out.unionAll(part)
    return out


@query("run_oracle", _with(CATALOG_SQL, _gamma_sql(2), _gamma_sql(1), _history_sql(2, "h2"), _history_sql(1, "h1"), _cut_sql(2, LEVEL, prefix="up"), _cut_sql(1, LEVEL, prefix="low")) + ", v AS (SELECT cloud, component, count(DISTINCT target) AS n FROM (SELECT u.cloud, u.component, l.component AS target FROM (SELECT cloud, component, unnest(string_split(facet, ',')) AS p FROM up) u JOIN low l ON l.cloud = u.cloud AND l.facet = u.p) GROUP BY 1, 2) SELECT s.cloud, CAST(s.n AS BIGINT) AS points, CAST((SELECT count(*) FROM catalog c WHERE c.cloud = s.cloud AND kind = 'event') AS BIGINT) AS events, CASE WHEN EXISTS (SELECT 1 FROM catalog c WHERE c.cloud = s.cloud AND kind <> 'event') THEN 'refused' ELSE 'complete' END AS status, CAST((SELECT count(*) FROM h1 WHERE h1.cloud = s.cloud) AS BIGINT) AS steps_1, CAST((SELECT count(*) FROM h2 WHERE h2.cloud = s.cloud) AS BIGINT) AS steps_2, coalesce((SELECT max(n) = 1 FROM v WHERE v.cloud = s.cloud), true) AS maps_sound FROM sizes s")
def run_oracle(spark, sf_dir):
    """One result per cloud: catalogue, forests of orders 1 and 2, the map between them; degenerate clouds are refused."""
    return hierarchy.run_oracle(sup(spark, sf_dir), K_MAX, LEVEL)
