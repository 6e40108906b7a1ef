"""Queries over scalar geometry: one row per run of four consecutive points of a label's cloud."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import binary64, exact
from ..operators import cloud
from .catalog import query
from .clouds import QUADS_SQL, SUP_SQL, emb, emb_sql, quads, sup, table

_G3 = exact.gram_columns(["a", "b", "c"])
_G4 = exact.gram_columns(["a", "b", "c", "d"])
_B3, _B4 = exact.circumball(["a", "b", "c"]), exact.circumball(["a", "b", "c", "d"])


def _on_quads(name: str, columns: dict[str, str], *layers: dict[str, str]) -> None:
    """Register ``columns`` (expressions of both dialects) over the quads, after layers of named helper expressions."""
    sql = "SELECT * FROM quads"
    for layer in layers:
        sql = "SELECT *, " + ", ".join(f"{e} AS {k}" for k, e in layer.items()) + f" FROM ({sql})"
    picked = ", ".join(f"CAST({e} AS BIGINT) AS {k}" for k, e in columns.items())
    oracle = f"WITH {emb_sql(64, 'emb6')}, {QUADS_SQL} SELECT cloud, id, {picked} FROM ({sql})"

    @query(name, oracle)
    def run(spark, sf_dir):
        df = quads(spark, sf_dir)
        for layer in layers:
            df = df.withColumns({k: F.expr(e) for k, e in layer.items()})
        return df.select("cloud", "id", *(F.expr(f"CAST({e} AS BIGINT)").alias(k) for k, e in columns.items()))


def _sign(e: str) -> str:
    return f"CASE WHEN {e} > 0 THEN 1 WHEN {e} < 0 THEN -1 ELSE 0 END"


_on_quads("vec_add", {f"v{c}": f"a_{c} + b_{c}" for c in "xyz"})
_on_quads("vec_subtract", {f"v{c}": f"a_{c} - b_{c}" for c in "xyz"})
_on_quads("vec_scale", {f"v{c}": f"3 * a_{c}" for c in "xyz"})
_on_quads("vec_dot", {"v": "a_x * b_x + a_y * b_y + a_z * b_z"})
_on_quads("sq_distance", {"ab": exact.squared_distance("a", "b"), "ac": exact.squared_distance("a", "c"), "ad": exact.squared_distance("a", "d")})
_on_quads("orient2d", {"side": _sign(exact.orient2d("a", "b", "c"))})
_on_quads("orient3d", {"volume": exact.orient3d("a", "b", "c", "d"), "side": _sign(exact.orient3d("a", "b", "c", "d"))})
_on_quads("distance_order", {"nearer": _sign(f"{exact.squared_distance('a', 'b')} - {exact.squared_distance('a', 'c')}")})
_on_quads("power_bisector", {"side": _sign(f"{exact.squared_distance('d', 'a')} + {exact.squared_distance('d', 'b')} - {exact.squared_distance('d', 'c')} - {exact.squared_distance('d', 'a')}")})
_on_quads("plane_side", {"side": _sign("a_x * d_x + a_y * d_y + a_z * d_z + b_x")})
_on_quads("affine_form_class", {"kind": "CASE WHEN b_x - a_x <> 0 OR b_y - a_y <> 0 OR b_z - a_z <> 0 THEN 0 WHEN c_x > 0 THEN 1 WHEN c_x < 0 THEN -1 ELSE 2 END"})
_planes = [[f"{p}_x", f"{p}_y", f"{p}_z"] for p in "abc"]
_right = ["d_x", "d_y", "d_z"]
_cramer = {"det": exact.det3(_planes)} | {f"n{c}": exact.det3([[_right[r] if k == i else _planes[r][k] for k in range(3)] for r in range(3)]) for i, c in enumerate("xyz")}
_on_quads("plane_intersection", {"det": "det", "nx": "nx", "ny": "ny", "nz": "nz", "kind": "CASE WHEN det <> 0 THEN 0 WHEN nx <> 0 OR ny <> 0 OR nz <> 0 THEN 1 ELSE 2 END"}, _cramer)
_on_quads("fourth_plane_incidence", {"side": _sign("(d_x * nx + d_y * ny + d_z * nz - a_x * det) * " + f"({_sign('det')})")}, _cramer)
_on_quads("affine_dimension", {"rank": f"CASE WHEN {exact.orient3d('a', 'b', 'c', 'd')} <> 0 THEN 3 WHEN g11 * g22 <> g12 * g12 OR g11 * g33 <> g13 * g13 OR g22 * g33 <> g23 * g23 THEN 2 WHEN g11 + g22 + g33 > 0 THEN 1 ELSE 0 END"}, _G4)
_layers3 = (_G3, {"d": _B3["D"]} | {f"m{i + 1}": m for i, m in enumerate(_B3["M"])})
_on_quads("circumball", {"d": "d", "m1": "m1", "m2": "m2", "num": _B3["level"], "den": "4 * d"}, *_layers3)
_on_quads("barycentric", {"b0": "2 * d - (m1 + m2)", "b1": "m1", "b2": "m2", "whole": "2 * d"}, *_layers3)
_on_quads("rel_interior", {"inside": "CASE WHEN d > 0 AND m1 > 0 AND m2 > 0 AND 2 * d - (m1 + m2) > 0 THEN 1 ELSE 0 END"}, *_layers3)
_on_quads("classify_sphere", {"side": _sign(exact.power_sign(["a", "b", "c"], "d"))}, *_layers3)
_on_quads(
    "support_analysis",
    {"kind": "CASE WHEN d = 0 THEN 0 WHEN m1 > 0 AND m2 > 0 AND 2 * d - (m1 + m2) > 0 THEN 1 WHEN m1 >= 0 AND m2 >= 0 AND 2 * d - (m1 + m2) >= 0 THEN 2 ELSE 3 END", "reduced": "CASE WHEN d = 0 THEN 0 ELSE 4 * CAST(2 * d - (m1 + m2) > 0 AS INT) + 2 * CAST(m1 > 0 AS INT) + CAST(m2 > 0 AS INT) END"},
    *_layers3,
)
_on_quads("support_level_order", {"order_": _sign(f"({_B3['level']}) - {exact.squared_distance('a', 'd')} * d")}, *_layers3)
_layers4 = (_G4, {"d": _B4["D"]} | {f"m{i + 1}": m for i, m in enumerate(_B4["M"])})
_on_quads("circumball_quad", {"d": "d", "m1": "m1", "m2": "m2", "m3": "m3"}, *_layers4)
_on_quads("label_moments", {f"s{c}": f"a_{c} + b_{c} + c_{c}" for c in "xyz"} | {"squares": " + ".join(f"{p}_{c} * {p}_{c}" for p in "abc" for c in "xyz")})
_box = {f"lo{c}": f"least(b_{c}, c_{c})" for c in "xyz"} | {f"hi{c}": f"greatest(b_{c}, c_{c})" for c in "xyz"}
_on_quads("box_distance", {"nearest": exact.box_distance("a", "lo", "hi"), "farthest": exact.box_distance("a", "lo", "hi", True)}, _box)
_phi = {f"{p}{e}{c}": f"{p}_{c}{' + 2' if e == 'hi' else ''}" for p in "abc" for e in ("lo", "hi") for c in "xyz"}
_on_quads("phi_aabb_max", {"phi": exact.phi_maximum("a", "b", "c")}, _phi)
_on_quads("power_distance", {"power": f"{exact.squared_distance('a', 'b')} - c_x * c_x"})


@query("bary_weight", f"WITH {emb_sql(64, 'emb6')}, {QUADS_SQL} SELECT cloud, id, (a_x + b_x + c_x) / 3.0 AS mx, ((a_x + b_x + c_x) * (a_x + b_x + c_x) + (a_y + b_y + c_y) * (a_y + b_y + c_y) + (a_z + b_z + c_z) * (a_z + b_z + c_z)) / 9.0 - ({' + '.join(f'{p}_{c} * {p}_{c}' for p in 'abc' for c in 'xyz')}) / 3.0 AS weight FROM quads")
def bary_weight(spark, sf_dir):
    sums = [f"(a_{c} + b_{c} + c_{c})" for c in "xyz"]
    squares = " + ".join(f"{p}_{c} * {p}_{c}" for p in "abc" for c in "xyz")
    return quads(spark, sf_dir).select("cloud", "id", F.expr("(a_x + b_x + c_x) / 3.0D").alias("mx"), F.expr(f"({' + '.join(f'{s} * {s}' for s in sums)}) / 9.0D - ({squares}) / 3.0D").alias("weight"))


@query("level_compare", f"WITH {emb_sql(64, 'emb6')}, {QUADS_SQL}, r AS (SELECT cloud, id, abs(a_x) AS n1, abs(a_y) + 1 AS d1, abs(b_x) AS n2, abs(b_y) + 1 AS d2 FROM quads) SELECT cloud, id, CAST(sign(n1 * d2 - n2 * d1) AS BIGINT) AS order_, CAST((n1 * d2 + n2 * d1) // gcd(n1 * d2 + n2 * d1, d1 * d2) AS BIGINT) AS num, CAST((d1 * d2) // gcd(n1 * d2 + n2 * d1, d1 * d2) AS BIGINT) AS den FROM r")
def level_compare(spark, sf_dir):
    r = quads(spark, sf_dir).selectExpr("cloud", "id", "abs(a_x) AS n1", "abs(a_y) + 1 AS d1", "abs(b_x) AS n2", "abs(b_y) + 1 AS d2").selectExpr("*", "n1 * d2 + n2 * d1 AS sn", "d1 * d2 AS sd").withColumn("g", cloud.gcd(F.col("sn"), F.col("sd")))
    return r.selectExpr("cloud", "id", "CAST(sign(n1 * d2 - n2 * d1) AS BIGINT) AS order_", "sn div g AS num", "sd div g AS den")


@query("morton_code", f"WITH {emb_sql()}, b AS (SELECT *, min(x) OVER w AS lox, max(x) OVER w AS hix, min(y) OVER w AS loy, max(y) OVER w AS hiy, min(z) OVER w AS loz, max(z) OVER w AS hiz FROM emb WINDOW w AS (PARTITION BY cloud)), q AS (SELECT cloud, id, " + ", ".join(f"CASE WHEN hi{c} = lo{c} THEN 0 ELSE least(CAST(floor(CAST({c} - lo{c} AS DOUBLE) * 2097152 / CAST(hi{c} - lo{c} AS DOUBLE)) AS BIGINT), 2097151) END AS m{c}" for c in "xyz") + f" FROM b) SELECT cloud, id, CAST({exact.spread_bits('mx')} + 2 * {exact.spread_bits('my')} + 4 * {exact.spread_bits('mz')} AS BIGINT) AS code FROM q")
def morton_code(spark, sf_dir):
    return cloud.morton(emb(spark, sf_dir)).select("cloud", "id", "code")


@query("src_binary64", "SELECT p_partkey, lower(printf('%016x', CASE WHEN p_retailprice IS NULL THEN NULL ELSE CAST(floor(p_retailprice * 100) AS BIGINT) END)) AS bits, p_retailprice < 1000 AS below FROM part")
def src_binary64(spark, sf_dir):
    """Fixed-width hexadecimal of an exact value, and its order."""
    return table(spark, sf_dir, "part").selectExpr("p_partkey", "lower(lpad(hex(CAST(floor(p_retailprice * 100) AS BIGINT)), 16, '0')) AS bits", "p_retailprice < 1000 AS below")


_EXPONENT = "CASE WHEN pow(2, floor(log2(v))) > v THEN floor(log2(v)) - 1 WHEN pow(2, floor(log2(v)) + 1) <= v THEN floor(log2(v)) + 1 ELSE floor(log2(v)) END"


@query("src_binary64_bits", f"WITH p AS (SELECT p_partkey, CAST(p_retailprice AS DOUBLE) AS v FROM part), e AS (SELECT *, CAST({_EXPONENT} AS BIGINT) AS e FROM p), h AS (SELECT *, format('{{:016x}}', (e + 1023) * 4503599627370496 + CAST((v / pow(2, e) - 1) * 4503599627370496 AS BIGINT)) AS bits FROM e) SELECT p_partkey, bits, v AS back, translate(substr(bits, 1, 1), '01234567', '89abcdef') || substr(bits, 2) AS order_key FROM h")
def src_binary64_bits(spark, sf_dir):
    """The bits of every price as a double, the double read back from them, and the total order key: bits in batches, digits in
    expressions.  The SQL twin rebuilds the bits of positive numbers from exponent and fraction."""

    @F.pandas_udf("long")
    def bits(v: pd.Series) -> pd.Series:
        return pd.Series(binary64.bits_of(v.fillna(0.0).to_numpy())).where(v.notna())

    @F.pandas_udf("double")
    def back(b: pd.Series) -> pd.Series:
        return pd.Series(binary64.of_bits(b.fillna(0).to_numpy())).where(b.notna())

    digits = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    t = table(spark, sf_dir, "part").select("p_partkey", bits(F.col("p_retailprice").cast("double") + 0.0).alias("b"))
    turned = F.when(F.col("b") < 0, F.bitwise_not("b")).otherwise(F.col("b").bitwiseXOR(F.lit(-(1 << 63))))
    return t.select("p_partkey", digits(F.col("b")).alias("bits"), back("b").alias("back"), digits(turned).alias("order_key"))


@query("src_neighbors_ulp", "SELECT p_partkey, nextafter(p_retailprice, CAST('infinity' AS DOUBLE)) AS above, nextafter(p_retailprice, CAST('-infinity' AS DOUBLE)) AS below FROM part")
def src_neighbors_ulp(spark, sf_dir):
    @F.pandas_udf("above double, below double")
    def near(v: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"above": np.nextafter(v, np.inf), "below": np.nextafter(v, -np.inf)})

    return table(spark, sf_dir, "part").select("p_partkey", near(F.col("p_retailprice").cast("double")).alias("n")).select("p_partkey", "n.above", "n.below")


@query("label_facets", f"WITH {SUP_SQL}, l AS (SELECT cloud, list(id ORDER BY id) AS label FROM sup GROUP BY cloud) SELECT cloud, CAST(label[k] AS BIGINT) AS left_out, array_to_string(list_filter(label, lambda v: v <> label[k]), ',') AS facet FROM (SELECT cloud, label, unnest(range(1, len(label) + 1)) AS k FROM l)")
def label_facets(spark, sf_dir):
    l = sup(spark, sf_dir).groupBy("cloud").agg(F.array_sort(F.collect_list("id")).alias("label"))
    return l.select("cloud", "label", F.posexplode(cloud.facets(F.col("label")))).select("cloud", F.expr("label[pos]").alias("left_out"), F.array_join("col", ",").alias("facet"))


@query("union_if_adjacent", f"WITH {SUP_SQL} SELECT a.cloud, a.id AS a, b.id AS b, CASE WHEN b.id = a.id + 1 THEN concat_ws(',', a.id, a.id + 1, a.id + 2) END AS joined FROM sup a JOIN sup b ON a.cloud = b.cloud AND a.id < b.id")
def union_if_adjacent(spark, sf_dir):
    p = sup(spark, sf_dir).select("cloud", "id")
    m = p.alias("a").join(p.alias("b"), "cloud").where("a.id < b.id").select("cloud", F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    pair = lambda c: F.array(F.col(c), F.col(c) + 1)
    return m.select("cloud", "a", "b", F.array_join(cloud.union_if_adjacent(pair("a"), pair("b")), ",").alias("joined"))
