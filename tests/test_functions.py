"""Array functions, sources and streams."""

from __future__ import annotations

import itertools
import struct

import numpy as np
import pytest

from lodestrata.functions import arrays, binary64
from lodestrata.sources import scans
from lodestrata.streaming import frames


def test_enclosing_ball():
    rng = np.random.default_rng(1)
    for dim in (1, 2, 3, 5):
        p = rng.normal(size=(30, dim))
        c, r2 = arrays.enclosing_ball(p)
        d = ((p - c) ** 2).sum(1)
        assert d.max() == pytest.approx(r2, rel=1e-6)
        for _ in range(50):  # no smaller ball nearby
            assert ((p - (c + rng.normal(size=dim) * 1e-3)) ** 2).sum(1).max() >= r2 - 1e-9


def test_bits_of_doubles(spark):
    rng = np.random.default_rng(3)
    values = [0.0, -0.0, 1.0, -1.0, 999.991, 999.992, 5e-324, -5e-324, 1.7976931348623157e308, float("inf"), float("-inf"), *rng.normal(size=200).tolist()]
    assert binary64.to_hex(1.0) == "3ff0000000000000" and binary64.to_hex(-0.0) == "8000000000000000"
    assert all(struct.pack(">d", binary64.from_hex(binary64.to_hex(v))) == struct.pack(">d", v) for v in values)
    for a, b in itertools.product(values, values):
        x, y = binary64.order_key(a), binary64.order_key(b)
        assert (x < y, x == y) == (a < b, a == b)
    assert binary64.to_hex(None) is binary64.from_hex(None) is binary64.order_key(None) is None
    with pytest.raises(ValueError, match="sixteen"):
        binary64.from_hex("3FF0000000000000")
    from lodestrata.plans import catalog

    got = catalog.queries()["src_binary64_bits"](spark, "/root/testdata/sf0.001")
    prices = {r.p_partkey: float(r.p_retailprice) for r in spark.read.parquet("/root/testdata/sf0.001/part.parquet").collect()}
    rows = got.collect()
    assert len(rows) == len(prices) > 0 and all((r.bits, r.back) == (struct.pack(">d", prices[r.p_partkey]).hex(), prices[r.p_partkey]) for r in rows)
    assert [prices[r.p_partkey] for r in sorted(rows, key=lambda r: r.order_key)] == sorted(prices.values())


def test_assignment_is_optimal():
    rng = np.random.default_rng(2)
    for n, m in ((3, 3), (3, 5), (5, 3), (1, 4)):
        c = rng.integers(0, 9, (n, m)).astype(float)
        got = sum(c[i, j] for i, j in arrays.assignment(c))
        k = min(n, m)
        want = min(sum(c[i, j] for i, j in zip(a, b)) for a in itertools.permutations(range(n), k) for b in itertools.combinations(range(m), k))
        assert got == want and len(arrays.assignment(c)) == k


def test_transport_balances_as_the_reach_grows():
    a, b = np.array([1.0, 2.0]), np.array([2.0, 1.0])
    plan = arrays.unbalanced_transport(a, b, np.array([[0.0, 1.0], [1.0, 0.0]]), 0.1, 1e6, 500)
    assert plan.sum(1) == pytest.approx(a, rel=1e-3) and plan.sum(0) == pytest.approx(b, rel=1e-3)
    assert arrays.unbalanced_transport(a, b, np.full((2, 2), np.inf), 0.1, 1.0).sum() == 0


def test_scans_labels_and_meshes(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(struct.pack("<8f", 1, 2, 3, 4, 5, 6, 7, 8))
    (tmp_path / "a.label").write_bytes(struct.pack("<2I", 7 << 16 | 10, 3))
    (tmp_path / "b.off").write_text("OFF\n3 1 0\n0 0 0\n1 2 3\n-1 5 0\n3 0 1 2\n")
    (tmp_path / "poses.txt").write_text("1 0 0 10 0 1 0 20 0 0 1 30\n")
    points = scans.read_scans(spark, str(tmp_path))
    assert [(r.point, r.x, r.remission) for r in points.orderBy("point").collect()] == [(0, 1.0, 4.0), (1, 5.0, 8.0)]
    assert [(r.semantic, r.instance) for r in scans.read_scan_labels(spark, str(tmp_path)).orderBy("point").collect()] == [(10, 7), (3, 0)]
    box = scans.read_off_boxes(spark, str(tmp_path / "b.off")).first()
    assert (box.lox, box.hix, box.loy, box.hiy, box.loz, box.hiz) == (-1.0, 1.0, 0.0, 5.0, 0.0, 3.0)
    world = scans.to_world(points.selectExpr("0 AS frame", "point", "CAST(x AS DOUBLE) x", "CAST(y AS DOUBLE) y", "CAST(z AS DOUBLE) z"), scans.read_poses(spark, str(tmp_path / "poses.txt")))
    assert [(r.x, r.y, r.z) for r in world.orderBy("point").collect()] == [(11.0, 22.0, 33.0), (15.0, 26.0, 37.0)]


def test_affine_clouds(spark):
    for dim in (1, 2, 3):
        rows = scans.affine_cloud(spark, dim, 12, 5).collect()
        p = np.array([(r.x, r.y, r.z) for r in rows])
        assert len({tuple(x) for x in p}) == 12 and np.linalg.matrix_rank(p - p[0]) == dim
        assert rows == scans.affine_cloud(spark, dim, 12, 5).collect()


def test_tracks_survive_gaps_only_when_confirmed():
    tracks, born = [], 0
    numbers = []
    for x in ([1.0], [1.1], [1.2], [], [], [1.3], [9.0]):
        tracks, born, got = frames.step(tracks, born, x)
        numbers.append(got)
    assert numbers == [[0], [0], [0], [], [], [0], [1]]
    tracks, born, _ = frames.step([], 0, [1.0])
    tracks, born, _ = frames.step(tracks, born, [])
    assert not tracks


def test_streamed_tracks_equal_the_batch(spark, tmp_path):
    rows = [(k, f, float(f) + 10 * n) for k in ("a", "b") for f in range(6) for n in range(2)]
    schema = "key string, frame long, x double"
    for f in range(6):
        spark.createDataFrame([r for r in rows if r[1] == f], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = frames.track_batch(spark.createDataFrame(rows, schema))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
    got = frames.run_to_table(frames.track_stream(stream), "tracks")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
    assert len({(r.key, r.track) for r in batch.collect()}) == 4


def test_transport_cost_is_the_sum_written_out():
    import math

    plan, cost = np.asarray([[0.2, 0.0], [0.1, 0.3]]), np.asarray([[1.0, np.inf], [2.0, 0.5]])
    a, b = np.asarray([0.5, 0.5]), np.asarray([0.25, 0.75])
    kl = lambda x, y: x * math.log(x / y) - x + y
    want = 0.2 * 1 + 0.1 * 2 + 0.3 * 0.5 + 3 * (kl(0.2, 0.5) + kl(0.4, 0.5) + kl(0.3, 0.25) + kl(0.3, 0.75))
    assert math.isclose(arrays.transport_cost(plan, cost, a, b, 3.0), want)
    assert arrays.divergence(np.zeros(2), b) == 1.0 and arrays.divergence(a, np.asarray([0.0, 1.0])) == math.inf
    assert arrays.divergence(np.zeros(1), np.zeros(1)) == 0.0


def test_sensor_poses_are_the_products_of_matrices(spark):
    draw = np.random.default_rng(4)
    rows = [(i, draw.normal(size=12).tolist(), draw.normal(size=12).tolist()) for i in range(8)]
    df = spark.createDataFrame(rows, "frame long, m array<double>, c array<double>")
    square = lambda v: np.vstack([np.asarray(v).reshape(3, 4), [0, 0, 0, 1]])
    whole = {r.frame: r.m for r in scans.sensor_poses(df, flatten=False).collect()}
    flat = {r.frame: r.m for r in scans.sensor_poses(df).collect()}
    for i, m, c in rows:
        want = np.linalg.inv(square(c)) @ square(m) @ square(c)
        assert np.allclose(square(whole[i]), want)
        yaw = np.arctan2(want[1, 0], want[0, 0])
        turn = [[np.cos(yaw), -np.sin(yaw), 0], [np.sin(yaw), np.cos(yaw), 0], [0, 0, 1]]
        assert np.allclose(square(flat[i]), np.vstack([np.hstack([turn, want[:3, 3:]]), [0, 0, 0, 1]]))


def test_calibrations_by_name(spark, tmp_path):
    twelve = lambda k: " ".join(str(float(k + i)) for i in range(12))
    files = {"a": f"P0: {twelve(0)}\nTr_velo_to_cam: {twelve(1)}\nTr: {twelve(2)}\n", "b": f"Tr_imu: {twelve(3)}\nTr_velo_to_cam: {twelve(4)}\r\n", "c": f"no key\nMyTr: {twelve(5)}\nTr: 1 2 x\n", "d": "\n", "e": "P0: 1\n"}
    for name, text in files.items():
        (tmp_path / f"{name}.calib").write_text(text)
    got = {r.path.rpartition("/")[2][0]: r.c for r in scans.read_calibrations(spark, str(tmp_path)).collect()}
    one = [1.0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0]
    assert {k: v[0] for k, v in got.items() if k in "abc"} == {"a": 2.0, "b": 4.0, "c": 5.0} and got["d"] == got["e"] == one
