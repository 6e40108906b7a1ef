"""Queries that write files, chunks and runs, and read them back."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import cloud
from ..operators.lineage import cut, shared_dir
from ..sources import scans, stores
from ..streaming import frames
from .catalog import query
from .clouds import table


def _base(spark, what: str) -> str:
    return f"{shared_dir(spark)}/lodestrata-{what}-{uuid.uuid4().hex[:12]}"


def _vectors(spark, sf_dir, n: int):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").cast("long").alias("cloud"), F.col("vec_id").cast("long").alias("vec_id"), *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyzw"[:n])))


def _rows_sql(n: int, extra: str = "") -> str:
    return f"SELECT CAST(label AS BIGINT) AS cloud, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS row, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {c}" for i, c in enumerate("xyzw"[:n])) + f"{extra} FROM embeddings"


def _in_order(encode):
    return lambda frame: encode(frame.sort_values("vec_id").drop(columns="vec_id"))


@query("src_npy", f"SELECT cloud, row, x, y, z FROM ({_rows_sql(3)})")
def src_npy(spark, sf_dir):
    """The vectors' leading coordinates through an array file per label."""
    base = _base(spark, "npy")
    cut(stores.write_files(_vectors(spark, sf_dir, 3), "cloud", base, ".npy", _in_order(stores.to_npy)), "files")
    return stores.read_files(spark, base, "*.npy", stores.from_npy(list("xyz")), "row long, x double, y double, z double").select(F.col("file").cast("long").alias("cloud"), "row", *"xyz")


@query("sink_npy", "SELECT CAST(o_custkey % 8 AS BIGINT) AS file, CAST(count(*) AS BIGINT) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1")
def sink_npy(spark, sf_dir):
    """Integer array files of order keys, summed after reading."""
    base = _base(spark, "npy")
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 8).cast("long").alias("part"), F.col("o_orderkey").cast("long").alias("key"))
    cut(stores.write_files(rows, "part", base, ".npy", stores.to_npy), "files")
    got = stores.read_files(spark, base, "*.npy", stores.from_npy(["key"]), "row long, key long")
    return got.groupBy(F.col("file").cast("long").alias("file")).agg(F.count("*").alias("n"), F.sum("key").alias("keys"))


@query("src_ply", f"SELECT cloud, row, x, y, z FROM ({_rows_sql(3)})")
def src_ply(spark, sf_dir):
    """The same through point files: even labels as text, odd ones binary."""
    base = _base(spark, "ply")

    def encode(frame: pd.DataFrame) -> bytes:
        return stores.to_ply(frame, text=bool(frame["even"].iloc[0]))

    cut(stores.write_files(_vectors(spark, sf_dir, 3).withColumn("even", F.col("cloud") % 2 == 0), "cloud", base, ".ply", _in_order(encode)), "files")
    return stores.read_files(spark, base, "*.ply", stores.from_ply, "row long, x double, y double, z double").select(F.col("file").cast("long").alias("cloud"), "row", *"xyz")


def _file():
    return F.regexp_extract("path", r"([^/.]+)\.[^/]*$", 1).cast("long").alias("cloud")


@query("src_kitti_scan", f"SELECT cloud, row AS point, x, y, z, w AS remission FROM ({_rows_sql(4)})")
def src_kitti_scan(spark, sf_dir):
    """Float quadruples through a binary scan per label."""
    base = _base(spark, "scans")
    cut(stores.write_files(_vectors(spark, sf_dir, 4), "cloud", base, ".bin", _in_order(lambda f: np.ascontiguousarray(f.to_numpy(), "<f4").tobytes())), "files")
    return scans.read_scans(spark, base).select(_file(), "point", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "remission")))


@query("src_kitti_labels", "SELECT CAST(label AS BIGINT) AS cloud, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS point, CAST(label AS INT) AS semantic, CAST(vec_id % 65536 AS INT) AS instance FROM embeddings")
def src_kitti_labels(spark, sf_dir):
    """Classes and instances through 32-bit label files."""
    base = _base(spark, "labels")
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("cloud"), F.col("vec_id").cast("long").alias("vec_id"), (F.col("label") + F.shiftleft(F.col("vec_id") % 65536, 16)).cast("long").alias("word"))
    cut(stores.write_files(rows, "cloud", base, ".label", _in_order(lambda f: f["word"].to_numpy().astype("<u4").tobytes())), "files")
    return scans.read_scan_labels(spark, base).select(_file(), "point", "semantic", "instance")


@query("src_kitti_poses", "SELECT vec_id, round(e[1] + 2 * e[2] + 3 * e[3] + e[4], 9) AS x, round(e[5] + 2 * e[6] + 3 * e[7] + e[8], 9) AS y, round(e[9] + 2 * e[10] + 3 * e[11] + e[12], 9) AS z FROM (SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)")
def src_kitti_poses(spark, sf_dir):
    """Each vector's first twelve coordinates as a pose in a text file, applied to the point (1, 2, 3)."""
    base = _base(spark, "poses")
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("cloud"), F.col("vec_id").cast("long").alias("vec_id"), *(F.col("embedding")[i].cast("double").alias(f"m{i}") for i in range(12)))
    text = lambda f: "".join(" ".join(map(repr, map(float, r))) + "\n" for r in f.itertuples(index=False)).encode()
    cut(stores.write_files(e, "cloud", base, ".txt", _in_order(text)), "files")
    frame = lambda cloud, k: F.struct(cloud.alias("cloud"), k.cast("long").alias("k")).alias("frame")
    poses = scans.read_poses(spark, base).select(_file(), F.col("frame").alias("k"), "m").select(frame(F.col("cloud"), F.col("k")), "m")
    points = cloud.numbered(e.select("cloud", "vec_id"), "cloud", "vec_id").select(frame(F.col("cloud"), F.col("id")), "vec_id", F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), F.lit(3.0).alias("z"))
    return scans.to_world(points, poses).select("vec_id", *(F.round(c, 9).alias(c) for c in "xyz"))


@query(
    "src_kitti_calib",
    "WITH v AS (SELECT CAST(label AS BIGINT) AS cloud, CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), a AS (SELECT cloud, arg_min(e, vec_id) AS a FROM v GROUP BY 1), "
    "w AS (SELECT v.cloud, vec_id, atan2(-e[3], e[11]) AS yaw, e[1] * a[1] + e[2] * a[2] + e[3] * a[3] + e[4] - a[1] AS w1, e[5] * a[1] + e[6] * a[2] + e[7] * a[3] + e[8] - a[2] AS w2, e[9] * a[1] + e[10] * a[2] + e[11] * a[3] + e[12] - a[3] AS w3 FROM v JOIN a ON a.cloud = v.cloud) "
    "SELECT vec_id, round(cos(yaw) - 2 * sin(yaw) + w3, 9) AS x, round(sin(yaw) + 2 * cos(yaw) - w1, 9) AS y, round(3 - w2, 9) AS z FROM w",
)
def src_kitti_calib(spark, sf_dir):
    """The same poses seen from a sensor whose axes a label's calibration file turns and shifts, flattened, applied to (1, 2, 3)."""
    base, e = _base(spark, "calibrated"), table(spark, sf_dir, "embeddings")
    e = e.select(F.col("label").cast("long").alias("cloud"), F.col("vec_id").cast("long").alias("vec_id"), *(F.col("embedding")[i].cast("double").alias(f"m{i}") for i in range(12)))
    numbers = lambda values: " ".join(map(repr, map(float, values)))
    text = lambda f: "".join(numbers(r) + "\n" for r in f.itertuples(index=False)).encode()
    cut(stores.write_files(e, "cloud", base, ".txt", _in_order(text)), "files")
    first = e.groupBy("cloud").agg(F.min("vec_id").alias("vec_id")).join(e.select("cloud", "vec_id", "m0", "m1", "m2"), ["cloud", "vec_id"])
    calib = lambda f: (f"P0: {numbers(range(12))}\nTr: " + numbers([0, -1, 0, f["m0"].iloc[0], 0, 0, -1, f["m1"].iloc[0], 1, 0, 0, f["m2"].iloc[0]]) + "\n").encode()
    cut(stores.write_files(first, "cloud", base, ".calib", _in_order(calib)), "files")
    frame = lambda cloud, k: F.struct(cloud.alias("cloud"), k.cast("long").alias("k")).alias("frame")
    poses = scans.read_poses(spark, f"{base}/*.txt").select(_file(), F.col("frame").alias("k"), "m").join(scans.read_calibrations(spark, base).select(_file(), "c"), "cloud")
    poses = scans.sensor_poses(poses.select(frame(F.col("cloud"), F.col("k")), "m", "c"))
    points = cloud.numbered(e.select("cloud", "vec_id"), "cloud", "vec_id").select(frame(F.col("cloud"), F.col("id")), "vec_id", F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), F.lit(3.0).alias("z"))
    return scans.to_world(points, poses).select("vec_id", *(F.round(c, 9).alias(c) for c in "xyz"))


@query("src_off_bbox", "SELECT CAST(s_nationkey AS BIGINT) AS cloud, " + ", ".join(f"min({e}) AS lo{c}, max({e}) AS hi{c}" for c, e in (("x", "CAST(s_suppkey AS DOUBLE)"), ("y", "CAST(s_acctbal AS DOUBLE)"), ("z", "CAST(s_suppkey % 7 AS DOUBLE)"))) + " FROM supplier GROUP BY 1")
def src_off_bbox(spark, sf_dir):
    """Boxes of a mesh file per nation."""
    base = _base(spark, "off")
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("cloud"), F.col("s_suppkey").cast("double").alias("x"), F.col("s_acctbal").cast("double").alias("y"), (F.col("s_suppkey") % 7).cast("double").alias("z"))
    mesh = lambda f: (f"OFF\n{len(f)} 0 0\n" + "".join(f"{x!r} {y!r} {z!r}\n" for x, y, z in f.astype(float).itertuples(index=False))).encode()
    cut(stores.write_files(s, "cloud", base, ".off", mesh), "files")
    return scans.read_off_boxes(spark, f"{base}/*.off").select(_file(), *(f"{e}{c}" for c in "xyz" for e in ("lo", "hi")))


@query("chunk_codec", "SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem")
def chunk_codec(spark, sf_dir):
    """Order lines through framed, checksummed chunks."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("CAST(l_orderkey AS BIGINT) AS l_orderkey", "CAST(l_linenumber AS BIGINT) AS l_linenumber", "CAST(round(l_extendedprice * 100) AS BIGINT) AS cents")
    return stores.decode_chunks(cut(stores.encode_chunks(rows), "chunks"), rows.columns)


@query("atomic_run_store", "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'O')")
def atomic_run_store(spark, sf_dir):
    """Runs of finished and open orders, committed whole and certified; a run that is refused and one that is written
    twice leave nothing behind."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderstatus")
    store = stores.RunStore(spark, _base(spark, "runs"), recertify=lambda run: not run.where("o_orderstatus = 'P'").limit(1).count())
    for status in ("F", "O", "P", "F"):
        try:
            store.commit(status, o.where(F.col("o_orderstatus") == status))
        except ValueError:
            pass
    return store.read(o.schema)


@query("incremental_verifier", "SELECT event_id, user_id, CASE WHEN sum(bad) OVER w - bad > 0 THEN 'poisoned' WHEN bad = 1 THEN 'failed' ELSE 'verified' END AS status FROM (SELECT CAST(event_id AS BIGINT) AS event_id, CAST(user_id AS VARCHAR) AS user_id, CASE WHEN value > 99 THEN 1 ELSE 0 END AS bad FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def incremental_verifier(spark, sf_dir):
    """Every user's events verified one after the other, as a stream with state: after a failure the user stays poisoned."""
    s = frames.read_stream(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").cast("long").alias("number"), (F.col("value") > 99).alias("bad"))
    return frames.run_to_table(frames.verify_stream(s), "verified").select(F.col("number").alias("event_id"), F.col("key").alias("user_id"), "status")
