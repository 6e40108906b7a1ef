"""Sources of points: binary LiDAR scans, labels, poses, OFF meshes, delimited text; explicit schemas only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCAN = "path string, point long, x float, y float, z float, remission float"
LABELS = "path string, point long, semantic int, instance int"


def read_scans(spark: SparkSession, path: str) -> DataFrame:
    """Little-endian float32 quadruples of every ``.bin`` file, one task per group of files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, raw in zip(frame["path"], frame["content"], strict=True):
                v = np.frombuffer(raw, "<f4").reshape(-1, 4)
                yield pd.DataFrame({"path": name, "point": np.arange(len(v)), "x": v[:, 0], "y": v[:, 1], "z": v[:, 2], "remission": v[:, 3]})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path).select("path", "content").mapInPandas(run, SCAN)


def read_scan_labels(spark: SparkSession, path: str) -> DataFrame:
    """Unsigned 32-bit labels: the low half is the semantic class, the high half the instance."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, raw in zip(frame["path"], frame["content"], strict=True):
                v = np.frombuffer(raw, "<u4").astype(np.int64)
                yield pd.DataFrame({"path": name, "point": np.arange(len(v)), "semantic": v & 0xFFFF, "instance": v >> 16})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.label").load(path).select("path", "content").mapInPandas(run, LABELS)


def read_poses(spark: SparkSession, path: str) -> DataFrame:
    """A row-major 3x4 matrix a line: ``frame, path, m`` (12 doubles).  Frames are numbered within the file."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split(F.trim("value"), "\n")).alias("frame", "line"))
    return lines.where("trim(line) <> ''").select("frame", "path", F.transform(F.split(F.regexp_replace("line", r"^\s+|\s+$", ""), r"\s+"), lambda v: v.cast("double")).alias("m")).where(F.size("m") == 12)


#: Names of the sensor's matrix in a calibration file, the first that is there; else any that has the last in its name.
CALIBRATION_KEYS = ("Tr", "Tr_velo_to_cam")


def read_calibrations(spark: SparkSession, path: str) -> DataFrame:
    """``path, c``: the matrix from sensor to camera (12 doubles, row-major 3x4) of every ``.calib`` file of ``key: values`` lines.

    A file that names none gives the identity, an empty file no row; lines that are no key with twelve values are passed over."""
    lines = spark.read.option("pathGlobFilter", "*.calib").text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", "\n")).alias("nth", "line"))
    value = F.transform(F.split(F.regexp_replace(F.substring_index("line", ":", -1), r"^\s+|\s+$", ""), r"\s+"), lambda v: v.try_cast("double"))
    named = lines.select("path", "nth", F.trim(F.substring_index("line", ":", 1)).alias("key"), F.when(F.col("line").contains(":"), value).alias("c"))
    whole = F.coalesce(F.size("c") == 12, F.lit(False)) & F.coalesce(F.forall("c", lambda v: v.isNotNull()), F.lit(False))
    rank = F.when(F.col("key") == CALIBRATION_KEYS[0], 0).when(F.col("key") == CALIBRATION_KEYS[1], 1).when(F.col("key").contains(CALIBRATION_KEYS[0]), 2)
    best = named.groupBy("path").agg(F.min_by(F.when(whole & rank.isNotNull(), F.col("c")), F.when(whole & rank.isNotNull(), F.struct(rank, "nth"))).alias("c"))
    return best.select("path", F.coalesce("c", F.array(*(F.lit(float(i % 5 == 0)) for i in range(12)))).alias("c"))


def sensor_poses(poses: DataFrame, flatten: bool = True) -> DataFrame:
    """Camera poses ``m`` with calibrations ``c`` (a column of ``poses``) as poses of the sensor: ``m`` is then the inverse of c,
    after m, after c.  ``flatten`` keeps of the turn only the one about the vertical axis."""
    at = lambda name: [[F.col(name)[4 * r + k] for k in range(4)] for r in range(3)]
    a, b = at("c"), at("m")
    minor = lambda r, k: a[(r + 1) % 3][(k + 1) % 3] * a[(r + 2) % 3][(k + 2) % 3] - a[(r + 1) % 3][(k + 2) % 3] * a[(r + 2) % 3][(k + 1) % 3]
    rest = [c for c in poses.columns if c not in ("m", "c")]
    det = sum((a[0][k] * minor(0, k) for k in range(1, 3)), a[0][0] * minor(0, 0))
    held = poses.select("*", *((minor(k, r) / det).alias(f"i{r}{k}") for r in range(3) for k in range(3)))
    # What comes after the inverse: the turn, and the shift.
    ba = [[sum((b[r][j] * a[j][k] for j in range(1, 3)), b[r][0] * a[0][k]) for k in range(3)] for r in range(3)]
    shift = [sum((b[r][j] * a[j][3] for j in range(1, 3)), b[r][0] * a[0][3]) + b[r][3] - a[r][3] for r in range(3)]
    held = held.select(*rest, *(f"i{r}{k}" for r in range(3) for k in range(3)), *(ba[r][k].alias(f"b{r}{k}") for r in range(3) for k in range(3)), *(shift[r].alias(f"s{r}") for r in range(3)))
    product = lambda r, name: sum((F.col(f"i{r}{j}") * F.col(name.format(j)) for j in range(1, 3)), F.col(f"i{r}0") * F.col(name.format(0)))
    turn = [[product(r, f"b{{}}{k}") for k in range(3)] for r in range(3)]
    if flatten:
        yaw = F.atan2(turn[1][0], turn[0][0])
        cos, sin, one, zero = F.cos(yaw), F.sin(yaw), F.lit(1.0), F.lit(0.0)
        turn = [[cos, -sin, zero], [sin, cos, zero], [zero, zero, one]]
    return held.select(*rest, F.array(*(x for r in range(3) for x in (*turn[r], product(r, "s{}")))).alias("m"))


def to_world(points: DataFrame, poses: DataFrame) -> DataFrame:
    """``points(frame, x, y, z, ...)`` moved by the pose of their frame."""
    at = lambda r: sum((F.col("m")[4 * r + i] * F.col(c) for i, c in enumerate("xyz")), F.col("m")[4 * r + 3])
    rest = [c for c in points.columns if c not in "xyz"]
    return points.join(poses, "frame").select(*rest, *(at(r).alias(c) for r, c in enumerate("xyz")))


def read_off_boxes(spark: SparkSession, path: str) -> DataFrame:
    """Bounding box of the vertices of every OFF mesh: ``path, lox, hix, ...``."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split(F.regexp_replace(F.trim("value"), r"#[^\n]*", ""), r"\s+").alias("t"))
    n = F.col("t")[1].cast("int")
    v = text.withColumn("v", F.slice("t", F.lit(5), 3 * n)).select("path", F.posexplode("v").alias("k", "w")).select("path", (F.col("k") % 3).alias("axis"), F.col("w").cast("double").alias("w"))
    return v.groupBy("path").agg(*(F.min(F.when(F.col("axis") == i, F.col("w"))).alias(f"lo{c}") for i, c in enumerate("xyz")), *(F.max(F.when(F.col("axis") == i, F.col("w"))).alias(f"hi{c}") for i, c in enumerate("xyz")))


def read_table(spark: SparkSession, path: str, schema: str, kind: str = "csv", header: bool = True) -> DataFrame:
    """A delimited or Parquet table by an explicit schema."""
    return spark.read.schema(schema).parquet(path) if kind == "parquet" else spark.read.schema(schema).option("header", header).option("mode", "FAILFAST").csv(path)


def affine_cloud(spark: SparkSession, dimension: int, n: int, seed: int, bound: int = 16) -> DataFrame:
    """A seeded cloud of ``n`` distinct integer points of exact affine rank ``dimension`` (1 to 3): ``id, x, y, z``.

    Coordinates come from a hash of (seed, id), so any number of tasks makes the same cloud.  The first
    points span the rank.
    """
    if not 1 <= dimension <= 3 or n <= dimension:
        raise ValueError("a cloud of rank d has d in 1..3 and more than d points")
    span = 2 * bound + 1
    ids = spark.range(n * 8)
    coordinate = lambda k: (F.pmod(F.xxhash64(F.lit(seed), "id", F.lit(k)), F.lit(span)) - bound) if k < dimension else F.lit(0).cast("long")
    base = [F.when(F.col("id") == 0, F.lit(0).cast("long")).when(F.col("id") <= dimension, (F.col("id") == k + 1).cast("long")).otherwise(coordinate(k)) for k in range(3)]
    drawn = ids.select("id", *(b.alias(c) for b, c in zip(base, "xyz", strict=True))).groupBy("x", "y", "z").agg(F.min("id").alias("id"))
    return drawn.orderBy("id").limit(n).select("id", "x", "y", "z")
