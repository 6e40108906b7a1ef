"""Comparing clusterings with a truth, and summaries of clusters: all plain aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exact


def confusion(labels: DataFrame) -> DataFrame:
    """``truth, cluster, n`` from ``labels(truth, cluster)``."""
    return labels.groupBy("truth", "cluster").agg(F.count("*").alias("n"))


def purity(labels: DataFrame) -> DataFrame:
    """Per cluster its size, majority truth (ties: least) and the majority's share."""
    c = confusion(labels)
    best = c.groupBy("cluster").agg(F.sum("n").alias("size"), F.max(F.struct("n", (-F.col("truth")).alias("t"))).alias("b"))
    return best.select("cluster", "size", (-F.col("b.t")).alias("truth"), (F.col("b.n") / F.col("size")).alias("purity"))


def purity_gain(labels: DataFrame) -> DataFrame:
    """Majority share of a parent cluster against the weighted share of its children: ``labels(truth, parent, cluster)``."""
    child = labels.groupBy("parent", "cluster", "truth").agg(F.count("*").alias("n")).groupBy("parent", "cluster").agg(F.max("n").alias("m")).groupBy("parent").agg(F.sum("m").alias("m"))
    top = labels.groupBy("parent", "truth").agg(F.count("*").alias("n")).groupBy("parent").agg(F.max("n").alias("p"), F.sum("n").alias("size"))
    return top.join(child, "parent").select("parent", "size", (F.col("p") / F.col("size")).alias("before"), (F.col("m") / F.col("size")).alias("after"))


def overlaps(labels: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs of truth and cluster with intersection over union above ``least``."""
    c = confusion(labels)
    t, k = c.groupBy("truth").agg(F.sum("n").alias("nt")), c.groupBy("cluster").agg(F.sum("n").alias("nc"))
    j = c.join(t, "truth").join(k, "cluster").withColumn("iou", F.col("n") / (F.col("nt") + F.col("nc") - F.col("n")))
    return j.where(F.col("iou") > least).select("truth", "cluster", "n", "iou")


def tracking_quality(labels: DataFrame) -> DataFrame:
    """Per truth class: association quality (mean over its members of the IoU of their cluster), the best IoU, and
    the root of their product."""
    c = confusion(labels)
    t, k = c.groupBy("truth").agg(F.sum("n").alias("nt")), c.groupBy("cluster").agg(F.sum("n").alias("nc"))
    j = c.join(t, "truth").join(k, "cluster").withColumn("iou", F.col("n") / (F.col("nt") + F.col("nc") - F.col("n")))
    return j.groupBy("truth").agg((F.sum(F.col("n") * F.col("iou")) / F.first("nt")).alias("aq"), F.max("iou").alias("best")).select("truth", "aq", "best", F.sqrt(F.col("aq") * F.col("best")).alias("score"))


def oriented_boxes(points: DataFrame) -> DataFrame:
    """Per group the yaw of the leading axis of (x, y) and the extents along and across it, and in z."""
    g = points.groupBy("grp").agg(F.covar_samp("x", "x").alias("cxx"), F.covar_samp("x", "y").alias("cxy"), F.covar_samp("y", "y").alias("cyy"))
    yaw = g.select("grp", (0.5 * F.atan2(2 * F.col("cxy"), F.col("cxx") - F.col("cyy"))).alias("yaw"))
    p = points.join(yaw, "grp").select("grp", "yaw", (F.col("x") * F.cos("yaw") + F.col("y") * F.sin("yaw")).alias("l"), (F.col("y") * F.cos("yaw") - F.col("x") * F.sin("yaw")).alias("w"), "z")
    return p.groupBy("grp").agg(F.first("yaw").alias("yaw"), (F.max("l") - F.min("l")).alias("length"), (F.max("w") - F.min("w")).alias("width"), (F.max("z") - F.min("z")).alias("height"))


def percolation_curve(forest: DataFrame) -> DataFrame:
    """Largest component's covered points up to each level of an order: a running maximum over the forest's rows."""
    sized = forest.select("cloud", "num", "den", F.expr(exact.level_key("num", "den")).alias("level"), F.size(F.split("covered", ",")).alias("n"))
    at = sized.groupBy("cloud", "num", "den", "level").agg(F.max("n").alias("n"))
    return at.select("cloud", "num", "den", F.max("n").over(Window.partitionBy("cloud").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)).cast("long").alias("largest"))


def latency_stats(values: DataFrame) -> DataFrame:
    """Per group p50, p95, maximum and median absolute deviation of ``value`` (interpolated percentiles)."""
    mid = values.groupBy("grp").agg(F.expr("percentile(value, 0.5)").alias("p50"), F.expr("percentile(value, 0.95)").alias("p95"), F.max("value").alias("largest"))
    mad = values.join(mid.select("grp", "p50"), "grp").groupBy("grp").agg(F.expr("percentile(abs(value - p50), 0.5)").alias("mad"))
    return mid.join(mad, "grp")
