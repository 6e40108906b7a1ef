"""The point clouds that the registered queries work on, in Spark and as SQL.

``emb``: the vectors of each label, their first three coordinates in 1/1024 (``emb6``: in 1/64, 6 bits).
``sup``: the suppliers of each nation, on a small integer lattice of 6 bits.  Both cover their whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cloud
from ..operators.lineage import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emb(spark: SparkSession, sf_dir: str, scale: int = 1024) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    at = [F.floor(F.col("embedding")[i].cast("double") * scale).cast("long").alias(c) for i, c in enumerate("xyz")]
    return cut(cloud.canonical(e.select(F.col("label").cast("long").alias("cloud"), F.col("vec_id").alias("source"), *at)), "emb")


def sup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    at = [(F.col("s_suppkey") % 31).cast("long").alias("x"), F.floor((F.col("s_acctbal") + 1000) / 200).cast("long").alias("y"), ((F.col("s_suppkey") * 7) % 29).cast("long").alias("z")]
    return cut(cloud.canonical(s.select(F.col("s_nationkey").cast("long").alias("cloud"), F.col("s_suppkey").alias("source"), *at)), "sup")


def emb_sql(scale: int = 1024, name: str = "emb") -> str:
    at = ", ".join(f"CAST(floor(CAST(embedding[{i}] AS DOUBLE) * {scale}) AS BIGINT) AS {c}" for i, c in enumerate("xyz", 1))
    return f"{name} AS (SELECT cloud, CAST(row_number() OVER (PARTITION BY cloud ORDER BY x, y, z) - 1 AS BIGINT) AS id, x, y, z, n FROM (SELECT cloud, x, y, z, count(*) AS n FROM (SELECT CAST(label AS BIGINT) AS cloud, {at} FROM embeddings) GROUP BY ALL))"


SUP_SQL = (
    "sup AS (SELECT cloud, CAST(row_number() OVER (PARTITION BY cloud ORDER BY x, y, z) - 1 AS BIGINT) AS id, x, y, z, n FROM (SELECT cloud, x, y, z, count(*) AS n FROM ("
    "SELECT CAST(s_nationkey AS BIGINT) AS cloud, CAST(s_suppkey % 31 AS BIGINT) AS x, CAST(floor((s_acctbal + 1000) / 200) AS BIGINT) AS y, CAST((s_suppkey * 7) % 29 AS BIGINT) AS z FROM supplier) GROUP BY ALL))"
)

#: Each point with the three after it in its cloud, as a..d.
QUADS_SQL = (
    "quads AS (SELECT * FROM (SELECT cloud, id, " + ", ".join(f"{'x y z'.split()[i]} AS a_{c}" for i, c in enumerate("xyz")) + ", "
    + ", ".join(f"lead({c}, {k}) OVER (PARTITION BY cloud ORDER BY id) AS {p}_{c}" for k, p in enumerate("bcd", 1) for c in "xyz") + " FROM emb6) WHERE d_x IS NOT NULL)"
)


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    w = Window.partitionBy("cloud").orderBy("id")
    p = emb(spark, sf_dir, 64).select("cloud", "id", *(F.col(c).alias(f"a_{c}") for c in "xyz"))
    return p.select("*", *(F.lead(f"a_{c}", k).over(w).alias(f"{q}_{c}") for k, q in enumerate("bcd", 1) for c in "xyz")).where("d_x IS NOT NULL")
