"""Joins of many rows with one row a key, where a single key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

#: Keys that are sent to every task; beyond, the join is dealt out over lanes.
BROADCAST_KEYS, LANES = 100_000, 32


def attach(rows: DataFrame, totals: DataFrame, key: str, most: int = BROADCAST_KEYS, lanes: int = LANES) -> DataFrame:
    """``rows`` with the columns of ``totals`` of the same ``key``; null keys meet null keys.

    ``totals`` has at most one row a key, and all keys of ``rows``.  Its rows are counted first: up to ``most`` it is
    broadcast.  Beyond, both sides are shuffled by key and lane, and a hot key's rows are spread over all lanes by
    their place in the table, which must be a written one.
    """
    if totals.limit(most + 1).count() <= most:
        other = totals.withColumnRenamed(key, "_key")
        return rows.join(F.broadcast(other), F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    lane = store.free_name([*rows.columns, *totals.columns], "lane")
    dealt = rows.withColumn(lane, F.pmod(F.monotonically_increasing_id(), F.lit(lanes)))
    copies = totals.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))).alias("_lane")).withColumnRenamed(key, "_key")
    return dealt.join(copies, F.col(key).eqNullSafe(F.col("_key")) & (F.col(lane) == F.col("_lane"))).drop(lane, "_lane", "_key")
