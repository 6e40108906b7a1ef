"""Places and running sums over a total order of a table, without putting the table or a key's rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import store


def lay_out(df: DataFrame, order: list[Column], what: str) -> DataFrame:
    """``df`` written in ranges of ``order``, with ``at``: increasing along the order, the range's number in its high bits.

    Rows that are equal in all of ``order`` lie in one range; end it with a number of the row where that may hurt.
    """
    return store.materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), what)


def running(laid: DataFrame, **sums: str) -> DataFrame:
    """``laid`` with the sum of each column over all rows before a row: ``running(laid, start="size")`` adds ``start``.

    A range's own sums come first (one row a range); then each range adds up its rows from there.
    """
    lots = laid.withColumn("lot", F.shiftright("at", 33))
    totals = lots.groupBy("lot").agg(*(F.sum(c).alias(f"{k}_") for k, c in sums.items()))
    before = Window.orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    totals = totals.select("lot", *(F.coalesce(F.sum(f"{k}_").over(before), F.lit(0)).alias(f"{k}_") for k in sums))
    own = Window.partitionBy("lot").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    out = lots.select("*", *(F.coalesce(F.sum(c).over(own), F.lit(0)).alias(k) for k, c in sums.items()))
    out = out.join(F.broadcast(totals), "lot")
    return out.select(*laid.columns, *((F.col(k) + F.col(f"{k}_")).cast("long").alias(k) for k in sums))
