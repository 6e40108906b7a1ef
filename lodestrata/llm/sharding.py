"""Sharding by minimax contiguous partition, in DataFrame operations only.

Texts that are equal form an atomic group, named by its SHA-256; groups are ordered by that name.
The smallest capacity with which a greedy walk over the ordered group sizes fills no more than the
wanted number of shards is found by binary search, and the walk with that capacity makes the cuts.

The driver never holds all groups.  It starts from the sums of the groups whose names share three
hexadecimal digits (at most 4096 rows) and knows each prefix sum at the ends of such intervals.  A
walk's cut that falls inside an interval is bounded from below by the interval's start and from above
by the capacity itself.  Where these bounds leave a capacity undecided, just the intervals in which the
walk may cut are replaced by their 4096 finer ones, until single groups remain.  Rows then find their
shard by comparing their own name with the cuts: no join, and no hot group.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import store

SHARDS, ROW_BYTES, DIGITS = 24, 8, 3
#: A name that no SHA-256 has: documents without a text are one group, the first.
NO_TEXT = ""


class _Intervals:
    """Sums of the group sizes by name prefix, refined where it matters."""

    def __init__(self, groups: DataFrame):
        self.groups = groups
        self.parts: dict[str, tuple[int, int, int]] = {}
        self._load([""])

    def _load(self, prefixes: list[str]) -> None:
        """Replace each prefix (an interval's start) by its finer intervals: sum, groups, largest group."""
        deep = len(prefixes[0]) + DIGITS
        rows = self.groups
        if prefixes != [""]:  # ranges of names, which lie together in the files
            rows = rows.where(reduce(or_, ((F.col("name") >= p) & (F.col("name") < p + "g") for p in prefixes)))
        for p in prefixes:
            self.parts.pop(p, None)
        for r in rows.groupBy(F.substring("name", 1, deep).alias("p")).agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.max("size").alias("m")).collect():
            self.parts[r.p] = (r.s, r.n, r.m)
        self.names = sorted(self.parts)
        self.ends, at = [], 0
        for p in self.names:
            at += self.parts[p][0]
            self.ends.append(at)
        self.total = at
        self.largest = max((v[2] for v in self.parts.values()), default=0)

    def walk(self, capacity: int, shards: int, low: bool) -> tuple[bool, set[str], list[int]]:
        """Greedy walk: does it end within ``shards``; the intervals it can't decide; the parts before each cut.

        ``low``: cuts inside an unrefined interval fall to its start, else they reach the capacity.
        """
        at, open_, cuts = 0, set(), []
        for _ in range(shards):
            if at >= self.total:
                return True, open_, cuts
            reach = at + capacity
            k = bisect_right(self.ends, reach)
            at = self.ends[k - 1] if k else 0
            if k < len(self.names) and self.parts[self.names[k]][1] > 1 and reach > at:
                open_.add(self.names[k])
                at = at if low else reach
            cuts.append(k)
        return at >= self.total, open_, cuts

    def refine(self, prefixes: set[str]) -> None:
        by: dict[int, list[str]] = {}
        for p in prefixes:
            by.setdefault(len(p), []).append(p)
        for some in by.values():
            self._load(sorted(some))

    def feasible(self, capacity: int, shards: int) -> bool:
        while True:
            yes, open_low, _ = self.walk(capacity, shards, low=True)
            if yes:
                return True
            maybe, open_high, _ = self.walk(capacity, shards, low=False)
            if not maybe:
                return False
            self.refine(open_low | open_high)


def smallest_capacity(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """The least feasible capacity over ``groups(name, size)`` and the first name of every shard but the first."""
    known = _Intervals(groups)
    if not known.names:
        return 0, []
    lo = max(-(-known.total // shards), known.largest)
    hi = lo + known.largest
    while not known.feasible(hi, shards):  # pragma: no cover - the sum of both bounds always suffices
        hi *= 2
    while lo < hi:
        mid = (lo + hi) // 2
        if known.feasible(mid, shards):
            hi = mid
        else:
            lo = mid + 1
    while True:  # cuts must fall between known groups
        _, open_, cuts = known.walk(lo, shards, low=True)
        if not open_:
            return lo, [known.names[k] for k in cuts if k < len(known.names)]
        known.refine(open_)


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row.

    A row's size is the UTF-8 bytes of its text plus 8.  A null text counts as no bytes; all such rows
    form one group, apart from rows with an empty text.  text_crc32 of a null text is that of no bytes (0).
    Repeated rows are placed as often as they come; null doc_ids too; an empty table gives no rows.
    Slots number a shard's rows from 0 in the order of the partitions they were read in.
    """
    spark = docs.sparkSession
    text = F.col("text")
    rows = store.materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES).alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.when(text.isNull(), F.lit(NO_TEXT)).otherwise(F.sha2(text.cast("binary"), 256)).alias("name"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "shard-rows",
    )
    groups = rows.groupBy("name").agg(F.sum("size").alias("size"))
    groups = store.materialize(groups.repartitionByRange("name").sortWithinPartitions("name"), "shard-groups")
    _, firsts = smallest_capacity(groups, shards)
    shard = F.lit(0)
    for first in firsts:
        shard = shard + (F.col("name") >= first).cast("int")
    placed = rows.select("doc_id", "size", "text_crc32", "row", shard.cast("int").alias("shard"), F.shiftright("row", 33).alias("part"))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    # One row a shard and input partition: few, whatever the keys of the rows.
    before = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row")) - 1
    return placed.withColumn("own", own).join(before, ["shard", "part"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("own")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal size, equal texts together."""
    return shard_documents(store.spark_table(spark, sf_dir, "documents"))
