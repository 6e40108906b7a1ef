"""Point clouds: canonical order and ids, normal forms, boxes, Morton codes, content hashes.

A cloud table has ``cloud, id, x, y, z``; several clouds live in one table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exact
from .lineage import cut


def canonical(points: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """``cloud, id, x, y, z, multiplicity, sources``: distinct points, numbered within their cloud in the order of
    their coordinates, with the ids of the rows they came from.

    ``points(cloud, source, x, y, z)``; rows with a null, NaN or infinite coordinate are left out, and -0.0 is 0.
    """
    finite = [f"{c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) < double('inf')" for c in "xyz"]
    clean = points.where(" AND ".join(finite)).select("cloud", "source", *((F.col(c) + F.lit(0)).alias(c) for c in "xyz"))
    merged = clean.groupBy("cloud", "x", "y", "z").agg(F.count("*").alias("multiplicity"), F.array_sort(F.collect_list("source")).alias("sources"))
    return numbered(merged, "cloud", "x", "y", "z").select("cloud", "id", "x", "y", "z", "multiplicity", "sources")


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """Add ``id``: the place of each row in its group by ``order``, from 0.

    Rows are dealt by ranges of (group, order), so a group of any size is sorted by many tasks; a range's first
    place is the number of the group's rows in the ranges before it, a sum over one row per range and group.
    """
    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_row", F.monotonically_increasing_id())
    held = cut(dealt, "numbered").withColumn("_part", F.shiftright("_row", 33))
    parts = held.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = parts.select(group, "_part", "_first", (F.sum("_n").over(Window.partitionBy(group).orderBy("_part")) - F.col("_n")).alias("_before"))
    return held.join(before, [group, "_part"]).withColumn("id", (F.col("_before") + F.col("_row") - F.col("_first")).cast("long")).select(*rows.columns, "id")


def strict(points: DataFrame) -> DataFrame:
    """:func:`canonical`, failing on duplicate points and on coordinates that aren't finite."""
    bad = " OR ".join(f"{c} IS NULL OR isnan({c}) OR abs({c}) = double('inf')" for c in "xyz")
    checked = points.withColumn("x", F.expr(f"CASE WHEN {bad} THEN CAST(raise_error('coordinate is not finite') AS {dict(points.dtypes)['x']}) ELSE x END"))
    out = canonical(checked)
    return out.withColumn("id", F.when(F.col("multiplicity") > 1, F.raise_error(F.lit("duplicate point")).cast("long")).otherwise(F.col("id")))


def bounding_boxes(points: DataFrame) -> DataFrame:
    """Per cloud the box, and the least id among the points at each extreme."""
    ends = []
    for c in "xyz":
        ends += [F.min(c).alias(f"lo{c}"), F.max(c).alias(f"hi{c}"), F.min(F.struct(F.col(c), F.col("id"))).alias(f"first{c}"), F.max(F.struct(F.col(c), -F.col("id"))).alias(f"last{c}")]
    out = points.groupBy("cloud").agg(*ends)
    return out.select("cloud", *(f"lo{c}" for c in "xyz"), *(f"hi{c}" for c in "xyz"), *(F.col(f"first{c}.id").alias(f"lo{c}_id") for c in "xyz"), *((-F.col(f"last{c}")["col2"]).alias(f"hi{c}_id") for c in "xyz"))


def morton(points: DataFrame, bits: int = 21) -> DataFrame:
    """Add ``code``: coordinates binned to ``bits`` bits within the cloud's box and interleaved, x lowest."""
    boxes = points.groupBy("cloud").agg(*(F.min(c).alias(f"lo{c}") for c in "xyz"), *(F.max(c).alias(f"hi{c}") for c in "xyz"))
    top = (1 << bits) - 1
    bins = {c: F.expr(f"CASE WHEN hi{c} = lo{c} THEN CAST(0 AS BIGINT) ELSE least(CAST(floor(CAST({c} - lo{c} AS DOUBLE) * {1 << bits} / CAST(hi{c} - lo{c} AS DOUBLE)) AS BIGINT), {top}) END") for c in "xyz"}
    binned = points.join(boxes, "cloud").withColumns({f"m{c}": bins[c] for c in "xyz"})
    code = f"{exact.spread_bits('mx')} + 2 * {exact.spread_bits('my')} + 4 * {exact.spread_bits('mz')}".replace(">>", "^^")
    for c in "xyz":
        for i in range(bits):
            code = code.replace(f"((m{c} ^^ {i}) & 1)", f"(shiftright(m{c}, {i}) & 1)")
    return binned.select(*points.columns, F.expr(code).alias("code"))


def canonical_id(kind: str, *fields: Column, version: str = "v1") -> Column:
    """A content hash: SHA-256 of a domain prefix and the fields' canonical text (``|`` between, null as ``~``)."""
    text = F.concat_ws("|", *(F.coalesce(f.cast("string"), F.lit("~")) for f in fields))
    return F.sha2(F.concat(F.lit(f"lodestrata/{version}/{kind}/"), text), 256)


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two longs by Euclid's steps, within one expression."""
    start = F.struct(F.abs(a).cast("long").alias("p"), F.abs(b).cast("long").alias("q"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, lambda s, _: F.when(s["q"] == 0, s).otherwise(F.struct(s["q"].alias("p"), (s["p"] % F.when(s["q"] == 0, F.lit(1)).otherwise(s["q"])).alias("q"))))
    return end["p"]


def facets(label: Column) -> Column:
    """The sub-labels of a sorted label with one id left out, in the order of the id left out."""
    return F.transform(F.sequence(F.lit(1), F.size(label)), lambda k: F.filter(label, lambda _, i: i != k - 1))


def union_if_adjacent(a: Column, b: Column) -> Column:
    """The union of two k-labels that share k - 1 ids, else null."""
    both = F.array_sort(F.array_union(a, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(both) == F.size(a) + 1), both)
