"""Mixing sources to target weights by a low-discrepancy schedule of blocks.

Targets follow from the weights: a share of all words is dealt out by weight, no source gives more than twice its
words, and what it can't give goes to the others.  A source's documents are shuffled, once per pass over it, and the
stream of their words is cut into blocks of equal size.  The mix is a sequence of slots: slot i lies at the i-th multiple of the
golden ratio, modulo one, and the cumulative block counts of the sources say whose slot that is.  The r-th slot of a
source takes its r-th block, the last of them cut where the target is reached.

So every stretch of the mix holds the sources close to their weights, and the whole holds them to the word.  Golden-ratio
points give a source a few slots more or less than it has blocks: slots without a block are left out, blocks
without a slot come at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import keyed, ordered, store

#: Weights of the sources in order, repeating; the share of all words that the mix holds; passes over a source at most.
WEIGHTS, SHARE, PASSES = (3, 1, 2), (3, 2), 2
BLOCK_WORDS = 1024
#: The odd integer next to 2**31 over the golden ratio: its multiples modulo 2**31 visit all of them.
GOLDEN, POINTS = 1327217885, 1 << 31
#: Cells of the schedule over which slots meet sources, at least.
CELLS = 4096
WORD = r"[^\x20\x09-\x0D]+"
_WIDE = "decimal(38,0)"


def water_level(sources: DataFrame, share: tuple[int, int] = SHARE, passes: int = PASSES) -> tuple[int, int]:
    """The fraction by which weights are multiplied; a source gives that or, if that is less, ``passes`` times its words.

    ``sources`` has weight and words.  Each round is one aggregate over the sources: those above their limit give it,
    and the rest of the share is dealt out to the others again, until none is above.
    """
    up, down = share
    level, before = (0, 1), None
    while level != before:
        before = level
        full = F.expr(f"cast(words as {_WIDE}) * {passes * before[1]} < cast(weight as {_WIDE}) * cast('{before[0]}' as {_WIDE})")
        r = sources.agg(F.sum(F.col("words").cast(_WIDE)).alias("all"), F.sum(F.when(full, F.col("words").cast(_WIDE))).alias("full"), F.sum(F.when(~full, F.col("weight").cast(_WIDE))).alias("weight")).first()
        if not r["all"] or not r.weight:
            return 0, 1
        level = (up * int(r["all"]) - down * passes * int(r.full or 0), down * int(r.weight))
    return level


def _sources(rows: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """``source, words, number, weight, base``: sources in order, with the words of all before."""
    own = rows.groupBy("source").agg(F.sum("size").alias("words"), F.lit(1).alias("one"))
    laid = ordered.lay_out(own, [F.asc_nulls_last("source")], "sources")
    table = ordered.running(laid, number="one").select("source", "words", "number")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))
    return store.materialize(table.withColumn("weight", weight.cast("long")), "sources")


def schedule(plan: DataFrame, spark: SparkSession) -> DataFrame:
    """``number, block, slot`` of every block: ``plan`` has ``number, blocks, base`` (the blocks of all before)."""
    r = plan.agg(F.coalesce(F.sum("blocks"), F.lit(0)).alias("all"), F.count("*").alias("n")).first()
    total, cells = r["all"], max(CELLS, 4 * r.n)
    width = max(1, -(-total // cells))
    owner = plan.where("blocks > 0").select("number", "base", (F.col("base") + F.col("blocks")).alias("end"))
    owner = owner.select("*", F.explode(F.sequence(F.expr(f"base div {width}"), F.expr(f"(end - 1) div {width}"))).alias("cell"))
    point = (F.col("id") % POINTS * GOLDEN % POINTS).cast("double")
    slots = spark.range(total).select(F.col("id").alias("slot"), F.floor(point * total / POINTS).cast("long").alias("place"))
    slots = slots.withColumn("cell", F.expr(f"place div {width}")).join(owner, "cell").where("place >= base and place < end")
    laid = ordered.lay_out(slots.select("number", "slot", F.lit(1).alias("one")), [F.asc("number"), F.asc("slot")], "slots")
    placed = store.materialize(ordered.running(laid, rank="one").select("number", "slot", "rank"), "slots")
    store.release(laid)
    own = placed.groupBy("number").agg(F.min("rank").alias("first"), F.count("*").alias("slots"))
    known = plan.join(own, "number", "left").select("number", "blocks", "base", "first", F.coalesce("slots", F.lit(0)).alias("slots"))
    known = store.materialize(known, "slots")
    used = keyed.attach(placed, known.select("number", "first", "blocks"), "number").select("number", (F.col("rank") - F.col("first")).alias("block"), "slot", "blocks").where("block < blocks").drop("blocks")
    late = known.where("slots < blocks").select("number", "base", F.explode(F.sequence(F.col("slots").cast("long"), F.col("blocks") - 1)).alias("block"))
    return used.unionAll(late.select("number", "block", (F.lit(total) + F.col("base") + F.col("block")).alias("slot")))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, passes: int = PASSES, block: int = BLOCK_WORDS, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """The rows with their sources' targets, and the mix.

    Rows: ``row, doc_id, size, source, source_size, target``.  Mix: ``slot, row, doc_id, pass, first, words``: within
    slot order, the words ``first`` to ``first + words - 1`` of a document; a document of several blocks lies in several slots.
    The order of documents depends on seed, pass, doc_id and size alone, so a second run gives the same mix whatever the
    partitions; of rows that share both, any may come first.

    A null text has no words, as has one of blanks: such rows are in the rows, not in the mix.  Null sources are one
    source, the last; null doc_ids are ids that are equal.  A source without words has the target 0, as have all if there are none.
    Rows that repeat are rows of their own.  An empty table gives none of either.  Other columns do not matter.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = store.materialize(rows.withColumn("row", F.monotonically_increasing_id()), "mix-rows")
    sources = _sources(rows, weights)
    up, down = water_level(sources, share, passes)
    full = F.expr(f"cast(words as {_WIDE}) * {passes * down} < cast(weight as {_WIDE}) * cast('{up}' as {_WIDE})")
    exact = F.expr(f"cast(weight as {_WIDE}) * cast('{up}' as {_WIDE})")
    target = F.when(full, (F.col("words") * passes).cast("double")).otherwise(exact.cast("double") / F.lit(float(down)))
    taken = F.when(full, F.col("words") * passes).otherwise(F.expr(f"(cast(weight as {_WIDE}) * cast('{up}' as {_WIDE})) div cast('{down}' as {_WIDE})"))
    table = sources.select("source", "words", "number", target.alias("target"), taken.cast("long").alias("quota"))
    table = table.select("*", F.expr(f"(quota + {block - 1}) div {block}").alias("blocks"), F.when(F.col("quota") > 0, F.expr("(quota + words - 1) div nullif(words, 0)")).otherwise(0).cast("int").alias("passes"))
    laid = ordered.lay_out(table.withColumn("stream", F.col("words") * F.col("passes")), [F.asc("number")], "targets")
    plan = store.materialize(ordered.running(laid, base="blocks", begin="stream"), "targets")

    known = keyed.attach(rows, plan.select("source", "words", "number", "target", "quota", "passes", "begin"), "source")
    out = store.materialize(known.select("row", "doc_id", "size", "source", F.col("words").alias("source_size"), "target"), "mix-targets")
    stream = known.where("passes > 0 and size > 0").select("row", "doc_id", "size", "number", "quota", "begin", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)).alias("pass"))
    key = F.md5(F.concat(F.lit(f"{seed}-"), F.col("pass").cast("string"), F.lit("-"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    laid = ordered.lay_out(stream.withColumn("key", key), [F.asc("number"), F.asc("pass"), F.asc("key"), F.asc("size"), F.asc("row")], "mix-stream")
    placed = ordered.running(laid, start="size").withColumn("start", F.col("start") - F.col("begin")).where("start < quota")
    placed = placed.withColumn("stop", F.least(F.col("start") + F.col("size"), "quota"))
    cut = placed.select("row", "doc_id", "number", "pass", "start", "stop", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(stop - 1) div {block}"))).alias("block"))
    cut = cut.select("row", "doc_id", "number", "pass", "block", (F.greatest("start", F.col("block") * block) - F.col("start")).alias("first"), (F.least("stop", (F.col("block") + 1) * block) - F.greatest("start", F.col("block") * block)).alias("words"))
    slots = schedule(plan.select("number", "blocks", "base"), spark)
    mixed = store.materialize(cut.join(slots, ["number", "block"]).select("slot", "row", "doc_id", "pass", "first", "words"), "mix")
    for frame in (rows, sources, plan, laid):
        store.release(frame)
    return out, mixed


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix holds."""
    rows, mixed = mix(store.spark_table(spark, sf_dir, "documents"))
    taken = mixed.groupBy("row").agg(F.sum("words").alias("taken"))
    return rows.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS words, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM d GROUP BY source),
w AS (SELECT *, CASE number % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY words * 2.0 / weight, number) AS i FROM w),
levels AS (
  SELECT i, words, weight, 3 * sum(words) OVER () - 4 * coalesce(sum(words) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS num,
    2 * sum(weight) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS den FROM o
), level AS (SELECT num, den FROM levels WHERE num * weight <= 2 * words * den ORDER BY i LIMIT 1),
t AS (
  SELECT source, words, CASE WHEN 2 * words * den < num * weight THEN CAST(2 * words AS DOUBLE) ELSE CAST(num * weight AS DOUBLE) / CAST(den AS DOUBLE) END AS target,
    CASE WHEN 2 * words * den < num * weight THEN 2 * words ELSE (num * weight) // den END AS quota FROM o, level
), p AS (
  SELECT d.doc_id, d.size, t.words, t.target, t.quota, pass, pass * t.words + coalesce(sum(d.size) OVER (
    PARTITION BY d.source, pass ORDER BY md5(concat('mix-', pass, '-', d.doc_id)), d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source, range(2) AS r(pass)
)
SELECT doc_id, size, words AS source_size, target, CAST(sum(greatest(0, least(start + size, quota) - start)) AS BIGINT) AS taken
FROM p GROUP BY doc_id, size, words, target
"""
