"""Near-duplicate texts: universal hash minima, banding, signature verification, components.

1. Every document becomes its set of distinct 5-word shingles; documents of equal sets are one class, which has a
   number of its own, whatever ids its documents have.
2. A class has ``BANDS * ROWS`` hash minima.  At similarity 0.75 a pair shares no band with a chance of
   (1 - 0.75**4)**32 = 5e-6.
3. In each bucket of a band every class is compared with the bucket's first class (a star, so a bucket of
   n classes costs n - 1 comparisons): first the signatures, then the full sets.  Only confirmed links stay.
4. Components of these links.  A bucket all of whose classes fell into one component is done.  In any
   other bucket the signatures of every class outside its largest component are compared with those of all
   classes of the other components, in blocks of bounded size, each pair in the first band that it shares; the
   classes of a block that agree with some other get their sets, and the sets decide, so that no link is lost
   that a star missed.
5. Components of all links.

Hot groups: copies collapse before anything is paired; buckets are reduced by a partial minimum; blocks
are dealt by (bucket, block, block).  No list of links or documents reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .components import connected_components
from .shingles import WORDS, MinWise, set_key, shared, shingle_set

BANDS, ROWS = 32, 4
#: Links: 100 * intersection >= 75 * union.
PERCENT = 75
#: Pairs whose signatures agree on less than this share go no further: 5.7 standard deviations below 0.75.
SURE_SHARE = 0.53
#: Classes of a bucket compared in one task, and pairs with both their sets that a worker receives at once.
BLOCK, PAIR_ROWS = 512, 128
#: Ids of candidate classes are broadcast up to this many (8 bytes each), else joined.
BROADCAST_IDS = 2_000_000
#: Components of more classes than this are hot, and of more than the table's share of this many, so there are never more of them.
HOT_CLASSES, MOST_HOT = 1000, 500_000


def _signatures(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    minima = MinWise(BANDS * ROWS)
    for frame in frames:
        ns, keys, sigs = [], [], []
        for text in frame["text"]:
            s = shingle_set(text)
            ns.append(len(s))
            keys.append(set_key(s) if len(s) else None)
            sigs.append(minima(s).tobytes() if len(s) else None)
        yield frame[["doc_id", "h1", "h2"]].astype({"doc_id": "Int64"}).assign(n_shingles=ns, set_key=keys, signature=sigs)


def _sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    minima = MinWise(BANDS * ROWS)
    for frame in frames:
        rows = []
        for text in frame["text"]:
            s = shingle_set(text)
            if len(s):
                rows.append((set_key(s), s.astype("<u8").tobytes(), minima(s).tobytes()))
        yield pd.DataFrame(rows, columns=["set_key", "shingles", "signature"])


def alike(sig_a: bytes, sig_b: bytes) -> bool:
    return np.count_nonzero(np.frombuffer(sig_a, "<u4") == np.frombuffer(sig_b, "<u4")) >= SURE_SHARE * BANDS * ROWS


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """The exact test on full sets."""
    low, high = sorted((len(a), len(b)))
    if 100 * low < PERCENT * high:
        return False
    both = shared(a, b)
    return 100 * both >= PERCENT * (low + high - both)


def _confirm(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = [
            (u, v)
            for u, v, sa, sb, a, b in zip(frame["u"], frame["v"], frame["sig_a"], frame["sig_b"], frame["set_a"], frame["set_b"], strict=True)
            if alike(sa, sb) and linked(np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8"))
        ]
        yield pd.DataFrame(rows, columns=["u", "v"], dtype="int64")


def _candidates(probes: pd.DataFrame, others: pd.DataFrame) -> Iterator[np.ndarray]:
    """Per probe the places of those others of another component whose signatures agree, if this is the first band the
    two share; a pair of two probes is seen from the one of lower number."""
    if not len(others):
        return
    theirs = np.stack([np.frombuffer(x, "<u4") for x in others["signature"]])
    turned = np.ascontiguousarray(theirs.T)
    comps, nodes, free = (others[c].to_numpy() for c in ("component", "node", "main"))
    for c, u, band, sig in zip(probes["component"], probes["node"], probes["band"], probes["signature"], strict=True):
        mine = np.frombuffer(sig, "<u4")
        agree = (turned == mine[:, None]).sum(axis=0, dtype=np.uint8)
        near = np.flatnonzero((agree >= SURE_SHARE * BANDS * ROWS) & (comps != c) & (free | (nodes > u)))
        if len(near):
            same = (theirs[near] == mine).reshape(len(near), BANDS, ROWS).all(axis=2)
            near = near[same.argmax(axis=1) == band]
        yield near


def _agreeing(frame: pd.DataFrame) -> pd.DataFrame:
    """The classes in one block of a mixed bucket whose signatures agree with some class's of another component."""
    probes, others = frame[frame["probe"]], frame[~frame["probe"]]
    mine, theirs = np.zeros(len(probes), bool), np.zeros(len(others), bool)
    for i, near in enumerate(_candidates(probes, others)):
        mine[i] = len(near)
        theirs[near] = True
    return pd.concat([probes[mine], others[theirs]])


def _cross(frame: pd.DataFrame) -> pd.DataFrame:
    """Links between components in one block of a mixed bucket; one per pair of components is enough."""
    probes, others = frame[frame["probe"]], frame[~frame["probe"]]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    rows = []
    comps, ids, sets = others["component"].to_numpy(), others["node"].to_numpy(), others["shingles"].to_list()
    for c, u, s, near in zip(probes["component"], probes["node"], probes["shingles"], _candidates(probes, others), strict=False):
        mine = np.frombuffer(s, "<u8")
        for k in near.tolist():
            if find(int(c)) != find(int(comps[k])) and linked(mine, np.frombuffer(sets[k], "<u8")):
                root[find(int(c))] = find(int(comps[k]))
                rows.append((int(u), int(ids[k])))
    return pd.DataFrame(rows, columns=["u", "v"], dtype="int64")


_BLOCK_KEY = ["bucket", "block", "probe_block"]


def _per_block(run, columns: list[str]):
    """``run`` over the rows of each block, which come one after the other."""

    def stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            key = frame[_BLOCK_KEY].to_numpy()
            ends = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            starts = [0, *ends.tolist()]
            found = [run(frame.iloc[a:b])[columns] for a, b in zip(starts, ends.tolist())]
            if found:
                yield pd.concat(found)
            held = frame.iloc[starts[-1] :]
        if held is not None and len(held):
            yield run(held)[columns]

    return stream


def _by_block(rows: DataFrame, run, schema: str) -> DataFrame:
    columns = [c.split()[0] for c in schema.split(", ")]
    return rows.repartition(*_BLOCK_KEY).sortWithinPartitions(*_BLOCK_KEY).mapInPandas(_per_block(run, columns), schema)


def _grouped(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` its doc_id, two hashes of its text, n_shingles and, unless doc_id is null or the set empty,
    the least (doc_id, hash, hash) in its component, ``first``."""
    spark = docs.sparkSession
    mine: list[DataFrame] = []

    def keep(table: DataFrame, what: str) -> DataFrame:
        mine.append(store.materialize(table, what))
        return mine[-1]

    def grouped(links: DataFrame) -> DataFrame:
        found = connected_components(links)
        mine.append(found)
        return keep(found, "components")

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    with store.batches_of(spark, store.TEXT_ROWS):
        marked = keep(store.map_frames(rows, _signatures, "doc_id long, h1 long, h2 long, n_shingles long, set_key binary, signature binary"), "signatures")
    usable = marked.where("doc_id is not null and set_key is not null")
    # The numbers of classes are fixed by the table that is written.
    classes = keep(usable.groupBy("set_key").agg(F.min(F.struct("doc_id", "h1", "h2")).alias("first"), F.first("signature").alias("signature")).withColumn("node", F.monotonically_increasing_id()), "classes")

    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring("signature", b * (4 * ROWS) + 1, F.lit(4 * ROWS))))
    buckets = classes.select("node", F.col("first.doc_id").alias("least"), "set_key", F.posexplode(bands).alias("band", "bucket"))
    hubs = buckets.groupBy("bucket").agg(F.min(F.struct("node", "set_key")).alias("hub"), F.count("*").alias("n")).where("n > 1")
    shared_buckets = keep(buckets.join(hubs, "bucket").select("bucket", "band", "n", "node", "least", "set_key", F.col("hub.node").alias("hub_node"), F.col("hub.set_key").alias("hub_key")), "buckets")

    star = shared_buckets.where("node <> hub_node").select("node", "set_key", "hub_node", "hub_key").distinct()
    wanted = shared_buckets.select(F.col("least").alias("doc_id")).distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    with store.batches_of(spark, store.TEXT_ROWS):
        sets = keep(rows.join(wanted, "doc_id", "left_semi").select("text").mapInPandas(_sets, "set_key binary, shingles binary, signature binary"), "sets")
    if sets.count() > sets.agg(F.count_distinct("set_key")).first()[0]:  # rows that share an id
        sets = keep(sets.dropDuplicates(["set_key"]), "sets")

    def of(key: str, suffix: str) -> DataFrame:
        return sets.select(F.col("set_key").alias(key), F.col("shingles").alias(f"set_{suffix}"), F.col("signature").alias(f"sig_{suffix}"))

    pairs = star.join(of("set_key", "a"), "set_key").join(of("hub_key", "b"), "hub_key").select(F.col("node").alias("u"), F.col("hub_node").alias("v"), "sig_a", "sig_b", "set_a", "set_b")
    with store.batches_of(spark, PAIR_ROWS):
        links = keep(pairs.mapInPandas(_confirm, "u long, v long"), "links")
    first = grouped(links)

    extra = _missed(shared_buckets, classes, sets, first, keep)
    if extra.limit(1).count():
        first = grouped(first.select(F.col("node").alias("u"), F.col("component").alias("v")).unionAll(extra))

    parts = classes.select("set_key", "first", "node").join(first, "node", "left").select("set_key", "first", F.coalesce("component", "node").alias("part"))
    parts = keep(parts, "parts")
    several = keep(parts.groupBy("part").agg(F.min("first").alias("of_all"), F.count("*").alias("n")).where("n > 1"), "several")
    # The classes of a hot component get its first document by broadcast and then go by a number of their own.
    most = max(HOT_CLASSES, parts.count() // MOST_HOT)
    hot = several.where(F.col("n") > most).select("part", F.col("of_all").alias("of_hot"))
    own = F.lit(-1) - F.pmod(F.xxhash64("set_key"), F.lit(1 << 62))
    parts = parts.join(F.broadcast(hot), "part", "left").withColumn("part", F.when(F.col("of_hot").isNull(), F.col("part")).otherwise(own))
    parts = parts.join(several.where(F.col("n") <= most).select("part", "of_all"), "part", "left").select("set_key", F.coalesce("of_hot", "of_all", "first").alias("first"))
    found = marked.select("doc_id", "h1", "h2", "n_shingles", "set_key").join(parts, "set_key", "left")
    found = store.materialize(found.select("doc_id", "h1", "h2", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("first")).alias("first")), "grouped")
    for table in mine:
        store.release(table)
    return found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` ``doc_id, n_shingles, component_id, kept``.

    A null, empty or blank text has no shingles and links with nothing.  Rows without a doc_id link with
    nothing and are kept, with a null component_id.  Rows that share a doc_id are documents of their own: each gets
    the smallest doc_id that its own text reaches.  Other columns are ignored; an empty table gives no rows.
    """
    component = F.coalesce("first.doc_id", "doc_id")
    return _grouped(docs).select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _missed(shared_buckets: DataFrame, classes: DataFrame, sets: DataFrame, components: DataFrame, keep) -> DataFrame:
    """Links between components that still share a bucket."""
    members = shared_buckets.select("bucket", "band", "node", "set_key").join(components, "node", "left").select("bucket", "band", "node", "set_key", F.coalesce("component", "node").alias("component"))
    parts = members.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("bucket").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("most")).where("parts > 1")
    held = members.join(mixed.select("bucket", "n", F.col("most.component").alias("largest"), F.col("most.n").alias("main_n")), "bucket")
    held = held.withColumns({
        "main": F.col("component") == F.col("largest"),
        "blocks": F.ceil(F.col("n") / BLOCK),
        "probe_blocks": F.ceil((F.col("n") - F.col("main_n")) / BLOCK),
    })
    held = keep(held.join(classes.select("node", "signature"), "node"), "mixed")
    lot, same = F.xxhash64("set_key"), ("bucket", "band", "node", "set_key", "component", "main", "signature")
    roles = held.select(*same, F.lit(False).alias("probe"), F.pmod(lot, "blocks").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("probe_blocks") - 1)).alias("probe_block")).unionAll(
        held.where("not main").select(*same, F.lit(True).alias("probe"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.pmod(lot, "probe_blocks").alias("probe_block"))
    )
    near = keep(_by_block(roles, _agreeing, "bucket long, block long, probe_block long, band int, node long, set_key binary, component long, main boolean, probe boolean"), "agreeing")
    with store.batches_of(sets.sparkSession, PAIR_ROWS):
        return keep(_by_block(near.join(sets, "set_key"), _cross, "u long, v long").distinct(), "cross-links")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, without near duplicates: of each group the row of least doc_id stays.

    Rows that share a doc_id are told apart by their texts (two 64-bit hashes of them); of rows that share both, one
    stays if it is the group's, else none.  Rows with a null doc_id and rows without a word link with nothing: all stay.
    """
    found = _grouped(docs).where("first is not null").select(F.struct("doc_id", "h1", "h2").alias("key"), "first")
    gone = store.materialize(found.where("key <> first").select("key").distinct(), "gone")
    again = store.materialize(found.where("key = first").groupBy("key").count().where("count > 1").select("key"), "again")
    few = gone.count() <= BROADCAST_IDS // 4 and again.count() <= BROADCAST_IDS // 4
    gone, again = (F.broadcast(gone), F.broadcast(again)) if few else (gone, again)
    key, order = store.free_name(docs.columns, "key"), store.free_name(docs.columns, "order")
    keyed = docs.withColumn(key, F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")))
    kept = keyed.join(gone.select(F.col("key").alias(key)), key, "left_anti")
    again = again.select(F.col("key").alias(key))
    if not again.limit(1).count():
        return kept.select(*docs.columns)
    hashed = F.xxhash64(*(F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t and t != "variant"))
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    one = kept.join(again, key, "left_semi").groupBy(key).agg(F.min_by(own, hashed).alias(order)).select(f"{order}.*")
    return kept.join(again, key, "left_anti").select(*docs.columns).unionAll(one)


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents."""
    return near_duplicates(store.spark_table(spark, sf_dir, "documents"))


#: The same by brute force in SQL: shared shingles of all pairs, components by recursion.
OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w
), n AS (SELECT doc_id, len(sh) AS k FROM s), e AS (SELECT doc_id, unnest(sh) AS g FROM s),
links AS (
  SELECT p.u, p.v FROM (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2) p
  JOIN n x ON x.doc_id = p.u JOIN n y ON y.doc_id = p.v WHERE 100 * p.c >= 75 * (x.k + y.k - p.c)
), reach(u, v) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
least_of AS (SELECT u, min(v) AS m FROM reach GROUP BY u)
SELECT n.doc_id, CAST(n.k AS BIGINT) AS n_shingles, m AS component_id, n.doc_id = m AS kept FROM n JOIN least_of ON n.doc_id = u
"""
