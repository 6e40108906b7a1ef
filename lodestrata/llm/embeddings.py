"""Near-duplicate vectors by PCA-ordered tiles.

Equal vectors of a label are one class with a count.  Classes are ordered within their label by the
leading principal coordinate of their unit vectors, and where a slab of that order holds too many by the next, and
cut into blocks of about ``BLOCK``; two blocks meet only if their boxes in the ``LEADS`` leading coordinates are so
close that a cosine of the threshold is possible.  A tile accumulates
the products of the leading coordinates first; by Cauchy-Schwarz the rest of a product is at most the
product of the two suffix norms, so a pair stops where leading product plus bound stays below the
threshold.  Pairs that reach the end are decided by the cosine of the stored vectors in double precision.

A tile reports, per class, how many vectors it links with, and a spanning forest of its links: linear in
the block, however many pairs are linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .components import connected_components

THRESHOLD, BLOCK, STEP = 0.98, 1024, 8
#: Tasks whose moment matrices are summed before they reach the driver, and dimensions with a basis of their own.
SUM_LOTS, BASES = 32, 16
#: Leading coordinates that bound a block, and cuts of an order by approximate percentiles.
LEADS, CUTS = 3, 256
#: Slack of the pruning bounds against rounding; the last test has none.
SLACK = 1e-9


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """In double precision, times a power of two so that no square over- or underflows: exact, and no cosine changes."""
    v = vectors.astype(np.float64)
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, initial=0, keepdims=True))[1])


def _unit(vectors: np.ndarray) -> np.ndarray:
    v = _scaled(vectors)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyspark import TaskContext

    sums: dict[int, list] = {}
    for frame in frames:
        for dim, part in frame.groupby("dim"):
            if dim > 4096:
                continue
            u = _unit(np.stack(part["embedding"].to_list()))
            held = sums.setdefault(int(dim), [np.zeros((int(dim), int(dim))), 0])
            held[0] += u.T @ u
            held[1] += len(u)
    lot = TaskContext.get().partitionId() % SUM_LOTS
    yield pd.DataFrame([(d, lot, n, m.tobytes()) for d, (m, n) in sums.items()], columns=["dim", "lot", "n", "moment"])


def _sum_moments(frame: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(m) for m in frame["moment"])
    return pd.DataFrame({"dim": frame["dim"][:1], "n": [int(frame["n"].sum())], "moment": [total.tobytes()]})


def principal_bases(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Per dimension an orthogonal basis, the directions of largest second moment first, over all vectors.

    ``vectors`` has ``dim`` and ``embedding``.  The most frequent dimensions get one, the others none: the
    bounds hold in any basis.
    """
    partial = vectors.mapInPandas(_moments, "dim long, lot long, n long, moment binary")
    rows = partial.groupBy("dim", "lot").applyInPandas(_sum_moments, "dim long, n long, moment binary")
    top = [r.dim for r in rows.groupBy("dim").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "dim").limit(BASES).collect()] if rows.columns else []
    found: dict[int, np.ndarray] = {}
    for r in rows.where(F.col("dim").isin(top)).collect() if top else []:
        found[r.dim] = found.get(r.dim, 0) + np.frombuffer(r.moment).reshape(r.dim, r.dim)
    return {d: np.linalg.eigh(m)[1][:, ::-1].copy() for d, m in found.items()}


def _turn(unit: np.ndarray, bases: dict[int, np.ndarray]) -> np.ndarray:
    basis = bases.get(unit.shape[1])
    return unit if basis is None else unit @ basis


def tile_links(a: np.ndarray, b: np.ndarray, bases: dict[int, np.ndarray], threshold: float, same: bool, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (into ``a`` and ``b``, vectors as stored) whose cosine reaches the threshold; i < j if ``same``."""
    ua, ub = _unit(a), _unit(b)
    x, y = _turn(ua, bases), _turn(ub, bases)
    dims = x.shape[1]
    tails = [(np.sqrt(np.maximum(0, np.einsum("ij,ij->i", v, v)[:, None] - np.cumsum(v * v, axis=1)))) for v in (x, y)]
    at = min(step, dims)
    acc = x[:, :at] @ y[:, :at].T
    keep = acc + tails[0][:, at - 1, None] * tails[1][None, :, at - 1] >= threshold - SLACK
    if same:
        keep &= np.triu(np.ones(keep.shape, bool), 1)
    i, j = np.nonzero(keep)
    acc = acc[i, j]
    while at < dims and len(i):
        more = min(at + step, dims)
        for lo in range(0, len(i), 1 << 16):
            s = slice(lo, lo + (1 << 16))
            acc[s] += np.einsum("ij,ij->i", x[i[s], at:more], y[j[s], at:more])
        at = more
        live = acc + tails[0][i, at - 1] * tails[1][j, at - 1] >= threshold - SLACK
        i, j, acc = i[live], j[live], acc[live]
    va, vb = _scaled(a), _scaled(b)
    na, nb = (np.sqrt(np.einsum("ij,ij->i", v, v)) for v in (va, vb))
    sure = np.zeros(len(i), bool)
    for lo in range(0, len(i), 1 << 16):
        s = slice(lo, lo + (1 << 16))
        sure[s] = np.einsum("ij,ij->i", va[i[s]], vb[j[s]]) / (na[i[s]] * nb[j[s]]) >= threshold
    return i[sure], j[sure]


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node of its component) that span the components of the links u-v."""
    nodes, both = np.unique(np.concatenate([u, v]), return_inverse=True)
    p, q = both[: len(u)], both[len(u) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        np.minimum.at(label, p, before[q])
        np.minimum.at(label, q, label[p])
        label = label[label]
        if (label == before).all():
            break
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def _tiles(bases: dict[int, np.ndarray], threshold: float, kind: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                dim = int(r.dim)
                a, b = (np.frombuffer(x, kind).reshape(-1, dim) for x in (r.vectors_a, r.vectors_b))
                ra, rb = np.frombuffer(r.reps_a, "<i8"), np.frombuffer(r.reps_b, "<i8")
                ca, cb = np.frombuffer(r.counts_a, "<i8"), np.frombuffer(r.counts_b, "<i8")
                i, j = tile_links(a, b, bases, threshold, r.block_a == r.block_b)
                if not len(i):
                    continue
                own = pd.DataFrame({"u": np.concatenate([ra[i], rb[j]]), "links": np.concatenate([cb[j], ca[i]])}).groupby("u", as_index=False)["links"].sum()
                yield own.assign(v=pd.Series([None] * len(own), dtype="Int64"))[["u", "v", "links"]]
                node, root = _forest(ra[i], rb[j])
                yield pd.DataFrame({"u": node, "v": pd.Series(root).astype("Int64"), "links": 0})

    return run


def _leading(bases: dict[int, np.ndarray], kind: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lead = np.zeros((len(frame), LEADS))
            for dim, at in frame.groupby("dim").indices.items():
                k = min(int(dim), LEADS)
                lead[at, :k] = _turn(_unit(np.stack(frame["embedding"].iloc[at].to_list())), bases)[:, :k]
            yield frame[["label", "dim", "rep", "n"]].assign(**{f"lead{k}": lead[:, k] for k in range(LEADS)}, vector=[np.asarray(e, kind).tobytes() for e in frame["embedding"]])

    return run


def _block(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("rep")
    one = frame.iloc[:1]
    return pd.DataFrame({
        "label": one["label"], "dim": one["dim"], "block": one["block"], **{f"{end}{k}": [getattr(frame[f"lead{k}"], f)()] for k in range(LEADS) for end, f in (("lo", "min"), ("hi", "max"))},
        "reps": [frame["rep"].to_numpy().astype("<i8").tobytes()], "counts": [frame["n"].to_numpy().astype("<i8").tobytes()], "vectors": [b"".join(frame["vector"])],
    })


def _binned(rows: DataFrame, group: list[str], lead: str, wanted: F.Column, name: str) -> DataFrame:
    """Add ``name``: the place of each row in its group by ``lead``, in as many ranges of about equal counts as ``wanted``
    says of the group's ``total`` rows, ``CUTS`` at most."""
    grid = [k / CUTS for k in range(1, CUTS)]
    cuts = rows.groupBy(*group).agg(F.count("*").alias("total"), F.percentile_approx(lead, grid, 2000).alias("cuts"))
    fine = F.size(F.filter("cuts", lambda c: c < F.col(lead)))
    parts = F.greatest(F.lit(1), F.least(wanted, F.lit(CUTS)))
    return rows.join(cuts, group).withColumn(name, F.floor(fine * parts / CUTS)).drop("total", "cuts")


def near_duplicate_vectors(table: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Per vector ``vec_id, n_links, component_id, kept``; vectors are compared within their label only.

    A null label, a null or empty vector, null or non-finite components and the zero vector link with
    nothing, nor do rows without a vec_id (they stay, with a null component_id).  Vectors of different
    lengths never link.  Repeated rows count as other vectors, and so do rows that share a vec_id with different vectors.  Vectors are compared as they are stored, floats or
    doubles.  Other columns are ignored; an empty table gives no rows.
    """
    spark = table.sparkSession
    e = F.col("embedding")
    sound = (
        F.col("label").isNotNull() & F.col("vec_id").isNotNull() & e.isNotNull() & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0)
    )
    stored, number = ("<f4", "float") if dict(table.dtypes)["embedding"] == "array<float>" else ("<f8", "double")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), "label", e.cast(f"array<{number}>").alias("embedding"), F.coalesce(sound, F.lit(False)).alias("sound"))
    rows = rows.withColumns({"h1": F.when(F.col("sound"), F.xxhash64("embedding")), "h2": F.when(F.col("sound"), F.xxhash64(F.lit(1), "embedding"))})
    mine: list[DataFrame] = []

    def keep(frame: DataFrame, what: str) -> DataFrame:
        mine.append(store.materialize(frame, what))
        return mine[-1]

    # A class has a number of its own, fixed by the table that is written, whatever ids its vectors have.
    classes = rows.where("sound").groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))
    classes = keep(classes.withColumns({"dim": F.size("embedding").cast("long"), "rep": F.monotonically_increasing_id()}), "vectors")
    bases = principal_bases(classes.select("dim", "embedding"))

    kind = dict(classes.dtypes)["label"]
    leads = [f"lead{k}" for k in range(LEADS)]
    led = keep(classes.select("label", "dim", "rep", "n", "embedding").mapInPandas(_leading(bases, stored), f"label {kind}, dim long, rep long, n long, {', '.join(f'{c} double' for c in leads)}, vector binary"), "led")
    slabs = keep(_binned(led, ["label", "dim"], "lead0", F.ceil(F.sqrt(F.col("total") / block)), "slab"), "slabs")
    rows_of = ["label", "dim", "slab"]
    bars = keep(_binned(slabs, rows_of, "lead1", F.ceil(F.col("total") / block), "bar"), "bars")
    sizes = bars.groupBy(*rows_of, "bar").agg(F.ceil(F.count("*") / block).alias("subs"))
    place = F.shiftleft(F.col("slab").cast("long") * CUTS + F.col("bar"), 40) + F.pmod(F.xxhash64("rep"), F.col("subs"))
    laid = bars.join(sizes, [*rows_of, "bar"]).withColumn("block", place).drop("slab", "bar", "subs")
    ends = [f"{end}{k}" for k in range(LEADS) for end in ("lo", "hi")]
    blocks = keep(
        laid.groupBy("label", "dim", "block").applyInPandas(_block, f"label {kind}, dim long, block long, {', '.join(f'{c} double' for c in ends)}, reps binary, counts binary, vectors binary"), "blocks"
    )

    gap = 2 - 2 * threshold + 1e-6
    meta = blocks.select("label", "dim", "block", *ends)
    apart = " + ".join(f"pow(greatest(0, a.lo{k} - b.hi{k}, b.lo{k} - a.hi{k}), 2)" for k in range(LEADS))
    near = meta.alias("a").join(meta.alias("b"), ["label", "dim"]).where(f"a.block <= b.block and {apart} <= {gap!r}")
    near = near.select("label", "dim", F.col("a.block").alias("block_a"), F.col("b.block").alias("block_b"))

    def side(s: str) -> DataFrame:
        return blocks.select("label", "dim", F.col("block").alias(f"block_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in ("reps", "counts", "vectors")))

    tiles = near.join(side("a"), ["label", "dim", "block_a"]).join(side("b"), ["label", "dim", "block_b"])
    with store.batches_of(spark, 16):  # a row is two whole blocks
        found = keep(tiles.mapInPandas(_tiles(bases, threshold, stored), "u long, v long, links long"), "tiles")

    counts = found.where("v is null").groupBy("u").agg(F.sum("links").alias("links"))
    stars = connected_components(found.where("v is not null").select("u", "v"))
    mine.append(stars)
    components = keep(stars, "components")
    named = classes.select("label", "h1", "h2", "rep", "least", "n").join(counts, F.col("rep") == F.col("u"), "left").join(components, F.col("rep") == F.col("node"), "left")
    named = keep(named.select("label", "h1", "h2", "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component"), "named")
    first = named.where("component is not null").groupBy("component").agg(F.min("least").alias("of_all"))
    named = named.join(first, "component", "left").select("label", "h1", "h2", "n_links", F.coalesce("of_all", "least").alias("first"))
    out = (
        rows.select("vec_id", "label", "h1", "h2")
        .join(named, ["label", "h1", "h2"], "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("first", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
    out = store.materialize(out, "near-vectors")
    for frame in mine:
        store.release(frame)
    return out


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all vectors of a label."""
    return near_duplicate_vectors(store.spark_table(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH RECURSIVE s AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM s a JOIN s b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98
), reach(u, v) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
least_of AS (SELECT u, min(v) AS m FROM reach GROUP BY u), n AS (SELECT u, count(*) AS k FROM links GROUP BY u)
SELECT x.vec_id, CAST(coalesce(n.k, 0) AS BIGINT) AS n_links, l.m AS component_id, x.vec_id = l.m AS kept
FROM embeddings x JOIN least_of l ON l.u = x.vec_id LEFT JOIN n ON n.u = x.vec_id
"""
