"""Product codes of vectors by delta-maintained Lloyd.

Vectors become integers and are cut into parts; each part position has a codebook, and a vector's code names the
nearest entry of each.  A round writes every vector with its previous and its new assignment to the shared folder.
The running sums and counts of the entries (integers, so that no order of adding matters) are then brought up to date
by what changed: a part that left an entry counts minus there and plus where it went, and parts that stayed are not
looked at.  Tasks add their contributions up before they are shuffled, so a round moves at most one number per entry
and component out of a task, and the driver holds one codebook: 64 entries times the length of a vector.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import keyed, store

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components are held at this magnitude (an input of 65536): squares of differences, summed over up to 8192
#: components, then stay within 63 bits.
MOST = 1 << 24
#: Rows of vectors that a Python worker receives at once.
ROWS = 4096

_FINITE = "embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) <> double('infinity'))"
_STATE = "vec_id long, label string, q array<int>, before binary, code binary, error long"


def quantise(values: np.ndarray) -> np.ndarray:
    """``floor(256 x)`` as integers, at most :data:`MOST` in magnitude."""
    return np.clip(np.floor(values.astype(np.float64) * SCALE), -MOST, MOST).astype(np.int64)


def cut(vectors: np.ndarray, parts: int = PARTS) -> np.ndarray:
    """Rows cut into ``parts`` equal consecutive parts; zeros fill up a length that ``parts`` does not divide."""
    n, dim = vectors.shape
    wide = -(-dim // parts) * parts
    if wide > dim:
        vectors = np.hstack([vectors, np.zeros((n, wide - dim), vectors.dtype)])
    return vectors.reshape(n, parts, wide // parts)


def nearest(pieces: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each part (ties: the lowest) and the squared distances summed over parts."""
    n, parts, width = pieces.shape
    code, error = np.zeros((n, parts), np.uint8), np.zeros(n, np.int64)
    for p in range(parts):
        far = np.zeros((n, books.shape[1]), np.int64)
        for j in range(width):
            d = pieces[:, p, j, None] - books[p, None, :, j]
            far += d * d
        at = far.argmin(axis=1)
        code[:, p] = at
        error += far[np.arange(n), at]
    return code, error


def _codes(column: pa.Array, parts: int) -> np.ndarray | None:
    """The codes of a batch as rows of bytes; None before the first assignment."""
    return None if column.null_count else np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, parts)


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _assign(dim: int, books: np.ndarray, fresh: bool):
    """Batches of state with new codes; from vectors as stored if ``fresh``, else from the integers of the round before."""
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("q", pa.list_(pa.int32())), ("before", pa.binary()), ("code", pa.binary()), ("error", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            q = quantise(_vectors(batch.column("embedding"), dim)) if fresh else _vectors(batch.column("q"), dim).astype(np.int64)
            code, error = nearest(cut(q), books)
            ends = pa.array(np.arange(0, (n + 1) * dim, dim, np.int32) if dim else np.zeros(n + 1, np.int32))
            lists = pa.ListArray.from_arrays(ends, pa.array(q.astype(np.int32).ravel(), pa.int32()))
            before = pa.nulls(n, pa.binary()) if fresh else batch.column("code")
            new = pa.array([row.tobytes() for row in code], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), lists, before, new, pa.array(error)], schema=schema)

    return run


def _changes(dim: int, entries: int):
    """What a task's changed parts add to and take from the entries: ``part, entry, place, amount``.

    Place -1 is the count, the others are components.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = -(-dim // PARTS)
        sums, counts = np.zeros((PARTS, entries, width), np.int64), np.zeros((PARTS, entries), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            pieces = cut(_vectors(batch.column("q"), dim).astype(np.int64))
            new, old = _codes(batch.column("code"), PARTS), _codes(batch.column("before"), PARTS)
            for p in range(PARTS):
                moved = slice(None) if old is None else np.flatnonzero(new[:, p] != old[:, p])
                for sign, code in ((1, new), (-1, old)):
                    if code is not None:
                        np.add.at(sums[p], code[moved, p], sign * pieces[moved, p])
                        np.add.at(counts[p], code[moved, p], sign)
        all_ = np.concatenate([counts[:, :, None], sums], axis=2)
        part, entry, place = np.nonzero(all_)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(place - 1), pa.array(all_[part, entry, place])], ["part", "entry", "place", "amount"])

    return run


class Codebooks:
    """Entries of each part position with the running sums and counts of the parts assigned to them."""

    def __init__(self, seeds: np.ndarray):
        self.entries = cut(seeds).transpose(1, 0, 2).copy()
        self.sums = np.zeros_like(self.entries)
        self.counts = np.zeros(self.entries.shape[:2], np.int64)

    def apply(self, changes: list) -> None:
        """Bring sums and counts up to date and put each used entry at the floor of its mean."""
        for c in changes:
            if c.place < 0:
                self.counts[c.part, c.entry] += c.amount
            else:
                self.sums[c.part, c.entry, c.place] += c.amount
        used = self.counts > 0
        self.entries[used] = self.sums[used] // self.counts[used][:, None]

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every row of ``vectors`` with a vector to encode.

    ``vectors`` has vec_id, embedding and label; other columns do not matter.  Rows whose vector is null or holds null
    or non-finite components are dropped.  Codebooks start from the rows with the 64 smallest vec_ids (null ids last,
    rows of one id by their vectors); fewer rows make fewer entries, and equal ones lose ties to the first of them.
    All vectors are of the length of the very first of these; a row of another length has a null code and error and
    counts for nothing.  A length that 16 does not divide is filled up with zeros, components beyond 65536 count as
    that.  Null labels are one label.  Repeated rows are rows of their own; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    label = F.when(F.col("label").isNotNull(), F.col("label").cast("string"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), "embedding").where(_FINITE)
    order = (F.col("vec_id").asc_nulls_last(), "embedding")
    first = rows.orderBy(*order).select(F.size("embedding").alias("dim")).limit(1).collect()
    dim = first[0].dim if first else 0
    fit = F.size("embedding") == dim
    seeds = [r.embedding for r in rows.where(fit).orderBy(*order).select("embedding").limit(ENTRIES).collect()]
    books = Codebooks(quantise(np.asarray(seeds, np.float64).reshape(len(seeds), dim)))
    size = books.entries.shape[1]
    state, old = rows.where(fit), None
    with store.batches_of(spark, ROWS):
        for k in range(rounds):
            state = store.materialize(state.mapInArrow(_assign(dim, books.entries.copy(), k == 0), _STATE), "codes")
            if old is not None:
                store.release(old)
            old = state
            moved = state if k == 0 else state.where("before <> code")
            changed = moved.select("q", "before", "code").mapInArrow(_changes(dim, size), "part long, entry long, place long, amount long")
            books.apply(changed.groupBy("part", "entry", "place").agg(F.sum("amount").alias("amount")).collect())
        last = state.mapInArrow(_assign(dim, books.entries.copy(), rounds == 0), _STATE).select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error")
        odd = rows.where(~fit).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
        coded = store.materialize(last.unionAll(odd), "codes")
    if old is not None:
        store.release(old)
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    out = keyed.attach(coded, totals, "label")
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors after two rounds."""
    return compress(store.spark_table(spark, sf_dir, "embeddings"))


def _sql_round(k: int) -> str:
    """Assignment and the next entries, from nothing: no running sums."""
    return f"""
a{k} AS (
  SELECT row, part, arg_min(e.entry, d * 64 + e.entry) AS entry, min(d) AS d FROM (
    SELECT p.row, p.part, e.entry, list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - e.v[i]) * (p.v[i] - e.v[i]))) AS d
    FROM parts p JOIN b{k} e ON e.part = p.part) AS e GROUP BY row, part
)"""


def _sql_books(k: int) -> str:
    return f"""
m{k} AS (
  SELECT part, entry, j, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM (
    SELECT a.part, a.entry, unnest(range(1, len(p.v) + 1)) AS j, unnest(p.v) AS x FROM a{k - 1} a JOIN parts p ON p.row = a.row AND p.part = a.part) AS s
  GROUP BY part, entry, j
), n{k} AS (SELECT part, entry, list(x ORDER BY j) AS v FROM m{k} GROUP BY part, entry),
b{k} AS (SELECT b.part, b.entry, coalesce(n.v, b.v) AS v FROM b{k - 1} b LEFT JOIN n{k} n ON n.part = b.part AND n.entry = b.entry)"""


OP13_SQL = (
    """
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT row, part, v[part * (len(v) // 16) + 1 : (part + 1) * (len(v) // 16)] AS v FROM kept, range(16) AS r(part)
), b0 AS (SELECT part, row - 1 AS entry, v FROM parts WHERE row <= 64),"""
    + ",".join([_sql_round(0), _sql_books(1), _sql_round(1), _sql_books(2), _sql_round(2)])
    + """,
codes AS (SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY row),
numbers AS (SELECT part, entry, unnest(range(1, len(v) + 1)) AS j, unnest(v) AS x FROM b2),
digest AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, j)) AS h FROM numbers)
SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM kept k JOIN codes c ON c.row = k.row, digest
"""
)
