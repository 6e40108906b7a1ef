"""Phrase collocations by Apriori, level by level.

Level one counts words.  For level k the phrases of k - 1 words that are frequent are sent to every task, and a task
emits a phrase of k words only where both its phrases of k - 1 words are among them.  What is sent is a table of bits,
one per hash value: its size follows the number of frequent phrases up to :data:`MOST_BITS` and no further.  Two
phrases that share a bit can only make a task emit what the count then drops (a phrase is never more frequent than its
parts), so results are exact at every size, and a table that is too full merely prunes less.

Tasks count before they emit.  A phrase's cuts are scored from the level tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import store

LEAST, WORDS, TOP, SUBSUMED = 10, 3, 2000, 50
#: Bits of the table of frequent phrases: so many per phrase, and at most so many in all (64 MB).
BITS_EACH, MOST_BITS = 16, 1 << 29
#: Bits that one task makes.
SEGMENT = 1 << 16
#: A task holds at most so many words and so many occurrences of phrases before it emits their counts.
HELD_WORDS, HELD_PHRASES = 250_000, 2_000_000
#: Texts of so many bytes are taken together.
BATCH_BYTES = 4 << 20
#: A part with more than this share of all words' occurrences is common: there are at most its reciprocal per level.
COMMON = 1000
#: Ranks are taken within so many lanes of a language first, then within fewer, then within the language.
LANES = (256, 16)

_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[list(_SEPARATORS)] = 2
_BLANKED = bytes(0x20 if _KIND[i] else i for i in range(256))
_SCHEMA = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("n", pa.int64())])


def words_of(buffer: bytes) -> tuple[list[bytes], np.ndarray]:
    """The words of a lower-cased buffer and the number of the piece that each lies in."""
    kind = _KIND[np.frombuffer(buffer, np.uint8)]
    start = kind == 0
    start[1:] &= kind[:-1] != 0
    return buffer.translate(_BLANKED).split(), np.cumsum(kind == 2)[start]


_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _start(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass")))


def _hashes(start, columns: list[np.ndarray]) -> np.ndarray:
    """Hashes of phrases from those of the language and of each word, word by word."""
    at = np.atleast_1d(start)
    for c in columns:
        at = at * _M1 + c
    at = (at ^ (at >> np.uint64(30))) * _M2
    at = (at ^ (at >> np.uint64(27))) * _M3
    return at ^ (at >> np.uint64(31))


class Bits:
    """A table of bits, looked up by hashes."""

    def __init__(self, raw: bytes):
        self.raw, self.mask = np.frombuffer(raw, np.uint8), np.uint64(len(raw) * 8 - 1)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return (self.raw[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


class _Ids(dict):
    """Words numbered as they are met."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class _Tally:
    """Counts of one language's phrases of ``k`` words within a task."""

    def __init__(self, lang: str, k: int, frequent):
        self.start, self.k, self.frequent = _start(lang), k, frequent
        self._clear()

    def _clear(self) -> None:
        self.ids, self.word_hashes = _Ids(), np.empty(0, np.uint64)
        self.held: list[np.ndarray] = []
        self.n_held = 0

    def _number(self, words: list[bytes]) -> np.ndarray:
        before = len(self.ids)
        at = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        if self.k > 1 and len(self.ids) > before:
            new = islice(self.ids, before, None)
            self.word_hashes = np.append(self.word_hashes, np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(self.ids) - before))
        return at

    def add(self, buffer: bytes) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """Take in a buffer of whole texts; counts come out when too much is held."""
        words, piece = words_of(buffer)
        at = self._number(words)
        if self.k > 1:
            m = self.k - 1  # phrases of m words that are frequent, by where they begin
            last = len(at) - m + 1
            if last < 2:
                return
            own = self.word_hashes[at]
            good = self.frequent(_hashes(self.start, [own[j : last + j] for j in range(m)]))
            first = np.flatnonzero(good[:-1] & good[1:] & (piece[: last - 1] == piece[m:]))
            at = np.stack([at[first + j] for j in range(self.k)], axis=1).astype(np.int32)
        self.held.append(at)
        self.n_held += len(at)
        if self.n_held > HELD_PHRASES or len(self.ids) > HELD_WORDS:
            yield from self.flush()

    def flush(self) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """``(phrases, counts)`` of all that is held."""
        if self.n_held:
            names, grams = pa.array(list(self.ids), pa.binary()), np.concatenate(self.held)
            if self.k == 1:
                n = np.bincount(grams, minlength=len(names))
                some = np.flatnonzero(n)
                yield names.take(pa.array(some)), n[some]
            else:
                wide = max(1, len(names) - 1).bit_length()
                if wide * self.k <= 63:  # a phrase in one number
                    keys = grams[:, 0].astype(np.int64)
                    for j in range(1, self.k):
                        keys = keys << wide | grams[:, j]
                    keys, count = np.unique(keys, return_counts=True)
                    columns = [keys >> wide * (self.k - 1 - j) & (1 << wide) - 1 for j in range(self.k)]
                else:
                    rows, count = np.unique(grams, axis=0, return_counts=True)
                    columns = list(rows.T)
                for i in range(0, len(count), 200_000):
                    yield pc.binary_join_element_wise(*(names.take(pa.array(c[i : i + 200_000])) for c in columns), b" "), count[i : i + 200_000]
        self._clear()


def _buffers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """Lower-cased texts of one language, a separator between them; a long text alone, and always whole."""
    for batch in batches:
        by: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
            raw = text.as_py()
            by.setdefault(lang, []).append(raw)
            sizes[lang] = sizes.get(lang, 0) + len(raw)
            if sizes[lang] > BATCH_BYTES:
                yield lang, b"\n".join(by.pop(lang)).lower()
                sizes.pop(lang)
        for lang, raws in by.items():
            yield lang, b"\n".join(raws).lower()


def _counter(k: int, sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = Bits(sent.value) if sent is not None else None
        tallies: dict[str, _Tally] = {}

        def out(lang: str, counts) -> Iterator[pa.RecordBatch]:
            for names, n in counts:
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(names)), names, pa.array(n.astype(np.int64))], schema=_SCHEMA)

        for lang, buffer in _buffers(batches):
            if lang not in tallies:
                if len(tallies) >= 8:  # languages are few; where they are not, counts are emitted early
                    gone = next(iter(tallies))
                    yield from out(gone, tallies.pop(gone).flush())
                tallies[lang] = _Tally(lang, k, frequent)
            yield from out(lang, tallies[lang].add(buffer))
        for lang, tally in tallies.items():
            yield from out(lang, tally.flush())

    return run


def frequent_bits(level: DataFrame) -> bytes:
    """The table of bits of a level's phrases: its size is a power of two, 16 segments at least and at most :data:`MOST_BITS`."""
    n = level.count()
    size = min(MOST_BITS, max(16 * SEGMENT, 1 << math.ceil(math.log2(max(1, n) * BITS_EACH))))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            phrases, at = batch.column("phrase").to_pylist(), np.empty(batch.num_rows, np.uint64)
            langs = batch.column("lang").to_pylist()
            start_of = {lang: _start(lang) for lang in set(langs)}
            starts = np.fromiter(map(start_of.__getitem__, langs), np.uint64, batch.num_rows)
            words = [p.split(b" ") for p in phrases]
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            for k in np.unique(sizes).tolist():
                some = np.flatnonzero(sizes == k)
                at[some] = _hashes(starts[some], [np.fromiter((xxhash.xxh3_64_intdigest(words[i][j]) for i in some.tolist()), np.uint64, len(some)) for j in range(k)])
            at &= np.uint64(size - 1)
            yield pa.RecordBatch.from_arrays([pa.array((at // np.uint64(SEGMENT)).astype(np.int64)), pa.array((at % np.uint64(SEGMENT)).astype(np.int32))], ["segment", "place"])

    def segment(table: pa.Table) -> pa.Table:
        bits = np.zeros(SEGMENT, np.uint8)
        bits[table.column("place").to_numpy()] = 1
        return pa.table({"segment": table.column("segment")[:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    # Distinct places of a segment: at most SEGMENT rows a group, whatever the level's size.
    rows = level.select("lang", "phrase").mapInArrow(places, "segment long, place int").distinct().groupBy("segment").applyInArrow(segment, "segment long, bits binary")
    table = bytearray(size // 8)
    for r in rows.collect():  # the table itself, at most MOST_BITS
        table[r.segment * SEGMENT // 8 : (r.segment + 1) * SEGMENT // 8] = r.bits
    return bytes(table)


def _part(words, start, length):
    return F.array_join(F.slice(words, start, length), " ")


def mine(docs: DataFrame, least: int = LEAST, most_words: int = WORDS, top: int = TOP, subsumed: int = SUBSUMED) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases of 2 to ``most_words`` words.

    ``docs`` has text and lang.  Null texts are empty, null languages are ``und``; texts without words count for
    nothing, rows that repeat count as often as they come.  Ties at every step are decided by the contract: lowest
    score, then the shortest first part; score, frequency and phrase (by bytes) in ranks.  No candidates, or an empty
    table: no rows.  Other columns do not matter.  Frequencies below 10**15 keep decimals of 38 digits exact.
    """
    spark = docs.sparkSession
    rows = docs.where("text is not null").select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text"))
    levels: list[DataFrame] = []
    total = None
    with store.batches_of(spark, store.TEXT_ROWS):
        for k in range(1, most_words + 1):
            sent = spark.sparkContext.broadcast(frequent_bits(levels[-1])) if levels else None
            counts = rows.mapInArrow(_counter(k, sent), "lang string, phrase binary, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
            if k == 1:
                counts = store.materialize(counts, "words")
                total = store.materialize(counts.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
            levels.append(store.materialize(counts.where(F.col("f") >= least), f"phrases-{k}"))
            if k == 1:
                store.release(counts)
            if sent is not None:
                sent.destroy()
    parts = levels[0]
    for level in levels[1:]:
        parts = parts.unionAll(level)
    named = [level.select("lang", F.col("phrase").cast("string").alias("phrase"), F.col("f").alias("a"), F.split(F.col("phrase").cast("string"), " ", -1).alias("words")) for level in levels[1:]]
    candidates = named[0]
    for level in named[1:]:
        candidates = candidates.unionAll(level)

    # A common word is a part of many candidates.  Common parts are few whatever the corpus and are sent to all tasks; the
    # candidates they answer go through the shuffle under lanes of their own, where nothing is left to find.
    words = total.agg(F.sum("n").alias("n")).first().n or 0
    parts = parts.select("lang", F.col("phrase").cast("string").alias("part"), "f")
    common = F.broadcast(parts.where(F.col("f") * COMMON > words))
    cuts = candidates.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part("words", F.lit(1), F.col("k")).alias("left"), _part("words", F.col("k") + 1, F.size("words") - F.col("k")).alias("right"))
    for side, f in (("left", "l"), ("right", "r")):
        cuts = cuts.join(common.select("lang", F.col("part").alias(side), F.col("f").alias("known")), ["lang", side], "left")
        cuts = cuts.withColumn("lane", F.when(F.col("known").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64("phrase"), F.lit(1 << 20))))
        cuts = cuts.join(parts.select("lang", F.col("part").alias(side), F.col("f").alias("found"), F.lit(0).cast("long").alias("lane")), ["lang", side, "lane"], "left")
        cuts = cuts.withColumn(f, F.coalesce("known", "found")).drop(side, "known", "found", "lane")
    score = F.expr("(cast(1000000 as decimal(7,0)) * (cast(a as decimal(18,0)) * cast(a as decimal(18,0)))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "score"), F.struct("score", "k")).alias("x")).select("lang", "phrase", "x.*")

    # What each candidate's own shorter phrases lie in, at most.
    inner = candidates.where(F.size("words") > 2).select("lang", "a", "words", F.explode(F.sequence(F.lit(2), F.size("words") - 1)).alias("m"))
    inner = inner.select("lang", "a", "words", "m", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("m") + 1)).alias("i"))
    around = inner.select("lang", _part("words", F.col("i"), F.col("m")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(around, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < subsumed * F.col("a"), F.lit(True)))

    by = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    for lanes in LANES:
        kept = kept.withColumn("lane", F.pmod(F.xxhash64("phrase"), F.lit(lanes))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "lane").orderBy(*by))).where(F.col("rank") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)).cast("long")).where(F.col("rank") <= top)
    out = store.materialize(ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "phrases")
    for level in (*levels, total):
        store.release(level)
    return out


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2000 phrases of two or three words."""
    return mine(store.spark_table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, string_split_regex(p, '[ \t]+') AS ws FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents) AS t
), ws AS (SELECT piece, lang, list_filter(ws, lambda w: w <> '') AS ws FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase FROM (
    SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM ws, range(1, 4) AS r(k)) AS t
), f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 10),
cuts AS (SELECT lang, phrase, a, cut, array_to_string(ws[1 : cut], ' ') AS p, array_to_string(ws[cut + 1 :], ' ') AS q FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates) AS t),
scored AS (
  SELECT c.*, x.f AS l, y.f AS r, (CAST(1000000 AS HUGEINT) * a * a) // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.p JOIN f y ON y.lang = c.lang AND y.phrase = c.q
), least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, array_to_string(ws[i : i + 1], ' ') AS phrase, max(a) AS longer FROM (SELECT *, unnest(range(1, 3)) AS i FROM candidates WHERE k = 3) AS t GROUP BY 1, 2
), kept AS (SELECT s.* FROM least s LEFT JOIN inside i ON i.lang = s.lang AND i.phrase = s.phrase WHERE i.longer IS NULL OR 100 * i.longer < 50 * s.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT k.lang, k.rank, k.phrase, k.a, k.l, k.r, n.n, CAST(k.score AS BIGINT) AS score FROM ranked k JOIN n ON n.lang = k.lang WHERE rank <= 2000
"""
