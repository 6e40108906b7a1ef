"""Language identification by prediction by partial matching over bytes.

Per language a tree of byte contexts of up to ``ORDER`` bytes holds how often each byte followed.  In a
context met n times with d different successors a byte seen c times costs log2((n + d) / c) bits; any other
byte costs the escape, log2((n + d) / d), and what it costs in the context one byte shorter; after the empty
context every byte costs 8 bits; a context never met costs nothing to leave.  Texts are put in lower case and
coded byte by byte as they are, blanks and line ends included, contexts running on from word to word; ``ORDER``
blanks stand before a text's first byte, in training as in scoring.  The counts are frozen after training, so
what a byte costs follows from the ``ORDER`` bytes before it: a worker keeps the costs of the windows of
``ORDER + 1`` bytes that it met lately, and a text's code length is the sum over its windows.

The language with the shortest code of the whole text is predicted.

A share among the learned languages can't tell a text in none of them, so a filter also asks how long the code
is.  Each word (with the white space after it) is taken at its cost in the language that codes it best, so
texts that mix learned languages pass; words with a digit, with signs in a row or without a letter (numbers, keys,
links, ornaments) say nothing of a language and don't count unless they are more than three quarters of a text.
The bound on the bits is learned: the training documents are coded by trees of the other half of them, and their
spread, of documents and of words, is what a text may show.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import caches, store

#: Bytes of the longest contexts, at most 7.
ORDER = 5
#: Documents whose language stays more open than this are rejected by a filter; mixtures of learned languages score more.
KEEP_SCORE = 0.3
#: A text's code may be longer than the median training document's by this many times their spread.
KEEP_SPREAD = 3.0
#: Least share of a text's bytes in words that say something of a language; other texts are judged by all their words.
TELLING_SHARE = 0.25
#: The trees are learned from at most this many documents a language, those of least hash.
DOCS_PER_LANGUAGE = 200
#: Bytes of a worker's table of windows, and characters of text that are coded at once.
CACHE_BYTES, BLOCK_CHARS = 48 << 20, 1 << 19
UNDETERMINED = "und"

_PAD = 8
_NO_WINDOW = np.uint64(0xFFFFFFFFFFFFFFFF)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: What a byte adds to a word's digits, letters and signs of ASCII, in 20 bits each.
_KIND = np.zeros(256, np.int64)
_KIND[48:58], _KIND[97:123], _KIND[128:] = 1, 1 << 20, 1 << 20
_SIGN = np.asarray([33 <= c < 48 or 58 <= c < 65 or 91 <= c < 97 or 123 <= c < 127 for c in range(256)])


def encoded(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def windows(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of the texts in a row, for each the ``order`` bytes before it and itself as a number (itself
    lowest), and where each text ends."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    raw = np.frombuffer(b" " * _PAD + (b" " * _PAD).join(texts), np.uint8)
    wide = np.ndarray((len(raw) - _PAD + 1,), ">u8", raw, strides=(1,))
    starts = np.cumsum(sizes + _PAD) - sizes
    at = np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return raw[at], wide[at - _PAD + 1].astype(np.uint64) & np.uint64((1 << 8 * (order + 1)) - 1), np.cumsum(sizes)


class Bound:
    """The most bits that n bytes of a text in learned languages may take; any number until it has learned."""

    def __init__(self, median: float = np.inf, spread: float = 0.0, word_variance: float = 0.0):
        self.median, self.spread, self.word_variance = median, spread, word_variance

    @classmethod
    def learn(cls, texts: dict[str, list[str]], order: int) -> Bound:
        """From documents coded by trees of the other half of them.  Fewer than two documents bound nothing."""
        halves = [{lang: sorted(own)[k::2] for lang, own in texts.items()} for k in (0, 1)]
        bits, sizes, off, size = [], [], 0.0, 0
        for own, other in (halves, halves[::-1]):
            judge = Scorer(Trees({lang: t for lang, t in other.items() if t}, order))
            if not judge.trees.languages:
                continue
            for text in (t for lang in sorted(own) for t in own[lang]):
                _, own_bits, n, telling = judge.words([encoded(text)])
                least, n = own_bits[telling].min(axis=1), n[telling]
                if len(n):
                    bits.append(least.sum())
                    sizes.append(n.sum())
                    off += float(((least - n * (bits[-1] / sizes[-1])) ** 2).sum())
                    size += int(n.sum())
        if not bits:
            return cls()
        rates = np.asarray(bits) / np.asarray(sizes)
        median = float(np.median(rates))
        return cls(median, float(np.quantile(rates, 0.99)) - median, off / size)

    def holds(self, bits: float, n: float) -> bool:
        return bool(bits <= n * (self.median + KEEP_SPREAD * float(np.sqrt(self.spread**2 + self.word_variance / n))))


class Trees:
    """How often each string of 1 to ``order + 1`` bytes was met in each language."""

    def __init__(self, texts: dict[str, list[str]], order: int = ORDER):
        self.name, self.order, self.languages = uuid.uuid4().hex, order, sorted(texts)
        self.bound = Bound()
        self.counts = []
        for lang in self.languages:
            _, whole, _ = windows([encoded(t) for t in texts[lang]], order)
            self.counts.append([np.unique(whole & np.uint64((1 << 8 * k) - 1), return_counts=True) for k in range(1, order + 2)])


class Scorer:
    """What each string met in any language costs in every language, and what leaving its context costs."""

    def __init__(self, trees: Trees):
        self.trees, langs = trees, len(trees.languages)
        self.grams, self.costs, self.contexts, self.escapes = [], [], [], []
        for k in range(1, trees.order + 2):
            grams = np.unique(np.concatenate([c[k - 1][0] for c in trees.counts] or [np.empty(0, np.uint64)]))
            first = np.flatnonzero(np.diff(grams >> np.uint64(8), prepend=_NO_WINDOW)) if len(grams) else np.empty(0, np.int64)
            contexts = grams[first] >> np.uint64(8)
            own = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(grams))))
            costs, escapes = np.empty((len(grams), langs)), np.zeros((len(contexts), langs))
            shorter = self.costs[-1][np.searchsorted(self.grams[-1], grams & np.uint64((1 << 8 * (k - 1)) - 1))] if k > 1 else np.full((len(grams), langs), 8.0)
            for lang in range(langs):
                got, n = trees.counts[lang][k - 1]
                at = np.searchsorted(grams, got)
                total, kinds = np.bincount(own[at], n, len(contexts)), np.bincount(own[at], minlength=len(contexts))
                met = kinds > 0
                escapes[met, lang] = np.log2((total[met] + kinds[met]) / kinds[met])
                costs[:, lang] = escapes[own, lang] + shorter[:, lang]
                costs[at, lang] = np.log2((total + kinds)[own[at]] / n)
            for held, new in ((self.grams, grams), (self.costs, costs), (self.contexts, contexts), (self.escapes, escapes)):
                held.append(new)
        self.costs, self.escapes = ([v.astype(np.float32) for v in t] for t in (self.costs, self.escapes))
        slots = 1 << max(10, (CACHE_BYTES // (8 + 4 * langs)).bit_length() - 1)
        self.shift, self.keys, self.rows = np.uint64(64 - slots.bit_length() + 1), np.full(slots, _NO_WINDOW), np.zeros((slots, langs), np.float32)

    def _cost(self, window: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each window, after the bytes before it, in each language."""
        out = np.full((len(window), len(self.trees.languages)), 8.0)
        for k, (grams, costs, contexts, escapes) in enumerate(zip(self.grams, self.costs, self.contexts, self.escapes, strict=True), 1):
            own = window & np.uint64((1 << 8 * k) - 1)
            for known, values, new in ((contexts, escapes, own >> np.uint64(8)), (grams, costs, own)):
                if not len(known):
                    continue
                at = np.searchsorted(known, new)
                at[at == len(known)] = 0
                hit = known[at] == new
                if known is grams:
                    out[hit] = values[at[hit]]
                else:
                    out[hit] += values[at[hit]]
        return out

    def bits(self, window: np.ndarray) -> np.ndarray:
        """:meth:`_cost` through the table of windows."""
        slot = (window * np.uint64(0x9E3779B97F4A7C15)) >> self.shift
        out = self.rows[slot]
        gone = np.flatnonzero(self.keys[slot] != window)
        if len(gone):
            new, back = np.unique(window[gone], return_inverse=True)
            rows = self._cost(new).astype(np.float32)
            out[gone] = rows[back]
            slot = (new * np.uint64(0x9E3779B97F4A7C15)) >> self.shift
            self.keys[slot], self.rows[slot] = new, rows  # of windows that share a slot the last stays, with its row
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language."""
        out = np.zeros((len(texts), len(self.trees.languages)))
        _, window, ends = windows(texts, self.trees.order)
        full = np.flatnonzero(np.diff(ends, prepend=0))
        if len(full):
            out[full] = np.add.reduceat(self.bits(window), np.concatenate([[0], ends[:-1]])[full], axis=0, dtype=np.float64)
        return out

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(text, bits in each language, bytes, whether it says something of a language)`` of each word, with the white
        space after it, and of the white space that a text begins with."""
        raw, window, ends = windows(texts, self.trees.order)
        if not len(raw):
            return np.empty(0, np.int64), np.empty((0, len(self.trees.languages))), np.empty(0, np.int64), np.empty(0, bool)
        space = _SPACE[raw]
        begins = ~space
        begins[1:] &= space[:-1]
        starts = np.concatenate([[0], ends[:-1]])
        begins[starts[np.diff(ends, prepend=0) > 0]] = True
        at = np.flatnonzero(begins)
        kinds = _KIND[raw]
        sign = _SIGN[raw]
        kinds[1:] += (sign[1:] & sign[:-1] & ~begins[1:]).astype(np.int64) << 40
        kinds = np.add.reduceat(kinds, at)
        bits = np.add.reduceat(self.bits(window), at, axis=0, dtype=np.float64)
        telling = (kinds & 0xFFFFF == 0) & (kinds >> 40 == 0) & (kinds >> 20 > 0)
        return np.searchsorted(ends, at, side="right"), bits, np.diff(np.append(at, len(raw))), telling

    def texts(self, texts, bounded: bool = False) -> Iterator[tuple[str, float, bool]]:
        """``(language, score, whether its code is as short as the learned languages')`` of each text; the last
        is only asked if ``bounded``."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text) if text else 0
            if size >= BLOCK_CHARS:
                yield from self._judge(held, bounded)
                held, size = [], 0
        yield from self._judge(held, bounded)

    def _judge(self, texts: list[str | None], bounded: bool) -> Iterator[tuple[str, float, bool]]:
        raw = [encoded(t) if t and any(map(str.isalpha, t)) else b"" for t in texts]
        known = np.ones(len(raw), bool)
        if not bounded:
            lengths = self.lengths(raw)
        else:  # a text's bits are those of its words
            of, bits, n, telling = self.words(raw)
            lengths = np.stack([np.bincount(of, b, len(raw)) for b in bits.T], axis=1) if bits.size else np.zeros((len(raw), bits.shape[1]))
            least = bits.min(axis=1, initial=np.inf)
            total, told = (np.stack([np.bincount(of, w * x, len(raw)) for x in (least, n)]) for w in (1, telling))
            total = np.where(told[1] >= TELLING_SHARE * total[1], told, total)
            known = [bool(t) and self.trees.bound.holds(b, k) for t, b, k in zip(raw, *total, strict=True)]
        for t, bits, sure in zip(raw, lengths, known, strict=True):
            if not t or not len(bits):
                yield UNDETERMINED, 0.0, False
                continue
            best = int(bits.argmin())
            share = np.exp2(-(bits - bits[best]) / len(t.split()))
            yield self.trees.languages[best], float(1 / share.sum()), bool(sure)


def scorer(trees: Trees) -> Scorer:
    """One automaton per worker and model."""
    return caches.claim(f"trees {trees.name}", lambda: Scorer(trees))


def held_out(doc_id) -> F.Column:
    """Documents that training never sees: crc32 of the id as text divides by 5; also those without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, order: int = ORDER) -> Trees:
    """Learn from ``docs`` (doc_id, text, lang) that aren't held out: of each language whole texts of the
    ``docs_per_language`` documents whose ids hash least (rows that share such an id and language all count).
    Null texts and nulls in lang teach nothing; without a usable row there is no language, and every text is ``und``."""
    usable = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = usable.select("doc_id", "lang").withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= docs_per_language).select("doc_id", "lang").distinct()
    texts: dict[str, list[str]] = {}
    # At most docs_per_language ids of each language: broadcast.
    for r in usable.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").select("lang", "text").collect():
        texts.setdefault(r.lang, []).append(r.text)
    trees = Trees(texts, order)
    trees.bound = Bound.learn(texts, order)
    return trees


def identify(docs: DataFrame, trees: Trees) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row.

    ``und`` with score 0: a null text or one without a letter.  The score is 1 for a certain and 1/languages
    for an open choice (it weighs the mean bits a word).  Ties go to the first language in order.
    """
    store.small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(trees)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = scorer(model.value)
        for frame in frames:
            got = list(judge.texts(frame["text"]))
            yield frame[["doc_id", "held_out"]].astype({"doc_id": "Int64"}).assign(lang_pred=[g[0] for g in got], score=[g[1] for g in got])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return store.map_frames(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, trees: Trees, least_score: float = KEEP_SCORE) -> DataFrame:
    """The rows of ``docs``, with all their columns, in learned languages: a score of at least ``least_score``, and a
    code within the bound.  Null texts and those without a letter go; repeated rows stay or go together."""
    model = docs.sparkSession.sparkContext.broadcast(trees)
    return store.filter_texts(docs, lambda: lambda texts: [lang != UNDETERMINED and s >= least_score and known for lang, s, known in scorer(model.value).texts(texts, bounded=True)])


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = store.spark_table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
