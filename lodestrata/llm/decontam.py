"""Benchmark decontamination: a BM25 index of the test items, queried with every training passage.

A passage is a window of words; windows overlap by half and hold the longest item whole.  A passage
retrieves every item whose BM25 score is at least ``SCORE_SHARE`` of the score the item has for its own
text.  Two exact prunings by upper bounds come before a score is computed:

* per item the terms are split into essential ones and the rest, whose impacts together are too small to
  reach the threshold alone; a passage whose essential terms can't make up the difference for any item is
  skipped without a search;
* the search is block-max WAND: postings lie in blocks with their largest impact, the pivot is the first
  item whose summed term maxima reach the threshold, and it is scored only if its block maxima do too.

What is retrieved is verified on five-word shingles: the share of the item's, of its question's and of its
answer's shingles that the passage has.

The index is built from blocks of items of bounded size, with document frequencies over all items; a pass over the
passages searches several blocks, which are broadcast together.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

SHINGLE, SIMILARITY = 5, 0.75
K1, B, SCORE_SHARE = 1.2, 0.75, 0.5
#: Share of an item's own score that may lie in its non-essential terms.
REST_SHARE = 0.2
POSTINGS_BLOCK, LEAST_PASSAGE = 64, 64
#: Characters of items in a block of the index, and blocks that are broadcast at once.
INDEX_CHARS, PASS_BLOCKS = 4 << 20, 4

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
HITS = "item_id long, score double, overlap double, question_overlap double, answer_overlap double, start long"


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def shingles(ws: list[str]) -> set[tuple]:
    return {tuple(ws[i : i + SHINGLE]) for i in range(max(1, len(ws) - SHINGLE + 1))} if ws else set()


def question_answer(text: str) -> tuple[str, str]:
    """An item's question and answer: cut after its last question mark, else before its last sentence."""
    at = text.rfind("?") + 1
    if 0 < at < len(text.rstrip()):
        return text[:at], text[at:]
    parts = _SENTENCE.split(text.strip())
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, "")


def share(part: set[tuple], whole: set[tuple], sequence: str) -> float | None:
    """The share of ``part`` that a passage has; parts of fewer words than a shingle are sought in its text."""
    if not part:
        return None
    return sum(g in whole if len(g) == SHINGLE else f" {' '.join(g)} " in sequence for g in part) / len(part)


class Index:
    """Postings by term: items in order with impacts relative to the item's own score, in blocks."""

    def __init__(self, items: list[tuple[int, str]], frequencies: dict[str, int], total: int, mean_length: float):
        self.ids = [i for i, _ in items]
        bags = [words(t) for _, t in items]
        self.sets = [tuple(shingles(words(p)) for p in (t, *question_answer(t))) for _, t in items]
        self.longest = max(map(len, bags), default=0)
        idf = {t: float(np.log1p((total - n + 0.5) / (n + 0.5))) for t, n in frequencies.items()}
        impacts: list[dict[str, float]] = []
        for bag in bags:
            norm = K1 * (1 - B + B * len(bag) / max(mean_length, 1e-9))
            raw = {t: idf[t] * n * (K1 + 1) / (n + norm) for t, n in Counter(bag).items()}
            own = sum(raw.values())
            impacts.append({t: x / own for t, x in raw.items()} if own > 0 else {})
        self.term = {t: k for k, t in enumerate(sorted({t for m in impacts for t in m}))}
        post: list[list[tuple[int, float]]] = [[] for _ in self.term]
        for d, m in enumerate(impacts):
            for t, x in m.items():
                post[self.term[t]].append((d, x))
        self.items = [[d for d, _ in p] for p in post]
        self.impacts = [[x for _, x in p] for p in post]
        self.block_max = [[max(x[i : i + POSTINGS_BLOCK]) for i in range(0, len(x), POSTINGS_BLOCK)] for x in self.impacts]
        self.most = [max(x) for x in self.impacts]
        self.block_ends = [p[POSTINGS_BLOCK - 1 :: POSTINGS_BLOCK] + p[-1:] * (len(p) % POSTINGS_BLOCK > 0) for p in self.items]
        # Essential postings, flat by term: the most frequent terms of an item are left out up to REST_SHARE.
        self.need = np.zeros(len(items))
        essential: list[list[tuple[int, float]]] = [[] for _ in self.term]
        for d, m in enumerate(impacts):
            rest = 0.0
            for t, x in sorted(m.items(), key=lambda e: (-frequencies[e[0]], e[0])):
                if rest + x <= REST_SHARE:
                    rest += x
                else:
                    essential[self.term[t]].append((d, x))
            self.need[d] = SCORE_SHARE - rest - 1e-9
        self.e_first = np.concatenate([[0], np.cumsum([len(e) for e in essential])]).astype(np.int64)
        self.e_item = np.asarray([d for e in essential for d, _ in e], np.int64)
        self.e_impact = np.asarray([x for e in essential for _, x in e])

    def search(self, terms: list[int], least: float) -> list[tuple[int, float]]:
        """All ``(item, score)`` of at least ``least`` for distinct ``terms``, by block-max WAND."""
        least -= 1e-9
        items, impacts, ends, blocks = self.items, self.impacts, self.block_ends, self.block_max
        heads = sorted([items[t][0], t, 0] for t in terms)  # current item, term, place in the postings
        found = []
        while heads:
            bound, p = 0.0, -1
            for k, (_, t, _) in enumerate(heads):
                bound += self.most[t]
                if bound >= least:
                    p = k
                    break
            if p < 0:
                break
            pivot = heads[p][0]
            while p + 1 < len(heads) and heads[p + 1][0] == pivot:
                p += 1
            bound, until = 0.0, len(self.ids)
            for _, t, _ in heads[: p + 1]:
                b = bisect_left(ends[t], pivot)
                if b < len(ends[t]):
                    bound += blocks[t][b]
                    until = min(until, ends[t][b] + 1)
            if bound >= least:
                if heads[0][0] == pivot:
                    score = sum(impacts[t][i] for _, t, i in heads[: p + 1])
                    if score >= least:
                        found.append((pivot, score))
                    target = pivot + 1
                else:
                    target = pivot
            else:  # no item up to the end of these blocks can reach it
                target = max(until, pivot + 1) if p + 1 >= len(heads) else max(min(until, heads[p + 1][0]), pivot + 1)
            moved = []
            for head in heads[: p + 1]:
                if head[0] < target:
                    i = bisect_left(items[head[1]], target, head[2])
                    if i == len(items[head[1]]):
                        continue
                    head = [items[head[1]][i], head[1], i]
                moved.append(head)
            heads = sorted(moved + heads[p + 1 :])
        return found

    def hits(self, text: str | None) -> list[tuple]:
        """Per contained item: id, relative score, overlaps, first word of the passage (the best of its passages)."""
        ws = words(text)
        if not ws or not self.ids:
            return []
        get = self.term.get
        terms = np.fromiter((get(w, -1) for w in ws), np.int64, len(ws))
        step = max(LEAST_PASSAGE, self.longest)
        at = np.flatnonzero(terms >= 0)
        n = self.e_first[terms[at] + 1] - self.e_first[terms[at]]
        at, n = at[n > 0], n[n > 0]
        if not len(at):
            return []
        flat = np.repeat(self.e_first[terms[at]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        item, impact, window = self.e_item[flat], self.e_impact[flat], np.repeat(at, n) // step
        # A word lies in the passages that start at its own step and at the one before.
        keys = np.concatenate([window, np.maximum(window - 1, 0)]) * len(self.ids) + np.concatenate([item, item])
        double = np.concatenate([np.ones(len(window), bool), window > 0])
        got, back = np.unique(keys[double], return_inverse=True)
        bound = np.bincount(back, np.concatenate([impact, impact])[double])
        passages = np.unique(got[bound >= self.need[got % len(self.ids)]] // len(self.ids))
        best: dict[int, tuple] = {}
        for p in passages.tolist():
            lo, hi = p * step, p * step + 2 * step
            own = np.unique(terms[lo:hi])
            grams, sequence = None, ""
            for d, score in self.search(own[own >= 0].tolist(), SCORE_SHARE):
                if grams is None:
                    grams, sequence = shingles(ws[lo:hi]), f" {' '.join(ws[lo:hi])} "
                whole, question, answer = (share(s, grams, sequence) for s in self.sets[d])
                if whole >= SIMILARITY or (question or 0) >= SIMILARITY and (answer or 0) >= SIMILARITY:
                    row = (self.ids[d], score, whole, question, answer, lo)
                    if d not in best or row[2] > best[d][2]:
                        best[d] = row
        return [best[d] for d in sorted(best)]


def _terms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per item its distinct terms, and a row without a term for its length."""
    for frame in frames:
        bags = [words(t) for t in frame["text"]]
        rows = [(b, t, 0) for b, ws in zip(frame["block"], bags, strict=True) for t in set(ws)]
        rows += [(b, None, len(ws)) for b, ws in zip(frame["block"], bags, strict=True) if ws]
        yield pd.DataFrame(rows, columns=["block", "term", "n"])


def build_indexes(items: DataFrame, index_chars: int = INDEX_CHARS) -> Iterator[Index]:
    """Indexes over blocks of ``items`` (item_id, text) of about ``index_chars`` characters each.

    Items without an id, without a word, or null are left out; repeated item_ids are items of their own.
    The driver holds one block at a time, with the frequencies of its own terms.
    """
    usable = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    chars = usable.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // index_chars))
    usable = usable.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    terms = None
    if blocks > 1:
        terms = store.materialize(usable.mapInPandas(_terms, "block long, term string, n long"), "terms")
        frequency = store.materialize(terms.where("term is not null").groupBy("term").agg(F.count("*").alias("n")), "frequencies")
        total, length = terms.where("term is null").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    for k in range(blocks):
        rows = [(r.item_id, r.text) for r in usable.where(F.col("block") == k).orderBy("item_id", "text").toLocalIterator() if words(r.text)]
        if terms is None:
            bags = [words(t) for _, t in rows]
            frequencies: dict[str, int] = Counter(t for bag in bags for t in set(bag))
            total, length = len(rows), sum(map(len, bags))
        else:
            own = terms.where((F.col("block") == k) & F.col("term").isNotNull()).select("term").distinct()
            frequencies = {r.term: r.n for r in frequency.join(own, "term").toLocalIterator()}
        yield Index(rows, frequencies, total, length / max(total, 1))
    if terms is not None:
        store.release(terms)
        store.release(frequency)


def _passes(docs: DataFrame, items: DataFrame, index_chars: int) -> Iterator:
    """Broadcast lists of indexes, together over all items."""
    indexes = build_indexes(items, index_chars)
    while some := list(islice(indexes, PASS_BLOCKS)):
        yield docs.sparkSession.sparkContext.broadcast(some)


def find_contamination(docs: DataFrame, items: DataFrame, index_chars: int = INDEX_CHARS) -> DataFrame:
    """A row per document and benchmark item that it contains: doc_id and ``HITS``.

    Null, empty and clean texts give no row; repeated rows give theirs as often as they come; other columns are
    ignored.  A null question or answer overlap means that the item has no such part.  No items: no rows.
    """
    store.small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for model in _passes(docs, items, index_chars):

        def run(frames: Iterator[pd.DataFrame], model=model) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = [(doc, *hit) for doc, text in zip(frame["doc_id"], frame["text"], strict=True) for index in model.value for hit in index.hits(text)]
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap", "start"], dtype=object)

        part = store.map_frames(rows, run, f"doc_id long, {HITS}")
        found = part if found is None else found.unionAll(part)
    return found


def without_contamination(docs: DataFrame, items: DataFrame, index_chars: int = INDEX_CHARS) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item, with all their columns.

    Null and empty texts stay; repeated rows stay or go together; no items: all rows stay.
    """
    for model in _passes(docs, items, index_chars):
        docs = store.filter_texts(docs, lambda model=model: lambda texts: [not any(index.hits(t) for index in model.value) for t in texts])
    return docs


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that contains an item of the benchmark, with the item."""
    return find_contamination(store.spark_table(spark, sf_dir, "documents"), store.spark_table(spark, sf_dir, "benchmark"))
