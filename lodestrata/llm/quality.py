"""Quality classification from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document.  Expectation-maximisation over
the counts of vote patterns (some hundreds, from all documents) estimates how each labeller votes
on good and on bad documents and how many are good, and with that the probability that a pattern's document
is good.  These posteriors of a bounded sample train a linear scorer over hashed features, which scores
every document, so that documents on which the labellers are silent or divided are judged too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import caches, store

#: Documents that train the scorer: those of least id hash.
SAMPLE_DOCS = 4000
FEATURES, KEEP_SCORE = 1 << 14, 0.5
CACHE_WORDS, BLOCK_CHARS = 400_000, 1 << 20
SPAN = 50
#: What stands between the entries of a menu on one line.
SEPARATORS = (" | ", " · ", " » ", " > ", " • ")
#: Prior of the M step: flat over vote distributions in which a labeller finds a fault in at most this share of good
#: documents, and none beyond.  Without it, a kind of bad document that one or two labellers know would pass for
#: good ones that these labellers misjudge.
MOST_FALSE_FAULTS = 0.005

#: NONE: looked at, nothing found.  UNSEEN: the text is too short to be looked at, which says nothing.
BAD, NONE, GOOD, UNSEEN = 0, 1, 2, 3
#: Most labellers only see faults; short words and sentence ends also speak for a text.
LABELLERS = ("marks", "capitals", "lone_marks", "repeats", "variety", "letters", "lines", "word_length", "menus", "short_words", "sentences")

_RUNS = re.compile(r"(\w)\1+")
_MARKS = str.maketrans("", "", "()[]{}\"'«»“”‘’.,;:!?-–—…")


_KINDS = {i: "A" if chr(i).isupper() else "a" if chr(i).isalpha() else "0" if chr(i).isdigit() else chr(i) for i in range(0x250)}


def shape_of(word: str) -> str:
    """The word with A, a and 0 for its capitals, other letters and digits."""
    if max(word) < chr(0x250):
        return word.translate(_KINDS)
    return "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)


def measure(shape: str) -> tuple[int, ...]:
    """What labellers and features take from a word of this shape, as ``Reader.COLUMNS``."""
    upper = shape.count("A")
    letters = upper + shape.count("a")
    noisy = bool(letters) and len(shape) - len(shape.rstrip("!?#$%&*@^~+=<>|\\/")) >= 2
    lone = not letters and "0" not in shape and bool(shape.translate(_MARKS))
    return noisy, letters >= 2 and upper == letters, lone, letters + shape.count("0"), len(shape), shape[-1:] in ".!?…", 1 <= letters <= 3, bucket("s" + _RUNS.sub(r"\1", shape)[:16])


def bucket(feature: str) -> int:
    return xxhash.xxh3_64_intdigest(feature) % FEATURES


class Reader:
    """Votes and hashed features of whole texts, with a bounded cache of words."""

    COLUMNS = ("noisy", "upper", "lone", "letters", "size", "ends", "short", "shape")

    def __init__(self):
        self.cache: dict[str, int] = {}
        self.shapes: dict[str, tuple[int, ...]] = {}
        self.found: list[tuple[int, ...]] = []
        self.table = np.zeros((CACHE_WORDS, len(self.COLUMNS)), np.int32)
        self.repeat = bucket("r")

    def rows(self, bags: list[list[str]]) -> None:
        """Make room for, and add, the words not met before."""
        new = set().union(*bags).difference(self.cache)
        if len(self.cache) + len(new) > len(self.table):
            self.cache.clear()
            new = set().union(*bags)
            if len(new) > len(self.table):
                self.table = np.zeros((len(new), len(self.COLUMNS)), np.int32)
        base = len(self.cache)
        for w in new:
            shape = shape_of(w)
            got = self.shapes.get(shape)
            if got is None:
                if len(self.shapes) >= CACHE_WORDS:
                    self.shapes.clear()
                got = self.shapes[shape] = measure(shape)
            self.cache[w] = base
            self.found.append(got)
            base += 1
        if new:
            self.table[base - len(new) : base] = self.found
            self.found.clear()

    def read(self, texts) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """``(votes, buckets, weights)`` of each text; the weights of a text's buckets sum to 1 or a little more."""
        held, size = [], 0
        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if size >= BLOCK_CHARS:
                yield from self._block(held)
                held, size = [], 0
        yield from self._block(held)

    def _block(self, texts: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        bags = [t.split() for t in texts]
        self.rows(bags)
        get = self.cache.__getitem__
        for text, bag in zip(texts, bags, strict=True):
            yield self._one(text, np.fromiter(map(get, bag), np.int64, len(bag)))

    def _one(self, text: str, at: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
        n = len(at)
        if not n:
            return [BAD] * len(LABELLERS), np.asarray([bucket("empty")]), np.ones(1)
        rows = self.table[at]
        noisy, upper, lone, letters, size, ends, short = rows[:, :7].sum(axis=0).tolist()
        again = float((at[1:] == at[:-1]).mean()) if n > 1 else 0.0
        whole = n // SPAN * SPAN
        spans = np.sort(at[:whole].reshape(-1, SPAN), axis=1) if whole else np.sort(at)[None]
        variety = float((np.diff(spans, axis=1) != 0).sum() + len(spans)) / spans.size
        lines = [x for x in text.split("\n") if x.strip()]
        doubled = 1 - len(set(lines)) / len(lines)
        mean = size / n
        separators = sum(map(text.count, SEPARATORS))
        faults = (noisy / n >= 0.15, upper / n >= 0.3, lone / n >= 0.1, again >= 0.15, variety <= 0.4, 1 - letters / size >= 0.2, len(lines) > 4 and doubled >= 0.4, not 2 <= mean <= 15, separators >= max(2, n / 10))
        votes = [BAD if f else NONE for f in faults]
        for k, seen in ((3, n >= 5), (4, n >= 20), (6, len(lines) > 4)):
            votes[k] = votes[k] if seen else UNSEEN
        plain = n - lone
        votes.append(UNSEEN if plain < 20 else GOOD if short / plain >= 0.15 else BAD if short / plain <= 0.06 else NONE)
        votes.append(UNSEEN if n < 40 else GOOD if 0.02 <= ends / n <= 0.35 else BAD if not ends else NONE)
        shapes, counts = np.unique(rows[:, 7], return_counts=True)
        extra = [(self.repeat, again)]
        if n >= 20:
            extra += [(bucket(f"v{int(variety * 10)}"), 0.5), (bucket(f"d{int(doubled * 5)}"), 0.25)]
        return votes, np.concatenate([shapes, [b for b, _ in extra]]).astype(np.int64), np.concatenate([counts / n, [x for _, x in extra]])


def pattern(votes: list[int]) -> int:
    code = 0
    for v in votes:
        code = 4 * code + v
    return code


def votes_of(patterns: np.ndarray) -> np.ndarray:
    places = 4 ** np.arange(len(LABELLERS) - 1, -1, -1)
    return patterns[:, None] // places % 4


class WeakLabels:
    """Labellers' vote distributions on good and bad documents, by expectation-maximisation."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 100):
        votes, n = votes_of(patterns), counts.astype(np.float64)
        balance = ((votes == GOOD).sum(1) - 2.0 * (votes == BAD).sum(1)) / votes.shape[1]
        good = 1 / (1 + np.exp(-12 * balance))
        for _ in range(rounds):
            before = good
            self.prior = float((n * good).sum() / max(n.sum(), 1e-9))
            # Rows: bad, good; one pseudo-count a vote keeps every chance above 0.
            self.chance = np.stack([np.stack([1 + (n[:, None] * p[:, None] * (votes == v)).sum(0) for v in (BAD, NONE, GOOD)]) for p in (1 - good, good)])
            self.chance /= self.chance.sum(axis=1, keepdims=True)
            # The most probable distribution under the prior: beyond its edge, the edge, and the other votes in their proportion.
            most = np.minimum(self.chance[1, BAD], MOST_FALSE_FAULTS)
            self.chance[1, NONE:] *= (1 - most) / (1 - self.chance[1, BAD])
            self.chance[1, BAD] = most
            self.chance = np.concatenate([self.chance, np.ones_like(self.chance[:, :1])], axis=1)  # UNSEEN
            good = self.posterior(votes)
            if np.abs(good - before).max(initial=0) < 1e-6:
                break
        self.by_pattern = dict(zip(patterns.tolist(), good.tolist(), strict=True))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Chance that a document with these votes is good."""
        of = np.arange(votes.shape[1])
        prior = min(max(self.prior, 1e-6), 1 - 1e-6)
        odds = np.log(prior / (1 - prior)) + (np.log(self.chance[1][votes, of]) - np.log(self.chance[0][votes, of])).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))

    def accuracies(self) -> dict[str, float]:
        """Per labeller the share of its votes that agree with the posterior label."""
        good, bad = self.prior * self.chance[1], (1 - self.prior) * self.chance[0]
        return {name: float((good[GOOD, k] + bad[BAD, k]) / (good[GOOD, k] + good[BAD, k] + bad[GOOD, k] + bad[BAD, k])) for k, name in enumerate(LABELLERS)}


def fit_scorer(features: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rounds: int = 300, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights per bucket and a bias: logistic regression on soft labels, both classes weighing the same."""
    weights = np.zeros(FEATURES)
    if not features:
        return weights, 0.0
    used = np.unique(np.concatenate([b for b, _ in features]))
    x = np.zeros((len(features), len(used)))
    for i, (b, v) in enumerate(features):
        np.add.at(x[i], np.searchsorted(used, b), v)
    mass = np.where(target >= 0.5, 0.5 / max((target >= 0.5).sum(), 1), 0.5 / max((target < 0.5).sum(), 1))
    w, bias, m, s = np.zeros(len(used)), 0.0, np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for k in range(1, rounds + 1):
        error = mass * (1 / (1 + np.exp(-np.clip(x @ w + bias, -50, 50))) - target)
        step = np.append(x.T @ error + 1e-5 * w, error.sum())
        m, s = 0.9 * m + 0.1 * step, 0.999 * s + 0.001 * step * step
        move = rate * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.999**k)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    weights[used] = w
    return weights, float(bias)


def reader() -> Reader:
    return caches.claim("quality reader", Reader)


def _features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = [(pattern(v), not t or t.isspace(), b.tolist(), w.tolist()) for t, (v, b, w) in zip(frame["text"], reader().read(frame["text"]), strict=True)]
        yield pd.concat([frame[["doc_id"]].astype("Int64"), pd.DataFrame(rows, columns=["pattern", "blank", "buckets", "weights"])], axis=1)


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, pattern, blank, buckets, weights``: what labellers and scorer need of each text, a few dozen numbers."""
    store.small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return store.materialize(store.map_frames(rows, _features, "doc_id long, pattern long, blank boolean, buckets array<int>, weights array<float>"), "features")


class Model:
    def __init__(self, labels: WeakLabels, weights: np.ndarray, bias: float):
        self.labels, self.weights, self.bias = labels, weights, bias


def _sample(rows: DataFrame, n: int) -> list:
    """The ``n`` documents of least id hash; rows that share id and pattern count once.  A bound on the hash, with room
    to spare, comes first, so that tasks send the driver little more than it keeps."""
    total, at = rows.count(), F.xxhash64("doc_id")
    part = 4 * n / max(total, 1)
    while True:
        some = rows if part >= 1 else rows.where(at < F.lit(int((part - 0.5) * 2**64)))
        some = some.groupBy("doc_id", "pattern").agg(F.first("buckets").alias("buckets"), F.first("weights").alias("weights"))
        found = some.orderBy(at, "doc_id", "pattern").limit(n).collect()
        if len(found) == n or part >= 1:
            return found
        part *= 4


def train(rows: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Estimate the labellers from all ``rows`` of :func:`features`, then fit the scorer on ``sample_docs`` of them."""
    counts = rows.groupBy("pattern").count().collect()  # distinct patterns: at most 4 ** labellers, a few hundred in practice
    labels = WeakLabels(np.asarray([r["pattern"] for r in counts], np.int64), np.asarray([r["count"] for r in counts], np.int64))
    sample = _sample(rows.where("doc_id is not null"), sample_docs)
    found = [(np.asarray(r.buckets, np.int64), np.asarray(r["weights"])) for r in sample]
    target = labels.posterior(votes_of(np.asarray([r.pattern for r in sample], np.int64))) if sample else np.empty(0)
    return Model(labels, *fit_scorer(found, target))


def _score(model: Model, buckets: np.ndarray, weights: np.ndarray) -> float:
    return float(1 / (1 + np.exp(-np.clip((model.weights[buckets] * weights).sum() + model.bias, -50, 50))))


def score(rows: DataFrame, model: Model, keep_score: float = KEEP_SCORE) -> DataFrame:
    """``doc_id, posterior, score, kept`` of every row of :func:`features`.

    ``posterior`` is the labellers' chance that the document is good, ``score`` the linear scorer's; ``kept``
    is score >= keep_score.  A null, empty or blank text is rejected with score 0; null doc_ids stay null and
    repeated rows are scored as often as they come; other columns are ignored; no rows give no rows.
    """
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [0.0 if blank else _score(sent.value, b, w) for blank, b, w in zip(frame["blank"], frame["buckets"], frame["weights"], strict=True)]
            posterior = sent.value.labels.posterior(votes_of(frame["pattern"].to_numpy(np.int64)))
            yield frame[["doc_id"]].astype("Int64").assign(posterior=posterior, score=got, kept=[s >= keep_score for s in got])

    return store.map_frames(rows, run, "doc_id long, posterior double, score double, kept boolean")


def keep_good(docs: DataFrame, model: Model, keep_score: float = KEEP_SCORE) -> DataFrame:
    """The rows of ``docs`` that the scorer keeps; null, empty and blank texts go."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judge(texts: list[str | None]) -> list[bool]:
        return [bool(t) and not t.isspace() and _score(sent.value, b, w.astype(np.float32)) >= keep_score for t, (_, b, w) in zip(texts, reader().read(texts), strict=True)]

    return store.filter_texts(docs, lambda: judge)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document."""
    rows = features(store.spark_table(spark, sf_dir, "documents"))
    return score(rows, train(rows))
