"""Word shingles as 64-bit hashes, and their min-wise signatures."""

from __future__ import annotations

import numpy as np
import xxhash

from . import caches

WORDS = 5
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


class WordHashes(dict):
    """Hashes of words, kept for the words met lately."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        got = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = got
        return got


def words(text: str | None) -> list[bytes]:
    """Maximal runs of anything but blank and the controls 9 to 13, with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


def sequence(ws: list[bytes], k: int = WORDS) -> np.ndarray:
    """The hash of each k-word shingle in text order; of the whole sequence if there are fewer words."""
    if not ws:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(caches.claim("word hashes", WordHashes).__getitem__, ws), np.uint64, len(ws))
    if len(ws) < k:
        at = np.full(1, len(ws), np.uint64)
        for x in h:
            at = _mix(at * _M1 + x)
        return at
    at = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        at = at * _M1 + h[i : len(h) - k + 1 + i]
    return _mix(at)


def shingle_set(text: str | None, k: int = WORDS) -> np.ndarray:
    """The distinct shingles of a text, sorted."""
    return np.unique(sequence(words(text), k))


def set_key(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


class MinWise:
    """``count`` minima of universal hashes (a x + b mod 2**64, high half kept)."""

    def __init__(self, count: int, seed: int = 1):
        draw = np.random.default_rng(seed)
        self.a = draw.integers(0, 1 << 63, count, np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
        self.b = draw.integers(0, 1 << 63, count, np.uint64)[:, None]

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        low = None
        for i in range(0, len(shingles), 2048):
            h = shingles[None, i : i + 2048] * self.a
            h += self.b
            m = h.min(axis=1)
            low = m if low is None else np.minimum(low, m)
        return (low >> np.uint64(32)).astype("<u4")


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())
