"""Whole-text tokenization with the tokenizers library, one distinct chunk at a time.

Both vocabularies used here split a text by a pattern before any merge, so the ids of a text are the ids
of its chunks in order.  Corpora repeat their chunks: each is encoded once and kept in a bounded cache,
the new ones of a block of texts together in one call of the library.  The pattern is applied here only to
texts of Latin letters up to U+024F, whose classes are the same in every version of Unicode; any other
text goes to the library whole, and so does a text that holds the content of an added token, such as
``<|endoftext|>``, which the library takes for that token before it splits.  A vocabulary that splits a probe text in
another way than by these two patterns gives every text to the library whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
from tokenizers import Tokenizer

from . import caches

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism

#: Chunks a worker keeps: half of them in the cache in use, half in the one before it.
CACHE_CHUNKS = 600_000
#: Characters of text whose unknown chunks are encoded together.
BLOCK_CHARS = 1 << 20
#: New chunks that go to the library as one text.
LOT_CHUNKS = 64

#: What a text of the quick way has none of (U+0130 grows when put in lower case).
_ODD = re.compile("[^\t\n\r -~¡-¬®-įı-ɏ]")


def _class(kind: str) -> str:
    """The characters of a general category up to U+024F, for a bracket of a pattern."""
    return "".join(re.escape(chr(i)) for i in range(0x250) if unicodedata.category(chr(i))[0] == kind)


_L, _N, _S = _class("L"), _class("N"), " \\t\\n\\r"
_SUFFIXES = "'s|'t|'re|'ve|'m|'ll|'d"
#: A blank belongs to the chunk after it; of a longer run only its last blank does.
_WITH_SPACE = re.compile(rf"{_SUFFIXES}| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_WITHOUT_SPACE = re.compile(rf"{_SUFFIXES}|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")


#: Chunks of every kind side by side; a vocabulary that isn't split by the patterns gives other ids for its chunks.
_PROBE = (
    " It's  we'll'd THEY'RE I'm o'clock   12 3456 7.5e10 a1b2 x_y-z (ok)?! ... end.\n\n\tTab \r\n line  \n  lead",
    "àÉß ŒuvreŊ 1½²³ «q» ¿qué? naïve façade\n \n x\n\ny  z ",
    "a  b   c    d\t\te\n\n\nf 's't ' t'' \"'s\" --'ll--",
)


class Encoder:
    """``encode_many(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, cache_chunks: int = CACHE_CHUNKS):
        self.library = Tokenizer.from_file(path)
        added = {t.content for t in self.library.get_added_tokens_decoder().values()}
        # In any case of letters, as the library may look for a token after it has put the text in lower case.
        self.added = re.compile("|".join(map(re.escape, sorted(added))) or r"(?!)", re.I)
        self.cache_chunks = cache_chunks
        self.cache: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        spec = self.library.pre_tokenizer.__getstate__() if self.library.pre_tokenizer else ""
        self.drops_space = '"Removed"' in (spec.decode() if isinstance(spec, bytes) else str(spec))
        # Between chunks: text that is one id, which no chunk has, and that touches no chunk's merges.
        self.between, mark = (" \x01 ", "\x01") if self.drops_space else ("\n", "\n")
        ids = self.library.encode(mark, add_special_tokens=False).ids
        self.mark = ids[0] if len(ids) == 1 else None
        self.by_chunks = True
        self.by_chunks = self._block(list(_PROBE)) == [self.whole(t) for t in _PROBE]
        self.cache, self.before = {}, {}

    def whole(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, chunks: list[str]) -> None:
        """Put chunks into the cache, many in one call of the library."""
        rest = [] if self.mark is None else [c for c in chunks if not c.isspace()]
        if len(rest) < len(chunks):
            self.cache.update((c, self.whole(c)) for c in chunks if not rest or c.isspace())
        lots = [rest[k : k + LOT_CHUNKS] for k in range(0, len(rest), LOT_CHUNKS)]
        for lot, got in zip(lots, self.library.encode_batch_fast([self.between.join(lot) for lot in lots], add_special_tokens=False), strict=True):
            ids = np.asarray(got.ids, dtype="<u4")
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) != len(lot) - 1:
                self.cache.update((c, self.whole(c)) for c in lot)
                continue
            raw = ids.tobytes()
            starts, ends = (4 * np.concatenate([[0], cuts + 1])).tolist(), (4 * np.concatenate([cuts, [len(ids)]])).tolist()
            self.cache.update(zip(lot, (raw[a:b] for a, b in zip(starts, ends, strict=True)), strict=True))

    def _split(self, text: str) -> list[str]:
        return _WITHOUT_SPACE.findall(text.lower()) if self.drops_space else _WITH_SPACE.findall(text)

    def _block(self, texts: list[str | None]) -> list[bytes]:
        if len(self.cache) > self.cache_chunks // 2:  # what isn't met again until the next turn goes
            self.before, self.cache = self.cache, {}
        get, before = self.cache.get, self.before
        found: list[list[bytes] | None] = []
        new: dict[str, None] = {}
        holes: list[tuple[list[bytes], int, str]] = []
        for t in texts:
            if t and (not self.by_chunks or _ODD.search(t) or self.added.search(t)):
                found.append(None)
                continue
            chunks = self._split(t) if t else []
            ids = list(map(get, chunks))
            k = -1
            for _ in range(ids.count(None)):
                k = ids.index(None, k + 1)
                c = chunks[k]
                old = before.get(c)
                if old is None:
                    new[c] = None
                    holes.append((ids, k, c))
                else:
                    self.cache[c] = ids[k] = old
            found.append(ids)
        if new:
            self._learn(list(new))
        for ids, k, c in holes:
            ids[k] = self.cache[c]
        return [self.whole(t) if ids is None else b"".join(ids) for t, ids in zip(texts, found, strict=True)]

    def encode_many(self, texts) -> Iterator[bytes]:
        held, size = [], 0
        for t in texts:
            held.append(t)
            size += len(t) if t else 0
            if size >= BLOCK_CHARS:
                yield from self._block(held)
                held, size = [], 0
        yield from self._block(held)

    def encode(self, text: str | None) -> bytes:
        return self._block([text])[0]


def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary file."""
    return caches.claim(f"encoder {path}", lambda: Encoder(path))


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
