"""Main text of web pages: nearest-URL page differencing over structurally marked lines.

Pages are sorted by host and URL path; each is compared with the nearest two on either side, where pages that have
most of its text are passed over: they are copies of it, and what it shares with them is its article.  The text lines
of both (one per block element) are aligned by longest common subsequence, and lines that a page shares with one
of its neighbours are template text and go.

Two things the differences can't tell, and the markup does.  Lines inside ``article`` or ``main`` are the article,
so they stay though another page repeats them; lines inside menus, headers, footers, sidebars, notices, adverts, forms
and reader comments are none, so they go though no other page has them.  Every other line is decided by differencing.
A page that has no other neighbour keeps all its unmarked lines, unless it has an article element: then only that.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from copy import copy
from itertools import accumulate, islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

#: Rows of pages dealt to one task.
TASK_PAGES = 4000
#: A page that holds this share of the characters of another's lines, those left out aside, is its copy.
COPY_SHARE = 0.7
#: Pages that a page is compared with on either side, and runs of copies that are passed over to find them.
SIDES, MOST_RUNS = 2, 64
#: Bytes of alignment rows held at once; longer alignments are halved.
ALIGN_BYTES = 32 << 20
#: Rows of results given at a time.
RESULT_ROWS = 256

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_RAW = frozenset("script style noscript template iframe svg math textarea title xmp noembed noframes".split())
#: Raw elements that a slash closes at once.
_EMPTY = frozenset(("svg", "math"))
_OUT = frozenset("nav header footer aside form menu dialog button select option label fieldset legend head".split())
_MAIN = frozenset(("article", "main"))
#: What a class or id says of an element by its last part, as in "cookie-notice"; by the part before where the last only places it, as in "sidebar-left".
_OUT_NAMES = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo banner cookie cookies consent gdpr notice notices popup modal overlay comment comments respond disqus sidebar menu nav navbar navigation breadcrumb breadcrumbs share social related newsletter subscribe signup login search footer header masthead toolbar pagination skip".split()
)
_PLACES = frozenset(
    "area banner bar block body box buttons column container content form group holder icons inner item items left link links list main outer panel posts primary right secondary section slot stories top bottom unit widget widgets wrap wrapper".split()
)
#: Parts that make a name say something of an element's state or surroundings: "no-sidebar", "has-comments".
_STATES = frozenset("has have no not with without is are hide show enable disable".split())
#: Elements that hold the page or its article: their names never leave them out.
_HOLDERS = frozenset("html body article main".split())
_OUT_ROLE = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
_OPEN = re.compile(r"<(?=[!?/a-zA-Z])")
_REMARK = r"<!--.*?(?:-->|$)|<(?:[!?]|/(?![a-zA-Z]))[^>]*+>?|"
#: Comment, declaration, or tag.  A value in quotes may hold ">"; a quote elsewhere is a character like others.
_TOKEN = re.compile(_REMARK + r"<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)>", re.S)
#: The same where a quote is never closed: a tag ends at the next ">".
_PLAIN = re.compile(_REMARK + r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
#: Name and value, one after the other, so that no value is read as a name.
_ATTRIBUTE = re.compile(r"([^\s/>=]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PATH_PARTS = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)([^?#]*)"


def _out_name(name: str) -> bool:
    """Whether a class or id names an element that is no main text."""
    parts = [p for p in re.split(r"[-_]+", name.lower()) if p]
    if not _STATES.isdisjoint(parts[:-1]):
        return False
    if parts[-2:] == ["side", "bar"]:
        return True
    while len(parts) > 1 and parts[-1] not in _OUT_NAMES and (parts[-1] in _PLACES or parts[-1].isdigit()):
        parts.pop()
    return bool(parts) and parts[-1] in _OUT_NAMES


def _left_out(tag: str, attributes: str, inside: bool) -> bool:
    if tag in _OUT and not (inside and tag == "header"):  # the header of an article is its headline
        return True
    for name, a, b, c in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), a or b or c
        if name == "role" and value.lower() in _OUT_ROLE or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name in ("class", "id") and tag not in _HOLDERS and any(_out_name(x) and not (inside and x.lower().endswith("header")) for x in value.split()):
            return True
    return False


def lines_of(page: str | None) -> list[tuple[str, bool, bool]]:
    """``(text, in the article, left out by the markup)`` of each non-empty block, in page order.

    Text of inline elements that the markup leaves out is a line of its own, after the rest of its block."""
    page = page or ""
    lines: list[tuple[str, bool, bool]] = []
    parts: tuple[list[str], list[str]] = [], []  # of this block, and what is left out of it
    stack: list[tuple[str, bool, bool]] = []
    blocks: list[int] = []  # places of block elements in the stack
    open_tags: Counter = Counter()
    inside = out = False
    at, token = 0, _TOKEN
    last = page.rfind(">") + 1

    def close_block() -> None:
        for part, gone in zip(parts, (False, True), strict=True):
            if part:
                text = " ".join("".join(part).split())
                part.clear()
                if text:
                    lines.append((text, inside, gone))

    def close_from(k: int) -> None:
        nonlocal inside, out
        _, inside, out = stack[k]
        for name, _, _ in stack[k:]:
            open_tags[name] -= 1
        del stack[k:]
        while blocks and blocks[-1] >= k:
            blocks.pop()

    while True:
        start = _OPEN.search(page, at)
        m = token.match(page, start.start()) if start else None
        if start and not m and token is _TOKEN and start.start() < last:
            token = _PLAIN
            continue
        raw = page[at : start.start()] if start else page[at:]
        if raw:
            parts[out].append(html.unescape(raw) if "&" in raw else raw)
        if not m:  # the page ends here, or within a tag
            break
        at = m.end()
        slash, tag, attributes = m[1], (m[2] or "").lower(), m[3]
        if not tag:
            continue
        if tag in _BLOCK:
            close_block()
        elif tag == "br":
            parts[out].append(" ")
        if slash:
            if open_tags[tag] > 0:
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                close_from(k)
        elif tag in _EMPTY and attributes.endswith("/"):
            pass
        elif tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in _VOID and not attributes.endswith("/"):
            if tag == "p" and blocks and stack[blocks[-1]][0] == "p":  # a paragraph ends where the next begins
                close_from(blocks[-1])
            if tag in _BLOCK:
                blocks.append(len(stack))
            open_tags[tag] += 1
            stack.append((tag, inside, out))
            out = out or _left_out(tag, attributes, inside)
            inside = inside or tag in _MAIN
    close_block()
    return lines


def _rows(a: list[int], where: dict[int, int], m: int, keep: bool) -> list[int]:
    """Bit rows of the alignment of ``a`` with m lines: after each line of a (or the last only), a zero at j where
    the longest common subsequence with the first j + 1 lines is longer than with the first j."""
    v, full = (1 << m) - 1, (1 << m) - 1
    rows = [v]
    for x in a:
        u = v & where.get(x, 0)
        v = (v + u | v - u) & full
        if keep:
            rows.append(v)
    return rows if keep else [v]


def _places(b: list[int]) -> dict[int, int]:
    where: dict[int, bytearray] = {}
    for j, y in enumerate(b):
        where.setdefault(y, bytearray(len(b) + 7 >> 3))[j >> 3] |= 1 << (j & 7)
    return {y: int.from_bytes(x, "little") for y, x in where.items()}


def _lengths(row: int, m: int) -> list[int]:
    """Lengths of the longest common subsequence with the first 0, 1, ... m lines."""
    bits = bin(row | 1 << m)[:2:-1]  # the lowest first
    return list(accumulate((c == "0" for c in bits), initial=0))


def _increasing(a: list[int], b: list[int]) -> Iterator[int]:
    """Places in ``a`` of a longest common subsequence with ``b``, in time of the pairs of equal lines: few here."""
    where: dict[int, list[int]] = {}
    for j, y in enumerate(b):
        where.setdefault(y, []).append(j)
    tails: list[int] = []
    ends: list[tuple] = []
    for i, x in enumerate(a):
        for j in reversed(where[x]):
            k = bisect_left(tails, j)
            tails[k : k + 1], ends[k : k + 1] = [j], [(i, ends[k - 1] if k else None)]
    link = ends[-1] if ends else None
    while link:
        yield link[0]
        link = link[1]


def _align(a: list[int], b: list[int], first: int) -> Iterator[int]:
    """Places in ``a`` (numbered from ``first``) of a longest common subsequence with ``b``."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        yield first + lo
        lo += 1
    a, b, first = a[lo:], b[lo:], first + lo
    hi = 0
    while hi < min(len(a), len(b)) and a[len(a) - 1 - hi] == b[len(b) - 1 - hi]:
        hi += 1
        yield first + len(a) - hi
    a, b = a[: len(a) - hi], b[: len(b) - hi]
    known, there = set(a), set(b)
    at = [i for i, x in enumerate(a) if x in there]
    a, b = [a[i] for i in at], [y for y in b if y in known]
    n, m = len(a), len(b)
    if not n or not m:
        return
    times, again = Counter(a), Counter(b)
    if sum(k * again[x] for x, k in times.items()) <= 4 * (n + m):
        yield from (first + at[i] for i in _increasing(a, b))
        return
    if n > 1 and n * m > 8 * ALIGN_BYTES:
        half = n // 2
        left = _lengths(_rows(a[:half], _places(b), m, False)[0], m)
        right = _lengths(_rows(a[:half - 1 : -1], _places(b[::-1]), m, False)[0], m)
        cut = max(range(m + 1), key=lambda j: left[j] + right[m - j])
        for k in (*_align(a[:half], b[:cut], 0), *_align(a[half:], b[cut:], half)):
            yield first + at[k]
        return
    rows = _rows(a, _places(b), m, True)
    i, j = n, m
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            yield first + at[i]


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """The lines of ``a`` on a longest common subsequence with ``b`` (by increasing runs of equal
    lines where these are few, else by bit rows, a machine word for 64 lines of ``b``)."""
    number: dict[str, int] = {}
    x, y = ([number.setdefault(line, len(number)) for line in lines] for lines in (a, b))
    return set(_align(x, y, 0))


def main_text(lines: list[tuple[str, bool, bool]], shared: set[int] | None) -> str:
    """The lines that stay; ``shared`` is None for a page that could not be compared."""
    alone = shared is None and any(inside and not out for _, inside, out in lines)
    return "\n".join(text for i, (text, inside, out) in enumerate(lines) if not out and (inside or not alone and i not in (shared or ())))


class _Page:
    """A page of a host: its row, its lines, and how often it has each line that is not left out."""

    __slots__ = ("path", "page_id", "url", "lines", "own", "size")

    def __init__(self, path: str, page_id, url: str | None, lines: list[tuple[str, bool, bool]]):
        self.path, self.page_id, self.url, self.lines = path, page_id, url, lines
        self.own = Counter(text for text, _, out in lines if not out)
        self.size = sum(len(text) * n for text, n in self.own.items())

    def copied_by(self, other: _Page) -> bool:
        if self.lines is other.lines:
            return self.size > 0
        there = other.own.get
        return 0 < COPY_SHARE * self.size <= sum(len(text) * min(n, there(text, 0)) for text, n in self.own.items())


def _results(pages: list[_Page]) -> Iterator[tuple]:
    """The results of a host's pages, in order."""
    first: list[int] = []  # of each run of copies of its first page
    run: list[int] = []
    for i, p in enumerate(pages):
        if not first or not p.copied_by(pages[first[-1]]):
            first.append(i)
        run.append(len(first) - 1)

    def nearest(p: _Page, others: Iterable[int]) -> Iterator[_Page]:
        return islice((pages[i] for i in others if not p.copied_by(pages[i])), SIDES)

    for i, p in enumerate(pages):
        k = run[i]
        # The pages beside it, then of the runs around its own each by its page that lies nearest.
        before = nearest(p, dict.fromkeys((*range(i - 1, max(i - 1 - SIDES, -1), -1), *(first[j] - 1 for j in range(k, max(k - MOST_RUNS, 0), -1)))))
        after = nearest(p, dict.fromkeys((*range(i + 1, min(i + 1 + SIDES, len(pages))), *first[k + 1 : k + 1 + MOST_RUNS])))
        others = [*before, *after]
        own = [x[0] for x in p.lines]
        shared = set().union(*(shared_lines(own, [x[0] for x in q.lines]) for q in others or pages[max(i - 1, 0) : i] + pages[i + 1 : i + 2]))
        text = main_text(p.lines, shared if others else None)
        yield p.page_id, p.url, text, len(text), len(shared)


def _extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by host and path; the pages of a host wait for its last one."""

    def results() -> Iterator[tuple]:
        held: list[_Page] = []
        at, last = None, None
        for frame in frames:
            for host, path, page, url, page_html in zip(frame["host"], frame["path"], frame["page_id"], frame["url"], frame["html"], strict=True):
                if host != at:
                    yield from _results(held)
                    held, at, last = [], host, None
                if held and page_html == last:  # equal pages share their lines
                    held.append(copy(held[-1]))
                    held[-1].path, held[-1].page_id, held[-1].url = path, page, url
                else:
                    held.append(_Page(path, page, url, lines_of(page_html)))
                last = page_html
        yield from _results(held)

    rows = results()
    while lot := list(islice(rows, RESULT_ROWS)):
        yield pd.DataFrame(lot, columns=["page_id", "url", "text", "n_chars", "n_shared"], dtype=object)


def extract_main_text(pages: DataFrame, task_pages: int = TASK_PAGES) -> DataFrame:
    """Per page ``page_id, url, text, n_chars, n_shared`` (lines it shares with the pages it is compared with, or with
    those beside it if all are copies).

    A null html is an empty page with an empty text; pages without a url form a host of their own.  A page at
    the edge of a task's range is compared with its neighbours inside the range.  One that is alone there, or has nothing
    but copies (or more than 64 runs of copies) on both sides, keeps its article element or else all its unmarked lines.
    Repeated rows are pages of their own, other columns are ignored.  An empty table gives no rows.
    """
    store.small_batches(pages.sparkSession)
    url = F.coalesce("url", F.lit(""))
    keyed = pages.select(
        F.regexp_extract(url, _PATH_PARTS, 1).alias("host"), F.regexp_extract(url, _PATH_PARTS, 2).alias("path"), F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.col("html")
    )
    n = max(1, -(-pages.count() // task_pages))
    ordered = keyed.repartitionByRange(n, "host", "path", "page_id").sortWithinPartitions("host", "path", "page_id")
    return store.map_frames(ordered, _extract, "page_id long, url string, text string, n_chars long, n_shared long")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_main_text(store.spark_table(spark, sf_dir, "pages"))
