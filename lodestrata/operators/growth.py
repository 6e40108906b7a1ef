"""Triples and quadruples grown from edges, and every support's ball with its points, a box of edges at a time.

An edge is the longest of its supports, so by Jung's bound their balls reach no farther from its end u than
sqrt(1.5) times its length.  Edges are dealt by the box of u as wide as that, in lots, and a lot meets the points of the 27 boxes
around: nothing but the points near a box and a lot of edges is held at once, and no tuple leaves the task unless it is a support
of the rank asked for.  All that decides is in integers: of 64 bits where they hold it, else of any length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Entries of a table of tuples by points that are looked at together.
TABLE = 1 << 20

SCHEMA = "cloud long, label array<long>, num long, den long, interior array<long>, shell array<long>"
_ARROW = pa.schema([("cloud", pa.int64()), ("label", pa.list_(pa.int64())), ("num", pa.int64()), ("den", pa.int64()), ("interior", pa.list_(pa.int64())), ("shell", pa.list_(pa.int64()))])


def _lifted(e: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """``D`` and the numerators ``m`` of circumcentres ``sum of m e / (2 D)`` of 0 and two or three points ``e``, tuple by tuple."""
    g = [[(a * b).sum(axis=-1) for b in e] for a in e]
    if len(e) == 2:
        (p, r), (_, q) = g
        return p * q - r * r, [q * (p - r), p * (q - r)]
    (a, b, c), (_, d, f), (_, _, h) = g
    adj = [[d * h - f * f, c * f - b * h, b * f - c * d], [c * f - b * h, a * h - c * c, b * c - a * f], [b * f - c * d, b * c - a * f, a * d - b * b]]
    return a * adj[0][0] + b * adj[0][1] + c * adj[0][2], [r[0] * a + r[1] * d + r[2] * h for r in adj]


def _centred(big: np.ndarray, m: list[np.ndarray]) -> np.ndarray:
    ok = (big > 0) & (2 * big - sum(m) > 0)
    for x in m:
        ok &= x > 0
    return ok.astype(bool)


def _powers(big: np.ndarray, m: list[np.ndarray], e: list[np.ndarray], at: np.ndarray, a2: np.ndarray) -> np.ndarray:
    """Tuples by points: below 0 inside the ball, 0 on it."""
    out = big[:, None] * a2[None]
    for x, y in zip(m, e, strict=True):
        out -= (x[:, None] * y) @ at.T
    return out


def edge_supports(v: int, e: np.ndarray, u: int, ids: np.ndarray, at: np.ndarray, a2: np.ndarray, most: int, largest: int) -> Iterator[tuple[list[int], int, int, np.ndarray]]:
    """``(members, num, den, powers)`` of the well-centred supports whose longest edge is (u, v) and whose rank may be ``most``.

    ``e``: v from u; ``ids, at, a2``: the points up to sqrt(1.5) edges from u (u and v too), from u, and their squared distances;
    ``num / den`` is not in lowest terms."""
    l2, dot = int(a2[ids == v][0]), at @ e
    pair = a2 - dot
    if (pair < 0).sum() + 2 <= most:
        yield [u, v], l2, 4, pair
    if largest < 3 or most < 3:
        return
    # Points no farther from either end, and those in the spindle of every ball.
    b2 = a2 - 2 * dot + l2
    lens = (a2 <= l2) & (b2 <= l2) & (ids != u) & (ids != v)
    high, x = dot[lens].astype(float), a2[lens].astype(float)
    if ((high > x) & (2 * (high - x) ** 2 > (l2 * x - high * high) * (1 + 1e-9) + 1e-3)).sum() > most - 3:
        return
    # As long an edge comes before (u, v) if its ends do.
    before = lambda a, b: (np.minimum(a, b) < u) | ((np.minimum(a, b) == u) & (np.maximum(a, b) < v))
    lens &= ((a2 < l2) | before(u, ids)) & ((b2 < l2) | before(v, ids))
    own = np.flatnonzero(lens)
    if not own.size:
        return
    w = at[own]
    first = np.broadcast_to(e, w.shape)
    big, m = _lifted([first, w])
    some = np.flatnonzero(big > 0)
    own, w, first, big, m = own[some], w[some], first[some], big[some], [x[some] for x in m]
    raw = m[0] * l2 + m[1] * a2[own]
    centred, faces, step = _centred(big, m), [], max(1, TABLE // len(ids))
    (x, y, z), (a, b, c) = e.astype(float), w.astype(float).T
    normal = np.stack([y * c - z * b, z * a - x * c, x * b - y * a], axis=1)
    spare = 0.375 * l2 - raw.astype(float) / (4.0 * big.astype(float))
    for lo in range(0, len(own), step):
        k = slice(lo, lo + step)
        powers = _powers(big[k], [x[k] for x in m], [first[k], w[k]], at, a2)
        for i in np.flatnonzero(centred[k] & ((powers < 0).sum(axis=1) + 3 <= most)):
            yield [u, v, int(ids[own[lo + i]])], int(raw[lo + i]), 4 * int(big[lo + i]), powers[i]
        if largest > 3 and most > 3:
            # A ball of four through the face has its centre on the face's normal, within what Jung's bound leaves: points that are in all of them.
            reach, size = np.sqrt(np.maximum(spare[k], 0)), big[k].astype(float)
            height = np.abs(normal[k] @ at.T.astype(float))
            sure = powers.astype(float) / size[:, None] + (2 * reach / np.sqrt(size))[:, None] * height < -1e-6 * (1 + l2)
            faces.append(lo + np.flatnonzero((spare[k] > -1e-9 * l2) & (sure.sum(axis=1) <= most - 4)))
    if not faces or (n := len(faces := np.concatenate(faces))) < 2:
        return
    for lo in range(0, n, rows := max(1, TABLE // n)):
        i, j = np.nonzero(np.arange(lo, min(n, lo + rows))[:, None] < np.arange(n)[None])
        i, j = faces[i + lo], faces[j]
        c2 = ((w[i] - w[j]) ** 2).sum(axis=1)
        a, b = ids[own[i]], ids[own[j]]
        ok = ((c2 < l2) | ((c2 == l2) & before(a, b))).astype(bool)
        i, j = i[ok], j[ok]
        tuples = [np.broadcast_to(e, (len(i), 3)), w[i], w[j]]
        big4, m4 = _lifted(tuples)
        ok = _centred(big4, m4)
        i, j, big4, m4, tuples = i[ok], j[ok], big4[ok], [x[ok] for x in m4], [t[ok] for t in tuples]
        raw4 = m4[0] * l2 + m4[1] * a2[own[i]] + m4[2] * a2[own[j]]
        for at_ in range(0, len(i), step):
            k = slice(at_, at_ + step)
            powers = _powers(big4[k], [x[k] for x in m4], [t[k] for t in tuples], at, a2)
            for r in np.flatnonzero((powers < 0).sum(axis=1) + 4 <= most):
                yield [u, v, int(ids[own[i[at_ + r]]]), int(ids[own[j[at_ + r]]])], int(raw4[at_ + r]), 4 * int(big4[at_ + r]), powers[r]


def grown(most: int, largest: int):
    """For a cogroup of ``cloud, u, v`` with their coordinates and ``id, x, y, z`` around: rows of ``SCHEMA``."""

    def run(edges: pa.Table, near: pa.Table) -> pa.Table:
        rows: dict[str, list] = {n: [] for n in _ARROW.names}
        take = lambda t, *names: np.stack([t.column(n).to_numpy() for n in names], axis=1)
        if edges.num_rows:
            cloud, u, v, ids = edges.column("cloud")[0].as_py(), edges.column("u").to_numpy(), edges.column("v").to_numpy(), near.column("id").to_numpy()
            start, end, all_at = take(edges, "u_x", "u_y", "u_z"), take(edges, "v_x", "v_y", "v_z"), take(near, "x", "y", "z")
            l2 = ((end - start) ** 2).sum(axis=1)
            order = np.lexsort((l2, u))
            firsts = np.flatnonzero(np.r_[True, u[order][1:] != u[order][:-1]])
            for lo, hi in zip(firsts, np.r_[firsts[1:], len(order)], strict=True):
                own = order[lo:hi]
                at = all_at - start[own[0]]
                d2 = (at * at).sum(axis=1)
                by = np.flatnonzero(2 * d2 <= 3 * l2[own[-1]])
                by = by[np.argsort(d2[by], kind="stable")]
                at, d2, names = at[by], d2[by], ids[by]
                for k in own:
                    n = np.searchsorted(d2, 3 * l2[k] // 2, "right")
                    kind = np.int64 if 32 * int(l2[k]) ** max(2, largest) < 2**62 else object
                    e = (end[k] - start[k]).astype(kind)
                    for members, num, den, powers in edge_supports(int(v[k]), e, int(u[k]), names[:n], at[:n].astype(kind, copy=False), d2[:n].astype(kind, copy=False), most, largest):
                        g = math.gcd(num, den)
                        for name, value in zip(_ARROW.names, (cloud, sorted(members), num // g, den // g, np.sort(names[:n][powers < 0]).tolist(), np.sort(names[:n][powers == 0]).tolist()), strict=True):
                            rows[name].append(value)
        return pa.Table.from_pydict(rows, _ARROW)

    return run
