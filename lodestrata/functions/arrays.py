"""Vectorised functions over small arrays, for pandas UDFs and grouped maps: balls, assignment, transport."""

from __future__ import annotations

import numpy as np


def enclosing_ball(points: np.ndarray) -> tuple[np.ndarray, float]:
    """Smallest enclosing ball (centre, squared radius) in any dimension, by moving to the front (Welzl)."""
    p = np.asarray(points, float)
    if not len(p):
        return np.zeros(p.shape[1] if p.ndim == 2 else 0), 0.0

    def through(on: list[np.ndarray]) -> tuple[np.ndarray, float]:
        if not on:
            return p[0], -1.0
        e = np.stack(on[1:]) - on[0] if len(on) > 1 else np.zeros((0, p.shape[1]))
        shift = np.linalg.lstsq(e, 0.5 * (e * e).sum(1), rcond=None)[0] if len(e) else np.zeros(p.shape[1])
        return on[0] + shift, float(shift @ shift)

    def solve(n: int, on: list[np.ndarray], order: list[int]) -> tuple[np.ndarray, float]:
        c, r2 = through(on)
        if len(on) == p.shape[1] + 1:
            return c, r2
        i = 0
        while i < n:
            x = p[order[i]]
            if (x - c) @ (x - c) > r2 * (1 + 1e-12) + 1e-15:
                c, r2 = solve(i, [*on, x], order)
                order.insert(0, order.pop(i))
            i += 1
        return c, r2

    return solve(len(p), [], list(range(len(p))))


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Least-cost assignment of rows to columns (as many pairs as the shorter side), by shortest augmenting paths.

    Rows whose cheapest columns differ are assigned at once; only the others look for a path, and what a path says of prices
    is taken in when it is found."""
    turned = cost.shape[0] > cost.shape[1]
    c = np.ascontiguousarray(cost.T if turned else cost, float)
    n, m = c.shape
    if not n:
        return []
    u, v, owner, own = c.min(axis=1), np.zeros(m), np.full(m, -1), np.full(n, -1)
    columns, rows = np.unique(c.argmin(axis=1), return_index=True)
    owner[columns], own[rows] = rows, columns
    for start in np.flatnonzero(own < 0):
        least, way, open_ = np.full(m, np.inf), np.full(m, -1), np.zeros(m)  # open_: infinite where a column is done
        i, far, rows, done = start, 0.0, [start], []
        while True:
            slack = c[i] - v
            slack += far - u[i] + open_
            better = slack < least
            np.copyto(least, slack, where=better)
            way[better] = i
            j = int((least + open_).argmin())
            far = least[j]
            if owner[j] < 0:
                break
            open_[j] = np.inf
            done.append(j)
            i = owner[j]
            rows.append(i)
        u[start] += far
        u[rows[1:]] += far - least[done]
        v[done] -= far - least[done]
        while True:
            i = way[j]
            owner[j] = i
            own[i], j = j, own[i]
            if i == start:
                break
    pairs = list(enumerate(own.tolist()))
    return sorted((b, a) if turned else (a, b) for a, b in pairs)


def sparse_assignment(n: int, m: int, rows: np.ndarray, columns: np.ndarray, gain: np.ndarray) -> list[tuple[int, int]]:
    """The matching of most gain among some pairs of ``n`` rows and ``m`` columns (gains are positive, pairs in order of rows): as
    :func:`assignment` of the whole table with gains turned to costs and 0 for all other pairs, without these.

    A row may stay free at cost 0, so a shortest path ends at a free column or at a row that gives its column up."""
    ends = np.searchsorted(rows, np.arange(n + 1))
    u, v, owner, own = np.zeros(n), np.zeros(m), np.full(m, -1), np.full(n, -1)
    np.minimum.at(u, rows, -gain)
    for k in np.flatnonzero(-gain == u[rows]):
        if own[rows[k]] < 0 and owner[columns[k]] < 0:
            own[rows[k]], owner[columns[k]] = columns[k], rows[k]
    least, way, open_ = np.full(m, np.inf), np.full(m, -1), np.zeros(m)
    for start in np.flatnonzero((own < 0) & (ends[1:] > ends[:-1])):
        i, far, tree, done, seen = start, 0.0, [start], [], []
        give, giver = np.inf, -1  # the shortest way that ends with a row set free
        while True:
            if far - u[i] < give:
                give, giver = far - u[i], i
            at = slice(ends[i], ends[i + 1])
            c = columns[at]
            slack = (far - u[i]) - gain[at] - v[c] + open_[c]
            better = slack < least[c]
            c = c[better]
            least[c], way[c] = slack[better], i
            seen.append(c)
            front = np.concatenate(seen)
            front = front[open_[front] == 0]
            seen = [front]
            j = int(front[least[front].argmin()]) if len(front) else -1
            if j < 0 or give <= least[j]:
                far, j = give, -1
                break
            far = least[j]
            if owner[j] < 0:
                break
            open_[j] = np.inf
            done.append(j)
            i = owner[j]
            tree.append(i)
        u[start] += far
        u[tree[1:]] += far - least[done]
        v[done] -= far - least[done]
        i = giver
        if j < 0:
            own[i], j = -1, own[i]
        else:
            i = -1
        while i != start:
            i = way[j]
            owner[j] = i
            own[i], j = j, own[i]
        least[front], open_[done] = np.inf, 0
        least[done] = np.inf
    return [(i, int(k)) for i, k in enumerate(own) if k >= 0]


def sparse_transport(n: int, m: int, rows: np.ndarray, columns: np.ndarray, cost: np.ndarray, blur: float, reach: float, rounds: int = 15) -> np.ndarray:
    """:func:`unbalanced_transport` between ``n`` and ``m`` unit masses where only some pairs are allowed: the plan at these."""
    kernel, power = np.exp(-cost / blur), reach / (reach + blur)
    u, v = np.ones(n), np.ones(m)
    for _ in range(rounds):
        s = np.bincount(rows, kernel * v[columns], n)
        u = np.where(s > 0, (1 / np.maximum(s, 1e-300)) ** power, 0.0)
        s = np.bincount(columns, kernel * u[rows], m)
        v = np.where(s > 0, (1 / np.maximum(s, 1e-300)) ** power, 0.0)
    return u[rows] * kernel * v[columns]


def gated(a: np.ndarray, b: np.ndarray, gate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(rows, columns, squared distances)`` of the points of ``a`` and ``b`` within a distance, by columns of cells as wide."""
    cells = lambda p: np.floor(p[:, :2] / gate).astype(np.int64)
    order = np.lexsort((b[:, 1], *cells(b).T[:1]))
    low, at = cells(b)[order, 0], b[order]
    found = []
    for shift in (-1, 0, 1):
        own = cells(a)[:, 0] + shift
        begin, end = np.searchsorted(low, own), np.searchsorted(low, own, "right")
        for x in np.unique(own[end > begin]):
            mine = np.flatnonzero(own == x)
            k = slice(begin[mine[0]], end[mine[0]])
            lo = np.searchsorted(at[k, 1], a[mine, 1] - gate * (1 + 1e-9))
            n = np.searchsorted(at[k, 1], a[mine, 1] + gate * (1 + 1e-9), "right") - lo
            r = np.repeat(mine, n)
            c = k.start + np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            d2 = ((a[r] - at[c]) ** 2).sum(axis=1)
            on = d2 <= gate * gate
            found.append((r[on], order[c[on]], d2[on]))
    rows, columns, d2 = (np.concatenate([f[i] for f in found]) if found else np.empty(0, (np.int64, np.int64, float)[i]) for i in range(3))
    by = np.lexsort((columns, rows))
    return rows[by], columns[by], d2[by]


def unbalanced_transport(a: np.ndarray, b: np.ndarray, cost: np.ndarray, blur: float, reach: float, rounds: int = 15) -> np.ndarray:
    """Entropic transport plan with marginals relaxed by a Kullback-Leibler penalty ``reach``; infinite costs forbid."""
    kernel = np.where(np.isfinite(cost), np.exp(-np.where(np.isfinite(cost), cost, 0) / blur), 0.0)
    power = reach / (reach + blur)
    u, v = np.ones(len(a)), np.ones(len(b))
    for _ in range(rounds):
        u = np.where((s := kernel @ v) > 0, (a / np.maximum(s, 1e-300)) ** power, 0.0)
        v = np.where((s := kernel.T @ u) > 0, (b / np.maximum(s, 1e-300)) ** power, 0.0)
    return u[:, None] * kernel * v[None, :]


def divergence(x: np.ndarray, y: np.ndarray) -> float:
    """Generalised Kullback-Leibler divergence of two measures: the sum of x log(x / y) - x + y, with its limits: y where x
    is 0, infinite where y is 0 and x is not."""
    with np.errstate(divide="ignore", invalid="ignore"):
        logs = np.where(x > 0, x * np.log(x / y), 0.0)
    return float((logs + (y - x)).sum())


def transport_cost(plan: np.ndarray, cost: np.ndarray, a: np.ndarray, b: np.ndarray, reach: float) -> float:
    """What a plan costs: mass times cost, and ``reach`` times the divergences of its marginals from ``a`` and ``b``.
    A forbidden way (of infinite cost) costs nothing if nothing goes there."""
    carried = float(np.multiply(plan, cost, where=plan > 0, out=np.zeros(plan.shape)).sum())
    return carried + reach * sum(divergence(plan.sum(axis=k), y) for k, y in ((1, a), (0, b)))


def spectral_coordinates(weights: np.ndarray, dimensions: int) -> np.ndarray:
    """Leading non-trivial eigenvectors of the symmetrically normalised graph, signs fixed by the largest entry."""
    d = np.maximum(weights.sum(1), 1e-12)
    values, vectors = np.linalg.eigh(np.eye(len(d)) - weights / np.sqrt(d[:, None] * d[None, :]))
    out = (vectors / np.sqrt(d)[:, None])[:, 1 : dimensions + 1]
    top = out[np.abs(out).argmax(axis=0), np.arange(out.shape[1])]
    return out * np.where(top < 0, -1, 1)


def inverse_rows(points: np.ndarray, x: np.ndarray, table: int = 1 << 20) -> np.ndarray:
    """The complete graph of points with weights 1 / (1 + squared distance), times ``x``: a band of rows at a time."""
    p = np.asarray(points, float)
    own, out = (p * p).sum(axis=1), np.empty((len(p), x.shape[1]))
    for lo in range(0, len(p), step := max(1, table // max(1, len(p)))):
        w = p[lo : lo + step] @ (-2 * p.T)
        w += own[None]
        w += 1 + own[lo : lo + step, None]
        np.reciprocal(w, out=w)
        w[np.arange(len(w)), lo + np.arange(len(w))] = 0  # no point is its own neighbour
        out[lo : lo + step] = w @ x
    return out


def inverse_spectral_coordinates(points: np.ndarray, dimensions: int, dense: int = 512, block: int = 8, most: int = 60) -> np.ndarray:
    """:func:`spectral_coordinates` of the complete graph of points with weights 1 / (1 + squared distance), in memory linear in them.

    More than ``dense`` points are solved by a block Krylov space of the normalised weights, each round a pass over bands of rows; it
    ends when the residuals of all that is asked for are at rounding, and starts anew from its best vectors where it would grow beyond
    ``most`` blocks."""
    p = np.asarray(points, float)
    n = len(p)
    if n <= dense:
        return spectral_coordinates(inverse_rows(p, np.eye(n)), dimensions)
    d = inverse_rows(p, np.ones((n, 1)))[:, 0]
    root = np.sqrt(np.maximum(d, 1e-12))[:, None]
    apply = lambda x: inverse_rows(p, x / root) / root
    start = np.concatenate([root, (p - p.mean(axis=0)) * root, np.random.default_rng(0).standard_normal((n, block - 1 - p.shape[1]))], axis=1)
    basis, images = np.empty((n, 0)), np.empty((n, 0))
    for _ in range(20 * most):
        for _ in range(2):  # twice is enough
            start = start - basis @ (basis.T @ start)
            start, _r = np.linalg.qr(start)
        image = apply(start)
        basis, images = np.concatenate([basis, start], axis=1), np.concatenate([images, image], axis=1)
        small = basis.T @ images
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        top = vectors[:, ::-1][:, : dimensions + 1]
        off = images @ top - (basis @ top) * values[::-1][: dimensions + 1]
        if np.linalg.norm(off, axis=0).max() < 1e-12:
            break
        start = image
        if basis.shape[1] >= min(block * most, n - block):
            keep = vectors[:, ::-1][:, : 2 * block]
            basis, images = basis @ keep, images @ keep
            start = images[:, :block] - basis[:, :block] * values[::-1][:block]
    out = (basis @ top / root)[:, 1:]
    lead = out[np.abs(out).argmax(axis=0), np.arange(out.shape[1])]
    return out * np.where(lead < 0, -1, 1)


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise; of points on a line its ends."""
    p = sorted(set(map(tuple, points.tolist())))

    def half(rows: list) -> list:
        out: list = []
        for r in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (r[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (r[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(r)
        return out

    return np.asarray(p if len(p) < 3 else half(p)[:-1] + half(p[::-1])[:-1])


def hulls_meet(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two convex hulls of integer points meet: no axis parts them."""
    axes = [(1, 0), (0, 1)]
    for h in (a, b):
        for u, v in zip(h, np.roll(h, -1, axis=0)):
            axes += [(v - u).tolist(), (int(u[1] - v[1]), int(v[0] - u[0]))]
    for n in np.asarray(axes):
        x, y = a @ n, b @ n
        if x.max() < y.min() or y.max() < x.min():
            return False
    return True
