"""Exact integer geometry as SQL expressions.

Each function gives the text of an expression over integer columns, valid in Spark SQL and in any SQL with
64-bit integers.  A point named ``p`` is the columns ``p_x, p_y, p_z``.  Nothing divides: levels and centres are
numerator and denominator.  With coordinates of at most 6 bits every value of a support of four points fits
in 64 bits; pairs do with 20 bits and triples with 10.
"""

from __future__ import annotations


def minus(a: str, b: str) -> tuple[str, str, str]:
    return tuple(f"({a}_{c} - {b}_{c})" for c in "xyz")


def dot(a: tuple, b: tuple) -> str:
    return "(" + " + ".join(f"{x} * {y}" for x, y in zip(a, b, strict=True)) + ")"


def squared_distance(a: str, b: str) -> str:
    d = minus(a, b)
    return dot(d, d)


def det2(m: list[list[str]]) -> str:
    return f"({m[0][0]} * {m[1][1]} - {m[0][1]} * {m[1][0]})"


def det3(m: list[list[str]]) -> str:
    parts = [f"{m[0][i]} * {det2([[r[j] for j in range(3) if j != i] for r in m[1:]])}" for i in range(3)]
    return f"({parts[0]} - {parts[1]} + {parts[2]})"


def det(m: list[list[str]]) -> str:
    if len(m) == 1:
        return m[0][0]
    return det2(m) if len(m) == 2 else det3(m) if len(m) == 3 else "(" + " ".join(f"{'-' if i % 2 else '+' if i else ''} {m[0][i]} * {det([[r[j] for j in range(len(m)) if j != i] for r in m[1:]])}" for i in range(len(m))) + ")"


def orient2d(a: str, b: str, c: str) -> str:
    """Twice the signed area in the xy plane."""
    return f"(({b}_x - {a}_x) * ({c}_y - {a}_y) - ({b}_y - {a}_y) * ({c}_x - {a}_x))"


def orient3d(a: str, b: str, c: str, d: str) -> str:
    """det[b-a, c-a, d-a]."""
    return det3([list(minus(b, a)), list(minus(c, a)), list(minus(d, a))])


def gram(points: list[str]) -> list[list[str]]:
    """Products of the edges from the first point."""
    e = [minus(p, points[0]) for p in points[1:]]
    return [[dot(a, b) for b in e] for a in e]


def circumball(points: list[str]) -> dict[str, object]:
    """Of 2 to 4 points, from columns g11.. of the Gram matrix: ``D``, ``M`` (numerators over 2 D), level numerator over 4 D.

    The result speaks of columns named ``g{i}{j}``; :func:`gram_columns` names them.
    """
    n = len(points) - 1
    g = [[f"g{min(i, j)}{max(i, j)}" for j in range(1, n + 1)] for i in range(1, n + 1)]
    h = [g[i][i] for i in range(n)]
    d = det(g)
    m = [det([[h[r] if c == i else g[r][c] for c in range(n)] for r in range(n)]) for i in range(n)]
    return {"D": d, "M": m, "level": "(" + " + ".join(f"m{i + 1} * {h[i]}" for i in range(n)) + ")"}


def gram_columns(points: list[str]) -> dict[str, str]:
    g = gram(points)
    return {f"g{i + 1}{j + 1}": g[i][j] for i in range(len(g)) for j in range(i, len(g))}


def power_sign(points: list[str], x: str) -> str:
    """Negative inside the ball through ``points``, 0 on it, positive outside; uses columns d and m1.. of the ball."""
    w = minus(x, points[0])
    inner = " + ".join(f"m{i + 1} * {dot(minus(p, points[0]), w)}" for i, p in enumerate(points[1:]))
    return f"(d * {dot(w, w)} - ({inner}))"


def box_distance(q: str, lo: str, hi: str, farthest: bool = False) -> str:
    """Least (or largest) squared distance from ``q`` to the box [lo, hi]."""
    if farthest:
        parts = [f"greatest(abs({q}_{c} - {lo}{c}), abs({q}_{c} - {hi}{c}))" for c in "xyz"]
    else:
        parts = [f"greatest({lo}{c} - {q}_{c}, 0, {q}_{c} - {hi}{c})" for c in "xyz"]
    return "(" + " + ".join(f"{p} * {p}" for p in parts) + ")"


def phi_maximum(x: str, u: str, v: str) -> str:
    """Largest (x-u).(x-v) over boxes ``{name}lo*``/``{name}hi*`` of x, u and v: an upper bound axis by axis."""
    axes = []
    for c in "xyz":
        corners = [f"({x}{p}{c} - {u}{q}{c}) * ({x}{p}{c} - {v}{r}{c})" for p in ("lo", "hi") for q in ("lo", "hi") for r in ("lo", "hi")]
        axes.append(f"greatest({', '.join(corners)})")
    return "(" + " + ".join(axes) + ")"


def spread_bits(value: str) -> str:
    """Every third bit: the bits of a 21-bit integer 3 apart, as a sum of shifted bits."""
    return "(" + " + ".join(f"(({value} >> {i}) & 1) * {1 << (3 * i)}" for i in range(21)) + ")"


def level_key(num: str, den: str) -> str:
    """A level num / den as a value that sorts like it: the quotient and 100 binary digits of the rest, by long
    division.  Different levels have different keys while both denominators are below 2^43 and their product below 2^100."""
    rest, digits = f"({num} % {den})", []
    for _ in range(5):
        digits.append(f"(({rest} * 1048576) div {den})")
        rest = f"(({rest} * 1048576) % {den})"
    return f"struct({num} div {den} AS q, ({digits[0]} * 1048576 + {digits[1]}) * 1048576 + {digits[2]} AS hi, {digits[3]} * 1048576 + {digits[4]} AS lo)"


def level_order_sql(num: str = "num", den: str = "den") -> str:
    """The same order for engines with 128-bit integers, as two keys: quotient, and 83 binary digits (denominators below 2^41)."""
    return f"{num} // {den}, (CAST({num} % {den} AS HUGEINT) * 9671406556917033397649408) // {den}"


def filtered_orientation(a: str, b: str, c: str, d: str) -> dict[str, str]:
    """The sign of det[b-a, c-a, d-a] in two stages: ``det`` and ``bound`` in floating point (the bound is what rounding can
    do to the determinant), and ``exact`` in integers for where the first can't tell."""
    e = [[f"CAST({p}_{k} - {a}_{k} AS DOUBLE)" for k in "xyz"] for p in (b, c, d)]
    size = " + ".join(f"abs({e[0][i]}) * (abs({e[1][j]} * {e[2][k]}) + abs({e[1][k]} * {e[2][j]}))" for i, j, k in ((0, 1, 2), (1, 2, 0), (2, 0, 1)))
    return {"det": det3(e), "bound": f"({size}) * CAST(1e-15 AS DOUBLE)", "exact": orient3d(a, b, c, d)}


def interval_product(a: tuple[str, str], b: tuple[str, str]) -> tuple[str, str]:
    """Least and largest product of two numbers within intervals."""
    corners = ", ".join(f"{x} * {y}" for x in a for y in b)
    return f"least({corners})", f"greatest({corners})"


def gram_bounds(boxes: list[str]) -> dict[str, str]:
    """Bounds of the Gram entries of edges from the first box's point to the others', boxes as ``{name}lo*``/``{name}hi*``: columns
    ``g{i}{j}lo`` and ``g{i}{j}hi``.  Axes are bounded one by one, so the bounds hold and needn't be met."""
    edge = lambda n, c: (f"({n}lo{c} - {boxes[0]}hi{c})", f"({n}hi{c} - {boxes[0]}lo{c})")
    out = {}
    for i, p in enumerate(boxes[1:], 1):
        for j, q in enumerate(boxes[1:], 1):
            if i < j:
                axes = [interval_product(edge(p, c), edge(q, c)) for c in "xyz"]
                lo, hi = (" + ".join(a[k] for a in axes) for k in (0, 1))
            elif i == j:
                lo = " + ".join(f"CASE WHEN {edge(p, c)[0]} > 0 THEN {edge(p, c)[0]} * {edge(p, c)[0]} WHEN {edge(p, c)[1]} < 0 THEN {edge(p, c)[1]} * {edge(p, c)[1]} ELSE 0 END" for c in "xyz")
                hi = " + ".join(f"greatest({edge(p, c)[0]} * {edge(p, c)[0]}, {edge(p, c)[1]} * {edge(p, c)[1]})" for c in "xyz")
            else:
                continue
            out |= {f"g{i}{j}lo": lo, f"g{i}{j}hi": hi}
    return out


def determinant_bounds() -> dict[str, str]:
    """Bounds of the determinant and the two numerators of a support of three boxes, from :func:`gram_bounds`."""
    g = {k: (f"g{k}lo", f"g{k}hi") for k in ("11", "12", "22")}
    minus_ = lambda a, b: (f"({a[0]}) - ({b[1]})", f"({a[1]}) - ({b[0]})")
    whole = interval_product(g["11"], g["22"])
    square = ("CASE WHEN g12lo > 0 THEN g12lo * g12lo WHEN g12hi < 0 THEN g12hi * g12hi ELSE 0 END", "greatest(g12lo * g12lo, g12hi * g12hi)")
    d = minus_(whole, square)
    m1, m2 = minus_(whole, interval_product(g["22"], g["12"])), minus_(whole, interval_product(g["11"], g["12"]))
    return {"dlo": d[0], "dhi": d[1], "m1lo": m1[0], "m1hi": m1[1], "m2lo": m2[0], "m2hi": m2[1]}
