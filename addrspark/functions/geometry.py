"""Distances on the ellipsoid, triangles and circumcircles, and the choice of three points around one."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The WGS84 ellipsoid.
A, INVERSE_F = 6378137.0, 298.257223563


def geodesic(lon1, lat1, lon2, lat2) -> np.ndarray:
    """Metres between points, by Vincenty's inverse formula; arrays are taken element by element."""
    f = 1 / INVERSE_F
    b = A * (1 - f)
    lon1, lat1, lon2, lat2 = (np.radians(np.asarray(v, float)) for v in (lon1, lat1, lon2, lat2))
    u1, u2 = np.arctan((1 - f) * np.tan(lat1)), np.arctan((1 - f) * np.tan(lat2))
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    gap = lon2 - lon1
    lam = gap + np.zeros_like(s1 + s2)
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(60):
            sl, cl = np.sin(lam), np.cos(lam)
            sin_s = np.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl)
            cos_s = s1 * s2 + c1 * c2 * cl
            sigma = np.arctan2(sin_s, cos_s)
            sin_a = np.where(sin_s > 0, c1 * c2 * sl / sin_s, 0.0)
            cos2_a = 1 - sin_a**2
            mid = np.where(cos2_a > 0, cos_s - 2 * s1 * s2 / cos2_a, 0.0)
            c = f / 16 * cos2_a * (4 + f * (4 - 3 * cos2_a))
            new = gap + (1 - c) * f * sin_a * (sigma + c * sin_s * (mid + c * cos_s * (2 * mid**2 - 1)))
            settled = np.abs(new - lam) < 1e-13
            if np.all(settled):
                break
            lam = np.where(settled, lam, new)  # no pair's distance depends on the others
        k = cos2_a * (A**2 - b**2) / b**2
        big_a = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
        big_b = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
        delta = big_b * sin_s * (mid + big_b / 4 * (cos_s * (2 * mid**2 - 1) - big_b / 6 * mid * (4 * sin_s**2 - 3) * (4 * mid**2 - 3)))
    return np.where(sin_s > 0, b * big_a * (sigma - delta), 0.0)


Point = tuple[float, float]


def cross(o: Point, a: Point, b: Point) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def in_triangle(p: Point, a: Point, b: Point, c: Point) -> bool:
    """Strictly inside: on the same side of all three edges."""
    s = [cross(a, b, p), cross(b, c, p), cross(c, a, p)]
    return all(x > 0 for x in s) or all(x < 0 for x in s)


def circumcircle(a: Point, b: Point, c: Point) -> tuple[float, float, float] | None:
    """(x, y, squared radius) of the circle through three points; None if they lie on a line."""
    d = 2 * cross(a, b, c)
    if d == 0:
        return None
    bx, by, cx, cy = b[0] - a[0], b[1] - a[1], c[0] - a[0], c[1] - a[1]
    ux, uy = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d, (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d
    return a[0] + ux, a[1] + uy, ux * ux + uy * uy


def in_circumcircle(p: Point, a: Point, b: Point, c: Point) -> bool:
    circle = circumcircle(a, b, c)
    return circle is not None and (p[0] - circle[0]) ** 2 + (p[1] - circle[1]) ** 2 < circle[2]


def surrounding(p: Point, points: Sequence[Point]) -> list[int]:
    """Indexes of three of the points, nearest first, that surround p tightly; of the first two if none do.

    The first triangle has the nearest point, the first later one not in line with it and p, and the first one beyond p
    that closes it. Then any point inside its circumcircle takes the place of a corner, if p stays inside and the
    triangle is new, until nothing changes.
    """
    second = next((k for k in range(1, len(points) - 2) if abs(cross(points[0], points[k], p)) > 1e-10), None)
    if second is None:
        return [*range(len(points))][:2]
    a, b = points[0], points[second]
    reach = cross(a, b, p)
    far = lambda q: cross(a, b, q) * reach >= 0 and abs(cross(a, b, q)) >= abs(reach)
    third = next((k for k in range(second + 1, len(points)) if far(points[k]) and in_triangle(p, a, b, points[k])), None)
    if third is None:
        return [0, 1]
    corners, seen = [0, second, third], {frozenset((0, second, third))}
    changed = True
    while changed:
        changed = False
        for k, q in enumerate(points):
            if k in corners or not in_circumcircle(q, *(points[c] for c in corners)):
                continue
            for at in range(3):
                other = [*corners[:at], k, *corners[at + 1 :]]
                if frozenset(other) not in seen and in_triangle(p, *(points[c] for c in other)):
                    corners, changed = other, True
                    seen.add(frozenset(other))
                    break
            if changed:
                break
    return corners


def surrounding_rows(px: np.ndarray, py: np.ndarray, xs: np.ndarray, ys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """surrounding of many points at once: a row of three indexes each, -1 where there are fewer.

    xs, ys: a row for each of the points px, py, whose first n are its points, nearest first, at least one.
    """
    at = np.arange(xs.shape[1])
    out = np.full((len(px), 3), -1)
    out[:, 0], out[:, 1] = 0, np.where(n > 1, 1, -1)
    area = lambda ox, oy, ax, ay, bx, by: (ax - ox) * (by - oy) - (ay - oy) * (bx - ox)
    one_side = lambda a, b, c: ((a > 0) & (b > 0) & (c > 0)) | ((a < 0) & (b < 0) & (c < 0))
    right = (np.abs(area(xs[:, :1], ys[:, :1], xs, ys, px[:, None], py[:, None])) > 1e-10) & (at >= 1) & (at < n[:, None] - 2)
    rows = np.flatnonzero(right.any(1))
    second = right[rows].argmax(1)
    x, y, ux, uy = px[rows, None], py[rows, None], xs[rows], ys[rows]
    ax, ay, bx, by = ux[:, :1], uy[:, :1], ux[np.arange(len(rows)), second][:, None], uy[np.arange(len(rows)), second][:, None]
    reach, beyond = area(ax, ay, bx, by, x, y), area(ax, ay, bx, by, ux, uy)
    closes = (beyond * reach >= 0) & (np.abs(beyond) >= np.abs(reach)) & one_side(reach, area(bx, by, ux, uy, x, y), area(ux, uy, ax, ay, x, y))
    closes &= (at > second[:, None]) & (at < n[rows, None])
    some = closes.any(1)
    rows = rows[some]
    corners = np.stack([np.zeros(len(rows), int), second[some], closes[some].argmax(1)], 1)
    out[rows] = corners
    name = lambda c: (np.sort(c, -1) * np.array([1 << 42, 1 << 21, 1])).sum(-1)
    seen = name(corners)[:, None]
    while len(rows):
        x, y, ux, uy, here = px[rows], py[rows], xs[rows], ys[rows], np.arange(len(rows))
        cx, cy = ux[here[:, None], corners], uy[here[:, None], corners]
        d = 2 * area(cx[:, 0], cy[:, 0], cx[:, 1], cy[:, 1], cx[:, 2], cy[:, 2])
        x1, y1, x2, y2 = cx[:, 1] - cx[:, 0], cy[:, 1] - cy[:, 0], cx[:, 2] - cx[:, 0], cy[:, 2] - cy[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            mx, my = (y2 * (x1 * x1 + y1 * y1) - y1 * (x2 * x2 + y2 * y2)) / d, (x1 * (x2 * x2 + y2 * y2) - x2 * (x1 * x1 + y1 * y1)) / d
            within = (ux - (cx[:, 0] + mx)[:, None]) ** 2 + (uy - (cy[:, 0] + my)[:, None]) ** 2 < (mx * mx + my * my)[:, None]
        within &= (d != 0)[:, None] & (at < n[rows, None])
        within[here[:, None], corners] = False
        r, k = np.nonzero(within)
        other = np.repeat(corners[r][:, None], 3, 1)
        other[:, [0, 1, 2], [0, 1, 2]] = k[:, None]
        ox, oy = ux[r[:, None, None], other], uy[r[:, None, None], other]
        sides = [area(ox[..., a], oy[..., a], ox[..., b], oy[..., b], x[r, None], y[r, None]) for a, b in ((0, 1), (1, 2), (2, 0))]
        names = name(other)
        fit = np.flatnonzero(one_side(*sides) & ~(names[..., None] == seen[r][:, None]).any(-1))  # by row, point and corner
        moved, first = np.unique(r[fit // 3], return_index=True)
        corners = other.reshape(-1, 3)[fit[first]]
        rows, seen = rows[moved], np.concatenate([seen[moved], names.reshape(-1)[fit[first], None]], 1)
        out[rows] = corners
    return out


# --- the same as columns


def cross_column(ox, oy, ax, ay, bx, by) -> Column:
    return (ax - ox) * (by - oy) - (ay - oy) * (bx - ox)


def in_triangle_column(px, py, ax, ay, bx, by, cx, cy) -> Column:
    s = [cross_column(ax, ay, bx, by, px, py), cross_column(bx, by, cx, cy, px, py), cross_column(cx, cy, ax, ay, px, py)]
    return ((s[0] > 0) & (s[1] > 0) & (s[2] > 0)) | ((s[0] < 0) & (s[1] < 0) & (s[2] < 0))


def circumcircle_columns(ax, ay, bx, by, cx, cy) -> tuple[Column, Column, Column]:
    d = 2 * cross_column(ax, ay, bx, by, cx, cy)
    ok = lambda v: F.when(d != 0, v / d)
    x1, y1, x2, y2 = bx - ax, by - ay, cx - ax, cy - ay
    ux, uy = ok(y2 * (x1 * x1 + y1 * y1) - y1 * (x2 * x2 + y2 * y2)), ok(x1 * (x2 * x2 + y2 * y2) - x2 * (x1 * x1 + y1 * y1))
    return ax + ux, ay + uy, ux * ux + uy * uy


#: Rounds of the inverse formula as a column: points that are not nearly opposite each other settle in fewer.
ROUNDS = 12


def geodesic_column(lon1, lat1, lon2, lat2) -> Column:
    """geodesic of four columns (or numbers), without leaving the JVM; null where one is null.

    It makes ROUNDS rounds where geodesic goes on until nothing changes: for points nearly opposite each other take that.
    """
    f = 1 / INVERSE_F
    b = A * (1 - f)
    lon1, lat1, lon2, lat2 = (F.radians(c if isinstance(c, Column) else F.lit(float(c))) for c in (lon1, lat1, lon2, lat2))
    u1, u2 = F.atan((1 - f) * F.tan(lat1)), F.atan((1 - f) * F.tan(lat2))
    start = F.struct(F.sin(u1).alias("s1"), F.cos(u1).alias("c1"), F.sin(u2).alias("s2"), F.cos(u2).alias("c2"), (lon2 - lon1).alias("gap"))

    def let(value: Column, body) -> Column:
        """body of a value that is computed once: a lambda's variable holds it."""
        return F.transform(F.array(value), body)[0]

    def terms(p: Column, lam: Column, body) -> Column:
        """body of the terms of a round: sin_s, cos_s, sin_a, cos2 and mid."""
        sides = F.struct(F.hypot(p["c2"] * F.sin(lam), p["c1"] * p["s2"] - p["s1"] * p["c2"] * F.cos(lam)).alias("sin_s"), (p["s1"] * p["s2"] + p["c1"] * p["c2"] * F.cos(lam)).alias("cos_s"))
        azimuth = lambda t: F.when(t["sin_s"] > 0, p["c1"] * p["c2"] * F.sin(lam) / t["sin_s"]).otherwise(0.0)
        middle = lambda t, cos2: F.when(cos2 > 0, t["cos_s"] - 2 * p["s1"] * p["s2"] / cos2).otherwise(0.0)
        return let(sides, lambda t: let(azimuth(t), lambda sin_a: let(1 - sin_a * sin_a, lambda cos2: let(middle(t, cos2), lambda mid: body(t["sin_s"], t["cos_s"], sin_a, cos2, mid)))))

    def once(p: Column, lam: Column) -> Column:
        def step(sin_s: Column, cos_s: Column, sin_a: Column, cos2: Column, mid: Column) -> Column:
            c = f / 16 * cos2 * (4 + f * (4 - 3 * cos2))
            return let(c, lambda c: p["gap"] + (1 - c) * f * sin_a * (F.atan2(sin_s, cos_s) + c * sin_s * (mid + c * cos_s * (2 * mid * mid - 1))))

        return terms(p, lam, step)

    def metres(p: Column, lam: Column) -> Column:
        def last(sin_s: Column, cos_s: Column, _: Column, cos2: Column, mid: Column) -> Column:
            k = cos2 * (A**2 - b**2) / b**2
            big_a = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
            big_b = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
            delta = let(big_b, lambda b2: b2 * sin_s * (mid + b2 / 4 * (cos_s * (2 * mid * mid - 1) - b2 / 6 * mid * (4 * sin_s * sin_s - 3) * (4 * mid * mid - 3))))
            return F.when(sin_s > 0, b * big_a * (F.atan2(sin_s, cos_s) - delta)).otherwise(0.0)

        return let(lam, lambda lam: terms(p, lam, last))

    settled = let(start, lambda p: metres(p, F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), p["gap"], lambda lam, _: once(p, lam))))
    return F.when(lon1.isNotNull() & lat1.isNotNull() & lon2.isNotNull() & lat2.isNotNull(), settled)
