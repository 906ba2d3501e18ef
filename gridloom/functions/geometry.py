"""Geometry as column expressions, and small numpy kernels for what is inherently sequential per polygon."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double,z:double>"


def numbers(text: Column) -> Column:
    """The numbers of a white-space separated list; entries that are no numbers are left out."""
    parts = F.split(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), " ")
    return F.filter(F.transform(parts, lambda p: p.try_cast("double")), lambda v: v.isNotNull())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pos_list(text: Column, dims: int = 3) -> Column:
    """array<struct(x, y, z)> of a position list; an incomplete last point is dropped. Two dimensions have z 0."""
    def points(v: Column) -> Column:
        n = F.floor(F.size(v) / dims).cast("int")
        z = (lambda i: F.get(v, i * dims + 2)) if dims == 3 else (lambda i: F.lit(0.0))
        pts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
            F.get(v, i * dims).alias("x"), F.get(v, i * dims + 1).alias("y"), z(i).alias("z")))
        return F.when(n > 0, pts).otherwise(F.array().cast(f"array<{POINT}>"))

    return let(numbers(text), points)


def open_ring(points: Column) -> Column:
    """The ring without a closing point that repeats its first (squared distance below 1e-10, over 3 points)."""
    a, b, n = F.get(points, F.lit(0)), F.get(points, F.size(points) - 1), F.size(points)
    d = lambda k: (a[k] - b[k]) * (a[k] - b[k])
    return F.when((n > 3) & (d("x") + d("y") + d("z") < 1e-10), F.slice(points, 1, F.greatest(n - 1, F.lit(0)))).otherwise(points)


def fan(n: Column) -> Column:
    """Triangles (0, i, i + 1) of a polygon of n points; exact for three and four points in ring order."""
    tri = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.struct(F.lit(0).alias("a"), i.alias("b"), (i + 1).alias("c")))
    return F.when(n >= 3, tri).otherwise(F.array().cast("array<struct<a:int,b:int,c:int>>"))


def cross(ax: Column, ay: Column, az: Column, bx: Column, by: Column, bz: Column) -> tuple[Column, Column, Column]:
    return ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx


def triangle_normal(p: str = "") -> tuple[Column, Column, Column]:
    """Unnormalised normal of columns x0..z2 (with a prefix)."""
    c = lambda k, i: F.col(f"{p}{k}{i}")
    return cross(*[c(k, 1) - c(k, 0) for k in "xyz"], *[c(k, 2) - c(k, 0) for k in "xyz"])


def triangle_area(p: str = "") -> Column:
    n = triangle_normal(p)
    return F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2]) / 2


def aspect_ratio(p: str = "") -> Column:
    """Longest over shortest side, the shortest taken as 1e-15 at least."""
    c = lambda k, i: F.col(f"{p}{k}{i}")
    side = lambda i, j: F.sqrt(sum(((c(k, i) - c(k, j)) * (c(k, i) - c(k, j)) for k in "xyz"), F.lit(0.0)))
    s = (side(0, 1), side(1, 2), side(2, 0))
    return F.greatest(*s) / F.greatest(F.least(*s), F.lit(1e-15))


def vertical_face(p: str = "", most: float = 0.1) -> Column:
    """Whether a triangle's unit normal is nearly level."""
    n = triangle_normal(p)
    return F.abs(n[2]) < most * F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])


def inside_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point is inside a ring of struct(x, y), by crossings of a ray."""
    n = F.size(ring)
    edge = F.transform(ring, lambda p, i: F.struct(p.alias("p"), F.get(ring, (i + 1) % n).alias("q")))
    hit = lambda e: ((e["p"]["y"] > y) != (e["q"]["y"] > y)) & (
        x < (e["q"]["x"] - e["p"]["x"]) * (y - e["p"]["y"]) / F.when(e["q"]["y"] != e["p"]["y"], e["q"]["y"] - e["p"]["y"]).otherwise(1.0) + e["p"]["x"])
    return F.size(F.filter(edge, hit)) % 2 == 1


def edge_crossing(p: float, q: float, level: float) -> float:
    """Where a segment between coordinates p and q meets a level, as a share of its length; one half if parallel."""
    return 0.5 if p == q else (level - p) / (q - p)


def clip_half_plane(poly: np.ndarray, axis: int, sign: int, level: float) -> np.ndarray:
    """The part of a polygon where sign * coordinate <= sign * level."""
    out = []
    for p, q in zip(poly, np.roll(poly, -1, axis=0)):
        a, b = sign * p[axis] <= sign * level, sign * q[axis] <= sign * level
        if a:
            out.append(p)
        if a != b:
            out.append(p + edge_crossing(p[axis], q[axis], level) * (q - p))
    return np.array(out).reshape(-1, poly.shape[1])


def clip_box(poly: np.ndarray, lo: tuple[float, float], hi: tuple[float, float]) -> np.ndarray:
    for axis in (0, 1):
        for sign, level in ((1, hi[axis]), (-1, lo[axis])):
            if len(poly):
                poly = clip_half_plane(poly, axis, sign, level)
    return poly


def newell_normal(points: np.ndarray) -> np.ndarray:
    p, q = points, np.roll(points, -1, axis=0)
    n = ((p[:, [1, 2, 0]] - q[:, [1, 2, 0]]) * (p[:, [2, 0, 1]] + q[:, [2, 0, 1]])).sum(0)
    size = np.linalg.norm(n)
    return n / size if size else np.array([0.0, 0.0, 1.0])


def plane_axes(points: np.ndarray) -> np.ndarray:
    """Points in the plane of their Newell normal."""
    n = newell_normal(points)
    up = np.array([0.0, 0.0, 1.0]) if abs(n[2]) < 0.9 else np.array([1.0, 0.0, 0.0])
    u = np.cross(up, n)
    u /= np.linalg.norm(u)
    return np.column_stack([points @ u, points @ np.cross(n, u)])


def _signed_area(p: np.ndarray) -> float:
    x, y = p[:, 0], p[:, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def _with_bridges(outer: list[int], holes: list[list[int]], pts: np.ndarray) -> list[int]:
    """One ring: each hole is joined to a visible outer point, holes from right to left."""
    for hole in sorted(holes, key=lambda h: -max(pts[i, 0] for i in h)):
        k = max(range(len(hole)), key=lambda i: pts[hole[i], 0])
        m = pts[hole[k]]
        order = sorted(range(len(outer)), key=lambda i: float(((pts[outer[i]] - m) ** 2).sum()))
        at = next((i for i in order if _visible(m, pts[outer[i]], [outer, *holes], pts)), order[0])
        outer = outer[: at + 1] + hole[k:] + hole[: k + 1] + outer[at:]
    return outer


def _visible(a: np.ndarray, b: np.ndarray, rings: list[list[int]], pts: np.ndarray) -> bool:
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    for ring in rings:
        for i, j in zip(ring, ring[1:] + ring[:1]):
            p, q = pts[i], pts[j]
            if side(a, b, p) * side(a, b, q) < 0 and side(p, q, a) * side(p, q, b) < 0:
                return False
    return True


def triangulate(points: np.ndarray, holes: list[np.ndarray] | None = None) -> np.ndarray:
    """Triangles (indices into points followed by the holes' points) of a planar polygon, by ear clipping.

    Three points are one triangle and four (0, 1, 2), (0, 2, 3), also where they are concave.
    """
    holes = [h for h in holes or [] if len(h) >= 3]
    if len(points) < 3:
        return np.zeros((0, 3), np.int32)
    if not holes and len(points) <= 4:
        return np.array([[0, 1, 2], [0, 2, 3]][: len(points) - 2], np.int32)
    every = np.vstack([points, *holes])
    flat = plane_axes(every) if every.shape[1] == 3 else every
    n = len(points)
    outer = list(range(n))
    if _signed_area(flat[outer]) < 0:
        outer.reverse()
    rings, at = [], n
    for h in holes:
        r = list(range(at, at + len(h)))
        rings.append(r if _signed_area(flat[r]) < 0 else r[::-1])
        at += len(h)
    ring = _with_bridges(outer, rings, flat)
    out = []
    while len(ring) > 3:
        for k in range(len(ring)):
            a, b, c = ring[k - 1], ring[k], ring[(k + 1) % len(ring)]
            if _is_ear(flat, ring, a, b, c):
                out.append((a, b, c))
                del ring[k]
                break
        else:
            break  # no ear is left in a degenerate ring
    if len(ring) == 3:
        out.append(tuple(ring))
    return np.array(out, np.int32).reshape(-1, 3)


def _is_ear(p: np.ndarray, ring: list[int], a: int, b: int, c: int) -> bool:
    (ax, ay), (bx, by), (cx, cy) = p[a], p[b], p[c]
    if (bx - ax) * (cy - ay) - (by - ay) * (cx - ax) <= 0:
        return False
    q = p[[i for i in ring if i not in (a, b, c)]]
    if not len(q):
        return True
    s = [(x1 - x0) * (q[:, 1] - y0) - (y1 - y0) * (q[:, 0] - x0) for x0, y0, x1, y1 in ((ax, ay, bx, by), (bx, by, cx, cy), (cx, cy, ax, ay))]
    same = [(np.abs(q - p[i]) < 1e-15).all(1) for i in (a, b, c)]
    return not ((s[0] >= 0) & (s[1] >= 0) & (s[2] >= 0) & ~(same[0] | same[1] | same[2])).any()
