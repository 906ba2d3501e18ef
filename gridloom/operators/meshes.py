"""Collections of meshes: union with order, dedup merge, counts and filters.

mesh: (feature_type, feature_id, seq, attrs, vertices array<struct(x, y, z)>, faces array<struct(a, b, c)>).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.codes import box_meets


def merge(first: DataFrame, other: DataFrame) -> DataFrame:
    """first, then other without the buildings and bridges whose id first already has; repeats inside other stay."""
    known = first.where(F.col("feature_type").isin("building", "bridge")).select("feature_type", "feature_id").distinct()
    return first.unionByName(other.join(known, ["feature_type", "feature_id"], "left_anti"), allowMissingColumns=True)


def renumber(meshes: DataFrame) -> DataFrame:
    """(path, k, id): ids from 1 in document order, buildings before bridges.

    A mesh's id is its place among its file's meshes plus the start of its file; starts come from one row for each file.
    """
    kind = F.when(F.col("feature_type") == "building", 0).otherwise(1).alias("kind")
    m = meshes.where(F.col("feature_type").isin("building", "bridge")).select("path", "k", kind)
    n = m.groupBy("kind", "path").agg(F.count("*").alias("n"))
    start = n.select("kind", "path", (F.sum("n").over(Window.orderBy("kind", "path")) - F.col("n")).alias("start"))
    place = m.withColumn("at", F.row_number().over(Window.partitionBy("kind", "path").orderBy("k")))
    return place.join(start, ["kind", "path"]).select("path", "k", (F.col("at") + F.col("start")).cast("long").alias("id"))


def totals(meshes: DataFrame) -> DataFrame:
    return meshes.groupBy("feature_type").agg(F.count("*").alias("meshes"), F.sum(F.size("vertices")).alias("vertices"), F.sum(F.size("faces")).alias("faces"))


def offsets(sizes: DataFrame, group: str, order: str, n: str) -> DataFrame:
    """sizes plus `offset`, the sum of n before it in its group: where each mesh's vertices start when joined."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("offset", F.coalesce(F.sum(n).over(w), F.lit(0)))


def triangles(meshes: DataFrame) -> DataFrame:
    """(seq, face, x0..z2) of every mesh."""
    f = meshes.select("seq", "vertices", F.posexplode("faces").alias("face", "f"))
    return f.select("seq", "face", *[F.get("vertices", F.col(f"f.{v}"))[k].alias(f"{k}{i}") for i, v in enumerate("abc") for k in "xyz"])


def in_rectangle(meshes: DataFrame, corners: list[tuple[float, float]], x: str = "x", y: str = "y") -> DataFrame:
    """Meshes whose box meets a rectangle that may be turned; they stay whole."""
    vx, vy = F.transform("vertices", lambda p: p[x]), F.transform("vertices", lambda p: p[y])
    return meshes.where(box_meets(F.array_min(vx), F.array_min(vy), F.array_max(vx), F.array_max(vy), corners))


def triangles_in_bounds(tri: DataFrame, lo_x: float, lo_y: float, hi_x: float, hi_y: float) -> DataFrame:
    """Triangles whose box meets a range (closed)."""
    x, y = ([F.col(f"{k}{i}") for i in range(3)] for k in "xy")
    return tri.where((F.greatest(*x) >= lo_x) & (F.least(*x) <= hi_x) & (F.greatest(*y) >= lo_y) & (F.least(*y) <= hi_y))


def place_prototypes(instances: DataFrame, prototypes: DataFrame) -> DataFrame:
    """(inst, k, x, y, z): prototype points by a 4 x 4 row-major matrix and a reference point.

    instances: (inst, href, m array<double>, rx, ry, rz); `#` before an id is dropped. prototypes: (proto, seq,
    k, x, y, z), of several with one id the first counts. A matrix of other than 16 numbers counts as identity;
    instances without a prototype give nothing.
    """
    first = prototypes.groupBy("proto").agg(F.min("seq").alias("seq"))
    p = prototypes.join(first, ["proto", "seq"], "left_semi")
    i = instances.withColumn("proto", F.ltrim("href", F.lit("#")))
    i = i.withColumn("m", F.when(F.size("m") == 16, F.col("m")).otherwise(F.array(*[F.lit(1.0 if k % 5 == 0 else 0.0) for k in range(16)])))
    j = i.join(p, "proto")
    at = lambda row: F.get("m", F.lit(4 * row)) * F.col("x") + F.get("m", F.lit(4 * row + 1)) * F.col("y") + F.get("m", F.lit(4 * row + 2)) * F.col("z") + F.get("m", F.lit(4 * row + 3))
    return j.select("inst", "k", *[(at(n) + F.col(r)).alias(k) for n, (k, r) in enumerate(zip("xyz", ("rx", "ry", "rz")))])


def centre_in_rectangle(meshes: DataFrame, corners: list[tuple[float, float]], x: str = "x", y: str = "y") -> DataFrame:
    """Meshes the mean of whose vertices lies in a rectangle [SW, NW, NE, SE] that may be turned, edges included."""
    mean = lambda k: F.aggregate("vertices", F.lit(0.0), lambda s, p: s + p[k]) / F.size("vertices")
    return meshes.where(F.size("vertices") > 0).where(in_corners(mean(x), mean(y), corners))


def in_corners(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Whether a point is in a convex ring of corners, edges included, whichever way they turn."""
    side = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1])]
    return (F.least(*side) >= 0) | (F.greatest(*side) <= 0)


def within_rectangle(polys: DataFrame, corners: list[tuple[float, float]]) -> DataFrame:
    """Polygons (ring) all of whose points are in a rectangle that may be turned, edges included."""
    return polys.where(F.forall("ring", lambda p: in_corners(p["x"], p["y"], corners)))


def meets_rectangle(polys: DataFrame, corners: list[tuple[float, float]]) -> DataFrame:
    """Polygons (ring) that share a point with a rectangle that may be turned: a point of one in the other, or crossing sides."""
    from gridloom.functions.geometry import inside_ring

    n = F.size("ring")
    next_ = lambda i: F.get("ring", (i + 1) % n)

    def crosses(p: Column, i: Column) -> Column:
        q = next_(i)
        out = F.lit(False)
        for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1]):
            d1, d2 = (bx - ax) * (p["y"] - ay) - (by - ay) * (p["x"] - ax), (bx - ax) * (q["y"] - ay) - (by - ay) * (q["x"] - ax)
            d3, d4 = ((q["x"] - p["x"]) * (y - p["y"]) - (q["y"] - p["y"]) * (x - p["x"]) for x, y in ((ax, ay), (bx, by)))
            out = out | ((d1 * d2 <= 0) & (d3 * d4 <= 0) & ((d1 != 0) | (d2 != 0)))
        return out

    point = F.exists("ring", lambda p: in_corners(p["x"], p["y"], corners))
    corner = inside_ring(F.lit(float(corners[0][0])), F.lit(float(corners[0][1])), F.col("ring"))
    return polys.where(point | corner | F.exists(F.transform("ring", crosses), lambda x: x))


def tagged(parts: dict[str, DataFrame], name: str) -> DataFrame:
    """Tables under one another, each with its tag; columns that one lacks are null there."""
    out = None
    for tag, df in parts.items():
        one = df.withColumn(name, F.lit(tag))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out
