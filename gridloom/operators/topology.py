"""Mesh topology and repair as relational steps over face(mesh, face, a, b, c) and vertex(mesh, v, x, y, z)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.raster import first_by


def edges(faces: DataFrame) -> DataFrame:
    """(mesh, face, i, a, b, lo, hi): the three directed edges of each face."""
    e = F.array(*[F.struct(F.col(p).alias("a"), F.col(q).alias("b")) for p, q in ("ab", "bc", "ca")])
    x = faces.select("mesh", "face", F.posexplode(e).alias("i", "e")).select("mesh", "face", "i", "e.a", "e.b")
    return x.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")})


def edge_counts(faces: DataFrame) -> DataFrame:
    return edges(faces).groupBy("mesh", "lo", "hi").agg(F.count("*").alias("n"))


def boundary_edges(faces: DataFrame) -> DataFrame:
    return edge_counts(faces).where("n = 1").select("mesh", "lo", "hi")


def boundary_loops(faces: DataFrame) -> DataFrame:
    """(mesh, rank, edges, first): the connected parts of each mesh's boundary, the one of most edges first, then by least vertex.

    A mesh's boundary edges are worked on together; its faces aren't gathered.
    """
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        points, at = np.unique(pdf[["lo", "hi"]].to_numpy(), return_inverse=True)
        a, b = at.reshape(-1, 2).T
        root = np.arange(len(points))
        while True:  # the least number reaches every point of a part
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, root[a], low)
            np.minimum.at(new, root[b], low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        part, n = np.unique(root[a], return_counts=True)
        order = np.lexsort((part, -n))
        return pd.DataFrame({"mesh": key[0], "rank": np.arange(len(part)), "edges": n[order], "first": points[part[order]]})

    return boundary_edges(faces).groupBy("mesh").applyInPandas(run, "mesh long, rank int, edges long, first long")


def pinch_points(faces: DataFrame) -> DataFrame:
    """(mesh, v, n): vertices on more than two boundary edges."""
    ends = boundary_edges(faces).select("mesh", F.explode(F.array("lo", "hi")).alias("v"))
    return ends.groupBy("mesh", "v").agg(F.count("*").alias("n")).where("n > 2")


def validate(faces: DataFrame) -> DataFrame:
    """(mesh, edges, open_edges, crowded_edges): edges with one use, and with over two."""
    return edge_counts(faces).groupBy("mesh").agg(
        F.count("*").alias("edges"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("open_edges"), F.sum(F.when(F.col("n") > 2, 1).otherwise(0)).alias("crowded_edges"))


def is_volume(faces: DataFrame) -> DataFrame:
    """(mesh, volume): whether every directed edge is used once and its reverse once."""
    d = edges(faces).groupBy("mesh", "lo", "hi").agg(F.sum(F.when(F.col("a") < F.col("b"), 1).otherwise(0)).alias("up"), F.count("*").alias("n"))
    return d.groupBy("mesh").agg(F.min((F.col("n") == 2) & (F.col("up") == 1)).alias("volume"))


def drop_crowding(faces: DataFrame) -> DataFrame:
    """Faces without those that are third or later, by number, on any of their edges."""
    w = Window.partitionBy("mesh", "lo", "hi").orderBy("face", "i")
    bad = edges(faces).withColumn("k", F.row_number().over(w)).where("k > 2").select("mesh", "face").distinct()
    return faces.join(bad, ["mesh", "face"], "left_anti")


def weld(vertices: DataFrame, faces: DataFrame, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) with vertices of equal rounded place made one, the first; collapsed faces go."""
    key = [F.rint(F.col(k) / tolerance).alias(f"k{k}") for k in "xyz"]
    to = vertices.select("mesh", "v", *key).withColumn("to", F.min("v").over(Window.partitionBy("mesh", "kx", "ky", "kz"))).select("mesh", "v", "to")
    out = faces
    for k in "abc":
        out = out.join(to.select("mesh", F.col("v").alias(k), F.col("to").alias(f"t{k}")), ["mesh", k])
    out = out.select("mesh", "face", *[F.col(f"t{k}").alias(k) for k in "abc"]).where("a <> b and b <> c and c <> a")
    kept = vertices.join(to.where("v = to").select("mesh", "v"), ["mesh", "v"], "left_semi")
    return kept, out


def drop_doubles(faces: DataFrame) -> DataFrame:
    """The first face of each set of three vertices."""
    k = faces.withColumn("k", F.array_sort(F.array("a", "b", "c")))
    return first_by(k, ["mesh", "k"], [F.col(c) for c in ("face", "a", "b")]).drop("k")


def drop_overlaps(faces: DataFrame, vertices: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """drop_doubles, then the first face of each quantised centroid."""
    f = drop_doubles(faces)
    p = vertices.select("mesh", "v", "x", "y", "z")
    c = f.select("mesh", "face", F.explode(F.array("a", "b", "c")).alias("v")).join(p, ["mesh", "v"])
    c = c.groupBy("mesh", "face").agg(*[F.rint(F.sum(k) / 3 / tolerance).alias(f"q{k}") for k in "xyz"])
    kept = first_by(c, ["mesh", "qx", "qy", "qz"], [F.col("face")])
    return f.join(kept.select("mesh", "face"), ["mesh", "face"], "left_semi")


def face_points(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(mesh, face, x0..z2)."""
    out = faces.select("mesh", "face", "a", "b", "c")
    for i, k in enumerate("abc"):
        out = out.join(vertices.select("mesh", F.col("v").alias(k), *[F.col(d).alias(f"{d}{i}") for d in "xyz"]), ["mesh", k])
    return out.select("mesh", "face", *[f"{d}{i}" for i in range(3) for d in "xyz"])


def drop_degenerate(tri: DataFrame, min_area: float = 1e-12, max_aspect: float = 1e6) -> DataFrame:
    from gridloom.functions.geometry import aspect_ratio, triangle_area

    return tri.where((triangle_area() >= min_area) & (aspect_ratio() <= max_aspect))


def walls(faces: DataFrame, offset: int) -> DataFrame:
    """(mesh, a, b, c, face): two triangles below each boundary edge, bottom vertices at v + offset, winding kept."""
    open_ = edges(faces).join(boundary_edges(faces), ["mesh", "lo", "hi"], "left_semi")
    t = F.array(
        F.struct(F.col("b").alias("p"), F.col("a").alias("q"), (F.col("a") + offset).alias("s")),
        F.struct(F.col("b").alias("p"), (F.col("a") + offset).alias("q"), (F.col("b") + offset).alias("s")))
    # Face numbers 8f + 2 to 8f + 7 are free for the walls below face f (see extrude).
    return open_.select("mesh", "face", "i", F.posexplode(t).alias("j", "t")).select(
        "mesh", F.col("t.p").alias("a"), F.col("t.q").alias("b"), F.col("t.s").alias("c"), (F.col("face") * 8 + 2 + F.col("i") * 2 + F.col("j")).alias("face"))


def bottom_cap(faces: DataFrame, offset: int) -> DataFrame:
    """The faces at v + offset with winding turned round."""
    return faces.select("mesh", (F.col("c") + offset).alias("a"), (F.col("b") + offset).alias("b"), (F.col("a") + offset).alias("c"), (F.col("face") * 8 + 1).alias("face"))


def extrude(vertices: DataFrame, faces: DataFrame, offset: int, bottom_z: float) -> tuple[DataFrame, DataFrame]:
    """A closed solid: the surface, walls at its boundary and a bottom at one height.

    Face f gives 8f, its bottom 8f + 1 and its walls numbers up to 8f + 7, so nothing is sorted to number them.
    """
    low = vertices.withColumns({"v": F.col("v") + offset, "z": F.lit(bottom_z)})
    top = faces.select("mesh", "a", "b", "c", (F.col("face") * 8).alias("face"))
    return vertices.unionByName(low), top.unionByName(walls(faces, offset)).unionByName(bottom_cap(faces, offset))


def split_pinches(faces: DataFrame, offset: int) -> DataFrame:
    """Faces in which each fan of faces around a pinch vertex, from the second on, has a vertex of its own.

    The new number of a vertex v in its k-th fan (by least face) is v + offset * k.
    """
    at = faces.select("mesh", "face", "a", "b", "c", F.explode(F.array("a", "b", "c")).alias("v")).join(pinch_points(faces).select("mesh", "v"), ["mesh", "v"], "left_semi")

    def fans(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        v = key[1]
        root = {f: f for f in pdf.face}

        def find(f: int) -> int:
            while root[f] != f:
                f = root[f]
            return f

        seen: dict[int, int] = {}
        for f, *corners in sorted(zip(pdf.face, pdf.a, pdf.b, pdf.c)):
            for o in corners:
                if o != v:
                    if o in seen:
                        x, y = find(seen[o]), find(f)
                        root[max(x, y)] = min(x, y)
                    seen[o] = f
        order = {r: i for i, r in enumerate(sorted({find(f) for f in pdf.face}))}
        return pd.DataFrame({"mesh": key[0], "face": pdf.face, "v": v, "k": [order[find(f)] for f in pdf.face]})

    moved = at.groupBy("mesh", "v").applyInPandas(fans, "mesh long, face long, v long, k long").where("k > 0")
    out = faces
    for c in "abc":
        m = moved.select("mesh", "face", F.col("v").alias(c), F.col("k").alias("__k"))
        out = out.join(m, ["mesh", "face", c], "left").withColumn(c, F.col(c) + F.coalesce("__k", F.lit(0)) * offset).drop("__k")
    return out.select("mesh", "face", "a", "b", "c")


def outward(tri: DataFrame) -> DataFrame:
    """(mesh, face, x0..z2) with whole meshes turned if over half their faces look to the centroid.

    Centroids and votes are aggregates by mesh that come back by a join, so no mesh is gathered.
    """
    from gridloom.functions.geometry import triangle_normal

    mid = {k: (F.col(f"{k}0") + F.col(f"{k}1") + F.col(f"{k}2")) / 3 for k in "xyz"}
    t = tri.join(tri.groupBy("mesh").agg(*[F.avg(v).alias(f"m{k}") for k, v in mid.items()]), "mesh")
    n = triangle_normal()
    dot = sum((n[i] * (mid[k] - F.col(f"m{k}")) for i, k in enumerate("xyz")), F.lit(0.0))
    votes = t.groupBy("mesh").agg((F.avg(F.when(dot < 0, 1.0).otherwise(0.0)) > 0.5).alias("turn"))
    t = tri.join(votes, "mesh")
    swap = {f"{k}{i}": F.when(F.col("turn"), F.col(f"{k}{3 - i}")).otherwise(F.col(f"{k}{i}")) for k in "xyz" for i in (1, 2)}
    return t.select("mesh", "face", "x0", "y0", "z0", *[swap[f"{k}{i}"].alias(f"{k}{i}") for i in (1, 2) for k in "xyz"])


def terrain_solid(vertices: DataFrame, faces: DataFrame, offset: int, bottom_z: float, tolerance: float = 1e-10) -> tuple[DataFrame, DataFrame]:
    """A closed solid of a terrain surface: degenerate faces out, vertices welded, doubled and crowding faces out, then extruded."""
    fit = faces.join(drop_degenerate(face_points(faces, vertices)).select("mesh", "face"), ["mesh", "face"], "left_semi")
    v, f = weld(vertices, fit, tolerance)
    return extrude(v, drop_crowding(drop_overlaps(f, v)), offset, bottom_z)


def repair_accepted(before: DataFrame, after: DataFrame) -> DataFrame:
    """(mesh, accepted) of repaired triangles (mesh, x0..z2): area from a tenth to five times the former, and the
    centre moved by at most 5 % of the box's diagonal or 15 m, whichever is more."""
    from gridloom.functions.geometry import triangle_area

    def measured(t: DataFrame, n: str) -> DataFrame:
        mid = {k: (F.col(f"{k}0") + F.col(f"{k}1") + F.col(f"{k}2")) / 3 for k in "xyz"}
        return t.groupBy("mesh").agg(
            F.sum(triangle_area()).alias(f"area{n}"), *[F.avg(v).alias(f"{k}{n}") for k, v in mid.items()],
            *[(F.max(F.greatest(*[F.col(f"{k}{i}") for i in range(3)])) - F.min(F.least(*[F.col(f"{k}{i}") for i in range(3)]))).alias(f"d{k}{n}") for k in "xyz"])

    j = measured(before, "a").join(measured(after, "b"), "mesh")
    norm = lambda xs: F.sqrt(sum((x * x for x in xs), F.lit(0.0)))
    drift, size = norm([F.col(f"{k}a") - F.col(f"{k}b") for k in "xyz"]), norm([F.col(f"d{k}a") for k in "xyz"])
    ratio = F.col("areab") / F.col("areaa")
    return j.select("mesh", ((ratio >= 0.1) & (ratio <= 5) & (drift <= F.greatest(0.05 * size, F.lit(15.0)))).alias("accepted"))


#: Corners and faces of a box, outward (fixed values).
BOX_CORNERS = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)]
BOX_FACES = [(0, 2, 1), (0, 3, 2), (4, 5, 6), (4, 6, 7), (0, 1, 5), (0, 5, 4), (1, 2, 6), (1, 6, 5), (2, 3, 7), (2, 7, 6), (3, 0, 4), (3, 4, 7)]


def box_triangles(boxes: DataFrame) -> DataFrame:
    """(seq, face, x0..z2): twelve triangles of each box (seq, xa, xb, ya, yb, za, zb)."""
    pick = lambda k, bit: F.col(f"{k}b" if bit else f"{k}a")
    tri = F.array(*[F.array(*[F.struct(*[pick(k, BOX_CORNERS[i][n]).cast("double").alias(k) for n, k in enumerate("xyz")]) for i in f]) for f in BOX_FACES])
    t = boxes.select("seq", F.posexplode(tri).alias("face", "t"))
    return t.select("seq", "face", *[F.col("t")[i][k].alias(f"{k}{i}") for i in range(3) for k in "xyz"])
