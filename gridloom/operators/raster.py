"""2-D grids from meshes: triangle x cell joins, conflicts, nearest fills, land cover, canopy and resizing.

Cells are rows (r, c, ...), r = 0 at the north. Grid coordinates: the centre of cell (r, c) is at
(x = c, y = r), as GridFrame.rowcol gives them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A cell whose centre is outside a triangle by up to this barycentric weight is still claimed.
TOLERANCE = -0.01
DEFAULT_CLASS = 14
#: Rank of each land-cover class where polygons overlap (fixed values).
PRIORITY = {14: 0, 12: 1, 1: 2, 2: 3, 3: 4, 4: 5, 5: 6, 6: 7, 7: 8, 8: 9, 9: 10, 10: 11, 11: 12, 13: 13}
#: Land-use codes and their land-cover classes (fixed values).
LAND_USE = {
    201: 4, 202: 4, 203: 5, 204: 9, 205: 2, 211: 13, 212: 13, 213: 13, 214: 11, 215: 12, 216: 12, 217: 2, 218: 11,
    219: 4, 220: 2, 221: 11, 222: 11, 223: 11, 224: 1, 231: 14, 251: 11, 252: 1, 260: 4, 261: 13, 262: 12, 263: 1,
}
#: Trunk height over tree height (fixed values).
TRUNK_RATIO = 11.76 / 19.98


def lookup(col: Column, table: dict[int, int], default: int) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(m[col], F.lit(default))


def _window(lo: Column, hi: Column, n: int) -> Column:
    return F.sequence(F.greatest(F.lit(0), F.least(F.lit(n), lo)).cast("int"), F.least(F.lit(n - 1), hi).cast("int"))


def triangle_cells(tri: DataFrame, n_rows: int, n_cols: int) -> DataFrame:
    """(triangle columns..., r, c, z) for each cell centre in a triangle x0..z2 in grid coordinates.

    The join is an explode of each triangle's own cell window and an exact test, so its cost follows the
    triangles' size and it needs no shuffle. Triangles without area give the cells of their corners.
    """
    x, y, z = ([F.col(f"{k}{i}") for i in range(3)] for k in "xyz")
    den = (y[1] - y[2]) * (x[0] - x[2]) + (x[2] - x[1]) * (y[0] - y[2])
    t = tri.withColumn("__den", den)
    lo = lambda v: F.greatest(F.lit(0), F.floor(F.least(*v)))
    hi = lambda v, n: F.least(F.lit(n - 1), F.floor(F.greatest(*v) + 0.5))
    w = (
        t.where(F.abs("__den") >= 1e-20)
        .withColumns({"__c0": lo(x), "__c1": hi(x, n_cols), "__r0": lo(y), "__r1": hi(y, n_rows)})
        .where("__c0 <= __c1 and __r0 <= __r1")
        .withColumn("r", F.explode(F.expr("sequence(cast(__r0 as int), cast(__r1 as int))")))
        .withColumn("c", F.explode(F.expr("sequence(cast(__c0 as int), cast(__c1 as int))")))
    )
    w0 = ((y[1] - y[2]) * (F.col("c") - x[2]) + (x[2] - x[1]) * (F.col("r") - y[2])) / F.col("__den")
    w1 = ((y[2] - y[0]) * (F.col("c") - x[2]) + (x[0] - x[2]) * (F.col("r") - y[2])) / F.col("__den")
    w = w.withColumns({"__w0": w0, "__w1": w1}).withColumn("__w2", 1 - F.col("__w0") - F.col("__w1"))
    w = w.where(f"__w0 >= {TOLERANCE} and __w1 >= {TOLERANCE} and __w2 >= {TOLERANCE}")
    unit = lambda k: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(k)))
    w = w.withColumns({"__w0": unit("__w0"), "__w1": unit("__w1")})
    w = w.withColumn("__w2", F.greatest(F.lit(0.0), 1 - F.col("__w0") - F.col("__w1")))
    s = F.col("__w0") + F.col("__w1") + F.col("__w2")
    # Relative to one corner, so that level triangles give their height exactly and ties stay ties.
    inside = w.withColumn("z", z[2] + (F.col("__w0") * (z[0] - z[2]) + F.col("__w1") * (z[1] - z[2])) / s)
    flat = t.where(F.abs("__den") < 1e-20).withColumn(
        "__v", F.explode(F.array(*[F.struct(F.rint(y[i]).cast("int").alias("r"), F.rint(x[i]).cast("int").alias("c"), z[i].alias("z")) for i in range(3)])))
    flat = flat.select(*tri.columns, "__v.r", "__v.c", "__v.z").where(f"r between 0 and {n_rows - 1} and c between 0 and {n_cols - 1}")
    return inside.select(*tri.columns, "r", "c", "z").unionByName(flat)


def mesh_cells(tri: DataFrame, n_rows: int, n_cols: int) -> DataFrame:
    """(seq, r, c, z_min, z_max) of each mesh over its cells; tri has seq and x0..z2."""
    hit = triangle_cells(tri.select("seq", *[f"{k}{i}" for i in range(3) for k in "xyz"]), n_rows, n_cols)
    return hit.groupBy("seq", "r", "c").agg(F.min("z").alias("z_min"), F.max("z").alias("z_max"))


def building_heights(cells: DataFrame, dem: DataFrame) -> DataFrame:
    """(r, c, h, id, h_min): tallest mesh of each cell above the ground; of equal ones the first in order.

    cells: (seq, r, c, z_min, z_max), seq from 1; dem: (r, c, dem). Meshes not above the ground are left out.
    """
    above = _above_ground(cells, dem)
    best = above.groupBy("r", "c").agg(F.max(F.struct("h", (-F.col("seq")).alias("k"), "h_min")).alias("b"))
    return best.select("r", "c", "b.h", (-F.col("b.k")).alias("id"), "b.h_min")


def building_segments(cells: DataFrame, dem: DataFrame) -> DataFrame:
    """(r, c, segments): [h_min, h_max] of every mesh over a cell, in mesh order."""
    parts = _above_ground(cells, dem).groupBy("r", "c").agg(F.array_sort(F.collect_list(F.struct("seq", "h_min", F.col("h").alias("h_max")))).alias("s"))
    return parts.select("r", "c", F.transform("s", lambda s: F.struct(s["h_min"].alias("h_min"), s["h_max"].alias("h_max"))).alias("segments"))


def _above_ground(cells: DataFrame, dem: DataFrame) -> DataFrame:
    j = cells.join(dem, ["r", "c"], "left").withColumn("dem", F.coalesce("dem", F.lit(0.0)))
    j = j.withColumns({"h": F.greatest(F.lit(0.0), F.col("z_max") - F.col("dem")), "h_min": F.greatest(F.lit(0.0), F.col("z_min") - F.col("dem"))})
    return j.where("h > 0")


def fill_ids(wanted: DataFrame, claimed: DataFrame, n_rows: int, n_cols: int, block: int = 16) -> DataFrame:
    """(r, c, id): the id of the nearest claimed cell for each wanted cell that has none; ties by (r, c).

    Both are (r, c[, id]). Cells are looked up in square blocks, in rings of growing distance: a match
    within the ring's radius is final. The last ring covers the grid. Nothing claimed gives an empty table.
    """
    open_ = wanted.select("r", "c").distinct().join(claimed.select("r", "c"), ["r", "c"], "left_anti")
    side = max(n_rows, n_cols)
    out, size = None, block
    while True:
        b = lambda k: F.floor(F.col(k) / size).cast("int")
        near = open_.withColumns({"br": b("r"), "bc": b("c")}).withColumn("o", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])))
        near = near.select("r", "c", (F.col("br") + F.col("o.i")).alias("br"), (F.col("bc") + F.col("o.j")).alias("bc"))
        have = claimed.select(F.col("r").alias("r1"), F.col("c").alias("c1"), "id", b("r").alias("br"), b("c").alias("bc"))
        d2 = (F.col("r") - F.col("r1")) * (F.col("r") - F.col("r1")) + (F.col("c") - F.col("c1")) * (F.col("c") - F.col("c1"))
        best = near.join(have, ["br", "bc"]).withColumn("d2", d2).groupBy("r", "c").agg(F.min(F.struct("d2", "r1", "c1", "id")).alias("m"))
        best = best.select("r", "c", "m.id", "m.d2")
        last = size >= side
        final = best if last else best.where(F.col("d2") <= size * size)
        out = final.select("r", "c", "id") if out is None else out.unionByName(final.select("r", "c", "id"))
        if last:
            return out
        open_ = open_.join(final.select("r", "c"), ["r", "c"], "left_anti")
        size *= 4


def polygon_cells(polys: DataFrame, n_rows: int, n_cols: int) -> DataFrame:
    """(seq, code, r, c) for each cell centre strictly inside a polygon (seq, code, ring[, holes]) and in none of its holes."""
    from gridloom.functions.geometry import inside_ring

    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    w = polys.where(F.size("ring") >= 3).withColumns({
        "__c": _window(F.floor(F.array_min(xs)), F.ceil(F.array_max(xs)), n_cols), "__r": _window(F.floor(F.array_min(ys)), F.ceil(F.array_max(ys)), n_rows)})
    w = w.where((F.array_max(xs) >= 0) & (F.array_min(xs) <= n_cols - 1) & (F.array_max(ys) >= 0) & (F.array_min(ys) <= n_rows - 1))
    w = w.withColumn("r", F.explode("__r")).withColumn("c", F.explode("__c"))
    x, y = F.col("c").cast("double"), F.col("r").cast("double")
    w = w.where(inside_ring(x, y, F.col("ring")))
    if "holes" in polys.columns:
        w = w.where(~F.exists("holes", lambda h: inside_ring(x, y, h)))
    return w.select("seq", "code", "r", "c")


def clip_polygons(polys: DataFrame, lo: tuple[float, float], hi: tuple[float, float]) -> DataFrame:
    """Polygons (seq, code, ring, holes) cut to a range of x and y; those with nothing left go, and so do holes.

    seq: a long. A concave ring that falls apart stays one ring whose parts touch along the range's edge.
    """
    from gridloom.functions.geometry import clip_box

    def cut(ring: list) -> list:
        p = clip_box(np.array([[q["x"], q["y"]] for q in ring], float).reshape(-1, 2), lo, hi)
        return [{"x": x, "y": y} for x, y in p.tolist()] if len(p) >= 3 else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(seq, code, cut(ring), [h for h in map(cut, holes) if h]) for seq, code, ring, holes in zip(pdf.seq, pdf.code, pdf.ring, pdf.holes)]
            yield pd.DataFrame([r for r in rows if r[2]], columns=["seq", "code", "ring", "holes"])

    point = "array<struct<x:double,y:double>>"
    near = polys.where((F.size("ring") >= 3) & F.exists("ring", lambda p: p["x"] >= lo[0]) & F.exists("ring", lambda p: p["x"] <= hi[0])
                       & F.exists("ring", lambda p: p["y"] >= lo[1]) & F.exists("ring", lambda p: p["y"] <= hi[1]))
    return near.select("seq", "code", "ring", "holes").mapInPandas(run, f"seq long, code int, ring {point}, holes array<{point}>")


def terrain_points(tri: DataFrame, decimals: int = 10) -> DataFrame:
    """(x, y, z): the corners of triangles x0..z2, one of each place (to so many decimals), the lowest."""
    p = tri.select(F.explode(F.array(*[F.struct(*[F.col(f"{k}{i}").alias(k) for k in "xyz"]) for i in range(3)])).alias("p")).select("p.*")
    one = p.groupBy(F.round("x", decimals).alias("qx"), F.round("y", decimals).alias("qy")).agg(F.min(F.struct("z", "x", "y")).alias("m"))
    return one.select("m.x", "m.y", "m.z")


def land_cover(cells: DataFrame, grid: DataFrame, default: int = DEFAULT_CLASS) -> DataFrame:
    """(r, c, code) of each grid cell: the class of highest priority, of equal ones the last in order."""
    rank = lookup(F.col("code"), PRIORITY, 0)
    won = cells.groupBy("r", "c").agg(F.max(F.struct(rank.alias("p"), F.col("seq"), F.col("code"))).alias("m")).select("r", "c", "m.code")
    return grid.select("r", "c").join(won, ["r", "c"], "left").select("r", "c", F.coalesce("code", F.lit(default)).alias("code"))


def vegetation_tops(cells: DataFrame, dem: DataFrame) -> DataFrame:
    """(r, c, top): highest vegetation above ground; cells: (seq, r, c, z_max, height), a given height wins over z."""
    j = cells.join(dem, ["r", "c"], "left")
    top = F.coalesce("height", F.greatest(F.lit(0.0), F.col("z_max") - F.coalesce("dem", F.lit(0.0))))
    return j.groupBy("r", "c").agg(F.max(top).alias("top")).where("top > 0")


def merge_canopy(own: DataFrame, other: DataFrame) -> DataFrame:
    """(r, c, top): own where it is above 0, else the other source's."""
    a, b = own.withColumnRenamed("top", "a"), other.withColumnRenamed("top", "b")
    j = a.join(b, ["r", "c"], "full").select("r", "c", F.coalesce(F.nullif("a", F.lit(0.0)), "b", F.lit(0.0)).alias("top"))
    return j.where("top > 0")


def static_canopy(cover: DataFrame, tree_codes: list[int], height: float) -> DataFrame:
    return cover.where(F.col("code").isin(tree_codes)).select("r", "c", F.lit(height).alias("top"))


def canopy_base(top: Column, bottom: Column, ratio: float = TRUNK_RATIO) -> Column:
    """The lower edge of a canopy: the given one, or top * ratio, and never above the top."""
    return F.least(F.coalesce(bottom, top * ratio), top)


def terrain_heights(tri: DataFrame, grid: DataFrame, n_rows: int, n_cols: int) -> DataFrame:
    """(r, c, dem) of each grid cell, linear in the triangle that holds its centre; cells outside all take the nearest cell's. No terrain: 0.

    Of several triangles the one counts in which the centre lies deepest (the barycentric weight that is least is greatest), then the higher.
    """
    hit = triangle_cells(tri.select(*[f"{k}{i}" for i in range(3) for k in "xyz"]), n_rows, n_cols)
    x, y = [F.col(f"x{i}") for i in range(3)], [F.col(f"y{i}") for i in range(3)]
    den = F.nullif((y[1] - y[2]) * (x[0] - x[2]) + (x[2] - x[1]) * (y[0] - y[2]), F.lit(0.0))
    a = ((y[1] - y[2]) * (F.col("c") - x[2]) + (x[2] - x[1]) * (F.col("r") - y[2])) / den
    b = ((y[2] - y[0]) * (F.col("c") - x[2]) + (x[0] - x[2]) * (F.col("r") - y[2])) / den
    deep = F.coalesce(F.round(F.least(a, b, 1 - a - b), 9), F.lit(-1.0))
    dem = hit.groupBy("r", "c").agg(F.max(F.struct(deep.alias("deep"), "z")).alias("m")).select("r", "c", F.col("m.z").alias("id"))
    rest = fill_ids(grid, dem, n_rows, n_cols)
    both = dem.unionByName(rest)
    return grid.select("r", "c").join(both, ["r", "c"], "left").select("r", "c", F.coalesce("id", F.lit(0.0)).alias("dem"))


def anchor_shift(vertices: DataFrame, old: DataFrame | None, new: DataFrame, n_rows: int, n_cols: int) -> DataFrame:
    """(seq, dz): the lift of each mesh onto another ground, at the cell of the mean of its vertices.

    vertices: (seq, x, y, z). With an old ground dz = new - old, else new - the mesh's lowest point.
    """
    fold = lambda v, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.rint(v).cast("int")))
    m = vertices.groupBy("seq").agg(fold(F.avg("y"), n_rows).alias("r"), fold(F.avg("x"), n_cols).alias("c"), F.min("z").alias("low"))
    m = m.join(new.withColumnRenamed("dem", "new"), ["r", "c"])
    if old is None:
        return m.select("seq", (F.col("new") - F.col("low")).alias("dz"))
    return m.join(old.withColumnRenamed("dem", "old"), ["r", "c"]).select("seq", (F.col("new") - F.col("old")).alias("dz"))


def _source_at(i: Column, n_in: int, n_out: int) -> Column:
    return F.lit(0.0) if n_out == 1 else i * float(n_in - 1) / float(n_out - 1)


def resize_nearest(grid: DataFrame, shape: tuple[int, int], to: tuple[int, int], value: str) -> DataFrame:
    """The grid at another shape: corners map to corners, each cell takes the nearest (half rounds up)."""
    out = grid.sparkSession.range(to[0] * to[1]).select(F.expr(f"cast(id div {to[1]} as int)").alias("r"), F.expr(f"cast(id % {to[1]} as int)").alias("c"))
    at = lambda k, i: F.floor(_source_at(F.col(k), shape[i], to[i]) + 0.5).cast("int")
    src = grid.select(F.col("r").alias("sr"), F.col("c").alias("sc"), F.col(value))
    return out.withColumns({"sr": at("r", 0), "sc": at("c", 1)}).join(src, ["sr", "sc"]).select("r", "c", value)


def resize_bilinear(grid: DataFrame, shape: tuple[int, int], to: tuple[int, int], value: str) -> DataFrame:
    """The grid at another shape: corners map to corners, linear in between."""
    out = grid.sparkSession.range(to[0] * to[1]).select(F.expr(f"cast(id div {to[1]} as int)").alias("r"), F.expr(f"cast(id % {to[1]} as int)").alias("c"))
    out = out.withColumns({"y": _source_at(F.col("r"), shape[0], to[0]) + 0.0, "x": _source_at(F.col("c"), shape[1], to[1]) + 0.0})
    out = out.withColumns({"y0": F.floor("y").cast("int"), "x0": F.floor("x").cast("int")})
    out = out.withColumns({"fy": F.col("y") - F.col("y0"), "fx": F.col("x") - F.col("x0")})
    corners = F.array(*[F.struct((F.col("y0") + i).alias("sr"), (F.col("x0") + j).alias("sc"),
                                 ((F.col("fy") if i else 1 - F.col("fy")) * (F.col("fx") if j else 1 - F.col("fx"))).alias("w")) for i in (0, 1) for j in (0, 1)])
    src = grid.select(F.col("r").alias("sr"), F.col("c").alias("sc"), F.col(value).alias("v"))
    e = out.select("r", "c", F.explode(corners).alias("k")).where("k.w > 0").select("r", "c", "k.sr", "k.sc", "k.w")
    return e.join(src, ["sr", "sc"]).groupBy("r", "c").agg(F.sum(F.col("w") * F.col("v")).alias(value))


def flip(grid: DataFrame, n_rows: int) -> DataFrame:
    """North-up to south-up rows and back."""
    return grid.withColumn("r", F.lit(n_rows - 1) - F.col("r"))


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def stride_for(pixels: int, most: int = 500_000) -> int:
    return max(1, math.ceil(math.sqrt(pixels / most)))


def raster_triangles(pixels: DataFrame) -> DataFrame:
    """(x0..z2): two triangles for each 2 x 2 block of pixels (r, c, lon, lat, z) that are all there."""
    p = pixels.select("r", "c", F.struct("lon", "lat", "z").alias("p")).where("p.z is not null")
    at = lambda i, j, n: p.select((F.col("r") - i).alias("r"), (F.col("c") - j).alias("c"), F.col("p").alias(n))
    q = p.withColumnRenamed("p", "a").join(at(0, 1, "b"), ["r", "c"]).join(at(1, 0, "d"), ["r", "c"]).join(at(1, 1, "e"), ["r", "c"])
    t = q.select("r", "c", F.posexplode(F.array(F.array("a", "d", "b"), F.array("b", "d", "e"))).alias("k", "t"))
    return t.select("r", "c", "k", *[F.col("t")[i][f].alias(f"{n}{i}") for i in range(3) for n, f in (("x", "lon"), ("y", "lat"), ("z", "z"))])
