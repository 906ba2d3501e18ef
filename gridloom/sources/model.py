"""City models as Parquet folders, named 2-D sources, and OBJ text."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.geometry import clip_box
from gridloom.operators.raster import flip

#: Names and colours of voxel codes (fixed values).
MATERIALS = {
    -1: ("ground", (0.45, 0.38, 0.30)), -2: ("tree", (0.20, 0.50, 0.20)), -3: ("building", (0.70, 0.70, 0.72)), -4: ("bridge", (0.55, 0.50, 0.45)),
}

_SOURCES: dict[str, Callable[[SparkSession], DataFrame]] = {}


def register_source(name: str, load: Callable[[SparkSession], DataFrame]) -> None:
    """A named DEM, land-cover or canopy source: a function that gives its (r, c, value) table."""
    _SOURCES[name] = load


def named_source(spark: SparkSession, name: str, south_up_rows: int | None = None) -> DataFrame:
    """The source's grid, north-up; south_up_rows: its number of rows if it is stored south-up."""
    if name not in _SOURCES:
        raise KeyError(f"unknown source {name!r}; register_source() adds one")
    g = _SOURCES[name](spark)
    return g if south_up_rows is None else flip(g, south_up_rows)


def write_model(tables: dict[str, DataFrame], path: str, n_rows: int, mode: str = "errorifexists") -> None:
    """Each table as a Parquet folder; grids and voxels are turned south-up here and nowhere else."""
    for name, df in tables.items():
        out = flip(df, n_rows) if {"r", "c"} <= set(df.columns) else df
        out.write.mode(mode).parquet(f"{path}/{name}")


def read_model(spark: SparkSession, path: str, names: list[str], n_rows: int) -> dict[str, DataFrame]:
    out = {}
    for name in names:
        df = spark.read.parquet(f"{path}/{name}")
        out[name] = flip(df, n_rows) if {"r", "c"} <= set(df.columns) else df
    return out


def voxel_quads(faces: DataFrame, size: float) -> DataFrame:
    """(code, face, k, x, y, z): four corners of each exposed face; x = row southwards, y = column, z up."""
    def corner(dx: int, dy: int, dz: int) -> Column:
        return F.struct(((F.col("r") + dx) * size).alias("x"), ((F.col("c") + dy) * size).alias("y"), ((F.col("z") + dz) * size).alias("z"))

    sides = {
        "south": [(1, 0, 0), (1, 1, 0), (1, 1, 1), (1, 0, 1)], "north": [(0, 0, 0), (0, 0, 1), (0, 1, 1), (0, 1, 0)],
        "east": [(0, 1, 0), (0, 1, 1), (1, 1, 1), (1, 1, 0)], "west": [(0, 0, 0), (1, 0, 0), (1, 0, 1), (0, 0, 1)],
        "up": [(0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)], "down": [(0, 0, 0), (0, 1, 0), (1, 1, 0), (1, 0, 0)],
    }
    quad = F.coalesce(*[F.when(F.col("face") == k, F.array(*[corner(*p) for p in v])) for k, v in sides.items()])
    q = faces.select("code", "r", "c", "z", "face", F.posexplode(quad).alias("k", "p"))
    return q.select("code", F.struct("r", "c", "z", "face").alias("quad"), "k", "p.x", "p.y", "p.z")


def rectangle_quads(rects: DataFrame, size: float) -> DataFrame:
    """(code, quad, k, x, y, z): four corners of each rectangle of faces (code, face, layer, u, v, height, width), in voxel_quads' frame."""
    u0, u1, v0, v1 = F.col("u"), F.col("u") + F.col("height"), F.col("v"), F.col("v") + F.col("width")
    side = F.col("layer") + F.when(F.col("face").isin("south", "east", "up"), 1).otherwise(0)
    at = lambda x, y, z: F.struct((x * size).alias("x"), (y * size).alias("y"), (z * size).alias("z"))
    rows = {  # (u, v) is (z, column), (z, row) or (row, column)
        "south": [(side, v0, u0), (side, v1, u0), (side, v1, u1), (side, v0, u1)], "north": [(side, v0, u0), (side, v0, u1), (side, v1, u1), (side, v1, u0)],
        "east": [(v0, side, u0), (v0, side, u1), (v1, side, u1), (v1, side, u0)], "west": [(v0, side, u0), (v1, side, u0), (v1, side, u1), (v0, side, u1)],
        "up": [(u0, v0, side), (u1, v0, side), (u1, v1, side), (u0, v1, side)], "down": [(u0, v0, side), (u0, v1, side), (u1, v1, side), (u1, v0, side)],
    }
    quad = F.coalesce(*[F.when(F.col("face") == k, F.array(*[at(*p) for p in v])) for k, v in rows.items()])
    q = rects.select("code", "face", "layer", "u", "v", F.posexplode(quad).alias("k", "p"))
    return q.select("code", F.struct("layer", "u", "v", "face").alias("quad"), "k", "p.x", "p.y", "p.z")


def cover_quads(cover: DataFrame, dem: DataFrame, size: float) -> DataFrame:
    """Corners of one quad for each cell with a code other than 0, at the cell's ground height."""
    c = cover.where("code <> 0").join(dem, ["r", "c"], "left").withColumn("dem", F.coalesce("dem", F.lit(0.0)))
    at = lambda dx, dy: F.struct(((F.col("r") + dx) * size).alias("x"), ((F.col("c") + dy) * size).alias("y"), F.col("dem").alias("z"))
    q = c.select("code", "r", "c", F.posexplode(F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 1))).alias("k", "p"))
    return q.select("code", F.struct("r", "c").alias("quad"), "k", "p.x", "p.y", "p.z")


def triangle_polygons(tri: DataFrame, lo: tuple[float, float], hi: tuple[float, float]) -> DataFrame:
    """Corners (code, quad, k, x, y, z) of triangles (code, seq, face, x0..z2) cut to a range of x and y."""
    cols = [f"{k}{i}" for i in range(3) for k in "xyz"]

    def run(batches):
        for pdf in batches:
            out = []
            for code, seq, face, *v in pdf[["code", "seq", "face", *cols]].itertuples(index=False, name=None):
                poly = clip_box(np.array(v, float).reshape(3, 3), lo, hi)
                out += [(code, seq, face, k, *p) for k, p in enumerate(poly.tolist()) if len(poly) >= 3]
            if out:
                yield pd.DataFrame(out, columns=["code", "seq", "face", "k", "x", "y", "z"])

    got = tri.select("code", "seq", "face", *cols).mapInPandas(run, "code int, seq long, face long, k int, x double, y double, z double")
    return got.select("code", F.struct("seq", "face").alias("quad"), "k", "x", "y", "z")


def obj_lines(corners: DataFrame, name: Callable[[Column], Column]) -> DataFrame:
    """(part, at, line) of an OBJ file from polygon corners (code, quad, k, x, y, z): shared vertices, one group for each code.

    Vertex numbers come from sorting the distinct points over partitions and adding each partition's start.
    """
    n = max(1, int(corners.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    v = corners.select("x", "y", "z").distinct().repartitionByRange(n, "x", "y", "z").withColumn("p", F.spark_partition_id()).cache()
    start = v.groupBy("p").agg(F.count("*").alias("n")).select("p", (F.coalesce(F.sum("n").over(Window.orderBy("p")), F.lit(0)) - F.col("n")).alias("start"))
    v = v.join(F.broadcast(start), "p").withColumn("id", F.row_number().over(Window.partitionBy("p").orderBy("x", "y", "z")) + F.col("start"))
    f = corners.join(v.select("x", "y", "z", "id"), ["x", "y", "z"]).groupBy("code", "quad").agg(F.array_sort(F.collect_list(F.struct("k", "id"))).alias("ids"))
    fl = f.select(F.lit(2).alias("part"), F.col("code").alias("g"), F.to_json("quad").alias("key"), F.concat(F.lit("f "), F.array_join(F.transform("ids", lambda x: x["id"].cast("string")), " ")).alias("line"))
    gl = f.select("code").distinct().select(F.lit(2).alias("part"), F.col("code").alias("g"), F.lit("").alias("key"), F.concat(F.lit("usemtl "), name(F.col("code"))).alias("line"))
    vl = v.select(F.lit(1).alias("part"), F.lit(0).alias("g"), F.lpad(F.col("id").cast("string"), 20, "0").alias("key"), F.format_string("v %.6f %.6f %.6f", "x", "y", "z").alias("line"))
    return vl.unionByName(fl).unionByName(gl)


def write_obj(corners: DataFrame, path: str, name: Callable[[Column], Column] | None = None) -> None:
    """An OBJ text folder of sorted parts (concatenate them in name order) with its MTL beside it."""
    name = name or (lambda c: F.coalesce(*[F.when(c == k, F.lit(v[0])) for k, v in MATERIALS.items()], F.concat(F.lit("class_"), c.cast("string"))))
    lines = obj_lines(corners, name).orderBy("part", "g", "key").select("line")
    lines.write.mode("overwrite").text(f"{path}.obj")
    spark = corners.sparkSession
    mtl = [x for n, rgb in MATERIALS.values() for x in (f"newmtl {n}", "Kd " + " ".join(f"{c:.3f}" for c in rgb))]
    spark.createDataFrame([(x,) for x in mtl], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.mtl")
