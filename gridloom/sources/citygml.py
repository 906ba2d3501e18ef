"""City-model XML as DataFrames: files, headers, terrain and land use by regular expressions, meshes by element.

Files are read whole through Spark's text reader, so they can be in any store it reads; a file that can't
be parsed gives a row in the failures and no meshes.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import codes, frames, geometry

MESH = ("feature_type string, feature_id string, k int, attrs map<string,string>, "
        "vertices array<struct<x:double,y:double,z:double>>, faces array<struct<a:int,b:int,c:int>>")
#: Folders of a dataset by feature type (fixed values).
FOLDERS = {"bldg": "building", "brid": "bridge", "dem": "terrain", "veg": "vegetation", "luse": "land use"}


def discover(spark: SparkSession, path: str) -> list[str]:
    """Dataset folders at a path: itself if it has `udx` or .gml files, else those of its children and theirs, sorted."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    at = fs.makeQualified(at)

    def entries(p):
        return sorted(((s.getPath(), s.isDirectory()) for s in fs.listStatus(p)), key=lambda x: str(x[0]))

    def is_dataset(p) -> bool:
        return any((d and q.getName() == "udx") or q.getName().endswith(".gml") for q, d in entries(p))

    if is_dataset(at):
        return [at.toString()]
    found, level = [], [at]
    for _ in range(2):
        level = [q for p in level for q, d in entries(p) if d]
        found += [q.toString() for q in level if is_dataset(q)]
    if not found:
        raise FileNotFoundError(f"no city model at {path}")
    return list(dict.fromkeys(found))


def read_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, text, feature_type, epsg, mesh_code) of all .gml files below the paths."""
    t = spark.read.text(paths, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.gml")
    t = t.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    folder = F.regexp_extract("path", r"/udx/([^/]+)/", 1)
    named = F.when(F.lower(codes.file_name(F.col("path"))).contains("luse"), F.lit("land use"))
    kind = F.coalesce(*[F.when(folder == k, F.lit(v)) for k, v in FOLDERS.items()], named, codes.probe_type(F.col("text")), F.lit("building"))
    return t.select("path", "text", kind.alias("feature_type"), codes.resolve_srs(codes.srs_name(F.col("text"))).alias("epsg"), codes.mesh_code(F.col("path")).alias("mesh_code"))


def envelope_meets(text: Column, lo_x: float, lo_y: float, hi_x: float, hi_y: float) -> Column:
    """Whether a file's lowerCorner/upperCorner (lat lon) meets a range; files without are kept."""
    head = F.substring(text, 1, codes.HEADER_CRS)
    lo, hi = (geometry.numbers(F.regexp_extract(head, rf"<gml:{k}Corner>([^<]+)</gml:{k}Corner>", 1)) for k in ("lower", "upper"))
    meets = (F.get(hi, F.lit(1)) >= lo_x) & (F.get(lo, F.lit(1)) <= hi_x) & (F.get(hi, F.lit(0)) >= lo_y) & (F.get(lo, F.lit(0)) <= hi_y)
    return F.coalesce(meets, F.lit(True))


def tin_from_text(df: DataFrame, text_col: str) -> DataFrame:
    """df's other columns plus (face, x0..z2): a triangle of the first nine numbers of each position list that has them."""
    lists = F.regexp_extract_all(F.col(text_col), F.lit(r"<gml:posList[^>]*>([^<]+)</gml:posList>"), F.lit(1))
    t = df.select(*[c for c in df.columns if c != text_col], F.posexplode(lists).alias("face", "__l")).withColumn("__v", geometry.numbers(F.col("__l"))).where("size(__v) >= 9")
    return t.select(*[c for c in df.columns if c != text_col], "face", *[F.get("__v", F.lit(3 * i + n)).alias(f"{k}{i}") for i in range(3) for n, k in enumerate("xyz")])


def _rings(block: Column, pattern: str) -> Column:
    """array<array<struct(x, y)>> of the position lists a pattern finds, x = longitude, of three points or more."""
    lists = F.transform(F.regexp_extract_all(block, F.lit(pattern), F.lit(1)), lambda s: geometry.pos_list(s))
    return F.filter(F.transform(lists, lambda l: F.transform(l, lambda p: F.struct(p["y"].alias("x"), p["x"].alias("y")))), lambda p: F.size(p) >= 3)


def land_use_from_text(df: DataFrame, text_col: str, bounds: tuple[float, float, float, float] | None = None) -> DataFrame:
    """df's other columns plus (k, part, class, ring, holes): each part of land-use features with a class and a ring of three points or more.

    A position list below an interior is a hole of the exterior before it; every other is a part by itself. x =
    longitude and y = latitude. bounds (lo_x, lo_y, hi_x, hi_y) keeps parts whose ring's box meets them.
    """
    keep = [c for c in df.columns if c != text_col]
    blocks = F.regexp_extract_all(F.col(text_col), F.lit(r"(?s)<luse:LandUse[^>]*>(.*?)</luse:LandUse>"), F.lit(1))
    b = df.select(*keep, F.posexplode(blocks).alias("k", "__b"))
    b = b.withColumn("class", F.regexp_extract("__b", r"<luse:class[^>]*>(\d+)</luse:class>", 1).try_cast("int")).where("class is not null")
    # Cut behind each interior's start tag: what precedes an exterior's list is a part of its own with the interiors up to the next.
    parts = F.regexp_extract_all("__b", F.lit(r"(?s)((?:(?!</?gml:interior).)*?<gml:posList[^>]*>[^<]+</gml:posList>(?:(?:(?!<gml:(?:posList|exterior)).)*?<gml:interior[^>]*>.*?</gml:interior>)*)"), F.lit(1))
    p = b.select(*keep, "k", "class", F.posexplode(parts).alias("part", "__p"))
    holes = _rings(F.col("__p"), r"(?s)<gml:interior[^>]*>.*?<gml:posList[^>]*>([^<]+)</gml:posList>.*?</gml:interior>")
    outer = _rings(F.regexp_replace("__p", r"(?s)<gml:interior[^>]*>.*?</gml:interior>", ""), r"<gml:posList[^>]*>([^<]+)</gml:posList>")
    out = p.select(*keep, "k", "part", "class", F.get(outer, F.lit(0)).alias("ring"), holes.alias("holes")).where("ring is not null")
    if bounds:
        x, y = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
        out = out.where((F.array_max(x) >= bounds[0]) & (F.array_min(x) <= bounds[2]) & (F.array_max(y) >= bounds[1]) & (F.array_min(y) <= bounds[3]))
    return out


def _name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _all(e: ET.Element, *names: str) -> list[ET.Element]:
    return [x for x in e.iter() if _name(x) in names]


def _ring(e: ET.Element) -> np.ndarray:
    """Points of a ring, without a closing repeat."""
    lists = _all(e, "posList") or _all(e, "pos")
    v = np.array([float(x) for p in lists for x in (p.text or "").split()])
    p = v[: len(v) // 3 * 3].reshape(-1, 3)
    return p[:-1] if len(p) > 3 and ((p[0] - p[-1]) ** 2).sum() < 1e-10 else p


class _Mesh:
    """Polygons put together with running vertex numbers."""

    def __init__(self) -> None:
        self.v: list[np.ndarray] = []
        self.f: list[np.ndarray] = []
        self.n = 0

    def polygons(self, e: ET.Element | None) -> _Mesh:
        for p in _all(e, "Polygon", "Triangle") if e is not None else []:
            outer = [x for x in p if _name(x) == "exterior"]
            pts = _ring(outer[0]) if outer else np.zeros((0, 3))
            holes = [h for h in (_ring(x) for x in p if _name(x) == "interior") if len(h) >= 3]
            tri = geometry.triangulate(pts, holes)
            if len(tri):
                every = np.vstack([pts, *holes])
                self.v.append(every)
                self.f.append(tri + self.n)
                self.n += len(every)
        return self

    def back(self, epsg: str | None) -> _Mesh:
        """Points of a projected system (east, north, z) as (latitude, longitude, z); others as they are."""
        if epsg in _PROJECTED:
            tm, east, north = _PROJECTED[epsg]
            for i, v in enumerate(self.v):
                lon, lat = tm.unproject(v[:, 0] - east, v[:, 1] - north, frames.NUMPY)
                self.v[i] = np.column_stack([lat, lon, v[:, 2]])
        return self

    def moved(self, matrix: np.ndarray, ref: np.ndarray) -> _Mesh:
        self.v = [v @ matrix[:3, :3].T + matrix[:3, 3] + ref for v in self.v]
        return self

    def __bool__(self) -> bool:
        return self.n > 0

    def columns(self) -> tuple[list, list]:
        v = np.vstack(self.v) if self.v else np.zeros((0, 3))
        f = np.vstack(self.f) if self.f else np.zeros((0, 3), int)
        return [dict(zip("xyz", p)) for p in v.tolist()], [dict(zip("abc", t)) for t in f.tolist()]


SURFACES = ("RoofSurface", "WallSurface", "GroundSurface", "OuterCeilingSurface", "OuterFloorSurface", "ClosureSurface")


def _under(e: ET.Element, *names: str) -> list[_Mesh]:
    return [m for x in _all(e, *names) if (m := _Mesh().polygons(x))]


def _joined(meshes: list[_Mesh]) -> _Mesh:
    out = _Mesh()
    for m in meshes:
        out.v += m.v
        out.f += [f + out.n for f in m.f]
        out.n += m.n
    return out


def _building(e: ET.Element, lod: int | None) -> tuple[_Mesh, int]:
    """The preferred level of detail if it has polygons, else the highest that has, else every polygon."""
    order = [*([lod] if lod is not None else []), 4, 3, 2, 1]
    for k in order:
        if k >= 2:
            bounded = [b for s in _all(e, *SURFACES) for b in _under(s, f"lod{k}MultiSurface")]
            got = _joined(bounded) or _joined(_under(e, f"lod{k}MultiSurface", f"lod{k}Solid"))
        else:
            got = _joined(_under(e, "lod1Solid", "lod1MultiSurface"))
        if got:
            return got, k
    return _Mesh().polygons(e), 0


def _first_text(e: ET.Element, *names: str) -> str | None:
    return next((x.text.strip() for x in _all(e, *names) if x.text and x.text.strip()), None)


def _bridge(e: ET.Element) -> _Mesh:
    solid = [x for x in e if _name(x) in tuple(f"lod{k}Solid" for k in (4, 3, 2, 1))]
    parts = _all(e, "BridgeConstructionElement", "BridgeInstallation", "BridgePart")
    for got in (_joined([_Mesh().polygons(x) for x in solid]), _joined([m for p in parts for m in _under(p, *[f"lod{k}Solid" for k in (4, 3, 2, 1)])]),
                _joined([m for x in _all(e, "boundedBy") for m in [_Mesh().polygons(x)]] + [m for p in parts for m in _under(p, *[f"lod{k}Geometry" for k in (4, 3, 2, 1)])])):
        if got:
            return got
    return _Mesh().polygons(e)


def _implicit(e: ET.Element, prototypes: dict[str, _Mesh]) -> _Mesh:
    """A prototype placed by matrix and reference point; a matrix of other than 16 numbers counts as identity."""
    m = [float(x) for x in (_first_text(e, "transformationMatrix") or "").split()]
    matrix = np.array(m).reshape(4, 4) if len(m) == 16 else np.eye(4)
    ref = [x for x in e if _name(x) == "referencePoint"]
    at = np.array([float(x) for x in (_first_text(ref[0], "pos", "coordinates") or "0 0 0").replace(",", " ").split()][:3]) if ref else np.zeros(3)
    geo = next((x for x in e if _name(x) in ("relativeGMLGeometry", "relativeGeometry")), None)
    own = _Mesh().polygons(geo)
    if not own and geo is not None:
        href = next((v for k, v in geo.attrib.items() if k.rpartition("}")[2] == "href"), "")
        own = _joined([prototypes[href.lstrip("#")]] if href.lstrip("#") in prototypes else [])
    return own.moved(matrix, at)


def _prototypes(root: ET.Element) -> dict[str, _Mesh]:
    out: dict[str, _Mesh] = {}
    for geo in _all(root, "relativeGMLGeometry", "relativeGeometry"):
        for x in geo:
            key = next((v for k, v in x.attrib.items() if k.rpartition("}")[2] == "id"), None)
            if key and key not in out and (m := _Mesh().polygons(x)):
                out[key] = m
    return out


def _plant(e: ET.Element, prototypes: dict[str, _Mesh]) -> _Mesh:
    for k in (4, 3, 2, 1):
        if got := _joined([_implicit(i, prototypes) for x in _all(e, f"lod{k}ImplicitRepresentation") for i in _all(x, "ImplicitGeometry")]):
            return got
    for k in (4, 3, 2, 1):
        if got := _joined(_under(e, f"lod{k}MultiSurface", f"lod{k}Geometry", f"lod{k}MultiSolid")):
            return got
    return _Mesh().polygons(e)


#: Attributes of a plant and their names here (fixed values).
PLANT = {"height": "height", "averageHeight": "height", "species": "type", "class": "type", "crownDiameter": "crown_diameter",
         "crownHeight": "crown_height", "trunkHeight": "trunk_height", "crownVolume": "crown_volume"}


#: Projected systems that points are taken back from.
_PROJECTED = frames.projections()


def extract(text: str, feature_type: str, lod: int | None = None, epsg: str | None = None) -> list[tuple]:
    """(feature_type, feature_id, k, attrs, vertices, faces) of a file's features, in document order.

    epsg: the file's projected system, if it has one; its points are given as latitude and longitude.
    """
    root = ET.fromstring(text)
    rows: list[tuple[str, dict, _Mesh]] = []

    def gml_id(e: ET.Element) -> str:
        return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == "id"), "unknown")

    if feature_type == "building":
        for e in _all(root, "Building"):
            m, k = _building(e, lod)
            h = _first_text(e, "measuredHeight")
            rows.append((gml_id(e), {"lod": str(k), **({"height": h} if h else {})}, m))
    elif feature_type == "bridge":
        rows = [(gml_id(e), {}, _bridge(e)) for e in _all(root, "Bridge")]
    elif feature_type == "terrain":
        rows = [(gml_id(e), {}, _Mesh().polygons(e)) for e in _all(root, "TINRelief")]
    else:
        known = _prototypes(root)
        for e in _all(root, "PlantCover", "SolitaryVegetationObject"):
            attrs = {PLANT[_name(x)]: x.text.strip() for x in e if _name(x) in PLANT and x.text and x.text.strip()}
            for g in _all(e, "doubleAttribute"):
                key, v = g.attrib.get("name", ""), _first_text(g, "value")
                if key in PLANT and v and PLANT[key] not in attrs:
                    attrs[PLANT[key]] = v
            rows.append((gml_id(e), attrs, _plant(e, known)))
    return [(feature_type, i, n, a, *m.back(epsg).columns()) for n, (i, a, m) in enumerate(rows) if m]


def meshes(files: DataFrame, lod: int | None = None) -> DataFrame:
    """(path, feature_type, feature_id, k, attrs, vertices, faces, failure) of files (path, text, feature_type[, epsg]).

    x = latitude and y = longitude, also for files in a projected system; without an epsg, points are as the file has
    them. A file that can't be parsed is one row
    with its error in `failure` and nothing else.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "feature_type", "feature_id", "k", "attrs", "vertices", "faces", "failure"]
        for pdf in batches:
            for path, text, kind, epsg in zip(pdf.path, pdf.text, pdf.feature_type, pdf.epsg):
                try:
                    rows = [(path, *r, None) for r in extract(text, kind, lod, epsg)]
                except (ET.ParseError, ValueError) as e:
                    rows = [(path, kind, None, None, None, None, None, str(e)[:300])]
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({"k": "Int32"})

    own = F.col("epsg") if "epsg" in files.columns else F.lit(None).cast("string").alias("epsg")
    return files.where("feature_type <> 'land use'").select("path", "text", "feature_type", own).mapInPandas(run, f"path string, {MESH}, failure string")
