"""Names and headers of city-model files as columns: mesh codes, tiles, CRS and feature types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: EPSG codes of geographic systems: coordinates that need no projection (fixed values).
GEOGRAPHIC = ("4326", "4979", "6668", "6697", "4612")
#: Substrings that tell a file's feature type, in the order of the test: any case, and as written (fixed values).
PROBES = (("building", "building", "bldg:"), ("bridge", "bridge", "brid:"), ("terrain", None, "dem:"), ("terrain", None, "TINRelief"),
          ("vegetation", "vegetation", "veg:"))
#: Compound systems named by URN (fixed values).
URNS = {
    "urn:adv:crs:ETRS89_UTM32*DE_DHHN2016_NH": "EPSG:25832",
    "urn:adv:crs:ETRS89_UTM32*DE_DHHN92_NH": "EPSG:25832",
    "urn:adv:crs:ETRS89_UTM32": "EPSG:25832",
    "urn:adv:crs:ETRS89_UTM33*DE_DHHN2016_NH": "EPSG:25833",
    "urn:adv:crs:ETRS89_UTM33*DE_DHHN92_NH": "EPSG:25833",
    "urn:adv:crs:ETRS89_UTM33": "EPSG:25833",
    "urn:adv:crs:DE_DHDN_3GK2*DE_DHHN92_NH": "EPSG:31466",
    "urn:adv:crs:DE_DHDN_3GK3*DE_DHHN92_NH": "EPSG:31467",
    "urn:adv:crs:DE_DHDN_3GK4*DE_DHHN92_NH": "EPSG:31468",
    "urn:adv:crs:DE_DHDN_3GK5*DE_DHHN92_NH": "EPSG:31469",
}
HEADER_TYPE, HEADER_CRS = 8192, 4096


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def mesh_code(path: Column) -> Column:
    """The 6 to 8 digits a file name starts with, else null."""
    return F.nullif(F.regexp_extract(file_name(path), r"^(\d{6,8})", 1), F.lit(""))


def decode_mesh_code(code: Column) -> Column:
    """struct(lat_sw, lon_sw, lat_ne, lon_ne) of a grid square code of 6 or 8 digits (7 as 6); null for others."""
    d = lambda i, n=1: F.substring(code, i, n).cast("int")
    third = F.length(code) >= 8
    lat = d(1, 2) / F.lit(1.5) + d(5) / F.lit(12.0) + F.when(third, d(7) / F.lit(120.0)).otherwise(0.0)
    lon = d(3, 2) + F.lit(100.0) + d(6) / F.lit(8.0) + F.when(third, d(8) / F.lit(80.0)).otherwise(0.0)
    dlat, dlon = F.when(third, F.lit(1 / 120)).otherwise(1 / 12), F.when(third, F.lit(1 / 80)).otherwise(1 / 8)
    box = F.struct(lat.alias("lat_sw"), lon.alias("lon_sw"), (lat + dlat).alias("lat_ne"), (lon + dlon).alias("lon_ne"))
    return F.when(code.rlike(r"^\d{6,8}$"), box)


def box_meets(lo_x: Column, lo_y: Column, hi_x: Column, hi_y: Column, corners: list[tuple[float, float]]) -> Column:
    """Whether a box meets a rectangle that may be turned (closed): no side of either parts them."""
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    tests = [lo_x <= max(xs), hi_x >= min(xs), lo_y <= max(ys), hi_y >= min(ys)]
    for (ax, ay), (bx, by) in zip(corners[:2], corners[1:3]):
        nx, ny = by - ay, ax - bx
        own = [nx * x + ny * y for x, y in corners]
        at = [nx * x + ny * y for x in (lo_x, hi_x) for y in (lo_y, hi_y)]
        tests += [F.least(*at) <= max(own), F.greatest(*at) >= min(own)]
    return reduce(lambda a, b: a & b, tests)


def in_rectangle_by_name(path: Column, corners: list[tuple[float, float]]) -> Column:
    """Whether a file's grid square meets the rectangle; names without a code are kept."""
    b = decode_mesh_code(mesh_code(path))
    return F.coalesce(box_meets(b["lon_sw"], b["lat_sw"], b["lon_ne"], b["lat_ne"], corners), F.lit(True))


def tile_in_range(path: Column, lo_x: float, lo_y: float, hi_x: float, hi_y: float, tile: float = 1000.0) -> Column:
    """Whether a `tile_<x>_<y>` file (kilometres) lies in a metric range, with a tile of margin; others are kept."""
    name = file_name(path)
    has = name.rlike(r"tile_\d+_\d+")
    x, y = (F.when(has, F.regexp_extract(name, r"tile_(\d+)_(\d+)", i).cast("double") * 1000.0) for i in (1, 2))
    hit = (x + 2 * tile >= lo_x) & (x - tile <= hi_x) & (y + 2 * tile >= lo_y) & (y - tile <= hi_y)
    return F.coalesce(hit, F.lit(True))


def srs_name(header: Column) -> Column:
    """The first srsName of a file's first characters, or null."""
    return F.nullif(F.regexp_extract(F.substring(header, 1, HEADER_CRS), r'srsName\s*=\s*"([^"]*)"', 1), F.lit(""))


def resolve_srs(name: Column) -> Column:
    """`EPSG:n` of a projected system named by URN or EPSG code; null for geographic systems and unknown names."""
    s = F.trim(name)
    code = F.regexp_extract(s, r"(?i)EPSG(?:::|:|/0/|/)(\d{4,6})", 1)
    by_urn = reduce(lambda out, kv: F.when(s == kv[0], F.lit(kv[1])).otherwise(out), URNS.items(), F.lit(None).cast("string"))
    return F.coalesce(by_urn, F.when((code != "") & ~code.isin(*GEOGRAPHIC), F.concat(F.lit("EPSG:"), code)))


def probe_type(text: Column) -> Column:
    """A file's feature type from its first characters, or null."""
    head = F.substring(text, 1, HEADER_TYPE)
    out = F.lit(None).cast("string")
    for kind, any_case, exact in reversed(PROBES):
        hit = head.contains(exact)
        out = F.when(hit | F.lower(head).contains(any_case) if any_case else hit, F.lit(kind)).otherwise(out)
    return out
