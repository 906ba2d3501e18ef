"""Coordinate frames: geodesics on the driver, affine 2-D and metric 3-D grids as column arithmetic."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: GRS80 and WGS84 ellipsoids (fixed values).
A_AXIS, GRS80_F, WGS84_F = 6378137.0, 1 / 298.257222101, 1 / 298.257223563
SCALE = 0.9999

LonLat = tuple[float, float]


def half_up(x: float) -> int:
    return int(math.floor(x + 0.5))


def geodesic_inverse(a: LonLat, b: LonLat) -> float:
    """Metres between two (lon, lat) points on WGS84 (Vincenty)."""
    f, ax = WGS84_F, A_AXIS
    bx = ax * (1 - f)
    u1, u2 = (math.atan((1 - f) * math.tan(math.radians(p[1]))) for p in (a, b))
    dl = math.radians(b[0] - a[0])
    lam = dl
    for _ in range(200):
        sl, cl = math.sin(lam), math.cos(lam)
        s = math.hypot(math.cos(u2) * sl, math.cos(u1) * math.sin(u2) - math.sin(u1) * math.cos(u2) * cl)
        if s == 0:
            return 0.0
        c = math.sin(u1) * math.sin(u2) + math.cos(u1) * math.cos(u2) * cl
        sig = math.atan2(s, c)
        sa = math.cos(u1) * math.cos(u2) * sl / s
        ca = 1 - sa * sa
        c2 = c - 2 * math.sin(u1) * math.sin(u2) / ca if ca else 0.0
        k = f / 16 * ca * (4 + f * (4 - 3 * ca))
        nxt = dl + (1 - k) * f * sa * (sig + k * s * (c2 + k * c * (2 * c2 * c2 - 1)))
        if abs(nxt - lam) < 1e-13:
            break
        lam = nxt
    uu = ca * (ax * ax - bx * bx) / (bx * bx)
    big_a = 1 + uu / 16384 * (4096 + uu * (uu * (320 - 175 * uu) - 768))
    big_b = uu / 1024 * (256 + uu * (uu * (74 - 47 * uu) - 128))
    ds = big_b * s * (c2 + big_b / 4 * (c * (2 * c2 * c2 - 1) - big_b / 6 * c2 * (4 * s * s - 3) * (4 * c2 * c2 - 3)))
    return bx * big_a * (sig - ds)


def geodesic_forward(p: LonLat, azimuth: float, metres: float) -> LonLat:
    """The point `metres` from p in direction `azimuth` (degrees from north) on WGS84."""
    f, ax = WGS84_F, A_AXIS
    bx = ax * (1 - f)
    az = math.radians(azimuth)
    tu = (1 - f) * math.tan(math.radians(p[1]))
    cu = 1 / math.hypot(1, tu)
    su = tu * cu
    s1 = math.atan2(tu, math.cos(az))
    sa = cu * math.sin(az)
    ca = 1 - sa * sa
    uu = ca * (ax * ax - bx * bx) / (bx * bx)
    big_a = 1 + uu / 16384 * (4096 + uu * (uu * (320 - 175 * uu) - 768))
    big_b = uu / 1024 * (256 + uu * (uu * (74 - 47 * uu) - 128))
    sig = metres / (bx * big_a)
    for _ in range(200):
        c2 = math.cos(2 * s1 + sig)
        s, c = math.sin(sig), math.cos(sig)
        ds = big_b * s * (c2 + big_b / 4 * (c * (2 * c2 * c2 - 1) - big_b / 6 * c2 * (4 * s * s - 3) * (4 * c2 * c2 - 3)))
        nxt = metres / (bx * big_a) + ds
        if abs(nxt - sig) < 1e-13:
            break
        sig = nxt
    s, c, c2 = math.sin(sig), math.cos(sig), math.cos(2 * s1 + sig)
    lat = math.atan2(su * c + cu * s * math.cos(az), (1 - f) * math.hypot(sa, su * s - cu * c * math.cos(az)))
    lam = math.atan2(s * math.sin(az), cu * c - su * s * math.cos(az))
    k = f / 16 * ca * (4 + f * (4 - 3 * ca))
    lon = lam - (1 - k) * f * sa * (sig + k * s * (c2 + k * c * (2 * c2 * c2 - 1)))
    return p[0] + math.degrees(lon), math.degrees(lat)


def create_rectangle(lon: float, lat: float, metres: float) -> list[LonLat]:
    """[SW, NW, NE, SE] of a square; the east-west offset is taken at its south edge."""
    half = metres / 2
    north, south = geodesic_forward((lon, lat), 0, half)[1], geodesic_forward((lon, lat), 180, half)[1]
    east, west = geodesic_forward((lon, south), 90, half)[0], geodesic_forward((lon, south), 270, half)[0]
    return [(west, south), (west, north), (east, north), (east, south)]


def buffered(vertices: list[LonLat], metres: float) -> list[LonLat]:
    """The rectangle scaled about its centre by 1 + 2 * metres / its shorter side."""
    if metres < 0:
        raise ValueError("buffer must not be negative")
    sw, nw, ne, _ = vertices
    side = min(geodesic_inverse(nw, ne), geodesic_inverse(sw, nw))
    k = 1 + 2 * metres / side
    cx, cy = sum(v[0] for v in vertices) / 4, sum(v[1] for v in vertices) / 4
    return [(cx + (x - cx) * k, cy + (y - cy) * k) for x, y in vertices]


def check_rectangle(sw: LonLat, nw: LonLat, ne: LonLat) -> None:
    """ValueError if a side has no length or the sides are parallel."""
    e, s = (ne[0] - nw[0], ne[1] - nw[1]), (sw[0] - nw[0], sw[1] - nw[1])
    le, ls = math.hypot(*e), math.hypot(*s)
    if le == 0 or ls == 0 or abs(e[0] * s[1] - e[1] * s[0]) / (le * ls) <= 1e-9:
        raise ValueError("degenerate rectangle")


@dataclass(frozen=True)
class GridFrame:
    """Affine 2-D grid, row 0 at the north edge: lon/lat = origin + (col + .5) * col step + (row + .5) * row step."""

    n_rows: int
    n_cols: int
    lon0: float
    lat0: float
    col_lon: float
    col_lat: float
    row_lon: float
    row_lat: float

    @classmethod
    def of(cls, vertices: list[LonLat], cell: float) -> GridFrame:
        """Frame of a rectangle [SW, NW, NE, SE]; sides in metres over the cell size, rounded half up, 1 at least."""
        sw, nw, ne = vertices[:3]
        check_rectangle(sw, nw, ne)
        rows = max(1, half_up(geodesic_inverse(sw, nw) / cell))
        cols = max(1, half_up(geodesic_inverse(nw, ne) / cell))
        return cls(rows, cols, nw[0], nw[1], (ne[0] - nw[0]) / cols, (ne[1] - nw[1]) / cols, (sw[0] - nw[0]) / rows, (sw[1] - nw[1]) / rows)

    def centre(self, row: Column, col: Column) -> tuple[Column, Column]:
        x, y = col + F.lit(0.5), row + F.lit(0.5)
        return self.lon0 + x * self.col_lon + y * self.row_lon, self.lat0 + x * self.col_lat + y * self.row_lat

    def centres(self, spark: SparkSession) -> DataFrame:
        """(r, c, lon, lat) of all cells."""
        cells = spark.range(self.n_rows * self.n_cols).select(
            F.expr(f"cast(id div {self.n_cols} as int)").alias("r"), F.expr(f"cast(id % {self.n_cols} as int)").alias("c"))
        lon, lat = self.centre(F.col("r"), F.col("c"))
        return cells.select("r", "c", lon.alias("lon"), lat.alias("lat"))

    def rowcol(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """Fractional (row, col) by the inverse of the frame; whole at cell centres."""
        det = self.col_lon * self.row_lat - self.col_lat * self.row_lon
        dx, dy = lon - self.lon0, lat - self.lat0
        return (dy * self.col_lon - dx * self.col_lat) / det - F.lit(0.5), (dx * self.row_lat - dy * self.row_lon) / det - F.lit(0.5)

    def cell(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """Nearest (row, col): half to even, then clipped, so points outside fold onto the edge."""
        r, c = self.rowcol(lon, lat)
        fold = lambda x, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.rint(x).cast("int")))
        return fold(r, self.n_rows), fold(c, self.n_cols)


@dataclass(frozen=True)
class VoxelFrame:
    """Metric 3-D grid: columns from min_x, rows from max_y downwards, levels from min_z."""

    n_rows: int
    n_cols: int
    n_z: int
    min_x: float
    max_y: float
    min_z: float
    size: float

    def index(self, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
        """(row, col, level) of a point; floors, so points outside stay outside."""
        f = lambda v: F.floor(v / self.size).cast("int")
        return f(self.max_y - y), f(x - self.min_x), f(z - self.min_z)

    def truncated_index(self, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
        """Like index, but cut towards zero."""
        f = lambda v: (v / self.size).cast("int")
        return f(self.max_y - y), f(x - self.min_x), f(z - self.min_z)

    def centre(self, r: Column, c: Column, z: Column) -> tuple[Column, Column, Column]:
        h = F.lit(0.5)
        return self.min_x + (c + h) * self.size, self.max_y - (r + h) * self.size, self.min_z + (z + h) * self.size

    def window(self, lo: Column, hi: Column, origin: float, n: int, down: bool = False) -> tuple[Column, Column]:
        """Cells of a coordinate range, padded by one and clipped to the grid (a range outside gives the edge)."""
        a, b = ((origin - hi, origin - lo) if down else (lo - origin, hi - origin))
        fold = lambda v: F.greatest(F.lit(0), F.least(F.lit(n - 1), v))
        return fold(F.floor(a / self.size).cast("int") - 1), fold(F.floor(b / self.size).cast("int") + 1)

    @property
    def epsilon(self) -> float:
        return self.size * 1e-6

    @property
    def contact_half(self) -> float:
        """Half size of the closed box: a face on a cell wall touches both sides."""
        return self.size / 2 + self.epsilon

    @property
    def penetration_half(self) -> float:
        """Half size of the open box: a face on a cell wall touches neither side."""
        return self.size / 2 - self.epsilon


def voxel_frame(width: float, height: float, z_min: float, z_max: float, size: float, underground: float = 0.0) -> VoxelFrame:
    """A frame around the origin with a voxel of margin above and below; counts are rounded half up, 1 at least."""
    lo, hi = z_min - size - underground, z_max + size
    n = lambda v: max(1, half_up(v / size))
    return VoxelFrame(n(height), n(width), n(hi - lo), -width / 2, height / 2, lo, size)


def _series(n: float) -> tuple[float, list[float], list[float]]:
    a = A_AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    fwd = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    inv = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    return a, fwd, inv


@dataclass(frozen=True)
class LocalMetres:
    """Transverse Mercator about a centre (k = 0.9999, GRS80) by the Krüger series, turned by -angle."""

    lon0: float
    lat0: float
    angle: float = 0.0
    scale: float = SCALE

    def _northing0(self) -> float:
        n = GRS80_F / (2 - GRS80_F)
        a, fwd, _ = _series(n)
        e = 2 * math.sqrt(n) / (1 + n)
        t = math.sinh(math.atanh(math.sin(math.radians(self.lat0))) - e * math.atanh(e * math.sin(math.radians(self.lat0))))
        xi = math.atan(t)
        return self.scale * a * (xi + sum(k * math.sin(2 * (j + 1) * xi) for j, k in enumerate(fwd)))

    def project(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """(x, y) in metres, all in column arithmetic."""
        n = GRS80_F / (2 - GRS80_F)
        a, fwd, _ = _series(n)
        e = 2 * math.sqrt(n) / (1 + n)
        s = F.sin(F.radians(lat))
        t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
        dl = F.radians(lon - self.lon0)
        xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
        x, y = eta, xi
        for j, k in enumerate(fwd, 1):
            x = x + k * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
            y = y + k * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        x, y = self.scale * a * x, self.scale * a * y - self._northing0()
        c, si = math.cos(self.angle), math.sin(self.angle)
        return c * x + si * y, -si * x + c * y

    def unproject(self, x: Column, y: Column, m=F) -> tuple[Column, Column]:
        """(lon, lat) of a point in metres; m: what works out sines and so on, pyspark's functions or NUMPY for arrays."""
        n = GRS80_F / (2 - GRS80_F)
        a, _, inv = _series(n)
        e = 2 * math.sqrt(n) / (1 + n)
        c, si = math.cos(self.angle), math.sin(self.angle)
        px, py = c * x - si * y, si * x + c * y
        xi0, eta0 = (py + self._northing0()) / (self.scale * a), px / (self.scale * a)
        xi, eta = xi0, eta0
        for j, k in enumerate(inv, 1):
            xi = xi - k * m.sin(2 * j * xi0) * m.cosh(2 * j * eta0)
            eta = eta - k * m.cos(2 * j * xi0) * m.sinh(2 * j * eta0)
        lon = self.lon0 + m.degrees(m.atan2(m.sinh(eta), m.cos(xi)))
        chi = m.asin(m.sin(xi) / m.cosh(eta))
        q0, q = m.atanh(m.sin(chi)), m.atanh(m.sin(chi))
        for _ in range(7):
            q = q0 + e * m.atanh(e * m.tanh(q))
        return lon, m.degrees(m.asin(m.tanh(q)))


class NUMPY:
    """numpy's functions by the names that pyspark has for them."""

    sin, cos, sinh, cosh, tanh, degrees = np.sin, np.cos, np.sinh, np.cosh, np.tanh, np.degrees
    asin, atanh, atan2 = np.arcsin, np.arctanh, np.arctan2


def rectangle_metres(vertices: list[LonLat], lon: float, lat: float, spark: SparkSession) -> LocalMetres:
    """The metric frame of a rectangle: x runs along its NW-NE side."""
    base = LocalMetres(lon, lat)
    ends = spark.createDataFrame([(0, *vertices[1]), (1, *vertices[2])], "i int, lon double, lat double")
    x, y = base.project(F.col("lon"), F.col("lat"))
    (_, x0, y0), (_, x1, y1) = sorted(ends.select("i", x, y).collect())
    return LocalMetres(lon, lat, math.atan2(y1 - y0, x1 - x0))


def equirectangular(lon: Column, lat: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """Rough local metres: 111 320 m per degree of longitude at the equator, 110 540 m of latitude."""
    return (lon - lon0) * 111320.0 * F.cos(F.radians(lat0)), (lat - lat0) * 110540.0


def projections() -> dict[str, tuple[LocalMetres, float, float]]:
    """Projected systems by EPSG code, with false easting and northing: UTM zones of ETRS89 and WGS84 (north and south),
    and the Japanese plane zones of JGD2000 and JGD2011."""
    out = {}
    for zone in range(1, 61):
        tm = LocalMetres(6.0 * zone - 183, 0.0, 0.0, 0.9996)
        out[f"EPSG:{32600 + zone}"] = (tm, 500_000.0, 0.0)
        out[f"EPSG:{32700 + zone}"] = (tm, 500_000.0, 10_000_000.0)
        if 28 <= zone <= 38:
            out[f"EPSG:{25800 + zone}"] = (tm, 500_000.0, 0.0)
    for i, (lon, lat) in enumerate(JAPAN):
        out[f"EPSG:{2443 + i}"] = out[f"EPSG:{6669 + i}"] = (LocalMetres(lon, lat), 0.0, 0.0)
    return out


#: Origins (lon, lat) of the Japanese plane zones I to XIX (fixed values).
JAPAN = [(129.5, 33.0), (131.0, 33.0), (132 + 1 / 6, 36.0), (133.5, 33.0), (134 + 1 / 3, 36.0), (136.0, 36.0), (137 + 1 / 6, 36.0), (138.5, 36.0), (139 + 5 / 6, 36.0), (140 + 5 / 6, 40.0),
         (140.25, 44.0), (142.25, 44.0), (144.25, 44.0), (142.0, 26.0), (127.5, 26.0), (124.0, 26.0), (131.0, 26.0), (136.0, 20.0), (154.0, 26.0)]


def _by_code(epsg: Column, codes: list[str] | None, one) -> Column:
    known = projections()
    out = F.lit(None)
    for code in codes if codes is not None else ("EPSG:25832", "EPSG:25833"):
        if code in known:
            out = F.when(epsg == code, one(*known[code])).otherwise(out)
    return out


def to_projected(lon: Column, lat: Column, epsg: Column, codes: list[str] | None = None) -> Column:
    """struct(x, y) in the system that epsg names, one of `codes`; null for another."""
    def one(tm: LocalMetres, east: float, north: float) -> Column:
        x, y = tm.project(lon, lat)
        return F.struct((x + east).alias("x"), (y + north).alias("y"))

    return _by_code(epsg, codes, one)


def to_geographic(x: Column, y: Column, epsg: Column, codes: list[str] | None = None) -> Column:
    """struct(lon, lat) of a point in the system that epsg names, one of `codes`; null for another."""
    def one(tm: LocalMetres, east: float, north: float) -> Column:
        lon, lat = tm.unproject(x - east, y - north)
        return F.struct(lon.alias("lon"), lat.alias("lat"))

    return _by_code(epsg, codes, one)
