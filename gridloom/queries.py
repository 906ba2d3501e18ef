"""The engine's operators as queries over the test tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import codes, geometry
from gridloom.functions.frames import GridFrame
from gridloom.operators import meshes, raster, stats, topology, voxel
from gridloom.plans import scenes
from gridloom.plans.scenes import FRAME, LEVELS, SIDE, SIZE, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: SQL of the scenes, for the comparison.
WITH = {
    "cells": "cells AS (SELECT (i // 64)::INT AS r, (i % 64)::INT AS c FROM range(4096) AS t(i))",
    "dem": "dem AS (SELECT r, c, ((r * 3 + c * 5) % 16) * 0.5::DOUBLE AS dem FROM cells)",
    "boxes": """boxes AS (SELECT o_orderkey AS seq, ((o_custkey * 7) % 56)::INT AS r0, ((o_orderkey * 11) % 56)::INT AS c0, (1 + o_orderkey % 8)::INT AS h,
        (1 + o_custkey % 8)::INT AS w, (4 + (o_orderkey * 13) % 60)::DOUBLE AS zmax FROM orders)""",
    "claims": "claims AS (SELECT seq, r::INT AS r, c::INT AS c, zmax FROM boxes, range(r0, r0 + h) AS a(r), range(c0, c0 + w) AS b(c))",
    "heights": """heights AS (SELECT r, c, h, seq AS id FROM (SELECT *, zmax - dem AS h, row_number() OVER (PARTITION BY r, c ORDER BY zmax - dem DESC, seq) AS k
        FROM claims JOIN dem USING (r, c) WHERE zmax > dem) WHERE k = 1)""",
    "ground": "ground AS (SELECT r, c, z::INT AS z, -1 AS code FROM dem, range(0, least(47, round_even(dem / 2.0, 0)::INT) + 1) AS t(z))",
    "cover": """cover AS (SELECT r, c, arg_max(code, p::BIGINT * 1000000000 + seq) AS code FROM (SELECT p_partkey AS seq, (1 + p_size % 14)::INT AS code, (p_partkey % 64)::INT AS r,
        ((p_partkey // 64) % 64)::INT AS c, CASE 1 + p_size % 14 WHEN 14 THEN 0 WHEN 12 THEN 1 WHEN 13 THEN 13 ELSE 1 + 1 + p_size % 14 END AS p FROM part) GROUP BY r, c)""",
    "tops": "tops AS (SELECT (l_partkey % 64)::INT AS r, (l_suppkey % 64)::INT AS c, max(l_quantity) AS top FROM lineitem GROUP BY ALL)",
    "faces": """faces AS (SELECT l_orderkey % 50 AS mesh, l_orderkey * 10 + l_linenumber AS face, l_partkey % 97 AS a, l_suppkey % 89 AS b, 100 + l_linenumber AS c
        FROM lineitem WHERE l_partkey % 97 <> l_suppkey % 89)""",
    "edges": """edges AS (SELECT mesh, face, i, a, b, least(a, b) AS lo, greatest(a, b) AS hi FROM (SELECT mesh, face, 0 AS i, a, b FROM faces UNION ALL
        SELECT mesh, face, 1, b, c FROM faces UNION ALL SELECT mesh, face, 2, c, a FROM faces))""",
    "plan": """plan AS (SELECT seq, c0 * 2 + 0.5::DOUBLE AS xa, (c0 + 2 + w % 3) * 2 - CASE WHEN seq % 5 = 0 THEN -0.5::DOUBLE ELSE 0.5::DOUBLE END AS xb, r0 * 2 + 0.5::DOUBLE AS ya, (r0 + 2 + h % 3) * 2 - 0.5::DOUBLE AS yb,
        CASE WHEN seq % 2 = 1 THEN c0 * 2 + 1.5::DOUBLE ELSE (c0 + 2 + w % 3) * 2 - CASE WHEN seq % 5 = 0 THEN -0.5::DOUBLE ELSE 0.5::DOUBLE END END AS xm, CASE WHEN seq % 2 = 1 THEN r0 * 2 + 1.5::DOUBLE ELSE (r0 + 2 + h % 3) * 2 - 0.5::DOUBLE END AS ym,
        3.5::DOUBLE + 2 * (zmax::INT % 3) AS zb FROM boxes)""",
    "solids": """solids AS (SELECT seq, 0 AS part, xa, xm, xb, ya, ym, yb, 0.5::DOUBLE AS za, zb FROM plan UNION ALL
        SELECT seq, 1, xa, xb, xb, ya, yb, yb, floor(zb / 2) * 2 + 4.2::DOUBLE, floor(zb / 2) * 2 + 4.5::DOUBLE FROM plan WHERE seq % 3 = 0)""",
    "around": """around AS (SELECT seq, part, r::INT AS r, c::INT AS c, z::INT AS z,
        c * 2 > xa - 1e-9 AND c * 2 + 2 < xb + 1e-9 AND r * 2 > ya - 1e-9 AND r * 2 + 2 < yb + 1e-9 AND z * 2 > za - 1e-9 AND z * 2 + 2 < zb + 1e-9 AND NOT (c * 2 + 2 > xm + 1e-9 AND r * 2 + 2 > ym + 1e-9) AS whole,
        c * 2 + 1 > xa AND c * 2 + 1 < xb AND r * 2 + 1 > ya AND r * 2 + 1 < yb AND z * 2 + 1 > za AND z * 2 + 1 < zb AND NOT (c * 2 + 1 > xm AND r * 2 + 1 > ym) AS middle
        FROM solids, range(floor(ya / 2)::INT, floor(yb / 2)::INT + 1) AS a(r), range(floor(xa / 2)::INT, floor(xb / 2)::INT + 1) AS b(c), range(floor(za / 2)::INT, least(47, floor(zb / 2)::INT) + 1) AS d(z)
        WHERE NOT (c * 2 > xm AND r * 2 > ym))""",
    "trees": """trees AS (SELECT r, c, z::INT AS z FROM (SELECT r, c, round_even(dem / 2.0, 0)::INT + round_even(least(top * (11.76 / 19.98), top) / 2.0, 0)::INT AS a,
        least(48, round_even(dem / 2.0, 0)::INT + round_even(top / 2.0, 0)::INT) AS b FROM tops JOIN dem USING (r, c)), range(a, b) AS t(z))""",
    "roofcells": "roofcells AS (SELECT r, c, z::INT AS z, -3 AS code FROM heights JOIN dem USING (r, c), range(round_even(dem / 2.0, 0)::INT + 1, least(48, round_even((dem + h) / 2.0, 0)::INT + 1)) AS t(z))",
    "city": """city AS (SELECT r, c, z, CASE WHEN bool_or(code = -3) THEN -3 ELSE -1 END AS code FROM (SELECT * FROM ground UNION ALL SELECT * FROM roofcells) GROUP BY ALL)""",
}


def query(*needs: str, sql: str | None = None):
    """Registers a query under its function's name; needs: the scenes its SQL builds on, in order."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = (f"WITH {', '.join(WITH[n] for n in needs)} " if needs else "") + sql
        return fn

    return add


def _r(c: str, name: str | None = None):
    return F.round(F.col(c), 6).alias(name or c)


# Names, headers and text


@query(sql="""SELECT p_partkey, code, round(CASE WHEN n >= 8 THEN la + s7 / 120.0 ELSE la END, 6) AS lat_sw, round(CASE WHEN n >= 8 THEN lo + s8 / 80.0 ELSE lo END, 6) AS lon_sw,
    round(CASE WHEN n >= 8 THEN la + s7 / 120.0 + 1 / 120.0 ELSE la + 1 / 12.0 END, 6) AS lat_ne, round(CASE WHEN n >= 8 THEN lo + s8 / 80.0 + 1 / 80.0 ELSE lo + 1 / 8.0 END, 6) AS lon_ne
    FROM (SELECT p_partkey, code, length(code) AS n, substr(code, 1, 2)::INT / 1.5 + substr(code, 5, 1)::INT / 12.0 AS la,
          100 + substr(code, 3, 2)::INT + substr(code, 6, 1)::INT / 8.0 AS lo, substr(code, 7, 1)::INT AS s7, substr(code || '0', 8, 1)::INT AS s8
          FROM (SELECT p_partkey, nullif(substr((50000000 + p_partkey * 7919 % 9999999)::VARCHAR, 1, (5 + p_partkey % 4)::INT), '') AS code FROM part) WHERE length(code) >= 7)""")
def mesh_code_decode(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.expr("concat(substr(cast(50000000 + p_partkey * 7919 % 9999999 as string), 1, cast(5 + p_partkey % 4 as int)), '_bldg.gml')").alias("path"))
    m = p.withColumn("code", codes.mesh_code(F.col("path"))).withColumn("b", codes.decode_mesh_code(F.col("code")))
    return m.where("length(code) >= 7").select("p_partkey", "code", *[F.round(F.col(f"b.{k}"), 6).alias(k) for k in ("lat_sw", "lon_sw", "lat_ne", "lon_ne")])


@query(sql="""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'EPSG:25832' WHEN 2 THEN 'EPSG:' || (30000 + p_size) WHEN 3 THEN 'EPSG:25833' END AS epsg FROM part""")
def srs_resolve(spark, d):
    n = F.expr("case p_partkey % 5 when 0 then 'urn:adv:crs:ETRS89_UTM32*DE_DHHN2016_NH' when 1 then 'http://www.opengis.net/def/crs/EPSG/0/6697' "
               "when 2 then concat('urn:ogc:def:crs:EPSG::', 30000 + p_size) when 3 then ' EPSG:25833 ' else 'local' end")
    head = F.concat(F.lit('<gml:Envelope srsName="'), n, F.lit('" srsDimension="3">'))
    return table(spark, d, "part").select("p_partkey", codes.resolve_srs(codes.srs_name(head)).alias("epsg"))


@query(sql="""SELECT p_partkey FROM part WHERE p_partkey % 7 = 0 OR ((p_partkey % 50) * 1000 + 1000 >= 9000 AND (p_partkey % 50) * 1000 <= 21000
    AND (p_size * 1000) + 1000 >= 9000 AND p_size * 1000 <= 31000)""")
def tile_prune(spark, d):
    path = F.expr("if(p_partkey % 7 = 0, concat('x/veg_', p_partkey, '.gml'), concat('x/veg_tile_', p_partkey % 50, '_', p_size, '.gml'))")
    return table(spark, d, "part").where(codes.tile_in_range(path, 10000, 10000, 20000, 30000)).select("p_partkey")


@query(sql="""SELECT page_id, CASE WHEN contains(h, 'building') OR contains(t, 'bldg:') THEN 'building' WHEN contains(h, 'bridge') OR contains(t, 'brid:') THEN 'bridge'
    WHEN contains(t, 'dem:') OR contains(t, 'TINRelief') THEN 'terrain' WHEN contains(h, 'vegetation') OR contains(t, 'veg:') THEN 'vegetation' END AS kind
    FROM (SELECT page_id, substr(t, 1, 8192) AS t, lower(substr(t, 1, 8192)) AS h FROM (SELECT page_id, (CASE page_id % 6 WHEN 0 THEN '<bldg:Building>' WHEN 1 THEN '<Bridge>' WHEN 2 THEN '<dem:ReliefFeature>'
          WHEN 3 THEN '<veg:PlantCover>' WHEN 4 THEN '<TINRelief>' ELSE '' END) || html AS t FROM pages))""")
def feature_type_probe(spark, d):
    t = F.concat(F.expr("case page_id % 6 when 0 then '<bldg:Building>' when 1 then '<Bridge>' when 2 then '<dem:ReliefFeature>' when 3 then '<veg:PlantCover>' when 4 then '<TINRelief>' else '' end"), "html")
    return table(spark, d, "pages").select("page_id", codes.probe_type(t).alias("kind"))


def _pos_text(n: str) -> str:
    return f"concat_ws(' ', transform(sequence(1, {n}), i -> concat_ws(' ', l_partkey % 100 + i, (l_suppkey % 50) * 0.5, i * 2)))"


_POS_SQL = "SELECT l_orderkey, l_linenumber, i::INT AS i, l_partkey % 100 + i AS x, (l_suppkey % 50) * 0.5 AS y, i * 2 AS z FROM lineitem, range(1, l_linenumber + 1) AS t(i)"


@query(sql=f"SELECT l_orderkey, l_linenumber, i, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z FROM ({_POS_SQL})")
def poslist_parse(spark, d):
    t = table(spark, d, "lineitem").withColumn("p", geometry.pos_list(F.expr(f"concat({_pos_text('l_linenumber')}, '  7 8\\n')")))
    return t.select("l_orderkey", "l_linenumber", F.posexplode("p").alias("k", "q")).select("l_orderkey", "l_linenumber", (F.col("k") + 1).alias("i"), "q.x", "q.y", "q.z")


@query(sql="""SELECT l_orderkey, l_linenumber, face::INT AS face, (l_partkey % 100 + 1 + face)::DOUBLE AS x0, (l_suppkey % 50) * 0.5::DOUBLE AS y0, 2.0::DOUBLE AS z0, (l_partkey % 100 + 2 + face)::DOUBLE AS x1, (l_suppkey % 50) * 0.5::DOUBLE AS y1,
    4.0::DOUBLE AS z1, (l_partkey % 100 + 3 + face)::DOUBLE AS x2, (l_suppkey % 50) * 0.5::DOUBLE AS y2, 6.0::DOUBLE AS z2 FROM lineitem, range(0, 2) AS t(face) WHERE l_linenumber >= 3""")
def tin_triangles(spark, d):
    from gridloom.sources.citygml import tin_from_text

    ring = lambda k: F.concat(F.lit("<gml:posList srsDimension='3'>"), F.expr(_pos_text("l_linenumber").replace("l_partkey % 100", f"l_partkey % 100 + {k}")), F.lit("</gml:posList>"))
    text = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(ring(0), F.lit("\n"), ring(1)).alias("text"))
    return tin_from_text(text, "text")


@query(sql="""SELECT p_partkey, k::INT AS k, (200 + p_size)::INT AS class, CASE WHEN 200 + p_size IN (203) THEN 5 WHEN 200 + p_size = 204 THEN 9 WHEN 200 + p_size IN (201, 202, 219) THEN 4
    WHEN 200 + p_size IN (205, 217, 220) THEN 2 WHEN 200 + p_size IN (211, 212, 213) THEN 13 WHEN 200 + p_size IN (214, 218, 221, 222, 223) THEN 11 WHEN 200 + p_size IN (215, 216) THEN 12
    WHEN 200 + p_size = 224 THEN 1 ELSE 14 END AS code, (CASE WHEN k = 0 THEN 4 ELSE 3 + p_partkey % 3 END)::INT AS points, (139 + k + p_partkey % 7)::DOUBLE AS x0, (35 + p_partkey % 5)::DOUBLE AS y0,
    CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END AS holes FROM part, range(0, 2) AS t(k) WHERE k = 0 OR p_partkey % 2 = 0""")
def landuse_scan(spark, d):
    from gridloom.sources.citygml import land_use_from_text

    ring = lambda k, n: (f"concat_ws(' ', transform(sequence(0, {n} - 1), i -> concat_ws(' ', 35 + p_partkey % 5 + if(i = 0, 0, i), 139 + {k} + p_partkey % 7 + (i % 2), 0)))")
    lot = lambda k, n, hole: ("concat('<luse:LandUse gml:id=\"a\"><luse:class codeSpace=\"x\">', 200 + p_size, '</luse:class><gml:exterior><gml:posList>', "  # noqa: E731
                              f"{ring(k, n)}, '</gml:posList></gml:exterior>', if({hole}, '<gml:interior><gml:posList>1 1 0 2 1 0 2 2 0</gml:posList></gml:interior>', ''), '</luse:LandUse>')")
    text = F.expr(f"concat('<CityModel>', {lot(0, '4', 'p_partkey % 4 = 0')}, if(p_partkey % 2 = 0, {lot(1, '(3 + p_partkey % 3)', 'p_partkey % 4 = 0')}, ''), '</CityModel>')")
    s = land_use_from_text(table(spark, d, "part").select("p_partkey", "p_size", text.alias("text")), "text")
    return s.select("p_partkey", "k", "class", raster.lookup(F.col("class"), raster.LAND_USE, 14).alias("code"), F.size("ring").alias("points"),
                    F.get("ring", F.lit(0))["x"].alias("x0"), F.get("ring", F.lit(0))["y"].alias("y0"), F.size("holes").alias("holes"))


@query(sql="SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND p_size % 6 + 1 > 3 THEN p_size % 6 ELSE p_size % 6 + 1 END::INT AS n FROM part")
def ring_close_dedupe(spark, d):
    ring = F.expr("transform(sequence(0, cast(p_size % 6 as int)), i -> struct(cast(if(p_partkey % 3 = 0 and i = p_size % 6, 0, i) as double) as x, 1.0D as y, 2.0D as z))")
    return table(spark, d, "part").select("p_partkey", F.size(geometry.open_ring(ring)).alias("n"))


@query(sql="""SELECT s_suppkey AS inst, k::BIGINT AS k, round(2.0::DOUBLE * (k + p) + s_suppkey, 6) AS x, round(k * 0.5::DOUBLE + s_nationkey, 6) AS y, round(p * 1.0::DOUBLE + 1, 6) AS z FROM supplier,
    (SELECT 0 AS p UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3), range(0, 4) AS t(k) WHERE s_nationkey % 5 = p""")
def prototype_instance(spark, d):
    pts = spark.range(16).select(F.concat(F.lit("p"), F.expr("id div 4")).alias("proto"), F.lit(0).alias("seq"), F.expr("id % 4").alias("k"),
                                 F.expr("cast(id % 4 + id div 4 as double)").alias("x"), F.expr("cast(id % 4 as double)").alias("y"), F.expr("cast(id div 4 as double)").alias("z"))
    i = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("inst"), F.concat(F.lit("#p"), F.expr("s_nationkey % 5")).alias("href"), F.expr("array(2D,0D,0D,0D, 0D,0.5D,0D,0D, 0D,0D,1D,1D, 0D,0D,0D,1D)").alias("m"),
        F.col("s_suppkey").cast("double").alias("rx"), F.col("s_nationkey").cast("double").alias("ry"), F.lit(0.0).alias("rz"))
    return meshes.place_prototypes(i, pts).select("inst", "k", _r("x"), _r("y"), _r("z"))


_GRID = GridFrame(40, 50, 139.0, 36.0, 0.02, 0.0, 0.0, -0.025)


@query(sql="""SELECT event_id, greatest(0, least(39, round_even((36.0 - lat) / 0.025 - 0.5, 0)::INT)) AS r, greatest(0, least(49, round_even((lon - 139.0) / 0.02 - 0.5, 0)::INT)) AS c
    FROM (SELECT event_id, 138.9003 + (event_id * 7 % 1201) * 0.001 AS lon, 34.9003 + (event_id * 13 % 1201) * 0.001 AS lat FROM events)""")
def lonlat_to_rowcol(spark, d):
    e = table(spark, d, "events").select("event_id", F.expr("138.9003D + (event_id * 7 % 1201) * 0.001D").alias("lon"), F.expr("34.9003D + (event_id * 13 % 1201) * 0.001D").alias("lat"))
    r, c = _GRID.cell(F.col("lon"), F.col("lat"))
    return e.select("event_id", r.alias("r"), c.alias("c"))


@query(sql="SELECT (i // 50)::INT AS r, (i % 50)::INT AS c, round(139.0 + (i % 50 + 0.5) * 0.02::DOUBLE, 6) AS lon, round(36.0 - (i // 50 + 0.5) * 0.025::DOUBLE, 6) AS lat FROM range(2000) AS t(i)")
def cell_centres(spark, d):
    return _GRID.centres(spark).select("r", "c", _r("lon"), _r("lat"))


@query("boxes", sql="SELECT seq FROM boxes WHERE c0 <= 40 AND c0 + w >= 10 AND r0 <= 30 AND r0 + h >= 20")
def mesh_bbox_filter(spark, d):
    b = scenes.boxes(spark, d).select("seq", F.expr("array(struct(cast(c0 as double) as x, cast(r0 as double) as y), struct(cast(c0 + w as double) as x, cast(r0 + h as double) as y))").alias("vertices"))
    return meshes.in_rectangle(b, [(10, 20), (10, 30), (40, 30), (40, 20)]).select("seq")


@query("boxes", sql="SELECT seq, count(*) AS n FROM boxes, range(0, 2) WHERE c0 + w - 0.75 >= 10 AND c0 - 0.25 <= 30 AND r0 + h - 0.75 >= 20 AND r0 - 0.25 <= 50 GROUP BY seq")
def terrain_tri_filter(spark, d):
    return meshes.triangles_in_bounds(scenes.roofs(spark, d), 10, 20, 30, 50).groupBy("seq").agg(F.count("*").alias("n"))


@query(sql="""SELECT kind AS feature_type, n, ids FROM (SELECT kind, count(*) AS n, count(DISTINCT id) AS ids FROM (
    SELECT 'building' AS kind, o_custkey AS id FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'building', o_custkey FROM orders WHERE o_orderkey % 2 = 1
    AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0)) GROUP BY kind)""")
def merge_dedupe(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.lit("building").alias("feature_type"), F.col("o_custkey").alias("feature_id"))
    m = meshes.merge(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"))
    return m.groupBy("feature_type").agg(F.count("*").alias("n"), F.countDistinct("feature_id").alias("ids"))


@query(sql="SELECT o_custkey, o_orderkey, coalesce(sum(1 + o_orderkey % 9) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM orders")
def prefix_offsets(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.expr("1 + o_orderkey % 9").alias("n"))
    return meshes.offsets(o, "o_custkey", "o_orderkey", "n").select("o_custkey", "o_orderkey", "offset")


# Grids


@query("boxes", "claims", sql="SELECT seq, r, c, round(zmax, 6) AS z_min, round(zmax, 6) AS z_max FROM claims")
def tri_cell_raster(spark, d):
    return raster.mesh_cells(scenes.roofs(spark, d), SIDE, SIDE).select("seq", "r", "c", _r("z_min"), _r("z_max"))


def _heights(spark, d):
    return raster.building_heights(raster.mesh_cells(scenes.roofs(spark, d), SIDE, SIDE), scenes.dem(spark))


@query("cells", "dem", "boxes", "claims", "heights", sql="SELECT r, c, round(h, 6) AS h, id FROM heights")
def building_height_argmax(spark, d):
    return _heights(spark, d).select("r", "c", _r("h"), "id")


@query("cells", "dem", "boxes", "claims", sql="""SELECT r, c, count(*) AS n, round(min(zmax - dem), 6) AS lowest, round(arg_min(zmax - dem, seq), 6) AS first FROM claims JOIN dem USING (r, c) WHERE zmax > dem GROUP BY r, c""")
def building_segments(spark, d):
    s = raster.building_segments(raster.mesh_cells(scenes.roofs(spark, d), SIDE, SIDE), scenes.dem(spark))
    return s.select("r", "c", F.size("segments").cast("long").alias("n"), F.round(F.array_min(F.transform("segments", lambda x: x["h_max"])), 6).alias("lowest"), F.round(F.get("segments", F.lit(0))["h_max"], 6).alias("first"))


@query("cells", "dem", "boxes", sql="""SELECT seq, round(n.dem + 3 - o.dem, 6) AS dz FROM (SELECT seq, least(63, greatest(0, round_even(r0 + h / 2.0, 0)))::INT AS r, least(63, greatest(0, round_even(c0 + w / 2.0, 0)))::INT AS c FROM boxes) AS b
    JOIN dem AS o USING (r, c) JOIN dem AS n ON n.r = b.c AND n.c = b.r""")
def anchor_to_dem(spark, d):
    v = scenes.boxes(spark, d).select("seq", F.explode(F.expr("array(struct(cast(c0 as double) as x, cast(r0 as double) as y, zmax as z), struct(cast(c0 + w as double) as x, cast(r0 + h as double) as y, zmax as z))")).alias("p")).select("seq", "p.*")
    old = scenes.dem(spark)
    new = old.select(F.col("c").alias("r"), F.col("r").alias("c"), (F.col("dem") + 3).alias("dem"))
    return raster.anchor_shift(v, old, new, SIDE, SIDE).select("seq", _r("dz"))


@query("cells", sql="SELECT r, c, round((3.0 * r + 5.0 * c) / 4, 6) AS dem FROM cells")
def dem_bary_interp(spark, d):
    corner = lambda i, j: F.expr(f"struct(cast((id % 16 + {j}) * 4 as double) as x, cast((id div 16 + {i}) * 4 as double) as y, (3D * (id div 16 + {i}) + 5D * (id % 16 + {j})) as z)")
    q = spark.range(256).select(F.explode(F.array(F.array(corner(0, 0), corner(0, 1), corner(1, 1)), F.array(corner(0, 0), corner(1, 1), corner(1, 0)))).alias("t"))
    tri = q.select(*[F.col("t")[i][k].alias(f"{k}{i}") for i in range(3) for k in "xyz"])
    return raster.terrain_heights(tri, scenes.cells(spark), SIDE, SIDE).select("r", "c", _r("dem"))


@query("cells", "dem", "boxes", "claims", "heights", sql="""SELECT r, c, id FROM (SELECT w.r, w.c, h.id, row_number() OVER (PARTITION BY w.r, w.c ORDER BY (w.r - h.r) * (w.r - h.r) + (w.c - h.c) * (w.c - h.c), h.r, h.c) AS k
    FROM (SELECT r, c FROM cells WHERE (r, c) NOT IN (SELECT (r, c) FROM heights WHERE (r + c) % 3 = 0)) AS w, (SELECT * FROM heights WHERE (r + c) % 3 = 0) AS h) WHERE k = 1""")
def id_gap_fill(spark, d):
    h = _heights(spark, d).where("(r + c) % 3 = 0").select("r", "c", "id")
    return raster.fill_ids(scenes.cells(spark), h, SIDE, SIDE)


@query("cells", "cover", sql="SELECT r, c, coalesce(code, 14) AS code FROM cells LEFT JOIN cover USING (r, c)")
def landcover_priority(spark, d):
    return raster.land_cover(scenes.land_use(spark, d), scenes.cells(spark))


@query("boxes", sql="SELECT seq, r::INT AS r, c::INT AS c FROM boxes, range(r0, r0 + h + 1) AS a(r), range(c0, c0 + w + 1) AS b(c) WHERE (c - c0 + 0.3) / (w + 0.5) + (r - r0 + 0.3) / (h + 0.5) < 1")
def point_in_polygon(spark, d):
    ring = F.expr("array(struct(c0 - 0.3D as x, r0 - 0.3D as y), struct(c0 + w + 0.2D as x, r0 - 0.3D as y), struct(c0 - 0.3D as x, r0 + h + 0.2D as y))")
    return raster.polygon_cells(scenes.boxes(spark, d).select("seq", F.lit(1).alias("code"), ring.alias("ring")), SIDE, SIDE).select("seq", "r", "c")


@query(sql="SELECT r::INT AS r, c::INT AS c, (sr * 100 + sc)::INT AS v FROM (SELECT r, c, floor(r * 63.0 / 99.0 + 0.5)::INT AS sr, floor(c * 63.0 / 39.0 + 0.5)::INT AS sc FROM range(100) AS a(r), range(40) AS b(c))")
def resize_nearest(spark, d):
    return raster.resize_nearest(scenes.cells(spark).withColumn("v", F.col("r") * 100 + F.col("c")), (SIDE, SIDE), (100, 40), "v")


@query("cells", sql="""SELECT o.r::INT AS r, o.c::INT AS c, round(sum(((g.r * g.r * 3 + g.c * 7 + g.r * g.c) % 50) * (1 - abs(y - g.r)) * (1 - abs(x - g.c))), 6) AS v FROM (SELECT r, c, r * 63.0::DOUBLE / 99 AS y, c * 63.0::DOUBLE / 39 AS x FROM range(100) AS a(r), range(40) AS b(c)) AS o
    JOIN cells AS g ON g.r IN (floor(y), floor(y) + 1) AND g.c IN (floor(x), floor(x) + 1) GROUP BY 1, 2""")
def resize_bilinear(spark, d):
    g = scenes.cells(spark).withColumn("v", F.expr("(r * r * 3 + c * 7 + r * c) % 50"))
    return raster.resize_bilinear(g, (SIDE, SIDE), (100, 40), "v").select("r", "c", _r("v"))


# Voxels


@query("cells", "dem", "ground", sql="SELECT r, c, z, code::INT AS code FROM ground")
def terrain_fill(spark, d):
    return voxel.fill_terrain(scenes.dem(spark), FRAME)


@query("cells", "dem", "ground", sql="SELECT r, c, z, -1 AS code FROM ground WHERE (r + c) % 2 = 0 UNION ALL SELECT r, c, 5, -1 FROM cells WHERE (r + c) % 2 = 1")
def terrain_gap_fill(spark, d):
    have = scenes.cells(spark).where("(r + c) % 2 = 1").select("r", "c", F.lit(5).alias("z"), F.lit(-1).alias("code"))
    return voxel.fill_terrain_gaps(have, scenes.dem(spark), FRAME)


@query("cells", "dem", "ground", "cover", sql="""SELECT r, c, z, CASE WHEN code2 <> 0 AND z = t THEN code2 ELSE -1 END::INT AS code FROM (SELECT g.*, max(z) OVER (PARTITION BY r, c) AS t, coalesce(k.code, 14) AS code2 FROM ground g LEFT JOIN cover k USING (r, c))""")
def landcover_overlay(spark, d):
    cover = raster.land_cover(scenes.land_use(spark, d), scenes.cells(spark))
    return voxel.overlay_land_cover(voxel.fill_terrain(scenes.dem(spark), FRAME), cover, scenes.dem(spark), FRAME, False)


@query("cells", "dem", "ground", "tops", "trees", sql="SELECT r, c, z, max(code)::INT AS code FROM (SELECT r, c, z, -1 AS code FROM ground UNION ALL SELECT r, c, z, -2 FROM trees) GROUP BY r, c, z")
def canopy_overlay(spark, d):
    return voxel.apply_canopy(voxel.fill_terrain(scenes.dem(spark), FRAME), scenes.canopy(spark, d), scenes.dem(spark), FRAME)


@query("cells", "dem", "boxes", "claims", "heights", "ground", "roofcells", "city", "tops", "trees", sql="""SELECT code::INT AS code, count(*) AS n FROM (SELECT r, c, z, arg_min(code, k) AS code FROM (
    SELECT r, c, z, code, 0 AS k FROM city UNION ALL SELECT r, c, z, -2, 1 FROM trees) GROUP BY r, c, z) GROUP BY 1""")
def veg_air_only(spark, d):
    trees = voxel.canopy_voxels(scenes.canopy(spark, d), scenes.dem(spark), FRAME)
    return voxel.code_counts(voxel.merge_layers([(_city(spark, d), True), (trees, False)]))


def _blocks(spark, d):
    """Building columns of the height grid as voxels above ground."""
    j = _heights(spark, d).join(scenes.dem(spark), ["r", "c"])
    j = j.withColumns({"a": F.rint(F.col("dem") / SIZE).cast("int") + 1, "b": F.least(F.lit(LEVELS), F.rint((F.col("dem") + F.col("h")) / SIZE).cast("int") + 1)}).where("a < b")
    return j.select("r", "c", F.explode(F.expr("sequence(a, b - 1)")).alias("z"), F.lit(voxel.BUILDING).alias("code"))


def _city(spark, d):
    return voxel.merge_layers([(voxel.fill_terrain(scenes.dem(spark), FRAME), True), (_blocks(spark, d), True)])


@query("cells", "dem", "boxes", "claims", "heights", "ground", "roofcells", "city", sql="SELECT r, c, z, code::INT AS code FROM city")
def layer_merge(spark, d):
    return _city(spark, d)


@query("cells", "dem", "boxes", "claims", "heights", "ground", "roofcells", "city", "cover", "tops", "trees", sql="""SELECT code::INT AS code, count(*) AS n, min(z) AS lowest, max(z) AS highest FROM (
    SELECT r, c, z, arg_min(code, k) AS code FROM (SELECT v.r, v.c, v.z, CASE WHEN v.code = -1 AND v.z = max(CASE WHEN v.code = -1 THEN v.z END) OVER (PARTITION BY r, c) AND coalesce(k.code, 14) <> 0 THEN coalesce(k.code, 14) ELSE v.code END AS code, 0 AS k
    FROM city v LEFT JOIN cover k USING (r, c) UNION ALL SELECT r, c, z, -2, 1 FROM trees) GROUP BY r, c, z) GROUP BY 1""")
def voxel_summary(spark, d):
    from gridloom.plans.city import build_voxels

    cover = raster.land_cover(scenes.land_use(spark, d), scenes.cells(spark))
    v = build_voxels(FRAME, scenes.dem(spark), terrain=None, buildings=_blocks(spark, d), cover=cover, canopy=scenes.canopy(spark, d))
    return v.groupBy("code").agg(F.count("*").alias("n"), F.min("z").alias("lowest"), F.max("z").alias("highest"))


@query("cells", "dem", "boxes", "claims", "heights", "ground", "roofcells", "city", "tops", "trees", sql="""SELECT r, c, z, code::INT AS code FROM city UNION ALL
    SELECT r, c, z, -2 FROM (SELECT r, c, z FROM trees WHERE (r + c) % 4 <> 0) ANTI JOIN city USING (r, c, z) UNION ALL
    SELECT r, c, 47, -2 FROM (SELECT r, c, 47 AS z FROM cells WHERE (r + c) % 4 = 0) ANTI JOIN city USING (r, c, z)""")
def reapply_canopy(spark, d):
    own = scenes.cells(spark).where("(r + c) % 4 = 0").select("r", "c", F.lit(47).alias("z"), F.lit(voxel.TREE).alias("code"))
    old = scenes.cells(spark).where("(r + c) % 4 = 1").select("r", "c", F.lit(46).alias("z"), F.lit(voxel.TREE).alias("code"))
    v = voxel.merge_layers([(_city(spark, d), True), (own, False), (old, False)])
    return voxel.reapply_canopy(v, own, scenes.canopy(spark, d), scenes.dem(spark), FRAME)


@query("cells", "dem", "boxes", "claims", "heights", sql="""SELECT DISTINCT r + a AS r, c + b AS c, z + d AS z FROM (SELECT r, c, least(47, floor(h / 2))::INT AS z FROM heights),
    (VALUES (0,0,0),(1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) AS o(a, b, d) WHERE r + a BETWEEN 0 AND 63 AND c + b BETWEEN 0 AND 63 AND z + d BETWEEN 0 AND 47""")
def dilate6(spark, d):
    return voxel.dilate6(_heights(spark, d).select("r", "c", F.least(F.lit(47), F.floor(F.col("h") / 2)).cast("int").alias("z")), FRAME)


_EXPOSED = """exposed AS (SELECT r, c, z, code, face FROM city, (VALUES (1,0,0,'south'),(-1,0,0,'north'),(0,1,0,'east'),(0,-1,0,'west'),(0,0,1,'up'),(0,0,-1,'down')) AS o(a, b, d, face)
    ANTI JOIN (SELECT r AS r2, c AS c2, z AS z2, code AS code2 FROM city) ON r2 = r + a AND c2 = c + b AND z2 = z + d AND code2 = code)"""
WITH["exposed"] = _EXPOSED
_CITY = ("cells", "dem", "boxes", "claims", "heights", "ground", "roofcells", "city")


@query(*_CITY, "exposed", sql="SELECT r, c, z, code::INT AS code, face FROM exposed")
def exposed_faces(spark, d):
    return voxel.exposed_faces(_city(spark, d))


@query(*_CITY, "exposed", sql="""SELECT code::INT AS code, face, r, z, min(c) AS start, count(*) AS length FROM (SELECT *, c - row_number() OVER (PARTITION BY code, face, r, z ORDER BY c) AS g FROM exposed WHERE face IN ('up', 'down')) GROUP BY code, face, r, z, g""")
def face_runs(spark, d):
    f = voxel.exposed_faces(_city(spark, d)).where("face in ('up', 'down')")
    return voxel.face_runs(f, ["code", "face", "r", "z"], "c")


@query(*_CITY, "exposed", sql="""SELECT code::INT AS code, face, z, start, length, min(r) AS across0, count(*) AS depth FROM (SELECT *, r - row_number() OVER (PARTITION BY code, face, z, start, length ORDER BY r) AS g2 FROM (
    SELECT code, face, r, z, min(c) AS start, count(*) AS length FROM (SELECT *, c - row_number() OVER (PARTITION BY code, face, r, z ORDER BY c) AS g FROM exposed WHERE face IN ('up', 'down')) GROUP BY code, face, r, z, g)) GROUP BY code, face, z, start, length, g2""")
def greedy_rectangles(spark, d):
    return voxel.greedy_rectangles(face_runs(spark, d), ["code", "face", "z"], "r")


@query(*_CITY, "exposed", sql="SELECT code::INT AS code, face, r, c, z FROM exposed")
def maximal_rectangles(spark, d):
    """The rectangles, cut into faces again: each face must come back once."""
    m = voxel.maximal_rectangles(voxel.exposed_faces(_city(spark, d)))
    cut = m.withColumn("i", F.explode(F.expr("sequence(u, u + height - 1)"))).withColumn("j", F.explode(F.expr("sequence(v, v + width - 1)")))
    back = {k: F.coalesce(*[F.when(F.col("face") == f, {p[0]: F.col("layer"), p[1]: F.col("i"), p[2]: F.col("j")}[k]) for f, p in voxel.PLANES.items()]) for k in "rcz"}
    return cut.select("code", "face", *[v.alias(k) for k, v in back.items()])


@query(sql="SELECT r::INT AS r, c::INT AS c, z::INT AS z FROM range(64) AS a(r), range(64) AS b(c), range(0, 48) AS d(z) WHERE r < 60 AND c < 60 AND 2 * z + 1 < 10 + ((63 - r) * 2 - 1) * 0.25 + (c * 2 + 1) * 0.5")
def terrain_voxels(spark, d):
    """A plane that rises to the north and east, in 30 x 30 squares of 4 m, over 60 x 60 cells."""
    from gridloom.plans import city

    z = lambda x, y: f"10 + ({y} + 126) * 0.25 + {x} * 0.5"
    at = lambda i, j: F.expr(f"struct(cast({j} * 4 as double) as x, cast(-{i} * 4 as double) as y, cast({z(f'{j} * 4', f'(-{i} * 4)')} as double) as z)")
    q = spark.range(900).select(F.expr("id div 30 as i"), F.expr("id % 30 as j"))
    t = q.select(F.explode(F.array(F.array(at("i", "j"), at("(i + 1)", "j"), at("i", "(j + 1)")), F.array(at("i", "(j + 1)"), at("(i + 1)", "j"), at("(i + 1)", "(j + 1)")))).alias("t"))
    return city.terrain_voxels(t.select(*[F.col("t")[i][k].alias(f"{k}{i}") for i in range(3) for k in "xyz"]), FRAME)


@query("boxes", "plan", "solids", "around", sql="SELECT seq, r, c, z FROM around WHERE NOT whole")
def sat_shell(spark, d):
    return voxel.surface_cells(scenes.solids(spark, d), FRAME, False)


@query("boxes", "plan", "solids", "around", sql="SELECT seq, r, c, z FROM around WHERE middle")
def winding_fill(spark, d):
    return voxel.winding_fill(scenes.meshes(spark, d), FRAME)


@query("boxes", "plan", "solids", sql="""SELECT seq, r::INT AS r, c::INT AS c, z::INT AS z FROM solids, range(floor(ya / 2)::INT, floor(yb / 2)::INT + 1) AS a(r), range(floor(xa / 2)::INT, floor(xb / 2)::INT + 1) AS b(c), range(0, least(47, floor(zb / 2)::INT) + 1) AS d(z)
    WHERE z BETWEEN floor(za / 2) AND floor(zb / 2) AND c * 2 + 1.00062 BETWEEN xa AND xb AND r * 2 + 0.99894 BETWEEN ya AND yb AND NOT (c * 2 + 1.00062 > xm AND r * 2 + 0.99894 > ym)""")
def scanline_parity(spark, d):
    return voxel.scanline_fill(scenes.solids(spark, d), FRAME)


@query("boxes", "plan", "solids", sql="""SELECT seq, r, c, z, round(count(*) / 27.0, 6) AS share FROM (SELECT seq, (i // 3)::INT AS r, (j // 3)::INT AS c, (k // 3)::INT AS z
    FROM (SELECT *, 2.0 / 3 AS s FROM solids), range((ya / s)::INT - 1, (yb / s)::INT + 2) AS a(i), range((xa / s)::INT - 1, (xb / s)::INT + 2) AS b(j), range(0, least(144, (zb / s)::INT + 2)) AS d(k)
    WHERE i * s + s > ya AND i * s < yb AND j * s + s > xa AND j * s < xb AND k * s + s > za AND k * s < zb
    AND NOT (i * s > ym AND j * s > xm)
    AND NOT (i * s > ya AND i * s + s < yb AND j * s > xa AND j * s + s < xb AND k * s > za AND k * s + s < zb AND NOT (i * s + s > ym AND j * s + s > xm))) WHERE r BETWEEN 0 AND 63 AND c BETWEEN 0 AND 63 GROUP BY seq, r, c, z""")
def occupancy_fraction(spark, d):
    return voxel.occupancy(scenes.meshes(spark, d), FRAME).select("seq", "r", "c", "z", _r("share"))


@query("boxes", "plan", "solids", "around", sql="SELECT seq, r, c, z FROM around WHERE NOT whole AND part = 0")
def shell_anchor(spark, d):
    return voxel.shell_anchor(scenes.solids(spark, d), FRAME, "connected")


@query("boxes", "plan", "solids", "around", sql="SELECT seq, r, c, z FROM around")
def fill_holes(spark, d):
    return voxel.fill_holes(voxel.surface_cells(scenes.solids(spark, d), FRAME, False))


@query("boxes", "plan", "solids", "around", sql="SELECT seq, r, c, z FROM around WHERE part = 0")
def building_solid(spark, d):
    return voxel.building_solid(scenes.solids(spark, d), FRAME, 0.0, 3, "connected")


@query(*_CITY, sql="""SELECT count(*) AS pairs, sum(CASE WHEN abs(a.t - b.t) = 1 THEN 1 ELSE 0 END)::BIGINT AS steps, round(avg(CASE WHEN abs(a.t - b.t) = 1 THEN 1.0 ELSE 0.0 END), 6) AS share
    FROM (SELECT r, c, max(z) AS t FROM city WHERE code = -3 GROUP BY r, c) a JOIN (SELECT r, c, max(z) AS t FROM city WHERE code = -3 GROUP BY r, c) b ON (b.r = a.r + 1 AND b.c = a.c) OR (b.r = a.r AND b.c = a.c + 1)""")
def roof_slope_fraction(spark, d):
    return voxel.roof_slope(_city(spark, d)).select("pairs", F.col("steps").cast("long").alias("steps"), _r("share"))


# Topology


@query("faces", "edges", sql="SELECT mesh, lo, hi, count(*) AS n FROM edges GROUP BY ALL")
def edge_counts(spark, d):
    return topology.edge_counts(scenes.faces(spark, d))


@query("faces", "edges", sql="SELECT mesh, lo, hi FROM edges GROUP BY ALL HAVING count(*) = 1")
def boundary_edges(spark, d):
    return topology.boundary_edges(scenes.faces(spark, d))


@query("faces", "edges", sql="SELECT mesh, v, count(*) AS n FROM (SELECT mesh, unnest([lo, hi]) AS v FROM (SELECT mesh, lo, hi FROM edges GROUP BY ALL HAVING count(*) = 1)) GROUP BY ALL HAVING count(*) > 2")
def pinch_points(spark, d):
    return topology.pinch_points(scenes.faces(spark, d))


@query("faces", "edges", sql="SELECT * FROM faces WHERE (mesh, face) NOT IN (SELECT (mesh, face) FROM (SELECT *, row_number() OVER (PARTITION BY mesh, lo, hi ORDER BY face, i) AS k FROM edges) WHERE k > 2)")
def nonmanifold_drop(spark, d):
    return topology.drop_crowding(scenes.faces(spark, d))


@query("faces", "edges", sql="SELECT mesh, count(*) AS edges, sum((n = 1)::INT)::BIGINT AS open_edges, sum((n > 2)::INT)::BIGINT AS crowded_edges FROM (SELECT mesh, lo, hi, count(*) AS n FROM edges GROUP BY ALL) GROUP BY mesh")
def solid_validate(spark, d):
    return topology.validate(scenes.faces(spark, d))


def _vertices(spark, d):
    return scenes.faces(spark, d).select("mesh", F.explode(F.array("a", "b", "c")).alias("v")).distinct().select(
        "mesh", "v", F.expr("cast(v % 10 as double)").alias("x"), F.expr("cast(v % 7 as double)").alias("y"), F.expr("cast(v % 3 as double)").alias("z"))


_TO = "t AS (SELECT mesh, v, min(v) OVER (PARTITION BY mesh, v % 10, v % 7, v % 3) AS w FROM (SELECT DISTINCT mesh, unnest([a, b, c]) AS v FROM faces))"
WITH["to"] = _TO


@query("faces", "to", sql="""SELECT f.mesh, face, x.w AS a, y.w AS b, z.w AS c FROM faces f JOIN t x ON x.mesh = f.mesh AND x.v = f.a JOIN t y ON y.mesh = f.mesh AND y.v = f.b JOIN t z ON z.mesh = f.mesh AND z.v = f.c
    WHERE x.w <> y.w AND y.w <> z.w AND z.w <> x.w""")
def weld_vertices(spark, d):
    return topology.weld(_vertices(spark, d), scenes.faces(spark, d), 1e-6)[1]


@query("faces", "to", sql="SELECT mesh, v, (v % 10)::DOUBLE AS x, (v % 7)::DOUBLE AS y, (v % 3)::DOUBLE AS z FROM t WHERE v = w")
def weld_points(spark, d):
    return topology.weld(_vertices(spark, d), scenes.faces(spark, d), 1e-6)[0]


@query("faces", sql="SELECT mesh, face, a, b, c FROM (SELECT *, row_number() OVER (PARTITION BY mesh, list_sort([a, b, c]) ORDER BY face, a, b) AS k FROM faces) WHERE k = 1")
def dedupe_faces(spark, d):
    return topology.drop_doubles(scenes.faces(spark, d))


@query("faces", sql="""SELECT mesh, face FROM (SELECT mesh, face, sqrt(pow((y1 - y0) * (z2 - z0) - (z1 - z0) * (y2 - y0), 2) + pow((z1 - z0) * (x2 - x0) - (x1 - x0) * (z2 - z0), 2) + pow((x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0), 2)) / 2 AS area,
    sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2) + pow(z1 - z0, 2)) AS s0, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2) + pow(z2 - z1, 2)) AS s1, sqrt(pow(x0 - x2, 2) + pow(y0 - y2, 2) + pow(z0 - z2, 2)) AS s2
    FROM (SELECT mesh, face, a%10 + 3000000.0::DOUBLE * (a%5 = 0)::INT AS x0, a%7 AS y0, a%3 AS z0, b%10 + 3000000.0::DOUBLE * (b%5 = 0)::INT AS x1, b%7 AS y1, b%3 AS z1, c%10 + 3000000.0::DOUBLE * (c%5 = 0)::INT AS x2, c%7 AS y2, c%3 AS z2 FROM faces))
    WHERE area >= 1e-12 AND greatest(s0, s1, s2) <= 1e6 * greatest(least(s0, s1, s2), 1e-15)""")
def degenerate_filter(spark, d):
    far = _vertices(spark, d).withColumn("x", F.col("x") + F.expr("if(v % 5 = 0, 3000000D, 0D)"))
    return topology.drop_degenerate(topology.face_points(scenes.faces(spark, d), far)).select("mesh", "face")


@query("faces", "edges", sql="""SELECT mesh, unnest([b, b]) AS a, unnest([a, a + 1000]) AS b, unnest([a + 1000, b + 1000]) AS c FROM edges WHERE (mesh, lo, hi) IN (SELECT (mesh, lo, hi) FROM edges GROUP BY mesh, lo, hi HAVING count(*) = 1)""")
def extrude_walls(spark, d):
    return topology.walls(scenes.faces(spark, d), 1000).select("mesh", "a", "b", "c")


# Statistics

_FACE = "l_suppkey % 40 AS b, l_discount AS v, l_returnflag = 'R' AS vertical"
_GVI = f"""gvi AS (SELECT b AS building_id, coalesce(avg(CASE WHEN vertical THEN v END), avg(v)) AS mean_v, CASE WHEN count(CASE WHEN vertical THEN 1 END) > 0 THEN count(CASE WHEN vertical THEN 1 END) ELSE count(*) END AS face_count
    FROM (SELECT {_FACE} FROM lineitem) WHERE b <> 0 GROUP BY b)"""
WITH["gvi"] = _GVI


def _gvi(spark, d):
    f = table(spark, d, "lineitem").select(F.expr("l_suppkey % 40").alias("building_id"), F.col("l_discount").alias("v"), F.expr("l_returnflag = 'R'").alias("vertical"))
    return stats.by_building(f)


@query("gvi", sql="SELECT building_id, round(mean_v, 6) AS mean_v, face_count FROM gvi")
def gvi_by_building(spark, d):
    return _gvi(spark, d).select("building_id", _r("mean_v"), "face_count")


@query("gvi", sql="SELECT i AS building_id, round(coalesce(mean_v, 0), 6) AS mean_v, coalesce(face_count, 0) AS face_count FROM range(0, 60, 3) AS t(i) LEFT JOIN gvi ON building_id = i")
def core_filter_backfill(spark, d):
    return stats.backfill(_gvi(spark, d), spark.range(0, 60, 3).withColumnRenamed("id", "building_id")).select("building_id", _r("mean_v"), "face_count")


@query(sql="(SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20) UNION ALL (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20)")
def topk_union(spark, d):
    return stats.ends_union(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 20)


@query(sql="""SELECT unnest(['low', 'middle', 'high']) AS name, round(unnest([avg((l_discount < 0.03)::INT), avg((l_discount >= 0.03 AND l_discount < 0.07)::INT), avg((l_discount >= 0.07)::INT)]) * 100, 6) AS percent FROM lineitem""")
def category_shares(spark, d):
    x = F.col("l_discount")
    return stats.shares(table(spark, d, "lineitem"), [("low", x < 0.03), ("middle", (x >= 0.03) & (x < 0.07)), ("high", x >= 0.07)]).select("name", _r("percent"))


@query(sql="""SELECT count(*) AS n, round(sum(l_quantity), 4) AS weight, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS mean,
    round(sqrt(sum(l_quantity * (l_extendedprice - m) * (l_extendedprice - m)) / sum(l_quantity)), 3) AS std, min(l_extendedprice) AS min, max(l_extendedprice) AS max
    FROM lineitem, (SELECT sum(l_extendedprice * l_quantity) / sum(l_quantity) AS m FROM lineitem)""")
def weighted_stats(spark, d):
    s = stats.weighted_stats(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity")
    return s.select("n", F.round("weight", 4).alias("weight"), F.round("mean", 4).alias("mean"), F.round("std", 3).alias("std"), "min", "max")


@query(sql="""WITH g AS (SELECT l_discount * 100 + l_tax AS v, sum(l_quantity) AS w FROM lineitem GROUP BY 1), a AS (SELECT v, (sum(w) OVER (ORDER BY v) - w / 2) / sum(w) OVER () AS p FROM g),
    q AS (SELECT unnest([5.0, 25.0, 50.0, 75.0, 95.0])::DOUBLE AS p), l AS (SELECT q.p, max(a.p) AS pa, arg_max(a.v, a.p) AS va FROM q LEFT JOIN a ON a.p <= q.p / 100 GROUP BY q.p),
    h AS (SELECT q.p, min(a.p) AS pb, arg_min(a.v, a.p) AS vb FROM q LEFT JOIN a ON a.p >= q.p / 100 GROUP BY q.p)
    SELECT p, round(coalesce(CASE WHEN pb > pa THEN va + (vb - va) * (p / 100 - pa) / (pb - pa) ELSE va END, va, vb), 5) AS v FROM l JOIN h USING (p)""")
def weighted_percentile(spark, d):
    li = table(spark, d, "lineitem").select((F.col("l_discount") * 100 + F.col("l_tax")).alias("x"), "l_quantity")
    return stats.weighted_percentiles(li, "x", "l_quantity", [5, 25, 50, 75, 95]).select("p", F.round("v", 5).alias("v"))


@query(sql="SELECT v, round(sum(n) OVER (ORDER BY v) / sum(n) OVER (), 6) AS share FROM (SELECT l_quantity AS v, count(*) AS n FROM lineitem GROUP BY 1)")
def ecdf(spark, d):
    return stats.ecdf(table(spark, d, "lineitem"), "l_quantity").select("v", _r("share"))


@query(sql="SELECT v, round(sum(n) OVER (ORDER BY v) / sum(n) OVER (), 6) AS share FROM (SELECT l_quantity AS v, sum(l_suppkey) AS n FROM lineitem GROUP BY 1)")
def weighted_ecdf(spark, d):
    return stats.ecdf(table(spark, d, "lineitem"), "l_quantity", F.col("l_suppkey")).select("v", _r("share"))


@query(sql="""SELECT x::DOUBLE AS x, round((SELECT count(*) FROM lineitem WHERE l_returnflag = 'R' AND l_quantity <= x) / (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') -
    (SELECT count(*) FROM lineitem WHERE l_returnflag = 'N' AND l_quantity <= x) / (SELECT count(*) FROM lineitem WHERE l_returnflag = 'N'), 6) AS diff FROM range(0, 60, 5) AS t(x)""")
def ecdf_diff(spark, d):
    grid = spark.range(0, 60, 5).select(F.col("id").cast("double").alias("x"))
    one = lambda k: stats.ecdf_on(table(spark, d, "lineitem").where(F.col("l_returnflag") == k), "l_quantity", grid)
    return one("R").withColumnRenamed("share", "a").join(one("N"), "x").select("x", F.round(F.col("a") - F.col("share"), 6).alias("diff"))


@query(sql="SELECT p::DOUBLE AS p, round(v, 6) AS v FROM (SELECT unnest([1, 5, 10, 25, 50, 75, 90, 95, 99]) AS p, unnest(quantile_cont(l_extendedprice, [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99])) AS v FROM lineitem)")
def percentile_ladder(spark, d):
    return stats.percentiles(table(spark, d, "lineitem"), "l_extendedprice", [1, 5, 10, 25, 50, 75, 90, 95, 99]).select("p", _r("v"))


@query(sql="""SELECT bin::INT AS bin, count(*) AS n FROM (SELECT len(list_filter(e[2 : len(e) - 1], lambda x: x < l_quantity)) AS bin FROM lineitem, (SELECT list_sort(list_distinct(quantile_cont(l_quantity, [0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e FROM lineitem)) GROUP BY 1""")
def qcut_bins(spark, d):
    return stats.quantile_bins(table(spark, d, "lineitem").select("l_quantity"), "l_quantity", 5).groupBy("bin").agg(F.count("*").alias("n"))


@query(sql="""SELECT b::INT AS bin, count(l_quantity) AS n, round(count(l_quantity) / sum(count(l_quantity)) OVER () / 2.5, 6) AS density FROM range(20) AS t(b) LEFT JOIN lineitem ON least(19, floor(l_quantity / 2.5)) = b AND l_quantity BETWEEN 0 AND 50 GROUP BY b""")
def histogram_bins(spark, d):
    return stats.histogram(table(spark, d, "lineitem"), "l_quantity", 0.0, 50.0, 20).select("bin", "n", _r("density"))


@query(sql="SELECT count(*) AS n, round(sum(l_quantity), 4) AS sum, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std, round(skewness(l_quantity), 6) AS skew, round(kurtosis(l_quantity), 6) AS kurt FROM lineitem")
def moments_sample(spark, d):
    return stats.moments(table(spark, d, "lineitem"), "l_quantity").select("n", F.round("sum", 4).alias("sum"), _r("mean"), _r("std"), _r("skew"), _r("kurt"))


_PAIR = """j AS (SELECT a.l_extendedprice AS x, b.l_extendedprice AS y, a.l_quantity AS w FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2 WHERE a.l_extendedprice > 0 AND b.l_extendedprice > 0)"""
WITH["pair"] = _PAIR


@query("pair", sql="""SELECT count(*) AS n, round(avg(abs(y - x)), 4) AS mae, round(sqrt(avg((y - x) * (y - x))), 4) AS rmse, round(sqrt(avg((y - x) * (y - x))) / avg(x), 6) AS nrmse, round(avg(y - x) / avg(x) * 100, 5) AS rel,
    round(sum(abs(y - x) * w) / sum(w), 4) AS wmae, round(sqrt(sum((y - x) * (y - x) * w) / sum(w)), 4) AS wrmse, round(corr(x, y), 6) AS pearson, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 3) AS intercept,
    round(regr_r2(y, x), 6) AS r2, sum((y > x)::INT)::BIGINT AS above, sum((y < x)::INT)::BIGINT AS below FROM j""")
def paired_error(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("v"), F.col("l_quantity").alias("w"))
    e = stats.paired_error(li.where("l_linenumber = 1").drop("l_linenumber"), li.where("l_linenumber = 2").drop("l_linenumber", "w"), "l_orderkey", "w")
    n = {"mae": 4, "rmse": 4, "rel": 5, "wmae": 4, "wrmse": 4, "intercept": 3}
    return e.select(*[c if c in ("n", "above", "below") else F.round(c, n.get(c, 6)).alias(c) for c in e.columns])


@query(sql="""SELECT count(*) AS n, round(corr(rx, ry), 6) AS spearman FROM (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS rx, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS ry FROM lineitem)""")
def rank_corr(spark, d):
    return stats.rank_correlation(table(spark, d, "lineitem"), "l_quantity", "l_discount").select("n", _r("spearman"))


@query(sql="""WITH g AS (SELECT l_quantity AS v, sum((l_returnflag = 'R')::INT) AS a, sum((l_returnflag <> 'R')::INT) AS b FROM lineitem GROUP BY 1), s AS (SELECT sum(a) OVER (ORDER BY v) AS a, sum(b) OVER (ORDER BY v) AS b, sum(a) OVER () AS n1, sum(b) OVER () AS n2 FROM g)
    SELECT max(n1)::BIGINT AS n1, max(n2)::BIGINT AS n2, round(max(abs(a / n1 - b / n2)), 6) AS d FROM s""")
def ks_stat(spark, d):
    return stats.ks_statistic(table(spark, d, "lineitem"), "l_quantity", F.col("l_returnflag") == "R").select("n1", "n2", _r("d"))


@query(sql="""SELECT count(*) AS n1, (SELECT count(*) FROM lineitem WHERE l_returnflag <> 'R') AS n2, round(sum(k) - count(*) * (count(*) + 1) / 2.0, 2) AS u FROM (SELECT l_returnflag, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS k FROM lineitem) WHERE l_returnflag = 'R'""")
def mannwhitney_u(spark, d):
    return stats.mann_whitney(table(spark, d, "lineitem"), "l_quantity", F.col("l_returnflag") == "R").select("n1", "n2", F.round("u", 2).alias("u"))


@query(sql="""SELECT round((m1 - m2) / sqrt(q1 / n1 + q2 / n2), 6) AS t, round(pow(q1 / n1 + q2 / n2, 2) / (pow(q1 / n1, 2) / (n1 - 1) + pow(q2 / n2, 2) / (n2 - 1)), 4) AS dof, round((m1 - m2) / sqrt(((n1 - 1) * q1 + (n2 - 1) * q2) / (n1 + n2 - 2)), 6) AS cohen_d
    FROM (SELECT count(*) AS n1, avg(l_quantity) AS m1, var_samp(l_quantity) AS q1 FROM lineitem WHERE l_returnflag = 'R'), (SELECT count(*) AS n2, avg(l_quantity) AS m2, var_samp(l_quantity) AS q2 FROM lineitem WHERE l_returnflag <> 'R')""")
def welch_t(spark, d):
    return stats.welch(table(spark, d, "lineitem"), "l_quantity", F.col("l_returnflag") == "R").select(_r("t"), F.round("dof", 4).alias("dof"), _r("cohen_d"))


@query("cells", "dem", sql="SELECT e AS edge_id, round(avg(dem), 6) AS v FROM (SELECT s_suppkey AS e, round_even(s_suppkey % 60 + ((s_suppkey * 7) % 60 - s_suppkey % 60) * k / 4.0, 0)::INT AS r, round_even(s_nationkey + (s_suppkey % 50 - s_nationkey) * k / 4.0, 0)::INT AS c FROM supplier, range(5) AS t(k)) JOIN dem USING (r, c) GROUP BY e")
def edge_overlay(spark, d):
    e = table(spark, d, "supplier").select(F.col("s_suppkey").alias("edge_id"), F.expr("s_suppkey % 60").alias("r0"), F.col("s_nationkey").alias("c0"), F.expr("(s_suppkey * 7) % 60").alias("r1"), F.expr("s_suppkey % 50").alias("c1"))
    return stats.edge_means(e, scenes.dem(spark).withColumnRenamed("dem", "v"), 5).select("edge_id", _r("v"))


# Solids, terrain and canopy

_AREA = "(xb - xa) * (yb - ya) - (xb - xm) * (yb - ym)"


def _points(t, key):
    """Triangles as faces whose vertices are named by their place."""
    at = lambda i: F.concat_ws(" ", *[F.col(f"{k}{i}").cast("string") for k in "xyz"]).alias("abc"[i])
    return t.select(key.alias("mesh"), "face", *[at(i) for i in range(3)])


@query("boxes", "plan", "solids", sql="SELECT seq * 2 + part AS mesh, seq % 4 <> 0 AS volume FROM solids")
def solid_volume(spark, d):
    t = scenes.solids(spark, d).where("seq % 4 <> 0 or face <> 0")
    return topology.is_volume(_points(t, F.expr("seq * 2 + part")))


@query("boxes", "plan", "solids", sql=f"SELECT seq * 2 + part AS mesh, round(({_AREA}) * (zb - za), 6) AS volume FROM solids")
def outward_volume(spark, d):
    t = scenes.solids(spark, d).withColumn("mesh", F.expr("seq * 2 + part")).where("face >= 0")
    half = {f"{k}{i}": F.when(F.col("mesh") % 4 == 0, F.col(f"{k}{3 - i}")).otherwise(F.col(f"{k}{i}")) for k in "xyz" for i in (1, 2)}
    det = F.expr("x0 * (y1 * z2 - z1 * y2) - y0 * (x1 * z2 - z1 * x2) + z0 * (x1 * y2 - y1 * x2)")
    out = topology.outward(t.select("mesh", "face", "x0", "y0", "z0", *[half[f"{k}{i}"].alias(f"{k}{i}") for i in (1, 2) for k in "xyz"]))
    return out.groupBy("mesh").agg(F.round(F.sum(det) / 6, 6).alias("volume"))


def _sheets(spark, d):
    """A sheet of 3 x 3 points for each supplier; every second has a face twice and one that is a line."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("mesh"), "s_nationkey")
    v = s.withColumn("v", F.explode(F.expr("sequence(0L, 8L)"))).select(
        "mesh", "v", F.expr("cast(v % 3 as double) as x"), F.expr("cast(v div 3 as double) as y"), F.expr("cast(5 + (v * s_nationkey) % 4 as double) as z"))
    f = s.withColumn("q", F.explode(F.expr("sequence(0L, 9L)"))).withColumn("p", F.expr("(q % 8) div 2 + (q % 8) div 4")).where("q < 8 or mesh % 2 = 0")
    f = f.select("mesh", F.col("q").alias("face"), F.col("p").alias("a"), F.expr("if(q % 2 = 0, p + 1, p + 4) as b"), F.expr("case when q = 9 then p when q % 2 = 0 then p + 4 else p + 3 end as c"))
    return v, f


@query(sql="SELECT s_suppkey AS mesh, true AS volume, 32 AS faces, 18 AS points, 0.0::DOUBLE AS bottom FROM supplier")
def terrain_solid(spark, d):
    v, f = _sheets(spark, d)
    points, faces = topology.terrain_solid(v, f, 100, 0.0)
    n = faces.groupBy("mesh").agg(F.countDistinct("face").alias("faces"))
    low = points.groupBy("mesh").agg(F.count("*").alias("points"), F.min("z").alias("bottom"))
    return topology.is_volume(faces).join(n, "mesh").join(low, "mesh").select("mesh", "volume", "faces", "points", "bottom")


@query(sql="SELECT s_suppkey AS mesh, face, CASE WHEN face // 2 = 0 THEN 0 ELSE 1000 * (face // 2) END AS a, 1 + (face // 2) * 2 + CASE WHEN face % 2 = 0 THEN 0 ELSE 100 END AS b, 2 + (face // 2) * 2 + CASE WHEN face % 2 = 0 THEN 0 ELSE 100 END AS c FROM (SELECT s_suppkey, unnest(range(0, 2 + 2 * (s_nationkey % 4))) AS face FROM supplier)")
def pinch_split(spark, d):
    n = table(spark, d, "supplier").select(F.col("s_suppkey").alias("mesh"), F.explode(F.expr("sequence(0L, 1L + 2 * (s_nationkey % 4))")).alias("face"))
    # Faces 2k and 2k + 1 share the edge from 0 to 50 + k: one fan.
    f = n.select("mesh", "face", F.lit(0).cast("long").alias("a"), F.expr("1 + (face div 2) * 2 + if(face % 2 = 0, 0, 100) as b"), F.expr("2 + (face div 2) * 2 + if(face % 2 = 0, 0, 100) as c"), F.expr("50000 + face div 2 as e"))
    fans = f.select("mesh", "face", "a", "b", F.col("e").alias("c"))
    got = topology.split_pinches(fans, 1000)
    return got.join(f.select("mesh", "face", F.col("c").alias("own")), ["mesh", "face"]).select("mesh", "face", "a", "b", F.col("own").alias("c"))


@query("faces", sql="""SELECT mesh, face, a, b, c FROM (SELECT *, row_number() OVER (PARTITION BY mesh, a%10 + b%10 + c%10, a%7 + b%7 + c%7, a%3 + b%3 + c%3 ORDER BY face) AS k2 FROM (
    SELECT *, row_number() OVER (PARTITION BY mesh, list_sort([a, b, c]) ORDER BY face) AS k FROM (SELECT mesh, face, min(a) AS a, max(b) AS b, min(c) AS c FROM faces GROUP BY ALL)) WHERE k = 1) WHERE k2 = 1""")
def overlap_drop(spark, d):
    one = scenes.faces(spark, d).groupBy("mesh", "face").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.min("c").alias("c"))
    return topology.drop_overlaps(one, _vertices(spark, d))


@query(sql="""SELECT l_returnflag AS feature_type, count(*) AS meshes, sum(l_linenumber + 2)::BIGINT AS vertices, sum(l_linenumber)::BIGINT AS faces FROM lineitem GROUP BY 1""")
def mesh_totals(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("feature_type"), F.expr("sequence(1, l_linenumber + 2) as vertices"), F.expr("sequence(1, l_linenumber) as faces"))
    return meshes.totals(li)


@query("cells", "dem", sql="""SELECT (l_partkey % 64)::INT AS r, (l_suppkey % 64)::INT AS c, round(max(coalesce(CASE WHEN l_linenumber = 3 THEN l_quantity / 2 END, greatest(0, l_quantity - 20 - dem))), 6) AS top
    FROM lineitem JOIN dem ON dem.r = l_partkey % 64 AND dem.c = l_suppkey % 64 GROUP BY 1, 2 HAVING max(coalesce(CASE WHEN l_linenumber = 3 THEN l_quantity / 2 END, greatest(0, l_quantity - 20 - dem))) > 0""")
def vegetation_tops(spark, d):
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("seq"), F.expr("cast(l_partkey % 64 as int) as r"), F.expr("cast(l_suppkey % 64 as int) as c"),
                                           F.expr("l_quantity - 20 as z_max"), F.expr("if(l_linenumber = 3, l_quantity / 2, null) as height"))
    return raster.vegetation_tops(c, scenes.dem(spark)).select("r", "c", _r("top"))


@query("cells", "cover", "tops", sql="""SELECT coalesce(a.r, b.r) AS r, coalesce(a.c, b.c) AS c, coalesce(a.top, b.top) AS top FROM (SELECT r, c, top FROM tops WHERE top > 25) a FULL JOIN (SELECT r, c, 10.0::DOUBLE AS top FROM cover WHERE code IN (5, 9)) b ON a.r = b.r AND a.c = b.c""")
def canopy_merge(spark, d):
    own = scenes.canopy(spark, d).withColumn("top", F.when(F.col("top") > 25, F.col("top")).otherwise(0.0)).select("r", "c", "top")
    cover = raster.land_cover(scenes.land_use(spark, d), scenes.cells(spark))
    return raster.merge_canopy(own, raster.static_canopy(cover, [5, 9], 10.0))


@query("boxes", "plan", "solids", sql=SQL["occupancy_fraction"].split("SELECT seq, r, c, z, round(count(*)", 1)[1].join(["SELECT seq, r, c, z FROM (SELECT seq, r, c, z, round(count(*)", ") WHERE share >= 0.3"]))
def occupancy_at_least(spark, d):
    return voxel.occupied_cells(scenes.meshes(spark, d), FRAME, 0.3)


@query("cells", "dem", sql="""SELECT r, c, k::INT AS k, c::DOUBLE AS x0, r::DOUBLE AS y0, CASE k WHEN 0 THEN a ELSE b END AS z0, (c + k)::DOUBLE AS x_mid, CASE k WHEN 0 THEN e ELSE f END AS z1, CASE k WHEN 0 THEN b ELSE g END AS z2 FROM (
    SELECT p.r, p.c, p.dem AS a, q.dem AS b, s.dem AS e, s.dem AS f, t.dem AS g FROM dem p JOIN dem q ON q.r = p.r AND q.c = p.c + 1 JOIN dem s ON s.r = p.r + 1 AND s.c = p.c JOIN dem t ON t.r = p.r + 1 AND t.c = p.c + 1
    WHERE (p.r + p.c) % 5 <> 0 AND (p.r + p.c + 1) % 5 <> 0 AND (p.r + p.c + 2) % 5 <> 0), range(0, 2) AS u(k)""")
def raster_tin(spark, d):
    px = scenes.dem(spark).select("r", "c", F.col("c").cast("double").alias("lon"), F.col("r").cast("double").alias("lat"), F.when((F.col("r") + F.col("c")) % 5 != 0, F.col("dem")).alias("z"))
    t = raster.raster_triangles(px)
    return t.select("r", "c", "k", F.col("c").cast("double").alias("x0"), F.col("r").cast("double").alias("y0"), "z0", F.col("x0").alias("x_mid"), "z1", "z2")


@query("boxes", sql="SELECT seq, round(greatest(0, least(c0 + w - 0.75, 30) - greatest(c0 - 0.25, 10)) * greatest(0, least(r0 + h - 0.75, 50) - greatest(r0 - 0.25, 20))::DOUBLE, 6) AS area FROM boxes WHERE c0 + w - 0.75 > 10 AND c0 - 0.25 < 30 AND r0 + h - 0.75 > 20 AND r0 - 0.25 < 50")
def triangle_clip(spark, d):
    from gridloom.sources.model import triangle_polygons

    t = scenes.roofs(spark, d).withColumn("face", F.expr("if(x1 = x2, 0, 1)")).withColumn("code", F.lit(-3))
    p = triangle_polygons(t, (10.0, 20.0), (30.0, 50.0)).groupBy("quad").agg(F.array_sort(F.collect_list(F.struct("k", "x", "y"))).alias("p"))
    area = F.abs(F.aggregate(F.transform("p", lambda a, i: a["x"] * F.get("p", (i + 1) % F.size("p"))["y"] - F.get("p", (i + 1) % F.size("p"))["x"] * a["y"]), F.lit(0.0), lambda s, x: s + x)) / 2
    return p.select("quad.seq", area.alias("a")).groupBy("seq").agg(F.round(F.sum("a"), 6).alias("area")).where("area > 0")


@query("boxes", sql="""SELECT seq, round(greatest(0, least(c0 + w + 0.5, 30) - greatest(c0, 10)) * greatest(0, least(r0 + h + 0.5, 50) - greatest(r0, 20)) - (CASE WHEN seq % 2 = 0 THEN greatest(0, least(c0 + 0.75, 30) - greatest(c0 + 0.25, 10)) *
    greatest(0, least(r0 + 0.75, 50) - greatest(r0 + 0.25, 20)) ELSE 0 END)::DOUBLE, 6)::DOUBLE AS area FROM boxes WHERE c0 + w + 0.5 > 10 AND c0 < 30 AND r0 + h + 0.5 > 20 AND r0 < 50""")
def landcover_clip(spark, d):
    ring = lambda a, b, x, y: f"array(struct(c0 + {a} as x, r0 + {a} as y), struct(c0 + {x} as x, r0 + {a} as y), struct(c0 + {x} as x, r0 + {y} as y), struct(c0 + {a} as x, r0 + {y} as y))"
    b = scenes.boxes(spark, d).select("seq", F.lit(5).alias("code"), F.expr(ring("0D", "0D", "w + 0.5D", "h + 0.5D")).alias("ring"), F.expr(f"if(seq % 2 = 0, array({ring('0.25D', '0.25D', '0.75D', '0.75D')}), array())").alias("holes"))
    cut = raster.clip_polygons(b, (10.0, 20.0), (30.0, 50.0))
    area = lambda p: F.abs(F.aggregate(F.transform(p, lambda a, i: a["x"] * F.get(p, (i + 1) % F.size(p))["y"] - F.get(p, (i + 1) % F.size(p))["x"] * a["y"]), F.lit(0.0), lambda s, x: s + x)) / 2
    gone = F.aggregate("holes", F.lit(0.0), lambda s, h: s + area(h))
    return cut.select("seq", F.round(area(F.col("ring")) - gone, 6).alias("area")).where("area > 0")


@query("boxes", sql="SELECT x, y, min(zmax) AS z FROM (SELECT zmax, c0 - 0.25::DOUBLE AS x, unnest([r0 - 0.25::DOUBLE, r0 + h - 0.75::DOUBLE]) AS y FROM boxes UNION ALL SELECT zmax, c0 + w - 0.75::DOUBLE, unnest([r0 - 0.25::DOUBLE, r0 + h - 0.75::DOUBLE]) FROM boxes) GROUP BY x, y")
def terrain_points(spark, d):
    return raster.terrain_points(scenes.roofs(spark, d))


@query(sql="SELECT s_suppkey AS mesh, rank::INT AS rank, CASE rank WHEN 0 THEN 4 ELSE 3 END AS edges, CASE rank WHEN 0 THEN 10 ELSE 20 * rank END AS first FROM (SELECT s_suppkey, unnest(range(0, 1 + s_nationkey % 3)) AS rank FROM supplier)")
def boundary_loops(spark, d):
    """A square of two faces and up to two triangles apart from it."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("mesh"), "s_nationkey")
    f = s.withColumn("face", F.explode(F.expr("sequence(0L, cast(1 + s_nationkey % 3 as bigint))")))
    return topology.boundary_loops(f.select("mesh", "face", F.expr("case face when 0 then 10L when 1 then 10L else 20 * (face - 1) end as a"),
                                            F.expr("case face when 0 then 11L when 1 then 12L else 20 * (face - 1) + 1 end as b"), F.expr("case face when 0 then 12L when 1 then 13L else 20 * (face - 1) + 2 end as c")))


# Filters of the examples

_BOX_RING = "array(struct(cast(c0 as double) as x, cast(r0 as double) as y), struct(cast(c0 + w as double) as x, cast(r0 as double) as y), struct(cast(c0 + w as double) as x, cast(r0 + h as double) as y), struct(cast(c0 as double) as x, cast(r0 + h as double) as y))"
_CORE = [(10.0, 20.0), (10.0, 31.0), (41.0, 31.0), (41.0, 20.0)]


@query("boxes", sql="SELECT seq FROM boxes WHERE c0 + w / 2.0 BETWEEN 10 AND 41 AND r0 + h / 2.0 BETWEEN 20 AND 31")
def centre_filter(spark, d):
    return meshes.centre_in_rectangle(scenes.boxes(spark, d).select("seq", F.expr(_BOX_RING).alias("vertices")), _CORE).select("seq")


@query("boxes", sql="SELECT seq FROM boxes WHERE c0 >= 10 AND c0 + w <= 41 AND r0 >= 20 AND r0 + h <= 31")
def within_filter(spark, d):
    return meshes.within_rectangle(scenes.boxes(spark, d).select("seq", F.expr(_BOX_RING).alias("ring")), _CORE).select("seq")


@query("boxes", sql="SELECT seq FROM boxes WHERE c0 <= 41 AND c0 + w >= 10 AND r0 <= 31 AND r0 + h >= 20")
def intersects_filter(spark, d):
    return meshes.meets_rectangle(scenes.boxes(spark, d).select("seq", F.expr(_BOX_RING).alias("ring")), _CORE).select("seq")


@query(sql="SELECT l_returnflag AS run, bin::INT AS bin, count(*) AS n FROM (SELECT l_returnflag, len(list_filter(e[2 : len(e) - 1], lambda x: x < l_extendedprice)) AS bin FROM lineitem, (SELECT list_sort(list_distinct(quantile_cont(l_extendedprice, [0, 0.25, 0.5, 0.75, 1.0]))) AS e FROM lineitem)) GROUP BY 1, 2")
def pooled_quartiles(spark, d):
    return stats.pooled_bins(table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "run"), "l_extendedprice", "run")


@query(sql="SELECT count(*) AS cells, count(v) AS valid, round(count(v) / count(*), 6) AS share, round(avg(v), 6) AS mean, min(v) AS low, max(v) AS high FROM (SELECT CASE WHEN event_id % 7 NOT IN (0, 1) THEN value END AS v FROM events)")
def grid_summary(spark, d):
    v = table(spark, d, "events").select(F.expr("case when event_id % 7 = 0 then null when event_id % 7 = 1 then double('NaN') else value end as value"))
    return stats.grid_summary(v, "value").select("cells", "valid", _r("share"), _r("mean"), "low", "high")


@query(sql="SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) AS k FROM events) WHERE k = 1")
def keep_best(spark, d):
    return stats.keep_best(table(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], "value", "event_id")


@query(sql="SELECT 'building' AS kind, s_suppkey AS id, s_nationkey AS extra, NULL::BIGINT AS other FROM supplier UNION ALL SELECT 'bridge', c_custkey, NULL, c_custkey * 2 FROM customer")
def tagged_concat(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("extra"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 2).alias("other"))
    return meshes.tagged({"building": s, "bridge": c}, "kind").select("kind", "id", "extra", "other")


@query("gvi", sql="SELECT s_suppkey AS building_id, s_name, round(mean_v, 6) AS mean_v FROM supplier JOIN gvi ON building_id = s_suppkey")
def lookup_join(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("building_id"), "s_name")
    return s.join(_gvi(spark, d), "building_id").select("building_id", "s_name", _r("mean_v"))


@query(sql="SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def csv_round_trip(spark, d):
    from gridloom.sources import tabular

    return tabular.round_trip(table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"))


# Features from XML

_RING = "concat('<gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>', {p}, '</gml:posList></gml:LinearRing></gml:exterior>{hole}</gml:Polygon>')"
_XML = ("concat('<core:CityModel xmlns:core=\"c\" xmlns:bldg=\"b\" xmlns:brid=\"r\" xmlns:veg=\"v\" xmlns:gen=\"e\" xmlns:xlink=\"x\" xmlns:gml=\"g\">', {body}, '</core:CityModel>')")


def _square(x: str, y: str, side: str, z: str) -> str:
    return f"concat_ws(' ', {x}, {y}, {z}, {x} + {side}, {y}, {z}, {x} + {side}, {y} + {side}, {z}, {x}, {y} + {side}, {z}, {x}, {y}, {z})"


def _parsed(spark, d, kind: str, body: str):
    from gridloom.sources import citygml

    t = table(spark, d, "supplier").select(F.concat(F.lit("f"), F.col("s_suppkey")).alias("path"), F.expr(_XML.format(body=body)).alias("text"), F.lit(kind).alias("feature_type"))
    m = citygml.meshes(t).where("failure is null")
    return m.withColumns({"x": F.array_max(F.transform("vertices", lambda p: p["x"])), "z": F.array_max(F.transform("vertices", lambda p: p["z"])), "points": F.size("vertices"), "triangles": F.size("faces")})


_SUP = "'f' || s_suppkey AS path"


@query(sql=f"""SELECT {_SUP}, 'b' || s_suppkey AS feature_id, (CASE s_nationkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 2 END)::VARCHAR AS lod, CASE WHEN s_nationkey % 2 = 0 THEN s_nationkey::VARCHAR END AS height,
    CASE s_nationkey % 3 WHEN 0 THEN 12 WHEN 1 THEN 4 ELSE 8 END AS points, CASE s_nationkey % 3 WHEN 0 THEN 10 WHEN 1 THEN 2 ELSE 8 END AS triangles, (CASE s_nationkey % 3 WHEN 1 THEN 4 ELSE 6 END)::DOUBLE AS x FROM supplier""")
def building_parse(spark, d):
    ring = lambda x, z, side="4": _RING.format(p=_square(x, "2", side, z), hole="")
    holed = _RING.format(p=_square("0", "0", "6", "9"), hole="<gml:interior><gml:LinearRing><gml:posList>2 2 9 2 3 9 3 3 9 3 2 9 2 2 9</gml:posList></gml:LinearRing></gml:interior>")
    lod1 = f"'<bldg:lod1Solid>', {ring('0', '8')}, '</bldg:lod1Solid>'"
    two = f"'<bldg:boundedBy><bldg:RoofSurface><bldg:lod2MultiSurface>', {holed}, '</bldg:lod2MultiSurface></bldg:RoofSurface></bldg:boundedBy>'"
    more = f"'<bldg:boundedBy><bldg:WallSurface><bldg:lod2MultiSurface>', {ring('1', '5', '3')}, '</bldg:lod2MultiSurface></bldg:WallSurface></bldg:boundedBy>'"
    body = (f"concat('<bldg:Building gml:id=\"b', s_suppkey, '\">', if(s_nationkey % 2 = 0, concat('<bldg:measuredHeight>', s_nationkey, '</bldg:measuredHeight>'), ''), {lod1}, "
            f"if(s_nationkey % 3 <> 1, concat({two}), ''), if(s_nationkey % 3 = 0, concat({more}), ''), '</bldg:Building>')")
    m = _parsed(spark, d, "building", body)
    return m.select("path", "feature_id", F.expr("attrs['lod']").alias("lod"), F.expr("attrs['height']").alias("height"), "points", "triangles", "x")


@query(sql=f"""SELECT {_SUP}, 'r' || s_suppkey AS feature_id, CASE s_nationkey % 3 WHEN 0 THEN 8 ELSE 4 END AS points, CASE s_nationkey % 3 WHEN 0 THEN 4 ELSE 2 END AS triangles, (CASE s_nationkey % 3 WHEN 0 THEN 24 WHEN 1 THEN 14 ELSE 9 END)::DOUBLE AS x FROM supplier""")
def bridge_parse(spark, d):
    ring = lambda x: _RING.format(p=_square(x, "0", "4", "3"), hole="")
    part = lambda x: f"'<brid:outerBridgeConstruction><brid:BridgeConstructionElement><brid:lod2Solid>', {ring(x)}, '</brid:lod2Solid></brid:BridgeConstructionElement></brid:outerBridgeConstruction>'"
    body = (f"concat('<brid:Bridge gml:id=\"r', s_suppkey, '\">', case s_nationkey % 3 when 0 then concat({part('0')}, {part('20')}) when 1 then concat('<brid:lod2Solid>', {ring('10')}, '</brid:lod2Solid>', {part('30')}) "
            f"else concat('<brid:boundedBy><brid:OuterCeilingSurface>', {ring('5')}, '</brid:OuterCeilingSurface></brid:boundedBy>') end, '</brid:Bridge>')")
    return _parsed(spark, d, "bridge", body).select("path", "feature_id", "points", "triangles", "x")


@query(sql=f"""SELECT {_SUP}, 'v' || s_suppkey || '_' || k AS feature_id, (s_nationkey + 1)::VARCHAR AS height, CASE WHEN k = 0 THEN 'oak' END AS kind, 4 AS points, 2 AS triangles,
    (CASE WHEN k = 0 THEN 100 + s_suppkey ELSE 2 * 4 + 50 + s_suppkey END)::DOUBLE AS x, (CASE WHEN k = 0 THEN 7 ELSE 1 + 7 END)::DOUBLE AS z FROM supplier, range(0, 2) AS t(k)""")
def vegetation_parse(spark, d):
    own = _RING.format(p=_square("0", "0", "4", "1"), hole="")
    shape = f"'<gml:MultiSurface gml:id=\"proto\">', {own}, '</gml:MultiSurface>'"
    at = lambda x: f"'<core:referencePoint><gml:Point><gml:pos>', {x} + s_suppkey, ' 0 6</gml:pos></gml:Point></core:referencePoint>'"
    # The first plant has the shape itself (and a matrix that isn't one); the second one refers to it and doubles x.
    one = (f"concat('<veg:SolitaryVegetationObject gml:id=\"v', s_suppkey, '_0\"><veg:height>', s_nationkey + 1, '</veg:height><veg:species>oak</veg:species><veg:lod2ImplicitRepresentation><core:ImplicitGeometry>"
           f"<core:transformationMatrix>1 2 3</core:transformationMatrix>', {at('96')}, '<core:relativeGMLGeometry>', {shape}, '</core:relativeGMLGeometry></core:ImplicitGeometry></veg:lod2ImplicitRepresentation></veg:SolitaryVegetationObject>')")
    two = (f"concat('<veg:SolitaryVegetationObject gml:id=\"v', s_suppkey, '_1\"><gen:doubleAttribute name=\"height\"><gen:value>', s_nationkey + 1, '</gen:value></gen:doubleAttribute><veg:lod1ImplicitRepresentation><core:ImplicitGeometry>"
           f"<core:transformationMatrix>2 0 0 0 0 1 0 0 0 0 1 1 0 0 0 1</core:transformationMatrix>', {at('50')}, '<core:relativeGMLGeometry xlink:href=\"#proto\"/></core:ImplicitGeometry></veg:lod1ImplicitRepresentation></veg:SolitaryVegetationObject>')")
    m = _parsed(spark, d, "vegetation", f"concat({one}, {two})")
    return m.select("path", "feature_id", F.expr("attrs['height']").alias("height"), F.expr("attrs['type']").alias("kind"), "points", "triangles", "x", "z")


@query(sql="SELECT event_id, round(10.9::DOUBLE + (event_id * 7 % 1201) * 0.001::DOUBLE, 8) AS lon, round(47.9::DOUBLE + (event_id * 13 % 1201) * 0.001::DOUBLE, 8) AS lat, 1 AS near FROM events")
def reproject_utm(spark, d):
    from gridloom.functions import frames

    e = table(spark, d, "events").select("event_id", F.expr("10.9D + (event_id * 7 % 1201) * 0.001D").alias("lon"), F.expr("47.9D + (event_id * 13 % 1201) * 0.001D").alias("lat"), F.expr("if(event_id % 2 = 0, 'EPSG:25832', 'EPSG:25833')").alias("epsg"))
    there = e.withColumn("p", frames.to_projected(F.col("lon"), F.col("lat"), F.col("epsg")))
    back = there.withColumn("q", frames.to_geographic(F.col("p.x"), F.col("p.y"), F.col("epsg")))
    # A degree of latitude is 111.2 km, which bounds the northing from both sides.
    return back.select("event_id", F.round("q.lon", 8).alias("lon"), F.round("q.lat", 8).alias("lat"), F.expr("cast(abs(p.y - lat * 111200) < 30000 as int)").alias("near"))


@query(sql="SELECT event_id, round(139.7::DOUBLE + (event_id * 7 % 1201) * 0.0001::DOUBLE, 8) AS lon, round(35.6::DOUBLE + (event_id * 13 % 1201) * 0.0001::DOUBLE, 8) AS lat FROM events")
def project_local(spark, d):
    from gridloom.functions.frames import LocalMetres

    local = LocalMetres(139.77, 35.65, 0.3)
    e = table(spark, d, "events").select("event_id", F.expr("139.7D + (event_id * 7 % 1201) * 0.0001D").alias("lon"), F.expr("35.6D + (event_id * 13 % 1201) * 0.0001D").alias("lat"))
    x, y = local.project(F.col("lon"), F.col("lat"))
    e = e.withColumns({"x": x, "y": y})
    lon, lat = local.unproject(F.col("x"), F.col("y"))
    return e.select("event_id", F.round(lon, 8).alias("lon"), F.round(lat, 8).alias("lat"))


# Caches


@query(sql="SELECT o_orderkey AS file FROM orders WHERE NOT (o_orderkey % 3 = 0 AND o_orderkey % 2 = 0)")
def cache_manifest_miss(spark, d):
    from gridloom.sources.cache import misses

    o = table(spark, d, "orders")
    files = o.select(F.col("o_orderkey").alias("file"), F.col("o_custkey").alias("size"), F.col("o_orderkey").alias("mtime"), F.lit("building").alias("feature_type"), F.lit(2).alias("lod"), F.lit(None).cast("string").alias("epsg"))
    known = files.where("file % 3 = 0").withColumn("mtime", F.expr("if(file % 2 = 0, mtime, mtime + 1)"))
    return misses(files, known).select("file")
