import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import geometry
from gridloom.functions.frames import GridFrame, VoxelFrame
from gridloom.operators import raster, topology, voxel
from gridloom.plans import city
from gridloom.sources import cache, citygml, model

FRAME = VoxelFrame(12, 12, 10, -6.0, 18.0, -6.0, 2.0)


def box(spark, x, y, z, ex, ey, ez, seq=1):
    b = spark.createDataFrame([(seq, x, x + ex, y, y + ey, z, z + ez)], "seq long, xa double, xb double, ya double, yb double, za double, zb double")
    return topology.box_triangles(b)


def cells(df):
    return {(r.r, r.c, r.z) for r in df.collect()}


def overlapped(b, eps=2e-6):
    """Cells with a part of a box on every axis."""
    x, y, z, ex, ey, ez = b
    out = set()
    for r in range(FRAME.n_rows):
        for c in range(FRAME.n_cols):
            for k in range(FRAME.n_z):
                lo = (FRAME.min_x + c * 2, FRAME.max_y - r * 2 - 2, FRAME.min_z + k * 2)
                if all(min(l + 2, o + e) - max(l, o) > eps for l, o, e in zip(lo, (x, y, z), (ex, ey, ez))):
                    out.add((r, c, k))
    return out


CASES = [(0.0, 0.0, 0.0, 12.0, 12.0, 10.0), (0.05, 0.05, 0.05, 12.0, 12.0, 10.0), (0.7, 0.7, 0.7, 12.0, 12.0, 10.0), (3.9, 0.3, 0.3, 0.5, 11.4, 9.4), (0.3, 0.3, 3.0, 11.0, 11.0, 0.3)]


@pytest.mark.parametrize("b", CASES)
def test_solid_is_every_overlapped_cell(spark, b):
    got = voxel.building_solid(box(spark, *b), FRAME, 0.0, 3, "connected")
    assert cells(got) == overlapped(b)


def test_aligned_box_has_its_own_cells_only(spark):
    b = box(spark, *CASES[0])
    assert voxel.winding_fill(b, FRAME).count() == 180
    assert cells(voxel.surface_cells(b, FRAME, True)) > cells(voxel.surface_cells(b, FRAME, False))


def test_shell_without_seed_is_kept_whole(spark):
    s = spark.createDataFrame([(1, 0, 0, 0), (1, 5, 5, 5)], "seq long, r int, c int, z int")
    assert voxel.anchor_shell(s, s.limit(0), "adjacent").count() == 2
    e = spark.createDataFrame([(1, 0, 0, 1)], "seq long, r int, c int, z int")
    assert cells(voxel.anchor_shell(s, e, "connected")) == {(0, 0, 0)}


def test_hollow_cube_is_filled(spark):
    shell = [(1, i, j, k) for i in range(2, 8) for j in range(2, 8) for k in range(2, 8) if {i, j, k} & {2, 7}]
    assert voxel.fill_holes(spark.createDataFrame(shell, "seq long, r int, c int, z int")).count() == 6**3


def test_flat_roof_has_no_slope_and_pitched_has(spark):
    make = lambda h: spark.createDataFrame([(r, c, z, -3) for r in range(6) for c in range(6) for z in range(h(r))], "r int, c int, z int, code int")
    assert voxel.roof_slope(make(lambda r: 4)).first()["share"] == 0
    assert voxel.roof_slope(make(lambda r: 2 + r)).first()["share"] == 0.5


def test_reapply_is_idempotent(spark):
    frame = VoxelFrame(4, 4, 12, 0.0, 8.0, 0.0, 2.0)
    v = spark.createDataFrame([(r, c, 0, -1) for r in range(4) for c in range(4)] + [(3, 3, 5, -2)], "r int, c int, z int, code int")
    own = v.where("z = 5")
    dem = spark.createDataFrame([(r, c, 0.0) for r in range(4) for c in range(4)], "r int, c int, dem double")
    canopy = spark.createDataFrame([(0, 0, 12.0, 4.0), (3, 3, 12.0, 4.0)], "r int, c int, top double, bottom double")
    once = voxel.reapply_canopy(v, own, canopy, dem, frame)
    assert cells(once) == cells(voxel.reapply_canopy(once, own, canopy, dem, frame))
    assert {x for x in cells(once) if x[:2] == (0, 0)} == {(0, 0, 0), *((0, 0, z) for z in range(2, 6))}
    assert {x for x in cells(once) if x[:2] == (3, 3)} == {(3, 3, 0), (3, 3, 5)}


def test_nothing_claimed_leaves_ids_alone(spark):
    w = spark.createDataFrame([(0, 0)], "r int, c int")
    assert raster.fill_ids(w, w.limit(0).withColumn("id", F.lit(1)), 4, 4).count() == 0


def test_ears_cover_a_polygon_with_a_hole():
    outer = np.array([[0, 0, 0], [4, 0, 0], [4, 4, 0], [0, 4, 0]], float)
    hole = np.array([[1, 1, 0], [1, 2, 0], [2, 2, 0], [2, 1, 0]], float)
    tri = geometry.triangulate(outer, [hole])
    p = np.vstack([outer, hole])
    area = sum(abs(np.cross(p[b] - p[a], p[c] - p[a])[2]) / 2 for a, b, c in tri)
    assert abs(area - 15) < 1e-9
    ell = np.array([[0, 0, 0], [4, 0, 0], [4, 1, 0], [1, 1, 0], [1, 4, 0], [0, 4, 0]], float)
    assert len(geometry.triangulate(ell)) == 4
    assert len(geometry.clip_box(outer, (1, 1), (9, 2))) == 4


def test_extruded_surface_is_a_volume(spark):
    v = spark.createDataFrame([(1, i, float(i % 3), float(i // 3), 5.0) for i in range(9)], "mesh long, v long, x double, y double, z double")
    quads = [(r * 3 + c, r * 3 + c + 1, r * 3 + c + 4, r * 3 + c + 3) for r in range(2) for c in range(2)]
    faces = spark.createDataFrame([(1, n, *t) for n, t in enumerate(t for a, b, c, d in quads for t in ((a, b, c), (a, c, d)))], "mesh long, face long, a long, b long, c long")
    assert topology.is_volume(faces).first()["volume"] is False
    solid = topology.extrude(v, faces, 100, 0.0)[1]
    assert topology.is_volume(solid).first()["volume"] is True


def test_pinched_fans_get_vertices_of_their_own(spark):
    f = spark.createDataFrame([(1, 0, 0, 1, 2), (1, 1, 0, 3, 4)], "mesh long, face long, a long, b long, c long")
    got = {r.face: r.a for r in topology.split_pinches(f, 1000).collect()}
    assert got == {0: 0, 1: 1000}


LOT = """<core:CityModel xmlns:core="c" xmlns:bldg="b" xmlns:gml="g"><core:cityObjectMember><bldg:Building gml:id="{id}"><bldg:measuredHeight>9</bldg:measuredHeight>
<bldg:lod1Solid><gml:Solid>{faces}</gml:Solid></bldg:lod1Solid></bldg:Building></core:cityObjectMember></core:CityModel>"""


def lot(lon, lat, size, height, name="b1"):
    c = [(lat, lon), (lat, lon + size), (lat + size, lon + size), (lat + size, lon)]
    ring = lambda pts: "<gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>" + " ".join(f"{a} {o} {z}" for a, o, z in [*pts, pts[0]]) + "</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon>"
    sides = [[(*c[i], 0), (*c[(i + 1) % 4], 0), (*c[(i + 1) % 4], height), (*c[i], height)] for i in range(4)]
    return LOT.format(id=name, faces="".join(ring(f) for f in [[(*p, 0) for p in c[::-1]], [(*p, height) for p in c], *sides]))


@pytest.fixture
def dataset(tmp_path):
    d = tmp_path / "set" / "udx" / "bldg"
    d.mkdir(parents=True)
    (d / "53393671_bldg.gml").write_text(lot(139.7699, 35.6499, 0.0002, 8.0))
    (d / "53393681_bldg.gml").write_text("<broken")
    return tmp_path / "set"


def test_files_parse_and_a_broken_one_is_reported(spark, dataset):
    assert citygml.discover(spark, str(dataset.parent)) == citygml.discover(spark, str(dataset))
    m = citygml.meshes(citygml.read_files(spark, str(dataset)))
    rows = m.collect()
    good = [r for r in rows if r.failure is None]
    assert len(rows) == 2 and len(good) == 1
    assert good[0].feature_id == "b1" and good[0].attrs["height"] == "9" and len(good[0].faces) == 12


def test_second_parse_comes_from_the_cache(spark, dataset, tmp_path):
    root = str(tmp_path / "cache")
    first = sorted(map(str, cache.refresh(spark, str(dataset), root).collect()))
    assert first == sorted(map(str, cache.refresh(spark, str(dataset), root).collect()))
    files = spark.read.parquet(f"{root}/v1/manifest")
    assert files.count() == 2


def test_city_from_files_to_obj(spark, dataset, tmp_path):
    cfg = city.CityConfig(str(dataset), 139.77, 35.65, 60.0, voxel_size=4.0)
    t = city.generate(spark, cfg, str(tmp_path / "model"))
    codes = {r.code: r.n for r in voxel.code_counts(t["voxels"]).collect()}
    assert codes[-3] > 20 and t["building"].where("id = 1").count() >= 20
    city.export_obj(t, str(tmp_path / "city"))
    lines = [x.value for x in spark.read.text(str(tmp_path / "city.obj")).collect()]
    v = [x for x in lines if x.startswith("v ")]
    used = {int(i) for x in lines if x.startswith("f ") for i in x.split()[1:]}
    assert used == set(range(1, len(v) + 1)) and len(set(v)) == len(v)
    again = city.reapply(spark, str(tmp_path / "model"), t["canopy"], str(tmp_path / "model2"))
    assert cells(again["voxels"]) == cells(t["voxels"])


LUSE = """<CityModel><gml:lowerCorner>35.6 139.7 0</gml:lowerCorner><gml:upperCorner>35.7 139.8 0</gml:upperCorner>
<luse:LandUse><luse:class>203</luse:class><gml:posList>35.6 139.7 0 35.6 139.77 0 35.7 139.77 0 35.7 139.7 0 35.6 139.7 0</gml:posList></luse:LandUse></CityModel>"""


def test_land_use_and_another_ground(spark, dataset):
    (dataset / "udx" / "luse").mkdir()
    (dataset / "udx" / "luse" / "533936_luse.gml").write_text(LUSE)
    t = city.run_core(spark, city.CityConfig(str(dataset), 139.77, 35.65, 60.0, voxel_size=4.0, dem_source="Flat"))
    got = {r.code: r["count"] for r in t["cover"].groupBy("code").count().collect()}
    assert set(got) == {5, 14} and abs(got[5] - got[14]) <= 15
    assert t["canopy"].count() == got[5]


def test_triangles_are_cut_for_export(spark):
    tri = topology.box_triangles(spark.createDataFrame([(1, 0, 4, 0, 4, 0, 2)], "seq long, xa int, xb int, ya int, yb int, za int, zb int")).withColumn("code", F.lit(-3))
    got = model.triangle_polygons(tri, (0.0, 0.0), (2.0, 9.0)).agg(F.max("x"), F.countDistinct("quad")).first()
    assert got[0] == 2.0 and got[1] >= 8


def test_terrain_becomes_a_solid(spark):
    v = spark.createDataFrame([(1, 0, 0.0, 0.0, 5.0), (1, 1, 1.0, 0.0, 5.0), (1, 2, 1.0, 1.0, 6.0), (1, 3, 0.0, 1.0, 5.0), (1, 4, 1.0, 1.0, 6.0)], "mesh long, v long, x double, y double, z double")
    f = spark.createDataFrame([(1, 0, 0, 1, 2), (1, 1, 0, 4, 3), (1, 2, 1, 2, 0), (1, 3, 2, 4, 0)], "mesh long, face long, a long, b long, c long")
    vs, fs = topology.terrain_solid(v, f, 100, 0.0)
    assert topology.is_volume(fs).first()["volume"] is True
    tri = topology.face_points(fs, vs)
    assert topology.repair_accepted(tri, tri).first()["accepted"] is True


DEM = """<core:CityModel xmlns:core="c" xmlns:dem="d" xmlns:gml="g"><core:cityObjectMember><dem:TINRelief gml:id="t">{tri}</dem:TINRelief></core:cityObjectMember></core:CityModel>"""


def test_projected_dataset_builds_the_same_city(spark, tmp_path):
    """One lot and its ground in latitude and longitude, and the same in UTM metres under an EPSG code."""
    from gridloom.functions import frames

    lon, lat, size = 11.5699, 48.1299, 0.0002
    far = 0.0008
    ground = [[(lat - far, lon - far, 3.0), (lat - far, lon + far, 3.0), (lat + far, lon + far, 3.0)], [(lat - far, lon - far, 3.0), (lat + far, lon + far, 3.0), (lat + far, lon - far, 3.0)]]
    ring = lambda pts: "<gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>" + " ".join(f"{a!r} {o!r} {z}" for a, o, z in [*pts, pts[0]]) + "</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon>"
    c = [(lat, lon), (lat, lon + size), (lat + size, lon + size), (lat + size, lon)]
    faces = [[(*p, 3.0) for p in c[::-1]], [(*p, 13.0) for p in c], *[[(*c[i], 3.0), (*c[(i + 1) % 4], 3.0), (*c[(i + 1) % 4], 13.0), (*c[i], 13.0)] for i in range(4)]]
    points = sorted({p for f in [*faces, *ground] for p in f})
    df = spark.createDataFrame([(i, p[1], p[0]) for i, p in enumerate(points)], "i int, lon double, lat double")
    flat = {points[r.i]: (r.p.x, r.p.y, points[r.i][2]) for r in df.select("i", frames.to_projected(F.col("lon"), F.col("lat"), F.lit("EPSG:25832"), ["EPSG:25832"]).alias("p")).collect()}
    out = {}
    for name, move, head in (("geo", lambda p: p, ""), ("utm", flat.__getitem__, '<gml:Envelope srsName="EPSG:25832"></gml:Envelope>')):
        for folder, text in (("bldg", LOT.format(id="b", faces="".join(ring([move(p) for p in f]) for f in faces))), ("dem", DEM.format(tri="".join(ring([move(p) for p in f]) for f in ground)))):
            d = tmp_path / name / "udx" / folder
            d.mkdir(parents=True)
            (d / f"a_{folder}.gml").write_text(text.replace("<core:cityObjectMember>", head + "<core:cityObjectMember>", 1))
        t = city.run_core(spark, city.CityConfig(str(tmp_path / name), lon + size / 2, lat + size / 2, 60.0, voxel_size=4.0, land_cover_source="CityGML"))
        out[name] = {(r.r, r.c, r.z, r.code) for r in t["voxels"].collect()}
    assert len({x for x in out["geo"] if x[3] == -3}) > 10 and any(x[3] == 14 for x in out["geo"])  # the ground's only level is under land cover
    assert out["geo"] == out["utm"]
    city.export_obj(t, str(tmp_path / "meshes"), "meshes")
    lines = [x.value for x in spark.read.text(str(tmp_path / "meshes.obj")).collect()]
    assert sum(x.startswith("f ") for x in lines) >= 14 and {x for x in lines if x.startswith("usemtl")} == {"usemtl ground", "usemtl building"}


def test_unknown_projection_is_an_error(spark, dataset):
    (dataset / "udx" / "bldg" / "x_bldg.gml").write_text('<core:CityModel xmlns:core="c" srsName="EPSG:31467"/>')
    with pytest.raises(ValueError, match="31467"):
        city.run_core(spark, city.CityConfig(str(dataset), 139.77, 35.65, 60.0))


def test_rectangles_are_maximal(spark):
    v = spark.createDataFrame([(r, c, 0, -3) for r in range(4) for c in range(6)] + [(9, 9, 0, -3)], "r int, c int, z int, code int")
    m = voxel.maximal_rectangles(voxel.exposed_faces(v)).where("face = 'up'")
    assert sorted((x.u, x.v, x.height, x.width) for x in m.collect()) == [(0, 0, 4, 6), (9, 9, 1, 1)]


def test_no_building_is_an_error(spark, dataset):
    with pytest.raises(ValueError):
        city.run_core(spark, city.CityConfig(str(dataset), 0.0, 0.0, 60.0))


def test_config_checks():
    with pytest.raises(ValueError):
        city.CityConfig(voxel_mode="odd")
    with pytest.raises(ValueError):
        city.CityConfig(buffer_meters=-1)
    assert city.CityConfig(voxel_mode="tight", building_shell_threshold=0.2).resolved() == city.Resolved(0.2, 0.0, "adjacent")


def test_new_files_stream_once(spark, dataset, tmp_path):
    from gridloom.streaming.incremental import parse_new_files

    out, at = str(tmp_path / "meshes"), str(tmp_path / "at")
    for _ in range(2):
        parse_new_files(spark, str(dataset), out, at).awaitTermination()
    assert spark.read.parquet(out).where("failure is null").count() == 1


def test_named_sources(spark):
    model.register_source("flat", lambda s: s.createDataFrame([(0, 0, 1.0)], "r int, c int, dem double"))
    assert model.named_source(spark, "flat", 5).first()["r"] == 4
    with pytest.raises(KeyError):
        model.named_source(spark, "none")
    assert GridFrame.of([(0, 0), (0, 1), (1, 1), (1, 0)], 50_000).n_rows == 2
