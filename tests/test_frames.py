import math

import pytest
from pyspark.sql import functions as F

from gridloom.functions import frames as f


def test_geodesic_round_trip():
    for az in (0, 37, 90, 180, 271):
        p = f.geodesic_forward((139.77, 35.65), az, 750.0)
        assert abs(f.geodesic_inverse((139.77, 35.65), p) - 750.0) < 1e-6


def test_meridian_and_equator_have_known_lengths():
    assert abs(f.geodesic_inverse((0, 0), (1, 0)) - 111319.490793) < 1e-3
    assert abs(f.geodesic_inverse((0, 0), (0, 1)) - 110574.388558) < 1e-3


def test_rectangle_and_buffer():
    r = f.create_rectangle(139.77, 35.65, 500)
    assert abs(f.geodesic_inverse(r[0], r[1]) - 500) < 0.01
    b = f.buffered(r, 50)
    assert abs(f.geodesic_inverse(b[0], b[1]) - 600) < 0.1
    with pytest.raises(ValueError):
        f.buffered(r, -1)


def test_grid_counts_round_half_up_and_degenerate_is_refused():
    g = f.GridFrame.of(f.create_rectangle(139.77, 35.65, 500), 2.0)
    assert (g.n_rows, g.n_cols) == (250, 250)
    assert [f.half_up(x) for x in (0.5, 1.5, 2.4999)] == [1, 2, 2]
    with pytest.raises(ValueError):
        f.GridFrame.of([(0, 0), (0, 0), (1, 1), (1, 0)], 1.0)


@pytest.mark.parametrize("turn", [0.0, 0.5, 2.0])
def test_cell_centres_come_back(spark, turn):
    c, s = math.cos(turn), math.sin(turn)
    g = f.GridFrame(12, 9, 10.0, 50.0, 0.01 * c, 0.01 * s, 0.01 * s, -0.01 * c)
    cells = g.centres(spark)
    r, k = g.cell(F.col("lon"), F.col("lat"))
    assert cells.where((r != F.col("r")) | (k != F.col("c"))).count() == 0


def test_points_outside_fold_onto_the_edge(spark):
    g = f.GridFrame(4, 5, 0.0, 0.0, 1.0, 0.0, 0.0, -1.0)
    r, c = g.cell(F.col("x"), F.col("y"))
    got = spark.createDataFrame([(-9.0, 9.0), (99.0, -99.0)], "x double, y double").select(r, c).collect()
    assert [tuple(x) for x in got] == [(0, 0), (3, 4)]


def test_metres_round_trip_and_scale(spark):
    m = f.LocalMetres(139.77, 35.65, 0.3)
    p = spark.createDataFrame([(139.77 + i / 100, 35.65 - j / 100) for i in range(-3, 4) for j in range(-3, 4)], "lon double, lat double")
    x, y = m.project(F.col("lon"), F.col("lat"))
    q = p.select("lon", "lat", x.alias("x"), y.alias("y"))
    lon, lat = m.unproject(F.col("x"), F.col("y"))
    worst = q.select(F.max(F.abs(lon - F.col("lon"))), F.max(F.abs(lat - F.col("lat")))).first()
    assert max(worst) < 1e-11
    a = f.geodesic_forward((139.77, 35.65), 0, 1000.0)
    d = spark.createDataFrame([a], "lon double, lat double").select(*f.LocalMetres(139.77, 35.65).project(F.col("lon"), F.col("lat"))).first()
    assert abs(math.hypot(*d) - 1000 * f.SCALE) < 1e-3


def test_voxel_index_floors(spark):
    v = f.VoxelFrame(4, 4, 4, 0.0, 8.0, 0.0, 2.0)
    d = spark.createDataFrame([(-0.5, 8.5, 1.0)], "x double, y double, z double")
    assert tuple(d.select(*v.index(F.col("x"), F.col("y"), F.col("z"))).first()) == (-1, -1, 0)
    assert tuple(d.select(*v.truncated_index(F.col("x"), F.col("y"), F.col("z"))).first()) == (0, 0, 0)
    assert v.contact_half > 1.0 > v.penetration_half


def test_projected_points(spark):
    """Northing on a central meridian is the scaled meridian arc, here by numeric integration; both ways agree."""
    import math

    from gridloom.functions import frames

    f = 1 / 298.257222101
    e2 = f * (2 - f)
    n = 200_000
    step = math.radians(48.0) / n
    arc = sum(6378137.0 * (1 - e2) / (1 - e2 * math.sin((i + 0.5) * step) ** 2) ** 1.5 * step for i in range(n))
    df = spark.createDataFrame([(9.0, 48.0), (11.5, 48.2)], "lon double, lat double")
    p = df.withColumn("p", frames.to_projected(F.col("lon"), F.col("lat"), F.lit("EPSG:25832"), ["EPSG:25832"]))
    rows = p.withColumn("q", frames.to_geographic(F.col("p.x"), F.col("p.y"), F.lit("EPSG:25832"), ["EPSG:25832"])).collect()
    assert abs(rows[0].p.x - 500_000) < 1e-6 and abs(rows[0].p.y - 0.9996 * arc) < 1e-3
    assert all(abs(r.q.lon - r.lon) < 1e-9 and abs(r.q.lat - r.lat) < 1e-9 for r in rows)
    assert rows[1].p.x > 500_000 + 180_000
