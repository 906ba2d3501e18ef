"""Scenes hold every row of their tables: brute force over the smallest tables, with no SQL."""

import os

import pyarrow.parquet as pq
import pytest

from gridloom import queries as Q
from gridloom.plans import scenes

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def every_box():
    for o in pq.read_table(f"{DATA}/orders.parquet", columns=["o_orderkey", "o_custkey"]).to_pylist():
        k, u = o["o_orderkey"], o["o_custkey"]
        yield k, u * 7 % 56, k * 11 % 56, 1 + k % 8, 1 + u % 8, 4.0 + k * 13 % 60


def test_every_order_is_a_box_and_a_solid(spark):
    want = sorted(every_box())
    assert sorted(map(tuple, scenes.boxes(spark, DATA).select("seq", "r0", "c0", "h", "w", "zmax").collect())) == want
    solids = {r.seq: r["count"] for r in scenes.solids(spark, DATA).groupBy("seq").count().collect()}
    # A plain box has 12 triangles and one with a corner cut out 28; every third has a plate above it.
    assert solids == {b[0]: (28 if b[0] % 2 else 12) + (12 if b[0] % 3 == 0 else 0) for b in want}


def test_tallest_of_every_building(spark):
    best = {}
    for seq, r0, c0, h, w, zmax in every_box():
        for r in range(r0, r0 + h):
            for c in range(c0, c0 + w):
                up = zmax - (r * 3 + c * 5) % 16 * 0.5
                if up > 0:
                    best[r, c] = min(best.get((r, c), (0.0, 0)), (-up, seq))
    got = Q.QUERIES["building_height_argmax"](spark, DATA).select("r", "c", "h", "id").collect()
    assert {(r.r, r.c): (-r.h, r.id) for r in got} == best and len(got) == len(best)


def test_every_line_is_parsed(spark):
    lines = pq.read_table(f"{DATA}/lineitem.parquet", columns=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]).to_pylist()
    points, triangles = [], []
    for t in lines:
        key, n, x = (t["l_orderkey"], t["l_linenumber"]), t["l_linenumber"], t["l_partkey"] % 100
        points += [(*key, i, float(x + i), t["l_suppkey"] % 50 * 0.5, i * 2.0) for i in range(1, n + 1)]
        triangles += [(*key, k, x + 1.0 + k, x + 3.0 + k, 6.0) for k in range(2) if n >= 3]
    assert sorted(map(tuple, Q.QUERIES["poslist_parse"](spark, DATA).select("l_orderkey", "l_linenumber", "i", "x", "y", "z").collect())) == sorted(points)
    assert sorted(map(tuple, Q.QUERIES["tin_triangles"](spark, DATA).select("l_orderkey", "l_linenumber", "face", "x0", "x2", "z2").collect())) == sorted(triangles)
