"""python -m gridloom CITYGML OUT --lon X --lat Y: build a city model."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from gridloom.plans.city import CityConfig, export_obj, generate


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="gridloom")
    p.add_argument("citygml")
    p.add_argument("out")
    p.add_argument("--lon", type=float, required=True)
    p.add_argument("--lat", type=float, required=True)
    p.add_argument("--size", type=float, default=500.0)
    p.add_argument("--buffer", type=float, default=0.0)
    p.add_argument("--voxel-size", type=float, default=2.0)
    p.add_argument("--lod", type=int)
    p.add_argument("--mode", default="inclusive")
    p.add_argument("--dem-source")
    p.add_argument("--cache")
    p.add_argument("--no-bridges", action="store_true")
    p.add_argument("--obj")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("gridloom").getOrCreate()
    cfg = CityConfig(a.citygml, a.lon, a.lat, a.size, buffer_meters=a.buffer, voxel_size=a.voxel_size, building_lod=a.lod,
                     voxel_mode=a.mode, dem_source=a.dem_source, cache_root=a.cache, include_bridges=not a.no_bridges)
    tables = generate(spark, cfg, a.out)
    if a.obj:
        export_obj(tables, a.obj)


if __name__ == "__main__":
    main()
