"""Parsed meshes kept as Parquet with a manifest: only files that are new or changed are parsed again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1
KEYS = ["file", "size", "mtime", "feature_type", "lod", "epsg"]


def misses(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """The files with no manifest row of equal file, size, time, type, level of detail and system (nulls are equal)."""
    m = manifest.select(*[F.col(k).alias(f"m_{k}") for k in KEYS])
    same = [F.col(k).eqNullSafe(F.col(f"m_{k}")) for k in KEYS]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return files.join(m, on, "left_anti")


def listing(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, size, mtime) of .gml files, without reading them."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.gml").load(paths)
    return b.select(F.col("_metadata.file_path").alias("file"), F.col("length").alias("size"), F.unix_micros("modificationTime").alias("mtime"))


def refresh(spark: SparkSession, paths: str | list[str], root: str, lod: int | None = None) -> DataFrame:
    """All meshes of the files at paths, parsing those the cache at `root` lacks.

    An empty parse is a hit the next time. Data is written before the manifest, so a job that dies leaves
    files to be parsed again and nothing half known.
    """
    from gridloom.sources import citygml

    files = citygml.read_files(spark, paths)
    now = listing(spark, paths).join(files.select(F.col("path").alias("file"), "feature_type", "epsg"), "file").withColumn("lod", F.lit(-1 if lod is None else lod))
    manifest_at, data_at = f"{root}/v{VERSION}/manifest", f"{root}/v{VERSION}/meshes"
    try:
        manifest = spark.read.parquet(manifest_at)
    except Exception as e:  # the first run has none
        if "PATH_NOT_FOUND" not in str(e):
            raise
        manifest = now.limit(0)
    todo = misses(now, manifest).cache()
    if not todo.isEmpty():
        stamp = F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in KEYS])
        fresh = citygml.meshes(files.join(todo.select(F.col("file").alias("path")), "path", "left_semi"), lod)
        fresh = fresh.join(todo.select(F.col("file").alias("path"), stamp.alias("stamp")), "path")
        fresh.write.mode("append").parquet(data_at)
        todo.select(*KEYS).write.mode("append").parquet(manifest_at)
    stamp = F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in KEYS])
    valid = now.select(F.col("file").alias("path"), stamp.alias("stamp"))
    out = spark.read.parquet(data_at).join(valid, ["path", "stamp"], "left_semi").drop("stamp")
    todo.unpersist()
    return out
