"""Cutting a plan: what many later steps read is computed once and kept in the shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; on one machine, unset, a temporary one is set."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    at = at or tempfile.mkdtemp(prefix="gridloom_checkpoints_")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df by reliable checkpoint in the shared folder."""
    shared(df.sparkSession)
    return df.checkpoint()
