"""Result tables as CSV, with a header, and back by a schema."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from gridloom.sources.scratch import shared


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """df as a CSV folder of parts; empty texts are quoted, nulls aren't, so both come back."""
    df.write.mode(mode).options(header=True, escape='"', emptyValue='""', nullValue="").csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).options(header=True, escape='"', multiLine=True, emptyValue="", nullValue=None).csv(path)


def round_trip(df: DataFrame) -> DataFrame:
    """df written as CSV in the shared folder and read back."""
    path = f"{shared(df.sparkSession)}/gridloom_csv_{uuid.uuid4().hex}"
    write_csv(df, path)
    return read_csv(df.sparkSession, path, df.schema)
