"""City-model files as a stream: each new file is parsed once, with a checkpoint, and appended as meshes."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridloom.functions import codes
from gridloom.sources import citygml


def parse_new_files(spark: SparkSession, path: str, out: str, checkpoint: str, lod: int | None = None, files_per_batch: int = 1000) -> StreamingQuery:
    """Parse what is there and not yet parsed, then stop; meshes go to `out` as Parquet."""
    t = (
        spark.readStream.schema("value string").option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.gml").option("maxFilesPerTrigger", files_per_batch).text(path, wholetext=True)
    )
    files = t.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    files = files.withColumn("feature_type", F.coalesce(codes.probe_type(F.col("text")), F.lit("building")))
    return citygml.meshes(files, lod).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
