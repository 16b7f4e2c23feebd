"""Media files as they arrive: the batch source's rows from a Structured Streaming file source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.sources import media

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def read_stream(spark: SparkSession, path: str, recursive: bool = False, files_per_trigger: int = 1000) -> DataFrame:
    """Stream rows of each file that appears under path, once; a lost run goes on from the sink's checkpoint."""
    source = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", recursive).option("maxFilesPerTrigger", files_per_trigger)
    return media.stream_rows(source.load(path).select(F.col("path").alias("file"), "content"))
