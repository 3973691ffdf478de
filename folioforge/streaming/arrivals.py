"""Files as they arrive: the readers of sources.files over a stream of whole files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """files(file_id, content) of each new file below a folder; feed it to sources.files.nodes or scanned."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    got = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(path)
    return got.select(F.col("path").alias("file_id"), "content")
