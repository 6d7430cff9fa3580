"""Archives that arrive in a folder, listed as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.scan import list_entries

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def stream_entries(spark: SparkSession, path: str, files_per_trigger: int = 1000, **options) -> DataFrame:
    """A streaming DataFrame of the entries of new files under path. The listing is one row to
    many without state, so any trigger and sink go with it; a batch that is run again gives the
    same rows."""
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).load(path)
    return list_entries(files.select("path", "content"), **options)
