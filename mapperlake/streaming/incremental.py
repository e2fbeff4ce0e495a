"""Incremental analysis: new and changed mapper files as a stream (an extension; batch analysis needs none of it)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapperlake.operators import catalog
from mapperlake.sources import projects

_BINARY = "path string, modificationTime timestamp, length long, content binary"


def parsed_stream(spark: SparkSession, root: str, max_files: int = 1000) -> DataFrame:
    """Parsed mappers of files as they arrive, at most max_files a batch."""
    found = spark.readStream.format("binaryFile").schema(_BINARY).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[xX][mM][lL]").option("maxFilesPerTrigger", max_files).load(root)
    rows = found.select(F.col("path").alias("source_file"), F.col("length").alias("size"), F.when(F.col("length") <= projects.MAX_BYTES, F.col("content")).alias("content"), F.lit(False).alias("external"))
    return catalog.parse(projects.decoded(rows))


def run_once(spark: SparkSession, root: str, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> None:
    """Take all files that the checkpoint hasn't seen to `sink` (an idempotent function of batch and number), then stop."""
    query = parsed_stream(spark, root).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
