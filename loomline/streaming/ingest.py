"""Incremental ingest: new files are worked on once, and a checkpoint remembers which."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.text import base_name


def new_files(spark: SparkSession, directory: str, suffix: str = ".pdf") -> DataFrame:
    """A stream of (name, content, modificationTime) of files as they arrive."""
    s = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return s.option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").load(directory).select(base_name(F.col("path")).alias("name"), "content", "modificationTime")


def ingest(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Runs ``work`` over what has arrived and appends to ``out``; ends when nothing is left."""
    q = work(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return q.trigger(availableNow=True).start()
