"""Streaming: new files analysed as they arrive, change counts by window with late data bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import code


def watch(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of ``path, text`` of the text files that appear in a folder."""
    return spark.readStream.format("text").option("wholetext", "true").load(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def code_spaces(stream: DataFrame) -> DataFrame:
    """Code spaces of a stream of files; stateless."""
    return code.spaces(stream)


def change_rate(changes: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Changes by status in tumbling windows of ``ts``; rows later than ``late`` are dropped."""
    return changes.withWatermark("ts", late).groupBy(F.window("ts", window), "status").agg(F.count("*").alias("changes")).select("window.start", "status", "changes")
