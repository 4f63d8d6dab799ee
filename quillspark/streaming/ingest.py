"""Structured Streaming: new documents from a folder, each once; event counts by window with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import file_id


def document_stream(spark: SparkSession, folder: str, late: str = "1 hour", per_trigger: int = 1000) -> DataFrame:
    """A stream (file_id, path, size, modified, text) of a folder's text files; a file of a known path and size comes once."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("maxFilesPerTrigger", per_trigger).load(folder)
    rows = files.select(file_id(F.col("path"), F.col("length")).alias("file_id"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("text"))
    return rows.withWatermark("modified", late).dropDuplicatesWithinWatermark(["file_id"])


def window_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) of a stream or table of events (ts, event_type, value)."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def run_once(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Writes what a stream has so far as Parquet, exactly once over restarts, and ends."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
