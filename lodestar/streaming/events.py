"""Streams of the event log: windowed counts with a watermark, and idempotent intake; keyed state is in ``keyed``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder, ``ts`` as a timestamp."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "60 seconds", slide: str | None = None) -> DataFrame:
    """Counts of each user in sliding or tumbling windows; what comes later than ``late`` is left out."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", size, slide), "user_id")
    return grouped.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("window.start").alias("start"), "n")


def accepted_once(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each key's first event within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
