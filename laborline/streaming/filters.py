"""Stateless cleaning and filtering of a stream, de-duplication within a watermark, and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, relevance


def postings(stream: DataFrame, today: str) -> DataFrame:
    """Cleaned and relevant postings of a stream of raw ones."""
    return relevance.kept(relevance.audited(clean.clean_postings(stream, today)))


def first_seen(stream: DataFrame, key: str, time: str, delay: str = "1 day") -> DataFrame:
    """Each key once within the watermark: the first that arrives, not the best as in the batch form."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, time: str, group: str, value: str, width: str = "1 hour", delay: str | None = None) -> DataFrame:
    """Count and sum per tumbling window and group; the same plan over a table or a stream."""
    source = events.withWatermark(time, delay) if delay else events
    return source.groupBy(F.window(time, width).alias("w"), group).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), group, "n", "total")


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def write_stream(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start(path)
