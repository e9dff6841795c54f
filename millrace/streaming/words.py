"""The map and aggregate operators over streams: they are the same expressions, with state where a batch job has an exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import mapping
from millrace.sources.readers import _chomped


def line_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of files as they arrive in a folder."""
    return spark.readStream.option("lineSep", "\n").text(folder).select(F.lit("").alias("key"), _chomped(F.col("value")).alias("value"))


def word_counts(records: DataFrame) -> DataFrame:
    """Running counts: for the complete or update mode."""
    return mapping.tokens(records).groupBy("key").agg(F.sum("value").alias("value"))


def windowed_counts(events: DataFrame, time: str, key: Column, window: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts of keys in event-time windows; records later than `late` are dropped, and state goes with them."""
    span = F.window(time, window, slide) if slide else F.window(time, window)
    counted = events.withWatermark(time, late).groupBy(span.alias("span"), key.alias("key")).agg(F.count(F.lit(1)).alias("value"))
    return counted.select(F.col("span.start").alias("start"), F.col("span.end").alias("end"), "key", "value")
