"""Fitted chains on streams: their transforms are projections, so they run unchanged on a streaming frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.dataset import Chain, Dataset


def transform_stream(stream: DataFrame, chain: Chain, features: list[str], kinds: dict[str, str], keep: tuple[str, ...] = ()) -> DataFrame:
    return chain.transform(Dataset.of(stream, features, None, keep=keep, kinds=kinds)).df


def profile_stream(stream: DataFrame, time: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count, mean and missing share of a column in windows of event time.

    In append and update mode rows later than ``late`` are left out, and append mode holds a window back until the watermark
    has passed its end; complete mode gives every window of every row that has a time.
    """
    w = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width).alias("w"))
    return w.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.avg(F.col(value).isNull().cast("double")).alias("missing")).select("w.start", "w.end", "n", "mean", "missing")


def once_per_key(stream: DataFrame, key: str, time: str, late: str = "10 days") -> DataFrame:
    """The first delivery of each key within the watermark."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])
