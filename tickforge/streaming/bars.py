"""Bars from event streams, with watermarks: tumbling, sliding and session windows. Batch frames work the same way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_bars(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes", key: str = "symbol", ts: str = "ts", price: str = "px") -> DataFrame:
    """(key, start, open, high, low, close, volume) per tumbling or sliding window; events later than the watermark are left out of a stream."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    bars = e.groupBy(key, F.window(ts, width, slide or width).alias("_w")).agg(
        F.min_by(price, ts).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, ts).alias("close"), F.count(F.lit(1)).cast("double").alias("volume")
    )
    return bars.select(key, F.col("_w.start").alias("start"), "open", "high", "low", "close", "volume")


def session_bars(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", key: str = "symbol", ts: str = "ts", price: str = "px") -> DataFrame:
    """(key, start, end, open, close, volume) per session: events less than ``gap`` apart."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    bars = e.groupBy(key, F.session_window(ts, gap).alias("_w")).agg(F.min_by(price, ts).alias("open"), F.max_by(price, ts).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
    return bars.select(key, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "open", "close", "volume")
