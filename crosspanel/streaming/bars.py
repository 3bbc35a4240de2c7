"""Bars from a stream of events: tumbling windows with a watermark, the same aggregation as the batch bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of events as they arrive; ``ts`` becomes a timestamp, which a watermark needs."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def streaming_bars(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """``(stock, dt, open, high, low, close, volume, amount)``; events later than the watermark are left out."""
    kept = events.withWatermark("ts", late).select("user_id", "value", "ts", F.struct("ts", "event_id").alias("at"))
    per = kept.groupBy(F.window("ts", width).alias("w"), F.col("user_id").alias("stock")).agg(
        F.min_by("value", "at").alias("open_price"), F.max("value").alias("high_price"), F.min("value").alias("low_price"), F.max_by("value", "at").alias("close_price"), F.count(F.lit(1)).cast("double").alias("volume"), F.round(F.sum("value"), 2).alias("amount")
    )
    return per.select("stock", F.to_date("w.start").alias("dt"), "open_price", "high_price", "low_price", "close_price", "volume", "amount")


def write_bars(bars: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Append closed windows to a Parquet table, exactly once."""
    writer = bars.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
