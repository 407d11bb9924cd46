"""Windowed rollups of a stream, with a watermark for late rows."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, keys, window: str = "1 day", late: str = "1 hour", value: str | None = None) -> DataFrame:
    """Counts (and means) by key and tumbling window; the same plan serves batches and streams."""
    if events.isStreaming:
        events = events.withWatermark(time, late)
    measures = [F.count("*").alias("n"), *([F.avg(value).alias("mean")] if value else [])]
    return events.groupBy(F.window(time, window).alias("w"), *keys).agg(*measures).select(F.col("w.start").alias("window_start"), *keys, "n", *(["mean"] if value else []))


def stream_to(df: DataFrame, path: str, checkpoint: str):
    """Appends finished windows to Parquet, once each; stops when the source has no more."""
    return df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
