"""Event-log features per entity and time window, batch or Structured Streaming (the optional extension of
SURVEY 2.14: sign-in and homework rates as windowed aggregates over `events`).

The same `window_features` expression runs on a static DataFrame and on a stream; the streaming form adds a
watermark so window state is dropped once late data can no longer arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
PRESENT = ("view", "click")
UNGRADED = ("error",)


def window_features(events: DataFrame, width: str = "1 day") -> DataFrame:
    w = F.window("ts", width)
    g = events.groupBy(F.col("user_id").cast("string").alias("entity_id"), w.alias("w")).agg(
        F.count(F.lit(1)).alias("events"),
        F.avg(F.col("event_type").isin(*PRESENT).cast("double")).alias("present_rate"),
        F.avg(F.col("event_type").isin(*UNGRADED).cast("double")).alias("ungraded_rate"),
        F.sum("value").alias("value_sum"))
    return g.select("entity_id", F.col("w.start").alias("window_start"), "events", "present_rate", "ungraded_rate", "value_sum")


def stream_window_features(spark: SparkSession, path: str, sink: str, checkpoint: str, width: str = "1 day",
                           watermark: str = "1 day", query_name: str = "event_windows", glob: str | None = None):
    """Start a streaming query over Parquet event files in directory `path` (optionally filtered by `glob`; append mode: a window is emitted once the
    watermark passes its end). Returns the StreamingQuery; windows are appended as Parquet files to the folder `sink`."""
    r = spark.readStream.schema(EVENT_SCHEMA)
    if glob:
        r = r.option("pathGlobFilter", glob)
    src = r.parquet(path)
    agg = window_features(src.withWatermark("ts", watermark), width)
    w = agg.writeStream.outputMode("append").format("parquet").queryName(query_name)
    return w.option("path", sink).option("checkpointLocation", checkpoint).start()
