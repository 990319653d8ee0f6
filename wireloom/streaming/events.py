"""Beyond the netlist: event streams with watermarks, windows and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream(spark: SparkSession, path: str, schema: str = "event_id long, ts timestamp, user_id long, event_type string, value double, props string") -> DataFrame:
    """Event files as they arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event type and tumbling window; batch or stream."""
    kept = events.withWatermark("ts", late) if events.isStreaming else events
    agg = kept.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return agg.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by user and session."""
    kept = events.withWatermark("ts", late) if events.isStreaming else events
    agg = kept.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return agg.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def run_once(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there, write it as Parquet, and stop."""
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query
