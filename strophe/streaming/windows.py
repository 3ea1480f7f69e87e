"""Windows over timed lines, in batch and as streams (extensions of the catalogue's clock).

The stream functions take and give streaming DataFrames, with a watermark that
bounds their state; late rows beyond it are dropped, as the watermark says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tumbling_counts(events: DataFrame, size: str = "1 hour", key: str = "event_type") -> DataFrame:
    """``window_start, key, n, users``."""
    return events.groupBy(F.window("ts", size).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users")).select(F.col("w.start").alias("window_start"), key, "n", "users")


def sliding_counts(events: DataFrame, size: str = "1 hour", step: str = "15 minutes", key: str = "event_type") -> DataFrame:
    return events.groupBy(F.window("ts", size, step).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


def sessions(events: DataFrame, gap: str = "30 minutes", key: str = "user_id") -> DataFrame:
    """``key, session_start, session_end, n``: runs of events less than ``gap`` apart."""
    return events.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def read_event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream; the time column becomes a zoned timestamp, as watermarks need."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_tumbling(events: DataFrame, late: str = "1 hour", size: str = "1 hour", key: str = "event_type") -> DataFrame:
    """``tumbling_counts`` of a stream, final once the watermark has passed a window (users approximately)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("user_id").alias("users")).select(F.col("w.start").alias("window_start"), key, "n", "users")


def stream_sessions(events: DataFrame, late: str = "1 hour", gap: str = "30 minutes", key: str = "user_id") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def append_to(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs what is available into a Parquet table, exactly once across restarts."""
    return df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
