"""Structured Streaming over events: an addition, mirroring the batch session windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """Event files as they arrive, with ``ts`` as a timestamp."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user that end after ``gap``; events later than ``late`` behind the newest are dropped."""
    w = F.session_window("ts", gap)
    out = events.withWatermark("ts", late).groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))
    return out.select("user_id", F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "events", "value")


def batch_sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """The same sessions over a whole table of events."""
    out = events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))
    return out.select("user_id", F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "events", "value")


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums by type and window."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))
    return out.select(F.col("w.start").alias("begin"), "event_type", "events", "value")


def run_once(stream: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Processes what is there and returns it as a table in memory; for checks."""
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
