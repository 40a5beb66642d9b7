"""Structured Streaming ingest: readings arrive as files, are windowed with a watermark, and are appended as chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of parquet files of readings; a timestamp without zone is read as UTC."""
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    df = r.parquet(folder)
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def _late(events: DataFrame, late: str | None) -> DataFrame:
    """With a watermark; None keeps the one that the stream has already."""
    return events if late is None else events.withWatermark("ts", late)


def windowed(events: DataFrame, late: str | None = "10 minutes", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """``window_start, event_type, n, total`` per window; rows later than the watermark are dropped by the engine."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = _late(events, late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "10 minutes") -> DataFrame:
    """``user_id, session_start, session_end, n``: stretches of activity with no pause of ``gap`` or more."""
    s = _late(events, late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def once(events: DataFrame, late: str = "1 hour", keys: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """Each reading once, whatever is sent again within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def append(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Append a stream to a parquet table until its present input is used up."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
