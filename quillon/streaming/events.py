"""Streaming scans and event-time aggregation; filters and projections are the batch operators themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parquet_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """A stream of the Parquet files that appear under a path; the schema comes from those already there."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stamped(df: DataFrame, ts: str, late: str) -> DataFrame:
    """Timestamps without time zone are read as UTC; streams get a watermark."""
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
        there = F.col(ts) if zone in ("UTC", "Etc/UTC") else F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(ts))
        df = df.withColumn(ts, there.cast("timestamp"))
    return df.withWatermark(ts, late) if df.isStreaming else df


def windowed_counts(df: DataFrame, ts: str, keys: list[str], width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """COUNT(*) by event-time window and keys; windows slide by ``slide`` if given. State older than the watermark goes.

    Works on batch input too.
    """
    return (
        stamped(df, ts, late)
        .groupBy(F.window(ts, width, slide).alias("w"), *keys)
        .agg(F.count(F.lit(1)).alias("count"))
        .select(F.col("w.start").alias("window_start"), *keys, "count")
    )


def session_counts(df: DataFrame, ts: str, keys: list[str], gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """COUNT(*) by session and keys: events less than ``gap`` apart share one, which ends that long after its last event."""
    return (
        stamped(df, ts, late)
        .groupBy(F.session_window(ts, gap).alias("w"), *keys)
        .agg(F.count(F.lit(1)).alias("count"))
        .select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "count")
    )


def run_to_memory(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there now and returns the result table; for tests and small results."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return df.sparkSession.table(name)
