"""Sliding counts, sessions and duplicate removal that read a stream or a table alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def watermarked(df: DataFrame, delay: str = "10 minutes") -> DataFrame:
    return df.withWatermark("ts", delay) if df.isStreaming else df


def sliding_counts(df: DataFrame, key: str, width: str, step: str) -> DataFrame:
    """key, start, n for every window that has events."""
    g = watermarked(df).groupBy(F.window("ts", width, step).alias("w"), key).agg(F.count("*").alias("n"))
    return g.select(key, F.unix_seconds(F.col("w.start")).alias("start"), "n")


def session_counts(df: DataFrame, key: str, gap: str) -> DataFrame:
    """key, start, n: sessions end after a pause of gap."""
    g = watermarked(df).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return g.select(key, F.unix_seconds(F.col("w.start")).alias("start"), "n")


def first_seen(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each combination of keys; within the watermark on a stream."""
    return watermarked(df).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def over_limit(df: DataFrame, key: str, width: str, most: int) -> DataFrame:
    """Windows in which a key had more than most events: a rate limit."""
    return sliding_counts(df, key, width, width).where(F.col("n") > most)


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Write all that a stream has now as Parquet, and stop."""
    df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
