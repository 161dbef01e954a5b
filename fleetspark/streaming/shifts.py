"""Streaming forms: windows of shifts, days that slide, sessions by gaps. Walks in time order and joins are in ``ordered``.

Each takes a batch or a stream; a stream needs ``watermark`` so that closed windows can be given out and forgotten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(df: DataFrame, watermark: str | None) -> DataFrame:
    """``ts`` as an instant, with a watermark on streams."""
    df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    return df.withWatermark("ts", watermark) if watermark else df


def shift_windows(df: DataFrame, watermark: str | None = None) -> DataFrame:
    """Counts and distance of each vehicle in windows of 8 hours from 06:00."""
    g = timed(df, watermark).groupBy("vehicle", F.window("ts", "8 hours", "8 hours", "6 hours").alias("w"))
    return g.agg(F.count("*").alias("n"), F.sum("dist").alias("km")).select("vehicle", F.col("w.start").alias("start"), "n", "km")


def sliding_day(df: DataFrame, watermark: str | None = None) -> DataFrame:
    """Counts and distance of the 24 hours up to the end of each shift."""
    g = timed(df, watermark).groupBy("vehicle", F.window("ts", "24 hours", "8 hours", "6 hours").alias("w"))
    return g.agg(F.count("*").alias("n"), F.sum("dist").alias("km")).select("vehicle", F.col("w.end").alias("end"), "n", "km")


def gap_sessions(df: DataFrame, gap: str = "300 seconds", watermark: str | None = None) -> DataFrame:
    """Sessions of a vehicle that end where nothing comes for ``gap``."""
    g = timed(df, watermark).groupBy("vehicle", F.session_window("ts", gap).alias("w"))
    return g.agg(F.count("*").alias("n"), F.sum("dist").alias("km")).select("vehicle", F.col("w.start").alias("start"), "n", "km")
