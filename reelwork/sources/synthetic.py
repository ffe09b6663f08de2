"""Deterministic pictures and tones over given frame and sample indexes."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def synthetic_video(frames: DataFrame, width: int = 640, height: int = 480) -> DataFrame:
    """(frame_idx, row, col, y, u, v, pts) of each frame_idx: a luma gradient that moves one step a
    frame; chroma is neutral."""
    rows = frames.select("frame_idx", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("row"))
    grid = rows.withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    y = F.pmod(F.col("col") + F.col("row") + F.col("frame_idx"), F.lit(256)).cast("int")
    return grid.select("frame_idx", "row", "col", y.alias("y"), F.lit(128).alias("u"), F.lit(128).alias("v"), F.col("frame_idx").alias("pts"))


def synthetic_tone(samples: DataFrame, rate: int = 48000, channels: int = 2, hz: float = 440.0) -> DataFrame:
    """(n, channel, v, pts) of each sample index n: one sine whose phase depends on n alone, so
    partitions need no state; every channel has the same value."""
    v = F.sin(F.lit(2 * pi * hz / rate) * F.col("n"))
    return samples.select("n", F.explode(F.sequence(F.lit(0), F.lit(channels - 1))).alias("channel"), v.alias("v"), F.col("n").alias("pts"))
