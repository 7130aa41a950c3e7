"""Synthetic signals made on the executors."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.signal import Signal


def coupled(spark: SparkSession, duration: float, fs: float, phase_hz: float, amp_hz: float, amp_phase: float = 1.0, amp_fast: float = 1.0, strength: float = 1.0, shift: float = 0.0, sigma: float | None = None, seed: int = 0) -> Signal:
    """A slow oscillation whose phase modulates a fast one by `strength` (0 to 1), shifted by radians, with normal noise."""
    t = F.col("id") / float(fs)
    chi = 1 - strength
    slow = 2 * math.pi * phase_hz * t
    level = amp_fast * ((1 - chi) * F.sin(slow - shift) + 1 + chi) / 2
    x = level * F.sin(2 * math.pi * amp_hz * t) + amp_phase * F.sin(slow)
    if sigma:
        x = x + sigma * F.randn(seed)
    return Signal(spark.range(int(duration * fs)).select(F.lit(0).alias("ch"), F.col("id").alias("idx"), x.alias("value")), ("ch",), fs)


def tone(spark: SparkSession, duration: float, fs: float, hz: float, channels: int = 1) -> Signal:
    n = int(duration * fs)
    x = spark.range(n * channels).select(F.expr(f"cast(id div {n} as int)").alias("ch"), (F.col("id") % n).alias("idx"))
    return Signal(x.withColumn("value", F.sin(2 * math.pi * hz * F.col("idx") / float(fs))), ("ch",), fs)
