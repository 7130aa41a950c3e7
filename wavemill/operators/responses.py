"""Frames for plots of filters: responses by frequency with the unwrapped phase, impulse responses, pass and stop bands."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fir_design import Fir, scaled
from ..functions.iir_design import Iir
from .signal import BLOCK, Signal


def unwrap(phases: np.ndarray, period: float = 2 * math.pi) -> np.ndarray:
    """Phases without jumps of more than half a period between neighbours, along the last axis."""
    turns = np.round(np.diff(phases, axis=-1) / period)
    out = np.array(phases, float)
    out[..., 1:] -= period * np.cumsum(turns, axis=-1)
    return out


def unwrapped(sig: Signal, period: float = 2 * math.pi, block: int = BLOCK) -> Signal:
    """The same along the samples of each key. Jumps are counted by block first, so no task sorts more than a block; the
    last sample of each block is sent to the next one."""
    keys = list(sig.keys)
    x = sig.df.withColumn("_b", F.expr(f"idx div {block}"))
    lent = sig.df.where(F.col("idx") % block == block - 1).withColumn("_b", F.expr(f"idx div {block} + 1"))
    both = x.unionByName(lent)
    w = Window.partitionBy(*keys, "_b").orderBy("idx")
    jump = F.coalesce(F.rint((F.col("value") - F.lag("value").over(w)) / period), F.lit(0.0))
    turned = both.withColumn("_t", jump).where(F.expr(f"idx div {block} = _b"))
    turned = turned.withColumn("_sum", F.sum("_t").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    total = turned.groupBy(*keys, "_b").agg(F.sum("_t").alias("_all"))
    before = total.withColumn("_before", F.coalesce(F.sum("_all").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).drop("_all")
    out = turned.join(before, [*keys, "_b"]).withColumn("value", F.col("value") - period * (F.col("_sum") + F.col("_before")))
    return sig.with_df(out.select(*keys, "idx", "value"))


def response(spark: SparkSession, f: Fir | Iir, n: int = 2000, rope: float = -100.0) -> DataFrame:
    """freq, gain, db (not below rope), phase (radians, unwrapped) at n points below Nyquist."""
    freq, h = f.response(n)
    phase = unwrap(np.angle(h))
    return spark.createDataFrame(pa.table({"freq": freq, "gain": np.abs(h), "db": scaled(h, "dB", rope), "phase": phase}))


def impulse(spark: SparkSession, f: Fir | Iir) -> DataFrame:
    """idx, seconds, value: the response to a unit impulse."""
    y = f.impulse()
    return spark.createDataFrame(pa.table({"idx": np.arange(len(y)), "seconds": np.arange(len(y)) / f.fs, "value": y}))


def bands(spark: SparkSession, f: Fir | Iir) -> DataFrame:
    """kind (pass, transition, stop), low, high, db: the gain a filter's design asks for by band; none for designs without one."""
    p, s = np.atleast_1d(f.fpass).astype(float).tolist(), np.atleast_1d(f.fstop).astype(float).tolist()
    rows = []
    if p and len(p) == len(s):
        edges = sorted([*((x, "p", i) for i, x in enumerate(p)), *((x, "s", i) for i, x in enumerate(s))])
        marks = [(0.0, edges[0][1]), *((x, k) for x, k, _ in edges), (f.fs / 2, edges[-1][1])]
        for (lo, a), (hi, b) in zip(marks, marks[1:], strict=False):
            if hi > lo:
                rows.append(("transition" if a != b else "pass" if a == "p" else "stop", lo, hi, None if a != b else -float(f.gpass if a == "p" else f.gstop)))
    return spark.createDataFrame(rows, "kind string, low double, high double, db double")
