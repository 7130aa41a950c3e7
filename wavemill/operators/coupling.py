"""Phase-to-power coupling: where a slow oscillation is in a phase, how strong is a fast one around it?"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fir_design import kaiser
from .algebra import standardize
from .filters import amplitude, analytic, fir, phase
from .signal import Signal


def phase_events(sig: Signal, fpass, fstop, at: float = 0.0, epsilon: float = 0.05, width: float = 2.0, design=kaiser) -> DataFrame:
    """keys, idx: where the band-passed signal's phase is within epsilon (radians) of `at`, of 0 <= phase < 2 pi."""
    p = phase(analytic(fir(sig, design(fpass, fstop, sig.fs)), width))
    return p.df.where((F.col("value") > at - epsilon) & (F.col("value") < at + epsilon)).select(*sig.keys, "idx")


def shuffled(events: DataFrame, n: int, sizes: int | DataFrame, seed: int = 0) -> DataFrame:
    """n surrogates: events moved round by a random part of their channel's length (surrogate, keys, idx). sizes: one length,
    or (keys, n)."""
    parts = [float(x) for x in np.random.default_rng(seed).random(n)]
    moved = F.posexplode(F.array(*map(F.lit, parts))).alias("surrogate", "_s")
    if isinstance(sizes, int):
        x = events.withColumn("_n", F.lit(sizes).cast("long"))
    else:
        x = events.join(sizes.withColumnRenamed("n", "_n"), [c for c in sizes.columns if c != "n"])
    shift = F.floor(F.col("_s") * F.col("_n"))
    return x.select("*", moved).withColumn("idx", (F.col("idx") + shift) % F.col("_n")).drop("_s", "_n")


def locked_power(amp: Signal, events: DataFrame, points: int, by=()) -> DataFrame:
    """Mean squared amplitude at each offset of windows [i - points/2, i + points/2) around events that lie within the signal.

    events: keys, idx and columns `by`. Result: keys, by, offset, power."""
    half = points // 2
    keys = list(amp.keys)
    e = events.join(amp.lengths("_n"), keys).where((F.col("idx") >= half) & (F.col("idx") + (points - half) <= F.col("_n")))
    wide = e.select(*keys, *by, "idx", F.explode(F.sequence(F.lit(-half), F.lit(points - half - 1))).alias("offset")).withColumn("idx", F.col("idx") + F.col("offset"))
    wide = wide.groupBy(*keys, *by, "offset", "idx").agg(F.count("*").alias("_m"))
    x = wide.join(amp.df, [*keys, "idx"])
    return x.groupBy(*keys, *by, "offset").agg((F.sum(F.col("value") * F.col("value") * F.col("_m")) / F.sum("_m")).alias("power"))


def normal_tail(z):
    """1 - Phi(z) as a column, with 12 digits for large z too: a series about 0 for |z| < 3, else the continued fraction of
    Laplace, z + 1/(z + 2/(z + 3/(z + ...)))."""
    x = F.abs(z)
    term, total = x, x
    for k in range(1, 40):
        term = term * x * x / (2 * k + 1)
        total = total + term
    density = F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    near = 0.5 - density * total
    tail = x
    for k in range(60, 0, -1):
        tail = x + k / tail
    upper = F.when(x < 3, near).otherwise(density / tail)
    return F.when(z >= 0, upper).otherwise(1 - upper)


def fdr(df: DataFrame, by, p: str = "pvalue") -> DataFrame:
    """Adds Benjamini-Hochberg adjusted p values within each group."""
    w = Window.partitionBy(*by)
    x = df.withColumn("_m", F.count("*").over(w))
    rank_up = F.count("*").over(w.orderBy(p).rangeBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("_q", F.col(p) * F.col("_m") / rank_up)
    adjusted = F.min("_q").over(w.orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, 0))
    return x.withColumn("adjusted", F.least(F.lit(1.0), adjusted)).drop("_m", "_q")


def phase_locking(sig: Signal, events: DataFrame, centers, bandwidth: float = 4.0, window_s: float = 2.0, surrogates: int = 300, width: float = 2.0, seed: int = 0) -> DataFrame:
    """center, keys, offset, power, pvalue, adjusted: for each center frequency, the standardised band's power around events,
    against surrogates (z = (p - mean) / (std / sqrt n), one-sided). A band narrower than twice the frequency of the events'
    phase passes no modulation by it."""
    points = int(window_s * sig.fs)
    out = None
    null_events = shuffled(events, surrogates, sig.lengths(), seed)
    for c in centers:  # a plan for each center, all run together
        f = kaiser((c - bandwidth / 2, c + bandwidth / 2), (c - bandwidth, c + bandwidth), sig.fs)
        amp = amplitude(analytic(standardize(fir(sig, f)), width))
        real = locked_power(amp, events, points)
        null = locked_power(amp, null_events, points, ("surrogate",)).groupBy(*sig.keys, "offset").agg(F.avg("power").alias("_mean"), F.stddev_pop("power").alias("_std"))
        z = (F.col("power") - F.col("_mean")) / F.nullif(F.col("_std") / math.sqrt(surrogates), F.lit(0.0))
        one = real.join(null, [*sig.keys, "offset"]).withColumn("pvalue", normal_tail(z)).withColumn("center", F.lit(float(c))).drop("_mean", "_std")
        out = one if out is None else out.unionByName(one)
    return fdr(out, ["center", *sig.keys])


@dataclass(frozen=True)
class PhaseLock:
    """Phase-to-power coupling with its settings kept: events() of a slow band, then estimate() of fast bands around them."""

    fpass: tuple[float, float]
    fstop: tuple[float, float]
    at: float = 0.0
    epsilon: float = 0.05
    width: float = 2.0
    bandwidth: float = 4.0
    window_s: float = 2.0
    surrogates: int = 300
    seed: int = 0

    def events(self, sig: Signal) -> DataFrame:
        return phase_events(sig, self.fpass, self.fstop, self.at, self.epsilon, self.width)

    def estimate(self, sig: Signal, centers, events: DataFrame | None = None) -> DataFrame:
        events = self.events(sig) if events is None else events
        return phase_locking(sig, events, centers, self.bandwidth, self.window_s, self.surrogates, self.width, self.seed)

    def frame(self, estimates: DataFrame, fs: float, alpha: float = 0.05) -> DataFrame:
        """What a plot needs: center, keys, seconds from the event, power, and whether it is significant at alpha."""
        return estimates.withColumn("seconds", F.col("offset") / float(fs)).withColumn("significant", F.col("adjusted") < alpha)
