"""Element-wise algebra and statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .signal import Signal


def _combine(sig: Signal, other, op) -> Signal:
    if isinstance(other, Signal):
        keys = [*sig.keys, "idx"]
        x = sig.df.join(other.df.withColumnRenamed("value", "_other"), keys, "full")
        same = F.col("value").isNotNull() & F.col("_other").isNotNull()
        x = x.withColumn("value", F.when(same, op(F.col("value"), F.col("_other"))).otherwise(F.raise_error(F.lit("signals of different shapes")).cast("double")))
        return sig.with_df(x.drop("_other"))
    if isinstance(other, (list, tuple, np.ndarray)):
        return _broadcast(sig, np.asarray(other, float), op)
    return sig.with_df(sig.df.withColumn("value", op(F.col("value"), F.lit(other))))


def _broadcast(sig: Signal, array: np.ndarray, op) -> Signal:
    """With an array whose axes are the last of (keys..., idx); an axis of length 1 holds for all places. Keys are numbers
    from 0. The array is on the driver, so small; places that it doesn't have are an error."""
    axes = [*sig.keys, "idx"]
    if array.ndim > len(axes):
        raise ValueError(f"an array of {array.ndim} axes for {len(axes)}")
    if array.ndim == 0:
        return sig.with_df(sig.df.withColumn("value", op(F.col("value"), F.lit(float(array)))))
    own = [(a, n) for a, n in zip(axes[len(axes) - array.ndim :], array.shape, strict=True) if n != 1]
    if not own:
        return sig.with_df(sig.df.withColumn("value", op(F.col("value"), F.lit(float(array.ravel()[0])))))
    top = sig.df.agg(*(F.max(a) for a, _ in own)).first()
    if any(m is not None and m + 1 != n for m, (_, n) in zip(top, own, strict=True)):
        raise ValueError("signals of different shapes")
    flat = array.reshape([n for _, n in own])
    at = np.unravel_index(np.arange(flat.size), flat.shape)
    names = [f"_at{i}" for i in range(len(own))]
    table = sig.df.sparkSession.createDataFrame(pa.table({n: a.astype(np.int64) for n, a in zip(names, at, strict=True)} | {"_other": flat.ravel()}))
    hit = F.lit(True)
    for n, (a, _) in zip(names, own, strict=True):
        hit = hit & (F.col(a) == F.col(n))
    x = sig.df.join(F.broadcast(table) if flat.size < 100_000 else table, hit)
    return sig.with_df(x.withColumn("value", op(F.col("value"), F.col("_other"))).drop("_other", *names))


def add(sig: Signal, other) -> Signal:
    """With a number, a signal of the same shape, or an array that is broadcast over keys and samples."""
    return _combine(sig, other, lambda a, b: a + b)


def multiply(sig: Signal, other) -> Signal:
    """With a real or complex number (the result then has re and im), a signal of the same shape, or an array that is
    broadcast over keys and samples."""
    if isinstance(other, complex):
        return sig.with_df(sig.df.select(*sig.keys, "idx", (F.col("value") * other.real).alias("re"), (F.col("value") * other.imag).alias("im")))
    return _combine(sig, other, lambda a, b: a * b)


def multiply_complex(sig: Signal, z: complex) -> Signal:
    """A complex signal (re, im) times a number."""
    re, im = F.col("re"), F.col("im")
    return sig.with_df(sig.df.select(*sig.keys, "idx", (re * z.real - im * z.imag).alias("re"), (re * z.imag + im * z.real).alias("im")))


def multiply_along(sig: Signal, weights, axis: str = "idx") -> Signal:
    """With a sequence of numbers, one for each place along idx or an integer key. It is on the driver, so small."""
    weights = [float(w) for w in weights]
    n = sig.df.agg(F.max(axis)).first()[0]
    if n is not None and n + 1 != len(weights):
        raise ValueError(f"{len(weights)} weights for {n + 1} places")
    table = sig.df.sparkSession.createDataFrame([(i, w) for i, w in enumerate(weights)], "_at long, _w double")
    x = sig.df.join(F.broadcast(table) if len(weights) < 100_000 else table, F.col(axis) == F.col("_at"))
    return sig.with_df(x.withColumn("value", F.col("value") * F.col("_w")).drop("_at", "_w"))


def _known(ignore_nan: bool) -> Column:
    return F.when(~F.isnan("value"), F.col("value")) if ignore_nan else F.col("value")


def mean(sig: Signal, over: str | None = None, ignore_nan: bool = True) -> DataFrame:
    """Along the samples, or along a key (then by idx and the other keys)."""
    by = list(sig.keys) if over is None else [*(k for k in sig.keys if k != over), "idx"]
    return sig.df.groupBy(*by).agg(F.avg(_known(ignore_nan)).alias("mean"))


def std(sig: Signal, over: str | None = None, ignore_nan: bool = True) -> DataFrame:
    """Population standard deviation."""
    by = list(sig.keys) if over is None else [*(k for k in sig.keys if k != over), "idx"]
    return sig.df.groupBy(*by).agg(F.stddev_pop(_known(ignore_nan)).alias("std"))


def standardize(sig: Signal, ignore_nan: bool = True, over: str | None = None) -> Signal:
    """(value - mean) / std by key, or over a key (then by idx and the other keys). Where std is 0, NaN at the mean and an
    infinity elsewhere. Statistics are aggregated first, so the join is by a row for each of them."""
    by = list(sig.keys) if over is None else [*(k for k in sig.keys if k != over), "idx"]
    s = sig.df.groupBy(*by).agg(F.avg(_known(ignore_nan)).alias("_m"), F.stddev_pop(_known(ignore_nan)).alias("_s"))
    d = F.col("value") - F.col("_m")
    flat = F.when(F.isnan(d) | (d == 0), F.lit(float("nan"))).when(d > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return sig.with_df(sig.df.join(s, by).withColumn("value", F.when(F.col("_s") == 0, flat).otherwise(d / F.nullif(F.col("_s"), F.lit(0.0)))).select(*sig.keys, "idx", "value"))


def count_true(mask: DataFrame) -> DataFrame:
    return mask.agg(F.count_if("keep").alias("n_true"))


def nearest(df: DataFrame, column: str, x0: float) -> DataFrame:
    """The first idx whose value is nearest to x0."""
    return df.agg(F.min_by("idx", F.struct(F.abs(F.col(column) - x0), F.col("idx"))).alias("idx"))


def extrema(sig: Signal) -> DataFrame:
    return sig.df.groupBy(*sig.keys).agg(F.min("value").alias("low"), F.max("value").alias("high"))


def decibels(value: Column) -> Column:
    return 10 * F.log10(value + 1)
